"""Text preparation as native columns: Turkish-aware folding, cleaning, sentences, tokens."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without their marks, abbreviations that don't end a sentence, words that aren't searched.
MARKED, PLAIN = "şçğüöıâîû", "scguoiaiu"
ABBREVIATIONS = ["vb", "vs", "örn", "bkz", "no", "tl", "a.ş", "sn", "dr", "prof"]
STOPWORDS = (
    "bir bu şu o ve ile için mi mı mu mü var yok ne nedir nelerdir hangi hangisi kaç daha en de da den dan te ta ten tan olan olarak "
    "göre gibi ama veya her tüm ben sen siz bana beni bize nasıl niye neden misin misiniz mısın mısınız kadar sonra önce çok az ki ise "
    "ancak yani hem ya"
).split()
#: Numeric references to what isn't a character: Windows-1252 bytes 0x80 to 0x9F, and U+FFFD for zero, surrogates and beyond the last one.
_WINDOWS = {k: bytes([k]).decode("cp1252", "replace") for k in range(0x80, 0xA0)} | {k: chr(k) for k in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Names of references, from the standard library's table; those without a semicolon may be followed by other letters.
_NAMES = {k.rstrip(";"): v for k, v in html5.items() if k.endswith(";")}
_OPEN_NAMES = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_REFERENCE = "&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|" + "|".join(f"{k}" for k in _OPEN_NAMES) + ")"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it: Spark would repeat the expression in each place.

    A fold over nothing hands its first value to f; an array of one item would be made, and its type derived, for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, f)


def exchanged(c: Column, letters: str, others: str) -> Column:
    """translate() by literal replacements, which look for bytes; it looks up each letter of the text. No letter may be among the others."""
    for a, b in zip(letters, others, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tr_fold(c: Column) -> Column:
    """Turkish lower case, a letter for a letter."""
    return F.lower(exchanged(c, "Iİ", "ıi"))


def tr_upper(c: Column) -> Column:
    """Turkish upper case."""
    return F.upper(F.translate(c, "iı", "İI"))


def tr_fold_ascii(c: Column) -> Column:
    """Lower case without marks."""
    return let(tr_fold(c), unmarked)


def unmarked(low: Column) -> Column:
    """tr_fold_ascii() of what tr_fold() gives."""
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(exchanged(low, MARKED, PLAIN))  # ASCII has no marks


def normalize_whitespace(c: Column) -> Column:
    """P06"""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def _code_point(n: Column) -> Column:
    """The character of a numeric reference, by its number."""
    windows = F.element_at(F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>"), n.cast("string"))
    controls = n.between(1, 8) | n.between(14, 31) | n.between(127, 127) | n.between(0xFDD0, 0xFDEF) | (n == 11) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    # four bytes of UTF-32 as text, which no function makes of a number otherwise beyond one byte
    made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF) | n.isNull(), "\ufffd").when(n.between(0x80, 0x9F), windows).when(controls, "").otherwise(made)


def _one_reference(r: Column) -> Column:
    """What a reference stands for; one of an unknown name stays, but for a known name at its beginning."""
    hexadecimal = F.conv(F.regexp_extract(r, "^&#[xX]([0-9a-fA-F]{1,15})", 1), 16, 10).try_cast("long")
    decimal = F.regexp_extract(r, "^&#([0-9]{1,18})", 1).try_cast("long")
    number = F.when(r.rlike("^&#[xX]"), hexadecimal).otherwise(decimal)
    name = F.regexp_extract(r, "^&([A-Za-z][A-Za-z0-9]*)", 1)
    known = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,string>")
    begun = F.regexp_extract(name, f"^({'|'.join(_OPEN_NAMES)})", 1)
    whole = F.when(r.endswith(";"), F.element_at(known, name))
    part = F.when(begun != "", F.concat(F.element_at(known, begun), F.substring(r, F.length(begun) + 2, F.length(r))))
    return F.when(r.startswith("&#"), _code_point(number)).otherwise(F.coalesce(whole, part, r))


def unescape(c: Column) -> Column:
    """Character references, named, decimal and hexadecimal, become their characters; as in browsers, some names need no semicolon."""

    def joined(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), _one_reference)
        between = F.split(t, _REFERENCE, -1)
        pairs = F.zip_with(between, found, lambda b, r: F.concat(b, F.coalesce(r, F.lit(""))))
        return F.array_join(pairs, "")

    return let(c, lambda t: F.when(t.rlike(_REFERENCE), joined(t)).otherwise(t))


def strip_html(c: Column) -> Column:
    """Scripts and styles go, tags become spaces, character references their characters."""
    return unescape(F.regexp_replace(F.regexp_replace(c, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", " "), "<[^>]+>", " "))


def normalize_text(c: Column) -> Column:
    """Tags, control characters and odd spaces and quotes go."""
    out = F.regexp_replace(strip_html(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return normalize_whitespace(F.translate(out, " ‘’“”​", " ''\"\""))


def split_sentences(c: Column) -> Column:
    """Array of sentences; a piece that ends in an abbreviation is joined with the next."""
    pieces = F.split(F.trim(c), "(?U)(?<=[.!?])\\s+(?=[\\p{L}\\p{N}])")
    short = "(?iu)(^|\\s)(" + "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS) + ")\\.$"

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), x)))
        return F.when((F.size(acc) > 0) & last.rlike(short), joined).otherwise(F.concat(acc, F.array(x)))

    return F.filter(F.aggregate(pieces, F.array().cast("array<string>"), add), lambda s: s != "")


def slugify_tr(c: Column) -> Column:
    """P08"""
    return F.btrim(F.regexp_replace(tr_fold_ascii(c), "[^a-z0-9]+", "-"), F.lit("-"))


def content_hash(c: Column) -> Column:
    """P11"""
    return F.sha2(c, 256)


WORD = "[a-zçğıöşü0-9]+"


def tokenize(c: Column, distinct: bool = False) -> Column:
    """Words of folded letters and digits that aren't stop words, once each if distinct."""
    stop = F.array(*map(F.lit, STOPWORDS))
    found = F.regexp_extract_all(tr_fold(c), F.lit(WORD), F.lit(0))
    return F.array_except(found, stop) if distinct else F.filter(found, lambda t: ~F.array_contains(stop, t))


def keyword_regex(words: list[str]) -> str:
    """Words of up to 4 letters stand alone, longer ones may take suffixes."""
    return "(?U)(" + "|".join(f"\\b{w}\\b" if len(w) <= 4 else f"\\b{w}" for w in words) + ")"


def no_spans() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


#: A code point that is no character and stands around matches, so that one pass over a text tells them, their groups and their places.
_MARK, _NO_MARK = "\uffff", "\ufffe"

#: Matches whose offsets are summed up at once; what is appended to an array copies it.
_BLOCK = 128
#: Matches that are placed one by one.
_FEW = 16


def place(found: Column, between: Column) -> Column:
    """array<struct<s, e, m>>: matches with offsets in code points, from the pieces before, between and after them."""
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b"), (F.length(b) + F.length(m)).alias("n")))

    def one(acc: Column, x: Column) -> Column:
        span = F.struct((acc["at"] + x["b"]).alias("s"), (acc["at"] + x["n"]).alias("e"), x["m"].alias("m"))
        return F.struct(span["e"].alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), no_spans().alias("out")), one, lambda a: a["out"])
        size = F.aggregate(xs, F.lit(0), lambda n, x: n + x["n"])
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(done)).alias("out"))

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(_BLOCK))
        parts = F.transform(starts, lambda k: F.slice(xs, k + 1, F.lit(_BLOCK)))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string>>>").alias("out"))
        return F.flatten(F.aggregate(parts, begin, block, lambda acc: acc["out"]))

    return let(pairs, blocks)


def _scan(text: Column, pattern: str, *groups: int) -> Column:
    """array<string>: for each match the piece before it, the match and its groups; at last the piece after all of them."""
    made = "".join(f"{_MARK}${k}" for k in (1, *[g + 1 for g in groups])) + _MARK
    return F.split(F.regexp_replace(F.when(text.contains(_MARK), exchanged(text, _MARK, _NO_MARK)).otherwise(text), f"({pattern})", made), _MARK, -1)  # split() compiles no pattern of one letter


def first_match(text: Column, pattern: str, *groups: int) -> Column:
    """struct<s, e, m, g1..., n>: the first match with its offsets in code points, the groups asked for (empty if they took no part) and
    the number of all matches; null without one. pattern must not match the empty string."""

    def read(t: Column, p: Column) -> Column:
        start, size = F.length(F.get(p, F.lit(0))), F.length(F.get(p, F.lit(1)))
        taken = [F.get(p, F.lit(2 + i)).alias(f"g{k}") for i, k in enumerate(groups)]
        number = ((F.size(p) - 1) / (2 + len(groups))).cast("int")
        return F.when(F.size(p) > 1, F.struct(start.alias("s"), (start + size).alias("e"), F.substring(t, start + 1, size).alias("m"), *taken, number.alias("n")))

    return let(text, lambda t: let(_scan(t, pattern, *groups), lambda p: read(t, p)))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: matches with offsets, from the pieces between them; most texts have no match of most patterns, or one."""

    span = lambda t, start, size: F.struct(start.alias("s"), (start + size).alias("e"), F.substring(t, start + 1, size).alias("m"))
    size = lambda p, k: F.length(F.get(p, F.lit(k) if isinstance(k, int) else k))

    def few(t: Column, p: Column) -> Column:
        def add(out: Column, k: Column) -> Column:
            last = F.get(out, F.size(out) - 1)["e"]
            return F.concat(out, F.array(span(t, last + size(p, k - 1), size(p, k))))

        return F.aggregate(F.sequence(F.lit(3), F.size(p) - 2, F.lit(2)), F.array(span(t, size(p, 0), size(p, 1))), add)

    def many(t: Column, p: Column) -> Column:
        found = place(F.filter(p, lambda _, i: i % 2 == 1), F.filter(p, lambda _, i: i % 2 == 0))
        return F.transform(found, lambda x: span(t, x["s"], x["e"] - x["s"]))

    def read(t: Column, p: Column) -> Column:
        some = F.when(F.size(p) == 3, F.array(span(t, size(p, 0), size(p, 1)))).when(F.size(p) <= 2 * _FEW, few(t, p)).otherwise(many(t, p))
        return F.when(F.size(p) > 1, some).when(t.isNotNull(), no_spans())

    return let(text, lambda t: let(_scan(t, pattern), lambda p: read(t, p)))


def has(folded: Column, *words: str) -> Column:
    """Whether a text contains one of the words."""
    return reduce(or_, [folded.contains(w) for w in words])


def small_letters(low: Column) -> Column:
    """tr_fold() with one form of each letter that (?iu) takes for the same: patterns in small letters, with an i for each i, match it where they match the text."""
    return exchanged(low, "ıſ", "is")


def plain_letters(folded: Column) -> Column:
    """tr_fold_ascii() with one form of each letter that (?iu) takes for the same: what a pattern needs, this contains in small ASCII letters."""
    return exchanged(folded, "ſ", "s")
