"""Field extractors: text to struct of raw value, canonical value and offsets, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablarium.functions.normalize import normalize_date, normalize_money, normalize_rate, normalize_term_months
from tablarium.functions.text import first_match, has, let, match_spans, tr_fold

#: Units that a rate is not, and patterns with which a field is found.
UNIT = "(?:ay|y[ıi]l|sene|taksit|adet|tl|₺)(?:a|e|da|de|ta|te|dan|den|tan|ten|[ıi]|l[ıi]k|lar|ler)?\\b"
SHARING = "(?iuU)(?:kâr|kar)\\s*pay[ıi]\\s*payla[şs][ıi]m\\s*oran[ıi]"
RATE_BEFORE = "(?iuU)(%\\s*\\d[\\d.,]*)\\s{0,3}(?:kâr|kar)\\s*pay[ıi](?:\\s*oran[ıi])?"
RATE_AFTER = (
    "(?iuU)(kâr|kar)\\s*pay[ıi]\\s*(oran[ıi])?[^%\\d]{0,15}(%?\\s*\\d[\\d.,]*(?![\\d.,])\\s*%?"
    f"(?:\\s*(?:-|–|ile|ila)\\s*%?\\s*\\d[\\d.,]*(?![\\d.,])\\s*%?(?!\\s*{UNIT}))?)(?!\\s*{UNIT})"
)
TERM = "(?iuU)(\\d(?<!\\d\\d)[\\d.,]*+)\\s*+(ay|yıl|yil|sene)(?:a|da|ta|dan|tan|ı|i|lık|lik)?\\b"
AMOUNT = "(?iuU)(finansman|kredi|tutar|limit)[^\\d]{0,20}(\\d[\\d.,]*\\s*(?:tl|₺|try|türk\\s*liras[ıi]))"
INSTALMENTS = "(?iuU)(\\d{1,3})\\s*taksit|taksit\\s*(?:say[ıi]s[ıi])?\\s*[:\\-]?\\s*(\\d{1,3})"
DISCOUNT_BEFORE = "(?iuU)(%\\s*\\d[\\d.,]*|\\d[\\d.,]*\\s*%)(?:[^.;\\n]{0,20}?)\\bindirim"
DISCOUNT_AFTER = "(?iuU)indirim\\s*(?:oran[ıi])?[^%\\d]{0,12}(%\\s*\\d[\\d.,]*|\\d[\\d.,]*\\s*%)"
DEADLINE = "(?iuU)\\d{4}-\\d{1,2}-\\d{1,2}|\\d{1,2}[./]\\d{1,2}[./]\\d{4}|\\d{1,2}\\s+(?:ocak|şubat|mart|nisan|mayıs|haziran|temmuz|ağustos|eylül|ekim|kasım|aralık)\\s+\\d{4}"


#: What a deadline is near to.
DEADLINE_TRIGGER = "(?iuU)kampanya|son\\s+ba[şs]vuru|ge[çc]erli|tarihine\\s+kadar"


def at(s: Column, e: Column, ws: Column | None = None, we: Column | None = None, distance: Column | int | None = 0, candidates: Column | int = 1) -> Column:
    """Evidence of a value: its offsets, those that its window is around, the distance to what it was found by, and how many were."""
    whole = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("int")
    return F.struct(
        whole(s).alias("s"), whole(e).alias("e"), whole(s if ws is None else ws).alias("ws"), whole(e if we is None else we).alias("we"), whole(distance).alias("distance"), whole(candidates).alias("candidates"),
    )


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def profit_rate(text: Column) -> Column:
    """A rate right before the phrase, else after it; none at all if a sharing ratio is mentioned."""
    raw = lambda t: F.coalesce(_group(t, RATE_BEFORE, 1), _group(t, RATE_AFTER, 3))
    return let(text, lambda t: F.when(t.rlike("(?iu)pay") & ~t.rlike(SHARING), normalize_rate(raw(t))))


def rate_found(text: Column) -> Column:
    """struct raw, at: what profit_rate() reads unless a sharing ratio is mentioned, and where it stands; see at()."""

    def before(m: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m["g1"].alias("raw"), at(m["s"], m["s"] + F.length(m["g1"]), m["s"], m["e"], 0, m["n"]).alias("at")))

    def after(m: Column) -> Column:
        start = m["e"] - F.length(m["g3"])  # the rate is what a match ends with
        return F.when(m.isNotNull(), F.struct(m["g3"].alias("raw"), at(start, m["e"], m["s"], m["e"], start - m["s"] - F.length(m["g1"]), m["n"]).alias("at")))

    return F.coalesce(F.when(text.contains("%"), let(first_match(text, RATE_BEFORE, 1), before)), let(first_match(text, RATE_AFTER, 1, 3), after))


def term(text: Column, low: Column | None = None, distance: bool = True) -> Column:
    """Struct months, s, e, d (to the nearest "vade"), n (terms in the text). Of all terms the one not after "ilk", nearest to "vade", first.

    low is tr_fold(text), if it is known. Without distance an only term isn't held against any "vade", and its d is null.
    """
    known = F.struct(match_spans(text, TERM).alias("spans"), (tr_fold(text) if low is None else low).alias("low"))

    def made(x: Column) -> Column:
        parts = lambda b, d: F.struct(normalize_term_months(b["m"]).alias("months"), b["s"].alias("s"), b["e"].alias("e"), d.alias("d"), F.size(x["spans"]).alias("n"))
        best = let(_nearest(x["spans"], x["low"]), lambda b: F.when(b.isNotNull(), parts(b, b["d"])))
        only = let(F.get(x["spans"], F.lit(0)), lambda b: parts(b, F.lit(None).cast("int")))
        return best if distance else F.when(F.size(x["spans"]) == 1, only).otherwise(best)

    return let(known, made)


def _nearest(spans: Column, low: Column) -> Column:
    def choose(near: Column) -> Column:
        def score(x: Column) -> Column:
            before = F.substring(low, F.greatest(x["s"] - 7, F.lit(1)), F.least(x["s"], F.lit(8)))
            distance = F.coalesce(F.array_min(F.transform(near, lambda v: F.abs(v - x["s"]))), F.lit(10**6))
            return F.struct(before.contains("ilk").alias("promo"), distance.alias("d"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))

        return F.array_min(F.transform(spans, score))

    return let(F.transform(match_spans(low, "vade"), lambda v: v["s"]), choose)


def amount(text: Column) -> Column:
    """X05"""
    return normalize_money(_group(text, AMOUNT, 2))


def amount_at(m: Column) -> Column:
    """Where the amount stands in the first match of AMOUNT, with both groups; see at()."""
    start = m["e"] - F.length(m["g2"])
    return at(start, m["e"], m["s"], m["e"], start - m["s"] - F.length(m["g1"]), m["n"])


def whole_at(m: Column) -> Column:
    """Where a match that is a value as a whole stands; see at()."""
    return at(m["s"], m["e"], candidates=m["n"])


def deadline_at(text: Column, m: Column) -> Column:
    """Where the day of the first match of DEADLINE stands; see at(). No trigger: a null distance."""
    near = F.array_min(F.transform(match_spans(text, DEADLINE_TRIGGER), lambda x: F.abs(x["s"] - m["s"])))
    return at(m["s"], m["e"], distance=near, candidates=m["n"])


def instalments(text: Column) -> Column:
    """X06"""
    return F.coalesce(_group(text, INSTALMENTS, 1), _group(text, INSTALMENTS, 2)).cast("int")


def deadline(text: Column) -> Column:
    """The first text that looks like a date; if it isn't one, null."""
    return normalize_date(_group(text, DEADLINE, 0))


def discount(text: Column) -> Column:
    """Not where points are spoken of within 25 characters."""
    raw = F.coalesce(_group(text, DISCOUNT_BEFORE, 1), _group(text, DISCOUNT_AFTER, 1))
    return let(F.struct(text.alias("t"), raw.alias("raw")), lambda x: _unless_points(x["t"], x["raw"]))


def discount_at(text: Column) -> Column:
    """Where the rate of discount() stands; see at()."""
    before = let(first_match(text, DISCOUNT_BEFORE, 1), lambda m: F.when(m.isNotNull(), at(m["s"], m["s"] + F.length(m["g1"]))))
    after = let(first_match(text, DISCOUNT_AFTER, 1), lambda m: F.when(m.isNotNull(), at(m["e"] - F.length(m["g1"]), m["e"])))
    return F.coalesce(before, after)


def _unless_points(text: Column, raw: Column) -> Column:
    at = F.position(raw, text)
    around = F.substring(text, F.greatest(at - 25, F.lit(1)), F.length(raw) + 50)
    return F.when(~around.rlike("(?iu)puan"), normalize_rate(raw))
