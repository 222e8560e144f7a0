"""Extractors of rewards, points, audiences and conditions; plausibility, confidence and spans of extracted fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablarium.functions.normalize import normalize_money, parse_tr_number
from tablarium.functions.text import first_match, keyword_regex, let, match_spans, split_sentences, tr_fold_ascii
from tablarium.operators.extract import at

#: Words and patterns of each field, ranges of plausible numbers, parts of the confidence.
REWARD = "(?iu)hediye|para\\s*puan|cashback|nakit\\s*iade|iade|bonus|çek|kazan[\\wçğıöşü]*|ödül"
MONEY = "(?iu)\\d[\\d.,]*\\s*(?:tl|₺|try|türk\\s*liras[ıi])"
POINTS = "(?iu)chip[\\s-]*para|alışveriş\\s*puan\\w*|alisveris\\s*puan\\w*|puan\\s*iade\\w*|bonus\\s*puan\\w*|puan"
AUDIENCES = {
    "belirli_segment": "(?iu)emekli|öğrenci|ogrenci|esnaf|kamu\\s*çalışan\\w*|kobi|serbest\\s*meslek",
    "maas_musterisi": "(?iu)maaş\\s*müşteri\\w*|maas\\s*musteri\\w*|maaşını\\s*bankamızdan|maaş\\s*ödemesi",
    "mevcut_musteri": "(?iu)mevcut\\s*müşteri|mevcut\\s*musteri|halihazırda|müşterilerimize\\s*özel",
    "yeni_musteri": "(?iu)yeni\\s*müşteri|yeni\\s*musteri|ilk\\s*kez|hoş\\s*geldin|hos\\s*geldin|yeni\\s*üye",
}
EXCLUDED = "(?iu)olmayan|hari[çc]|d[ıi][şs][ıi]nda|ge[çc]erli\\s*de[ğg]il"
CONDITION = (
    "(?iu)şart|koşul|kosul|gerekmekte|gerekli|zorunlu|asgari|en\\s*az\\s+\\d|minimum|yalnızca|sadece|hariç|için\\s*geçerli|olmas[ıi]\\s*gerek"
)
BOILERPLATE = (
    "(?iu)çerez|cookie|kvkk|kişisel\\s*veri|aydınlatma\\s*metni|gizlilik\\s*(politika|bildirim)|açık\\s*rıza|veri\\s*sorumlusu|telif|tüm\\s*hakları|"
    "sosyal\\s*medya\\s*hesap|bilgi\\s*toplumu|çağrı\\s*merkezi|müşteri\\s*hizmetleri|şubelerimiz"
)
PLAUSIBLE = {
    "kar_payi_orani": (0.0, 15.0), "indirim_orani": (0.0, 100.0), "vade_ay": (1.0, 480.0), "taksit_sayisi": (1.0, 480.0), "finansman_tutari": (100.0, 1e8),
    "tahsis_ucreti": (0.0, 1e6), "odul_miktari": (0.0, 1e7), "alisveris_puani": (0.0, 1e7),
}
BASE, ADJACENT, NEAR, FAR, IMPLAUSIBLE, SEVERAL, RANGE, FLOOR, CEILING = 0.70, 0.25, 0.12, -0.15, -0.45, -0.10, -0.05, 0.05, 0.98
_SIDE = 30


def rewarded(text: Column) -> Column:
    """struct d, s, m, at, to: the amount of reward(), its distance to the word, and its offsets."""

    def near(t: Column) -> Column:
        def one(r: Column) -> Column:
            start = F.greatest(r["s"] - _SIDE, F.lit(0))
            before = let(match_spans(F.substring(t, start + 1, r["s"] - start), MONEY), lambda m: F.get(m, F.size(m) - 1))
            after = F.get(match_spans(F.substring(t, r["e"] + 1, F.lit(_SIDE)), MONEY), F.lit(0))
            made = lambda d, m, off: F.struct(d.alias("d"), r["s"].alias("s"), m["m"].alias("m"), (off + m["s"]).alias("at"), (off + m["e"]).alias("to"))
            return let(F.struct(before.alias("b"), after.alias("a")), lambda x: F.when(x["b"].isNotNull(), made(r["s"] - start - x["b"]["e"], x["b"], start)).when(x["a"].isNotNull(), made(x["a"]["s"], x["a"], r["e"])))

        return F.array_min(F.array_compact(F.transform(match_spans(t, REWARD), one)))

    return let(text, near)


def reward(text: Column) -> Column:
    """Struct value, currency of the amount nearest to a word of reward: the last in the 30 characters before, else the first in those after."""
    return let(rewarded(text), lambda x: normalize_money(x["m"]))


def points(text: Column) -> Column:
    """Struct kind (rate or points), value, within 30 characters of the first word for points."""

    def around(x: Column) -> Column:
        start = F.greatest(x["p"]["s"] - _SIDE, F.lit(0))
        return F.when(x["p"].isNotNull(), F.substring(x["t"], start + 1, x["p"]["e"] + _SIDE - start))

    def typed(c: Column) -> Column:
        rate = F.regexp_extract(c, "%\\s*(\\d[\\d.,]*)|(\\d[\\d.,]*)\\s*%", 0)
        raw = F.when(rate != "", rate).otherwise(F.regexp_extract(c, "\\d[\\d.,]*", 0))
        return let(parse_tr_number(raw), lambda v: F.when(v.isNotNull(), F.struct(F.when(rate != "", "rate").otherwise("points").alias("kind"), v.alias("value"))))

    return let(let(F.struct(text.alias("t"), F.get(match_spans(text, POINTS), F.lit(0)).alias("p")), around), typed)


def points_at(text: Column) -> Column:
    """Where the number of points() stands; see extract.at()."""

    def inside(start: Column, c: Column) -> Column:
        sign = let(first_match(c, "%\\s*\\d[\\d.,]*|\\d[\\d.,]*\\s*%"), lambda m: let(first_match(m["m"], "\\d[\\d.,]*"), lambda n: at(start + m["s"] + n["s"], start + m["s"] + n["e"])))
        plain = let(first_match(c, "\\d[\\d.,]*"), lambda n: at(start + n["s"], start + n["e"]))
        return F.when(c.rlike("%\\s*\\d|\\d[\\d.,]*\\s*%"), sign).otherwise(plain)

    def around(t: Column, p: Column) -> Column:
        return let(F.greatest(p["s"] - _SIDE, F.lit(0)), lambda start: let(F.substring(t, start + 1, p["e"] + _SIDE - start), lambda c: inside(start, c)))

    return let(text, lambda t: let(first_match(t, POINTS), lambda p: around(t, p)))


def audience_at(text: Column) -> Column:
    """Where the first segment of audience() is mentioned, in the order new, present, salary, group; see extract.at()."""
    mention = lambda t, p: let(first_match(t, p), lambda m: F.when(~F.substring(t, m["e"] + 1, F.lit(25)).rlike(EXCLUDED), at(m["s"], m["e"])))
    return let(text, lambda t: F.coalesce(*[mention(t, AUDIENCES[k]) for k in sorted(AUDIENCES, reverse=True)]))


def conditions_at(text: Column, first: Column) -> Column:
    """Where the first of conditions() stands in the text, null if the text has other white space there; see extract.at()."""
    return let(F.position(first, text) - 1, lambda s: F.when(s >= 0, at(s, s + F.length(first))))


def audience(text: Column) -> Column:
    """Sorted array of segments whose first mention isn't excluded within 25 characters; null if there is none."""

    def label(t: Column, name: str, pattern: str) -> Column:
        first = F.regexp_instr(t, F.lit(pattern))
        after = F.substring(t, first + F.length(F.regexp_extract(t, pattern, 0)), F.lit(25))
        return F.when((first > 0) & ~after.rlike(EXCLUDED), name)

    found = let(text, lambda t: F.array_compact(F.array(*[label(t, k, p) for k, p in AUDIENCES.items()])))
    return let(found, lambda a: F.when(F.size(a) > 0, a))


def conditions(text: Column) -> Column:
    """The first eight sentences of 20 to 400 characters that state a condition and aren't boilerplate; null if there is none."""
    good = lambda s: s.rlike(CONDITION) & ~s.rlike(BOILERPLATE) & F.length(s).between(20, 400)
    picked = lambda t: F.slice(F.filter(F.transform(split_sentences(t), lambda s: F.trim(s)), good), F.lit(1), F.lit(8))
    some = lambda t: F.when(t.rlike(CONDITION.replace("(?iu)", "(?iuU)")), picked(t))  # noqa: E731, no sentence has what its text lacks
    return let(let(text, some), lambda p: F.when(F.size(p) > 0, p))


def is_plausible(field: Column, numbers: Column) -> Column:
    """All numbers lie in the field's range; null for fields without range and without numbers."""
    least, most = (F.coalesce(*[F.when(field == k, bounds[side]) for k, bounds in PLAUSIBLE.items()]) for side in (0, 1))
    return F.when(F.size(numbers) > 0, (F.array_min(numbers) >= least) & (F.array_max(numbers) <= most))


def confidence(field: Column, numbers: Column, distance: Column, candidates: Column, is_range: Column) -> Column:
    """Score of an extracted value, three digits; null distance: no trigger."""
    near = F.when(distance <= 15, ADJACENT).when(distance <= 60, NEAR).otherwise(FAR)
    wrong = F.when(~F.coalesce(is_plausible(field, numbers), F.lit(True)), IMPLAUSIBLE).otherwise(0.0)
    total = F.lit(BASE) + near + wrong + F.when(candidates > 1, SEVERAL).otherwise(0.0) + F.when(is_range, RANGE).otherwise(0.0)
    return F.round(F.least(F.greatest(total, F.lit(FLOOR)), F.lit(CEILING)), 3)


def verify_span(text: Column, start: Column, end: Column, raw: Column) -> Column:
    """The offsets lie in the text and give the raw value."""
    inside = (start >= 0) & (start <= end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == F.coalesce(raw, F.lit(""))), F.lit(False))


def locate_span(text: Column, start: Column, end: Column, raw: Column, window: Column) -> Column:
    """Struct s, e, ambiguous: the stored offsets if they hold, else the value in its window, else anywhere; null if it isn't there.

    ambiguous: the place isn't stored, and the value, or its window, stands elsewhere in the text too.
    """
    at, inner = F.position(window, text), F.position(raw, window)
    stored, framed = verify_span(text, start, end, raw), (at > 0) & (inner > 0)
    found = F.when(stored, start).when(framed, at + inner - 2).when(F.position(raw, text) > 0, F.position(raw, text) - 1)
    again = lambda x, p: F.position(x, text, p + 1) > 0
    several = F.when(stored, False).when(framed, again(window, at) | (F.position(raw, window, inner + 1) > 0)).otherwise(again(raw, F.position(raw, text)))
    return let(found, lambda s: F.when(s.isNotNull() & (raw != ""), F.struct(s.alias("s"), (s + F.length(raw)).alias("e"), F.coalesce(several, F.lit(False)).alias("ambiguous"))))


def confidence_level(c: Column) -> Column:
    """N13"""
    return F.when(c >= 0.85, "high").when(c >= 0.6, "medium").when(c.isNotNull(), "low").otherwise("unknown")


#: Claims about rates that name no number (folded), and phrases of terms by concept (folded).
CLAIMS = [
    "avantajli kar payi", "avantajli oran", "ozel oranli", "ozel oran", "dusuk maliyetli", "uygun maliyetli", "cazip oran", "avantajli finansman", "avantajli fiyat",
]
TERMS = {
    "finansman_maliyeti": ["finansman maliyeti", "toplam geri odeme", "toplam maliyet", "yillik maliyet orani"],
    "katilim_fonu": ["katilim fonu", "katilma hesabi", "kar-zarar paylasimi"],
}


def rate_claim(text: Column) -> Column:
    """The longest claim without a number in the text, folded; null if there is none. It never becomes a rate."""
    return let(tr_fold_ascii(text), lambda t: F.coalesce(*[F.when(t.rlike(keyword_regex([c])), c) for c in sorted(CLAIMS, key=len, reverse=True)]))


def term_hits(text: Column) -> Column:
    """Map of the concepts in the text to their first phrase, folded."""

    def hits(t: Column) -> Column:
        first = {k: F.coalesce(*[F.when(t.rlike(keyword_regex([p])), p) for p in phrases]) for k, phrases in TERMS.items()}
        pairs = F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(F.lit(k).alias("k"), p.alias("p"))) for k, p in first.items()]))
        return F.map_from_entries(pairs)

    return let(tr_fold_ascii(text), hits)
