"""Turkish numbers, rates, money, terms, dates and fee statements as typed columns. No information gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablarium.functions.text import has, let, tr_fold_ascii

#: Months, range separators, and phrases about fees (folded).
MONTHS = ["ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik"]
RANGE_SEPARATOR = "(?U)\\s*(?:-|–|—|ile|ila|arası|arasında|/)\\s*"
FREE = ["masrafsiz", "ucretsiz", "dosya masrafi yok", "masraf yok", "sifir masraf", "tahsis ucreti yok"]
FEE_HINTS = ["masraf", "ucret", "tahsis"]
NEGATION = (
    "(?U)(?:al[ıi]nma[zy]\\w*|al[ıi]nm[ıi]yor|tahsil\\s+edilme[zy]\\w*|talep\\s+edilme[zy]\\w*|yans[ıi]t[ıi]lma[zy]\\w*|yoktur|yok\\b|"
    "bulunmamaktad[ıi]r|muaf|s[ıi]f[ıi]r|bedelsiz)"
)
CHARGE = (
    "(?U)(?:al[ıi]n[ıi]r|al[ıi]nacak|al[ıi]nmaktad[ıi]r|al[ıi]nmakta|tahsil\\s+edil(?!me)|tabidir|tabi\\s+olacak|tabi\\s+tutul|"
    "yans[ıi]t[ıi]l[ıi]r|yans[ıi]t[ıi]lacak|uygulan[ıi]r|uygulanacak|odenir|ucretlidir|masrafl[ıi]d[ıi]r|talep\\s+edil(?!me))"
)


def parse_tr_number(c: Column) -> Column:
    """1.500,00 and 1.500 are 1500, 2,05 and 2.05 are 2.05; two dots without a comma are no number."""
    return let(F.btrim(F.regexp_replace(c, "[^0-9,.-]", ""), F.lit(".,")), _number)


def _number(s: Column) -> Column:
    plain = (
        F.when(s.contains(",") & s.contains("."), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(s.contains(","), F.replace(s, F.lit(","), F.lit(".")))
        .when(s.rlike("^[^.]*\\.[0-9]{3}$"), F.replace(s, F.lit("."), F.lit("")))
        .otherwise(s)
    )
    return F.when(s.rlike("[0-9]"), plain.try_cast("double"))


def normalize_rate(c: Column) -> Column:
    """Struct num, min, max; a range has min < max, a single rate or an empty range has num."""
    def read(t: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(t, F.lit("%?\\s*\\d[\\d.,]*\\s*%?"), F.lit(0)), parse_tr_number)
        return let(F.struct(numbers.alias("n"), t.rlike(RANGE_SEPARATOR).alias("r")), lambda x: _rate(x["n"], x["r"]))

    return let(c, lambda t: F.when(t.isNotNull(), read(t)))


def _rate(numbers: Column, separated: Column) -> Column:
    a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    wide = separated & a.isNotNull() & b.isNotNull() & (a != b)
    return F.when(a.isNotNull(), F.struct(
        F.when(~F.coalesce(wide, F.lit(False)), a).alias("num"), F.when(wide, F.least(a, b)).alias("min"), F.when(wide, F.greatest(a, b)).alias("max"),
    ))


def normalize_money(c: Column) -> Column:
    """Struct value, currency (TRY unless another is named)."""
    value = parse_tr_number(F.regexp_extract(c, "\\d[\\d.,]*", 0))
    return let(F.struct(value.alias("value"), tr_fold_ascii(c).alias("low")), lambda x: _money(x["value"], x["low"]))


def _money(value: Column, low: Column) -> Column:
    currency = F.when(low.rlike("\\b(usd|dolar)|\\$"), "USD").when(low.rlike("\\b(eur|euro|avro)|€"), "EUR").otherwise("TRY")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), currency.alias("currency")))


def normalize_term_months(c: Column) -> Column:
    """Months, half-even."""
    pattern = "(?U)(\\d[\\d.,]*)\\s*(ay|yil|sene)(?:a|da|ta|dan|tan|i|lik)?\\b"
    months = lambda low: F.bround(parse_tr_number(F.regexp_extract(low, pattern, 1)) * F.when(F.regexp_extract(low, pattern, 2) == "ay", 1).otherwise(12)).cast("int")
    return let(tr_fold_ascii(c), months)


def normalize_date(c: Column) -> Column:
    """ISO, d.m.yyyy, d/m/yyyy and d Month yyyy; the first form that is present decides, impossible dates are null."""
    return let(c, _date)


def _date(c: Column) -> Column:
    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    iso, dotted, named = "(\\d{4})-(\\d{1,2})-(\\d{1,2})", "(\\d{1,2})[./](\\d{1,2})[./](\\d{4})", "(?u)(\\d{1,2})\\s+([A-Za-zÇĞİÖŞÜçğıöşü]+)\\s+(\\d{4})"
    part = lambda p, k: F.regexp_extract(c, p, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), tr_fold_ascii(part(named, 2)))
    return (
        F.when(c.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(c.rlike(dotted), made(part(dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when(c.rlike(named) & (month > 0), made(part(named, 3), month.cast("string"), part(named, 1)))
    )


def normalize_fee_status(c: Column, folded: Column | None = None) -> Column:
    """Struct has_fee, amount. A denial is a value (false, 0); a bare mention is null. folded is tr_fold_ascii(c), if it is known."""
    known = lambda t: F.struct(t.alias("c"), (tr_fold_ascii(t) if folded is None else folded).alias("low"))
    return let(let(c, known), lambda x: _fee(x["c"], x["low"]))


def _fee(c: Column, low: Column) -> Column:
    fee = lambda has, amount: F.struct(F.lit(has).alias("has_fee"), amount.cast("double").alias("amount"))
    known = c.rlike("%\\s*\\d|\\d[\\d.,]*\\s*%") | low.rlike(CHARGE)
    charged = lambda money: F.when(money.isNotNull(), fee(True, money["value"])).when(known, fee(True, F.lit(None)))
    return F.when(has(low, *FREE), fee(False, F.lit(0.0))).when(has(low, *FEE_HINTS), F.when(low.rlike(NEGATION), fee(False, F.lit(0.0))).otherwise(let(normalize_money(c), charged)))
