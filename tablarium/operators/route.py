"""Questions as columns: the field that is asked for, intent, filters, and the path that answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablarium.functions.text import let, tr_fold, tr_fold_ascii

#: Fixed values (folded): words by field, intent and type, in the order in which they are tried.
FIELDS = {
    "kar_payi_orani": ["kar payi", "getiri oran", "kar oran", "oran"],
    "vade_ay": ["vade", "odeme suresi", "kac ay", "kac yil", "ay vade"],
    "finansman_tutari": ["tutar", "limit", "ne kadar finansman", "kredi tutar"],
    "tahsis_ucreti": ["tahsis", "dosya masraf"],
    "masraf_durumu": ["masraf", "ucret", "masrafsiz", "ucretsiz"],
    "taksit_sayisi": ["taksit"],
}
INTENTS = {
    "lowest": ["en dusuk", "en az", "en ucuz", "en avantajli", "minimum"],
    "highest": ["en yuksek", "en fazla", "en uzun", "en cok", "maksimum", "en buyuk"],
    "list": ["hangi banka", "hangi bankalar", "listele", "goster", "var mi", "veren", "sunan", "olanlar"],
}
TYPES = {"konut": "Konut Finansmanı", "tasit": "Taşıt Finansmanı", "ihtiyac": "İhtiyaç Finansmanı", "kart": "Kart", "yatirim": "Yatırım Ürünü"}
LEAST = ["veren", "uzeri", "ve uzeri", "en az"]
#: Words of interest, other than those for its absence, and the field that such a question means.
INTEREST, INTEREST_FIELD = "(?U)\\bfaiz(?!siz)|\\binterest", "kar_payi_orani"


def _first(low: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(low.rlike("|".join(words)), name) for name, words in table.items()])


def detect(question: Column) -> Column:
    """QA2: struct field, intent, term_min, campaign_type; each null if the question doesn't tell."""

    def parts(low: Column) -> Column:
        months = F.nullif(F.regexp_extract(low, "(\\d{1,3})\\s*ay", 1), F.lit("")).cast("int")
        kind = F.coalesce(*[F.when(low.contains(word), name) for word, name in TYPES.items()])
        return F.struct(_first(low, FIELDS).alias("field"), _first(low, INTENTS).alias("intent"), F.when(low.rlike("|".join(LEAST)), months).alias("term_min"), kind.alias("campaign_type"))

    return let(tr_fold_ascii(question), parts)


def banks_in(question: Column, aliases: dict[str, str]) -> Column:
    """QA3: distinct slugs of the banks that are named; aliases (folded) map to slugs, and longer ones are taken out of the text before shorter ones are tried."""
    begin = F.struct(tr_fold_ascii(question).alias("rest"), F.array().cast("array<string>").alias("slugs"))
    known = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(s).alias("slug")) for a, s in sorted(aliases.items(), key=lambda x: (-len(x[0]), x[0]))])

    def step(acc: Column, x: Column) -> Column:
        hit = acc["rest"].contains(x["alias"])
        return F.struct(F.when(hit, F.replace(acc["rest"], x["alias"], F.lit(" "))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["slugs"], F.array(x["slug"]))).otherwise(acc["slugs"]).alias("slugs"))

    return F.aggregate(known, begin, step, lambda acc: F.array_distinct(acc["slugs"]))


def mentions_interest(question: Column) -> Column:
    return tr_fold(question).rlike(INTEREST)


def route(question: Column, aliases: dict[str, str] | None = None) -> Column:
    """QA1: struct handler, field, intent, term_min, campaign_type, banks.

    structured if a field and an intent or filter (a term, a type, a bank by its alias) are named, else rag. A word of interest
    names the profit rate if nothing names a field. A structured question without an intent asks for a list.
    """

    def made(x: Column) -> Column:
        d, banks = x["d"], x["banks"]
        field = F.coalesce(d["field"], F.when(x["interest"], INTEREST_FIELD))
        told = field.isNotNull() & (d["intent"].isNotNull() | d["term_min"].isNotNull() | d["campaign_type"].isNotNull() | (F.size(banks) > 0))
        return F.struct(
            F.when(told, "structured").otherwise("rag").alias("handler"), field.alias("field"), F.coalesce(d["intent"], F.when(told, "list")).alias("intent"),
            d["term_min"].alias("term_min"), d["campaign_type"].alias("campaign_type"), banks.alias("banks"),
        )

    named = banks_in(question, aliases) if aliases else F.array().cast("array<string>")
    return let(F.struct(detect(question).alias("d"), named.alias("banks"), mentions_interest(question).alias("interest")), made)
