"""Answers from stored fields: values as text, sentences on the best offer, lists; checks of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablarium.functions.text import keyword_regex, let, tr_fold_ascii
from tablarium.operators.rank import direction, numeric_key
from tablarium.operators.route import INTEREST

#: Names of fields in sentences, and stems by which a question asks for a ruling, for advice or for a promise.
LABELS = {
    "kar_payi_orani": "kâr payı oranı", "vade_ay": "vade", "finansman_tutari": "finansman tutarı", "tahsis_ucreti": "tahsis ücreti",
    "masraf_durumu": "masraf durumu", "taksit_sayisi": "taksit sayısı",
}
NOTHING = "Bu kritere uyan kampanya bulunamadı."
RULING = (
    "caiz|haram|mekruh|fetva|gunah|fikhi|fikih|seri hukum|ser'i hukum|dini hukum|dinen caiz|dinen uygun|dinen sakinca|islami hukum|muftu|din isleri"
).split("|")
RULING_WEAK = "helal|dinen|dini|islami|islam'a|islama|sirket ortakligi"
PARTICLE = "(?:mi|midir|mu|mudur|degil mi|uygun mu|sakincali)"
ADVICE = (
    "tavsiye|oner|secmeli|secelim|sececegim|sectiginizde|yatirayim|yatirmali|yapmali miyim|ne yapmaliyim|tercih etmeli|tercih etsem|alayim|gireyim|kullanayim|"
    "daha iyi|en iyisi|benim icin en|sence|hangisi karli|kazandirir mi|portfoy"
).split("|")
PROMISE = (
    "garanti|kesin getiri|kesin kazanc|kesin kar|sabit getiri|sabit kar|taahhut|ne kadar kazanirim|ne kazanirim|kazancim ne|zarar eder miyim|riskli mi|kesinlikle kazan"
).split("|")
RATE = "%\\s*\\d"


def number(x: Column) -> Column:
    """A number without zeros at its end."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), "\\.?0+$", "")


def show(field: Column, v: Column) -> Column:
    """A canonical value (num, min, max, value, currency) as text; others as JSON."""
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    return (
        F.when((field == "kar_payi_orani") & v["num"].isNotNull(), F.concat(F.lit("%"), comma(number(v["num"]))))
        .when((field == "vade_ay") & v["num"].isNotNull(), F.concat(v["num"].cast("long").cast("string"), F.lit(" ay")))
        .when(v["value"].isNotNull(), F.concat(number(v["value"]), F.lit(" "), F.coalesce(v["currency"], F.lit("TRY"))))
        .when(v["min"].isNotNull(), F.concat(F.lit("%"), comma(number(v["min"])), F.lit("–%"), comma(number(v["max"])))).otherwise(F.to_json(v))
    )


def label(field: Column) -> Column:
    return F.coalesce(*[F.when(field == k, t) for k, t in LABELS.items()], field)


def superlative(rows: DataFrame, field: str, highest: bool) -> DataFrame:
    """QA4, QA6: bank, answer: the sentence on the best of rows (bank, value, seq); no comparable row: no answer."""
    keyed = rows.withColumn("k", numeric_key(F.col("value"))).filter("k.comparable")
    order = F.col("k.key").desc() if highest else F.col("k.key")
    word = "en yüksek" if highest else "en düşük"
    top = keyed.orderBy(order, "seq").limit(1)
    text = F.concat(F.lit(f"{word} "), label(F.lit(field)), F.lit(": **"), F.col("bank"), F.lit("** ("), show(F.lit(field), F.col("value")), F.lit(")."))
    return top.select("bank", text.alias("answer"))


def listed(rows: DataFrame, field: str, k: int = 20) -> DataFrame:
    """QA6: place, line of the first k rows (bank, value, seq) in the field's fair order; what can't be compared comes last, with a note."""
    keyed = rows.withColumn("k", numeric_key(F.col("value")))
    better = F.when(direction(F.lit(field)) == "lower_is_better", F.col("k.key")).otherwise(-F.col("k.key"))
    note = F.when(F.col("k.comparable"), "").otherwise(F.concat(F.lit("  _(not: "), F.col("k.note"), F.lit(")_")))
    top = keyed.orderBy(~F.col("k.comparable"), F.when(F.col("k.comparable"), better), "seq").limit(k)
    lines = top.select(F.collect_list(F.concat(F.lit("- "), F.col("bank"), F.lit(": "), show(F.lit(field), F.col("value")), note)).alias("lines"))  # k of them
    return lines.select(F.posexplode("lines").alias("place", "line"))


def _stem(folded: Column, stems: list[str]) -> Column:
    return folded.rlike("\\b(?:" + "|".join(stems) + ")")


def gates(question: Column, scope: list[str]) -> Column:
    """QA15: array of the gates that a question meets, in their order: ruling (then no other), terminology, advice, guarantee, abstention.

    scope: folded words, one of which a question has to hold.
    """

    def met(q: Column) -> Column:
        ruling = _stem(q, RULING) | q.rlike(f"\\b(?:{RULING_WEAK})[^.?!]{{0,18}}?\\b{PARTICLE}\\b")
        others = F.array(
            F.when(q.rlike(INTEREST), "terminology"), F.when(_stem(q, ADVICE), "advice"), F.when(_stem(q, PROMISE), "guarantee"),
            F.when(~q.rlike(keyword_regex(scope)), "abstention"),
        )
        return F.when(ruling, F.array(F.lit("ruling"))).otherwise(F.array_compact(others))

    return let(tr_fold_ascii(F.coalesce(question, F.lit(""))), met)


def states_rate(answer: Column) -> Column:
    """QA17"""
    return F.coalesce(answer.rlike(RATE), F.lit(False))


def soft_terms(answer: Column) -> Column:
    """QA17: terms of conventional banking that an answer should avoid; the product "kredi kartı" is none."""
    folded = tr_fold_ascii(F.coalesce(answer, F.lit("")))
    return let(folded, lambda t: F.array_compact(F.array(F.when(t.rlike("\\bkredi") & ~t.rlike("\\bkredi kart"), "kredi"), F.when(t.rlike("\\bmevduat"), "mevduat"))))
