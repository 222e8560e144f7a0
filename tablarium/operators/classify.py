"""Campaign types by keyword hits, and the choice between extraction layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.text import keyword_regex, let, tr_fold_ascii

#: Keywords (folded) by type, special types before general ones.
TYPES = {
    "Konut Finansmanı": ["konut", "ev", "mortgage", "konut finansman"],
    "Taşıt Finansmanı": ["tasit", "arac", "otomobil", "araba"],
    "İhtiyaç Finansmanı": ["ihtiyac", "ihtiyac finansman"],
    "Alışveriş Puanı": ["puan", "alisveris puani", "chip-para"],
    "Yeni Müşteri": ["yeni musteri", "ilk kez", "hos geldin"],
    "Yatırım Ürünü": ["yatirim", "katilma hesabi", "katilim fonu", "altin hesabi", "fon"],
    "Kart": ["kredi karti", "kart", "bonus", "kartiniz"],
    "Finansman": ["finansman", "kredi"],
}
LAYERS = {"rule": 3, "ner": 2, "llm": 1}


def campaign_type(text: Column) -> Column:
    """Struct type, confidence; most distinct keywords, then the earlier type. No keyword: null type, 0."""
    return let(tr_fold_ascii(text), _type)


def _type(low: Column) -> Column:
    scores = [
        F.struct(sum((low.rlike(keyword_regex([w])).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-k).alias("rank"), F.lit(name).alias("type"))
        for k, (name, words) in enumerate(TYPES.items())
    ]
    kind = lambda best: F.struct(F.when(best["hits"] > 0, best["type"]).alias("type"), F.when(best["hits"] > 0, F.least(F.lit(0.9), 0.5 + 0.1 * best["hits"])).otherwise(0.0).alias("confidence"))
    return let(F.array_max(F.array(*scores)), kind)


def reconcile(fields: DataFrame, keys: list[str], by_confidence: bool = False) -> DataFrame:
    """One row of each key: the strongest layer, then confidence, then the smallest seq. by_confidence: without layers."""
    layer = F.coalesce(*[F.when(F.col("extractor") == k, v) for k, v in LAYERS.items()], F.lit(0))
    order = [F.col("confidence").desc(), F.col("seq")]
    w = Window.partitionBy(*keys).orderBy(*([] if by_confidence else [layer.desc()]), *order)
    return fields.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
