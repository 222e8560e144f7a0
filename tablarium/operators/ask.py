"""Questions answered in one plan: parsed, answered once for each distinct request, quoted where nothing is stored, and guarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.spread import copies, spread
from tablarium.functions.text import tokenize
from tablarium.operators.answers import gates, label, show
from tablarium.operators.guard import guard
from tablarium.operators.rank import direction, numeric_key
from tablarium.operators.route import INTEREST_FIELD, route

_REQUEST = ["field", "intent", "term_min", "campaign_type", "banks"]
NO_PASSAGE, INCOMPARABLE, NO_CAMPAIGN = (
    "İlgili bir kampanya metni bulunamadı.", "Karşılaştırılabilir veri bulunamadı (değerler aralık veya farklı birimde olabilir).", "Bu kritere uyan kampanya bulunamadı.",
)


def parsed(questions: DataFrame, aliases: dict[str, str], scope: list[str]) -> DataFrame:
    """id, question, gates, handler, field, intent, term_min, campaign_type, banks of questions (id, question).

    A question for advice is answered with facts: without another field it asks for the list of profit rates.
    """
    read = questions.select("id", "question", gates(F.col("question"), scope).alias("gates"), route(F.col("question"), aliases).alias("r")).select("id", "question", "gates", "r.*")
    advice = F.array_contains("gates", "advice") & (F.col("handler") != "structured")
    return read.withColumns({
        "handler": F.when(F.array_contains("gates", "ruling") | F.array_contains("gates", "abstention"), "safety").when(advice, "structured").otherwise(F.col("handler")),
        "field": F.when(advice, F.coalesce("field", F.lit(INTEREST_FIELD))).otherwise(F.col("field")), "intent": F.when(advice, F.coalesce("intent", F.lit("list"))).otherwise(F.col("intent")),
    })


def _cells(stored: DataFrame, k: int) -> DataFrame:
    """Of each field, bank, type and term the k rows that come first in either order: no other row can be among the first k of any request."""
    first_term = stored.filter("field = 'vade_ay'").groupBy("campaign_id").agg(F.min_by("value", "seq")["num"].alias("months"))
    keyed = stored.join(first_term, "campaign_id", "left").withColumn("k", numeric_key(F.col("value"))).select("*", "k.*").drop("k")
    cell = ["field", "bank", "campaign_type", "months", "comparable"]
    ends = []
    value = F.when(F.col("comparable"), F.col("key"))  # what can't be compared goes by seq
    for order in (value.asc(), value.desc()):
        at = Window.partitionBy(*cell).orderBy(order, "seq")
        ends.append(keyed.withColumn("n", F.row_number().over(at)).filter(F.col("n") <= k).drop("n"))
    return ends[0].unionByName(ends[1]).dropDuplicates(["field", "campaign_id", "seq"])


def structured(requests: DataFrame, stored: DataFrame, k: int = 20) -> DataFrame:
    """QA4, QA5, QA6 for many requests at once: the columns of requests, body, sources.

    requests: distinct rows of field, intent, term_min, campaign_type, banks. stored: campaign_id, bank, campaign_type, field, value, seq.
    A request for the lowest or highest names the best comparable row; a list has the first k rows in the field's fair order, those that
    can't be compared last. sources: how many of the first k rows there are.
    """
    r = requests.withColumn("request", F.to_json(F.struct(*_REQUEST)))
    met = r.alias("r").join(_cells(stored, k).alias("x"), "field").filter(
        ((F.size("banks") == 0) | F.array_contains("banks", F.col("x.bank"))) & (F.col("r.campaign_type").isNull() | (F.col("r.campaign_type") == F.col("x.campaign_type")))
        & (F.col("term_min").isNull() | (F.col("months") >= F.col("term_min")))
    )
    falling = (F.col("intent") == "highest") | ((F.col("intent") == "list") & (direction(F.col("field")) != "lower_is_better"))
    order = [F.desc("comparable"), F.when(F.col("comparable"), F.when(falling, -F.col("key")).otherwise(F.col("key"))), F.col("seq")]
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*order))).filter(F.col("place") <= k)
    name, text = label(F.col("field")), show(F.col("field"), F.col("value"))
    note = F.when(F.col("comparable"), "").otherwise(F.concat(F.lit("  _(not: "), F.col("note"), F.lit(")_")))
    best = F.concat(F.when(F.col("intent") == "lowest", "en düşük ").otherwise("en yüksek "), name, F.lit(": **"), F.col("bank"), F.lit("** ("), text, F.lit(")."))
    shown = ranked.select("request", "place", "comparable", F.concat(F.lit("- "), F.col("bank"), F.lit(": "), text, note).alias("line"), best.alias("best"))
    said = shown.groupBy("request").agg(  # k rows each
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("sources"),
        F.min(F.when((F.col("place") == 1) & F.col("comparable"), F.col("best"))).alias("best"),
    )
    head = F.concat(F.coalesce(F.concat("campaign_type", F.lit(" — ")), F.lit("")), name, F.lit(" (uygun kampanyalar):\n"))
    whole = r.join(said, "request", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    body = F.when(F.col("intent").isin("lowest", "highest"), F.coalesce("best", F.lit(INCOMPARABLE))).when(F.col("sources") > 0, F.concat(head, F.col("lines"))).otherwise(NO_CAMPAIGN)
    return whole.select(*_REQUEST, body.alias("body"), "sources")


def quoted(questions: DataFrame, texts: DataFrame, k: int = 3, least: int = 2) -> DataFrame:
    """QA7, QA13 for many questions: id, body, sources: the text that shares most words with the question, and how many of the best k there are.

    texts: id, bank, text. Words meet through an index of the questions' words only; a text has to share `least` of them. Of equal
    questions one is asked, and of equal texts the first is met; the k best of these hold the k best of all (see embed.nearest()).
    """
    ids, members = copies(questions, "question", ["id"]), copies(texts.select(F.col("id").alias("text_id"), "text"), "text", ["text_id"], k)
    words = ids.groupBy("copy").agg(F.first("question").alias("question")).select(F.col("copy").alias("asked"), F.explode(F.array_distinct(tokenize(F.col("question")))).alias("token"))
    index = members.filter("nth = 1").select("copy", "text_id", F.explode(tokenize(F.col("text"), distinct=True)).alias("token"))
    overlap = words.join(index, "token").groupBy("asked", "copy", "text_id").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= least)
    order = Window.partitionBy("asked").orderBy(F.desc("overlap"), "text_id")
    first = lambda df: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    met = first(first(overlap).drop("text_id", "place").join(members.select("copy", "text_id"), "copy"))
    top = ids.select("id", F.col("copy").alias("asked")).join(met, "asked")
    best = top.groupBy("id").agg(F.count("*").alias("sources"), F.min(F.when(F.col("place") == 1, F.col("text_id"))).alias("text_id"))
    shown = best.join(texts.select(F.col("id").alias("text_id"), "bank", "text"), "text_id")
    return shown.select("id", F.concat(F.lit("İlgili kampanya ("), F.col("bank"), F.lit("): "), F.col("text")).alias("body"), "sources")


def ask(questions: DataFrame, stored: DataFrame, texts: DataFrame, aliases: dict[str, str], scope: list[str], k: int = 20) -> DataFrame:
    """QA14: id, handler, field, intent, answer, gates, abstained, sources, violations, soft_terms of questions (id, question).

    Equal questions are read and answered once, and distinct requests looked up once. A question without sources abstains; one that is
    out of scope or asks for a ruling isn't looked up.
    """
    ids = copies(questions, "question", ["id"])
    one = spread(ids.groupBy("copy").agg(F.first("question").alias("question")))  # reading a question takes about a millisecond
    read = parsed(one.select(F.col("copy").alias("id"), "question"), aliases, scope)
    bodies = structured(read.filter("handler = 'structured'").select(*_REQUEST).distinct(), stored, k)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _REQUEST]
    quotes = quoted(read.filter("handler = 'rag'").select("id", "question"), texts).select("id", F.col("body").alias("quote"), F.col("sources").alias("quotes"))
    met = read.alias("a").join(bodies.alias("b"), same, "left").select("a.*", F.col("b.body").alias("known"), F.col("b.sources").alias("rows")).join(quotes, "id", "left")
    of = lambda structured, rag, safety: F.when(F.col("handler") == "structured", structured).when(F.col("handler") == "rag", rag).otherwise(safety)
    every = met.withColumns({"body": of(F.col("known"), F.coalesce("quote", F.lit(NO_PASSAGE)), F.lit("")), "sources": of(F.col("rows"), F.coalesce("quotes", F.lit(0)), F.lit(1))})
    checked = guard(F.col("body"), F.col("gates"), F.col("sources") > 0, (F.col("handler") == "structured") & (F.col("field") == INTEREST_FIELD))
    answers = every.select(F.col("id").alias("copy"), "handler", "field", "intent", F.coalesce("sources", F.lit(0)).alias("sources"), checked.alias("g"))
    return ids.select("id", "copy").join(answers, "copy").select("id", "handler", "field", "intent", "sources", "g.*")
