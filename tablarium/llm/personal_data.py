"""Personal data: labelling functions vote on candidate spans, expectation-maximisation weighs them.

Votes are 1 (personal), -1 (not) or 0 (no opinion). What is counted for the model is one row per pattern of
votes, and one per value of a feature; both numbers are fixed by the functions below, not by the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import fresh, materialize, read, regex_spans, span_list

#: kind: (regular expression, whether it is a base kind). Lookbehinds only skip starts that cannot be leftmost.
KINDS = {
    "email": ("(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", True),
    "ip": ("(?<![0-9])[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", True),
    "card": ("(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){13,18}(?![\\x20-]?[0-9])", True),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", True),
    "local_phone": ("(?<![0-9+().-])(?<![0-9]\\x20)\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9])(?![\\x20.-][0-9])", False),
    "id_number": ("(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False),
    "account": ("(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", False),
}
BASE = tuple(k for k, (_, base) in KINDS.items() if base)

#: Gazetteers, fixed values.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "be", "pt", "us", "ca"]
CALLING_CODES = "^\\+(1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1368]|35[0-9]|37[0-9]|38[0-9]|42[013])"
CARD_ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|64|65|62|35)"
ACCOUNT_COUNTRIES = "^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE|TR)"
#: Words around a span that speak for or against personal data.
FOR = "(?i)(mail|phone|tel[:. ]|call|fax|mobile|contact|card|carte|tarjeta|karte|account|iban|konto|ssn|address|adresse|login|name|client|kunde)"
AGAINST = "(?i)(order|invoice|version|isbn|build|release|serial|part no|article|page|figure|table)"
AROUND = 40
VOTES = ("v_shape", "v_list", "v_context", "v_edge")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """The filter of a base kind, or whether another kind's number is well formed."""
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(m, "\\."), lambda x: x.cast("double") <= 255),
        "card": (n >= 14) & (n <= 19) & F.call_function("luhn_check", _digits(m)),
        "phone": (n >= 10) & (n <= 15),
        "local_phone": ~_digits(m).rlike("^[01]|^...[01]"),
        "id_number": ~m.rlike("^(000|666|9)|-00-|-0000$"),
        "account": n >= 10,
    }[kind]


def _listed(kind: str, m: Column) -> Column:
    """The gazetteers' vote."""
    sure = lambda c: F.when(c, 1).otherwise(-1)
    return {
        "email": sure(F.lower(F.element_at(F.split(m, "\\."), -1)).isin(*TOP_DOMAINS)),
        "ip": sure(~m.rlike("^(0|127|255|22[4-9]|23[0-9])\\.")),
        "card": sure(_digits(m).rlike(CARD_ISSUERS)),
        "phone": sure(m.rlike(CALLING_CODES)),
        "local_phone": F.lit(0),
        "id_number": F.lit(0),
        "account": sure(m.rlike(ACCOUNT_COUNTRIES)),
    }[kind]


def candidate_spans(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with the column `name`: structs s, k, e, kind, base, the VOTES and the features len and share of every candidate."""
    whole = fresh("whole", *docs.columns)
    docs = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    columns = []
    for order, (kind, (pattern, base)) in enumerate(KINDS.items()):
        found = regex_spans(F.col(whole), pattern)
        if base:
            found = F.filter(found, _checker(kind))
        columns.append(F.transform(found, _voter(F.col(whole), kind, order, base)))
    return docs.withColumn(name, F.array_sort(F.concat(*columns))).drop(whole)


def _checker(kind: str):
    return lambda x: _valid(kind, x["m"])


def _voter(t: Column, kind: str, order: int, base: bool):
    def votes(x: Column) -> Column:
        m = x["m"]
        start = F.greatest(x["s"] - AROUND, F.lit(0))
        before, after = F.substring(t, start + 1, x["s"] - start), F.substring(t, x["e"] + 1, F.lit(AROUND))
        near = F.concat(before, F.lit(" "), after)
        return F.struct(
            x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
            F.when(F.coalesce(_valid(kind, m), F.lit(False)), 1).otherwise(-1).alias("v_shape"), _listed(kind, m).alias("v_list"),
            F.when(near.rlike(AGAINST), -1).when(near.rlike(FOR), 1).otherwise(0).alias("v_context"),
            F.when(before.rlike("[\\p{L}\\p{N}_]$") | after.rlike("^[\\p{L}\\p{N}_]"), -1).otherwise(1).alias("v_edge"),
            F.least(F.length(m), F.lit(32)).alias("len"), F.round(F.length(_digits(m)) / F.length(m) * 4).cast("int").alias("share"),
        )

    return votes


@dataclass
class LabelModel:
    """What EM has learned: the prior, and P(vote | class) of each labelling function."""

    prior: float = 0.5
    likelihood: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)

    def posterior(self, votes: tuple[int, ...]) -> float:
        a, b = self.prior, 1 - self.prior
        for name, v in zip(VOTES, votes, strict=True):
            p, q = self.likelihood[name][v]
            a, b = a * p, b * q
        return a / (a + b)


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> LabelModel:
    """EM over the counts of vote patterns (at most 3 ** len(VOTES)); starts from the majority vote."""
    total = sum(n for _, n in patterns)
    soft = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns]
    model = LabelModel()
    for _ in range(rounds):
        mass = sum(p * n for p, (_, n) in zip(soft, patterns, strict=True))
        model.prior = (mass + 1) / (total + 2)
        for j, name in enumerate(VOTES):
            model.likelihood[name] = {
                x: (
                    (sum(p * n for p, (v, n) in zip(soft, patterns, strict=True) if v[j] == x) + 1) / (mass + 3),
                    (sum((1 - p) * n for p, (v, n) in zip(soft, patterns, strict=True) if v[j] == x) + 1) / (total - mass + 3),
                )
                for x in (-1, 0, 1)
            }
        soft = [model.posterior(v) for v, _ in patterns]
    return model


def _by_votes(model: LabelModel, x: Column) -> Column:
    """log P(personal | votes) / P(not | votes) as a column."""
    out = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, table in model.likelihood.items():
        odds = {v: math.log(p / q) for v, (p, q) in table.items()}
        out = out + F.when(x[name] == 1, odds[1]).when(x[name] == -1, odds[-1]).otherwise(odds[0])
    return out


@dataclass(frozen=True)
class SpanClassifier:
    """Log odds by kind, length and share of digits, and the prior's; trained on EM's probabilities."""

    prior: float
    odds: dict[str, dict]

    def score(self, x: Column) -> Column:
        out = F.lit(self.prior)
        for name, table in self.odds.items():
            part = F.lit(0.0)
            for value, odds in table.items():
                part = F.when(x[name] == value, odds).otherwise(part)
            out = out + part
        return out


def fit_span_classifier(spans: DataFrame, model: LabelModel) -> SpanClassifier:
    """Naive Bayes on features of spans (column x), weighted by what the label model thinks of their votes."""
    soft = 1 / (1 + F.exp(-_by_votes(model, F.col("x"))))
    features = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"x.{f}").cast("string").alias("v")) for f in ("kind", "len", "share")]))
    counts = spans.select(soft.alias("p"), features.alias("y")).groupBy("y.f", "y.v").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    total, mass = sum(c["n"] for c in counts if c["f"] == "kind"), sum(c["p"] for c in counts if c["f"] == "kind")
    values = {f: sum(c["f"] == f for c in counts) for f in ("kind", "len", "share")}
    odds: dict[str, dict] = {f: {} for f in values}
    for c in counts:
        yes, no = (c["p"] + 1) / (mass + values[c["f"]]), (c["n"] - c["p"] + 1) / (total - mass + values[c["f"]])
        odds[c["f"]][c["v"] if c["f"] == "kind" else int(c["v"])] = math.log(yes / no)
    return SpanClassifier(math.log((mass + 1) / (total - mass + 1)), odds)


def personal_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "spans") -> DataFrame:
    """The columns `keep` of docs and `name` (s, k, e, kind; by start, then kind): base spans, and others that the model takes.

    The votes of all candidates in all rows are counted. A span that isn't of a base kind stays if the label model's
    and the classifier's log odds have a positive mean. Null and empty texts have no spans; long texts are searched
    whole; repeated rows and null doc_ids are rows like others; without candidates nothing is fitted. A column of docs
    called like `name` isn't kept.
    """
    found = materialize(candidate_spans(docs.drop(name), name=name).select(*keep, name))
    spans = found.select(F.explode(name).alias("x"))
    patterns = spans.groupBy(*[F.col(f"x.{v}").alias(v) for v in VOTES]).count().collect()
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    if not patterns:
        return found.select(*keep, none.alias(name))
    model = fit_label_model([(tuple(r[v] for v in VOTES), r["count"]) for r in sorted(patterns)])
    classifier = fit_span_classifier(spans, model)
    taken = F.filter(name, lambda x: x["base"] | (_by_votes(model, x) + classifier.score(x) > 0))
    return found.select(*keep, F.transform(taken, lambda x: F.struct(x["s"], x["k"], x["e"], x["kind"])).alias(name))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs; see personal_spans()."""
    found = personal_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with each span, overlapping ones together, replaced by the first one's kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"))


QUERIES = {"op8_personal_data": op8_personal_data}
