"""Language-model output as columns: the JSON object in it, what is wrong with it, and confidences of its values from token probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.functions.spread import dealt
from tablarium.functions.text import let, match_spans

#: Blocks before an answer, fences around it, commas that end a list, white space of JSON, bounds of a confidence.
THOUGHT, OPEN_THOUGHT = "(?is)<think>.*?</think>", "(?is)<think>.*"
FENCE = "(?s)```(?:json|JSON)?\\s*(.*?)(?:```|\\z)"
LAST_COMMA = ",\\s*([}\\]])"
SPACE = "[ \\t\\r\\n]*"
LEAST, MOST = 0.01, 0.99


#: Nested brackets that one pattern follows; deeper ones are counted.
_LEVELS = 8


def _closed(begin: str, end: str) -> str:
    """A pattern of `begin` and all up to the `end` that closes it; possessive, so that it reads a text once and doesn't recurse."""
    string, plain = '"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"', f'[^\\{begin}\\{end}"]*+'
    inner = string
    for _ in range(_LEVELS):
        whole = f"\\{begin}{plain}(?:{inner}{plain})*+\\{end}"
        inner = f"(?:{string}|{whole})"
    return whole


def balanced(text: Column, begin: str = "{", end: str = "}") -> Column:
    """struct s, e: the first `begin` and the end after the `end` that closes it; null without one, or if it stays open. Brackets within strings don't count."""

    def found(t: Column, whole: Column) -> Column:
        s = F.position(F.lit(begin), t) - 1
        return F.when(whole != "", F.struct(s.alias("s"), (s + F.length(whole)).alias("e"))).when(t.contains(begin), _counted(t, begin, end))

    return let(text, lambda t: let(F.regexp_extract(t, f"(?s)\\A[^\\{begin}]*+({_closed(begin, end)})", 1), lambda whole: found(t, whole)))


def _counted(text: Column, begin: str, end: str) -> Column:
    """balanced() for any depth: an automaton over the places of brackets, quotes and backslashes, whose state is the depth, whether
    a string is open, and which character a backslash has taken its meaning from."""
    events = lambda t: match_spans(t, f'[\\{begin}\\{end}"\\\\]')
    none = F.lit(None).cast("int")

    def step(a: Column, x: Column) -> Column:
        m, running = x["m"], a["s"].isNotNull() & a["e"].isNull()
        free = running & (a["skip"] != x["s"])  # not after a backslash
        start = F.coalesce(a["s"], F.when(m == begin, x["s"]))
        inside = a["quoted"]
        depth = F.when(a["s"].isNull(), F.when(m == begin, 1).otherwise(0)).when(free & ~inside, a["depth"] + F.when(m == begin, 1).when(m == end, -1).otherwise(0)).otherwise(a["depth"])
        return F.struct(
            start.alias("s"), F.coalesce(a["e"], F.when(free & ~inside & (m == end) & (a["depth"] == 1), x["e"])).alias("e"), depth.alias("depth"),
            F.when(free & (m == '"'), ~inside).otherwise(inside).alias("quoted"), F.when(free & inside & (m == "\\"), x["s"] + 1).otherwise(a["skip"]).alias("skip"),
        )

    first = F.struct(none.alias("s"), none.alias("e"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(-1).alias("skip"))
    return let(F.aggregate(events(text), first, step), lambda a: F.when(a["e"].isNotNull(), F.struct(a["s"].alias("s"), a["e"].alias("e"))))


def _part(text: Column, span: Column) -> Column:
    return F.substring(text, span["s"] + 1, span["e"] - span["s"])


def read_object(text: Column) -> Column:
    """Struct json, error: the first whole object in a model's answer as valid JSON, or why there is none; never raises.

    Thoughts and fences go first. An object that isn't valid is tried without commas before closing brackets, then with double
    quotes for single ones if it has none. error: empty, nothing left, not closed, no object, not JSON.
    """
    no = lambda why: F.struct(F.lit(None).cast("string").alias("json"), F.lit(why).alias("error"))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, THOUGHT, ""), OPEN_THOUGHT, "")

    def unfenced(t: Column) -> Column:
        return let(F.regexp_extract(t, FENCE, 1), lambda f: F.regexp_replace(F.when(f.rlike("\\S"), f).otherwise(t), "^\\s+|\\s+$", ""))

    def mended(c: Column) -> Column:
        shorter = F.regexp_replace(c, LAST_COMMA, "$1")
        doubled = F.when(c.contains('"'), shorter).otherwise(F.replace(shorter, F.lit("'"), F.lit('"')))
        good = F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (c, shorter, doubled)])
        return let(good, lambda g: F.when(g.isNotNull(), F.struct(g.alias("json"), F.lit(None).cast("string").alias("error"))).otherwise(no("not JSON")))

    def found(t: Column) -> Column:
        missing = F.when(t.contains("{"), no("not closed")).otherwise(no("no object"))
        return F.when(t == "", no("nothing left")).otherwise(let(balanced(t), lambda span: F.when(span.isNull(), missing).otherwise(let(_part(t, span), mended))))

    return F.when(text.isNull() | ~text.rlike("\\S"), no("empty")).otherwise(let(let(bare(text), unfenced), found))


def _value(text: Column) -> Column:
    """The length of the JSON value that text begins with; null if it doesn't end."""
    of = lambda span: F.when(span["s"] == 0, span["e"])
    string, scalar = F.length(F.regexp_extract(text, '^"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"', 0)), F.length(F.regexp_extract(text, "^[^,}\\] \\t\\r\\n]+", 0))
    return (
        F.when(text.startswith('"'), F.nullif(string, F.lit(0))).when(text.startswith("{"), let(balanced(text), of))
        .when(text.startswith("["), let(balanced(text, "[", "]"), of)).otherwise(F.nullif(scalar, F.lit(0)))
    )


def value_span(text: Column, field: str) -> Column:
    """struct s, e: where the "value" of the object under `field` stands within the first whole object of the text; null without it."""
    return F.get(value_spans(text, [field]), F.lit(0))["at"]


def value_spans(text: Column, fields: list[str]) -> Column:
    """array of structs field, at: value_span() of each field."""

    key = lambda name: f'.*?"{name}"{SPACE}:{SPACE}'
    after = lambda t, name: F.nullif(F.length(F.regexp_extract(t, f"(?s)\\A{key(name)}", 0)), F.lit(0))  # noqa: E731, where the value of the first such key begins

    def held(whole: Column, field: str) -> Column:
        """The object under the first such key; null if there is another value."""
        deep = let(after(whole, field), lambda at: let(F.substring(whole, at + 1, F.length(whole)), lambda r: F.when(r.startswith("{"), let(balanced(r), lambda b: _part(r, b)))))
        return let(F.regexp_extract(whole, f"(?s)\\A(?>{key(field)})({_closed('{', '}')})", 1), lambda h: F.when(h != "", h).otherwise(deep))

    def inside(outer: Column, whole: Column, field: str) -> Column:
        def made(h: Column, v: Column) -> Column:
            start = outer["s"] + after(whole, field) + v
            return let(_value(F.substring(h, v + 1, F.length(h))), lambda n: F.when(n > 0, let(start, lambda s: F.struct(s.alias("s"), (s + n).alias("e")))))

        return let(held(whole, field), lambda h: let(after(h, "value"), lambda v: F.when(v > 0, made(h, v))))

    each = lambda outer, whole: F.array(*[F.struct(F.lit(f).alias("field"), inside(outer, whole, f).alias("at")) for f in fields])
    return let(text, lambda t: let(balanced(t), lambda outer: let(_part(t, outer), lambda whole: each(outer, whole))))


def field_confidences(tokens: DataFrame, fields: list[str]) -> DataFrame:
    """Id, field, confidence of each field with a value in the answer that tokens (id, pos, token, logprob) spell.

    A running sum of lengths places each token; those that overlap a value count, and exp of their mean logarithm is the
    confidence, from 0.01 to 0.99 (not a number: 0.01). Answers without a whole object, and values without tokens, give no row.
    """
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = dealt(tokens.filter("id is not null").select("id", "pos", F.coalesce("token", F.lit("")).alias("token"), "logprob"), "id")
    placed = known.withColumn("e", F.sum(F.length("token")).over(before)).withColumn("s", F.col("e") - F.length("token"))
    # an answer is as long as a model may write
    answers = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "e", "token", "logprob"))).alias("x"))
    text = F.array_join(F.col("x.token"), "")

    def mean(at: Column) -> Column:
        add = lambda a, t: F.struct((a["sum"] + t["logprob"]).alias("sum"), (a["n"] + 1).alias("n"))
        met = F.filter("x", lambda t: (t["s"] < at["e"]) & (t["e"] > at["s"]) & t["logprob"].isNotNull())
        return F.aggregate(met, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), add, lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]))

    found = answers.select("id", F.explode_outer(F.transform(value_spans(text, fields), lambda v: F.struct(v["field"].alias("field"), F.when(v["at"].isNotNull(), mean(v["at"])).alias("mean")))).alias("v"))
    said = found.filter("v.mean is not null").select("id", "v.*")
    return said.select("id", "field", F.when(F.isnan("mean"), LEAST).otherwise(F.greatest(F.least(F.exp("mean"), F.lit(MOST)), F.lit(LEAST))).alias("confidence"))
