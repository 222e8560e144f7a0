"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of five-word shingles and multi-index hashing find the closest ones. Fingerprints of texts at 0.8
differ in some ten of 64 bits, beyond what balls of few bits reach, so prefix filtering finds the links that are left:
shingles have one global order, and two sets that similar share a shingle among the first m - ceil(0.8 m) + 1 of each.
Shingles that are common in a sample come last, which keeps the lists short; any order gives the same result.

Texts of sizes m and k that first meet at places p and q can share min(m - p, k - q) shingles at most, so they are compared
only if 9 min(m - p, k - q) >= 4 (m + k). A list's members are first compared with the one that has the shingle earliest.
What a list then holds outside its largest component is compared with the others that it can still meet. Texts in lists with
many such members, as those that share a passage only, are compared by parts instead: shingles are dealt into more parts than
similar texts can differ in, so such texts have a whole part in common, which texts that share a passage rarely do. No
candidate is left out, and each is checked by its whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablarium.llm.common import broadcast_if_small, discard, fresh, map_arrow, materialize, parts
from tablarium.llm.components import connected_components
from tablarium.llm.simhash import fingerprints, links

SIZE = 5
#: The least similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: The order of shingles is learned from one in SHARE of the texts, LEAST_TEXTS at least, and holds at most so many common shingles.
SHARE, LEAST_TEXTS, MAX_COMMON = 16, 2_000, 1_000_000
#: A shingle in one of so many texts of the sample is hot: its list is never put in order by one task.
HOT = 50
#: Members of lists with more of them outside the largest component are compared by parts.
MANY = 64
#: Parts that texts of a size have over those they can differ in, as a share of these, which leaves room for empty parts.
SPARE = 0.15
#: Counts of a text's shingles by so many ranges of their hashes bound what two texts can share.
RANGES = 256


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; a shorter text is one run, one without words has none."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SIZE:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-SIZE])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, (ends[SIZE - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def with_node(docs: DataFrame) -> DataFrame:
    """docs, written, with row (unique) and node, the smallest row that has the same words (told by 128 bits of hash)."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    kinds = ", ".join(f"`{c}` {t}" for c, t in numbered.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [xxhash.xxh3_128_digest(b" ".join(_words(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.binary())], [*batch.schema.names, "said"])

    return materialize(map_arrow(numbered, run, f"{kinds}, said binary"))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that three or more texts of a sample have, and whether each is hot."""
    n = texts.count()
    share = min(1_000_000, max(1_000_000 // SHARE, 1_000_000 * LEAST_TEXTS // max(1, n) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["h"])

    seen = map_arrow(texts.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share).select("text"), run, "h long")
    rows = seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(MAX_COMMON).toArrow()
    hashes, counts = rows["h"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order], counts[order] * HOT > n * share / 1_000_000


def _by_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and shingles of some texts at a time: one record batch a text costs more than its shingles, all at once too much memory."""
    for batch in batches:
        for s, e in parts(batch.column(1)):
            if s < e:
                part = batch.slice(s, e - s)
                yield part.column(0).to_numpy(), [shingles(t.as_py()) for t in part.column(1)]


def prefixes(texts: DataFrame) -> DataFrame:
    """h, node, m, p, hot: of each text, which has m shingles, the first m - ceil(0.8 m) + 1 by their places p."""
    sent = texts.sparkSession.sparkContext.broadcast(_common(texts))

    def first(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts, hot = sent.value
        n, of = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if len(hashes):
            at = np.searchsorted(hashes, h).clip(max=len(hashes) - 1)
            known = hashes[at] == h
            n, of = np.where(known, counts[at], 0), known & hot[at]
        best = np.lexsort((h, n))[: len(h) - -(-NUM * len(h) // DEN) + 1]
        return h[best], of[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in _by_parts(batches):
            heads, m = [first(h) if len(h) else (h, h > 0) for h in sets], np.fromiter(map(len, sets), np.int32, len(sets))
            n = np.fromiter((len(h) for h, _ in heads), np.int64, len(heads))
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            columns = [np.concatenate([h for h, _ in heads]).view(np.int64), np.repeat(nodes, n), np.repeat(m, n), place, np.concatenate([x for _, x in heads])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "m", "p", "hot"])

    return map_arrow(texts.select("node", "text"), run, "h long, node long, m int, p int, hot boolean")


def _arrays(texts: DataFrame, of_set: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """node and s, an array of what of_set makes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in _by_parts(batches):
            made = [of_set(h) for h in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))], ["node", "s"])

    return map_arrow(texts.select("node", "text"), run, f"node long, s array<{kind}>")


def _sets(texts: DataFrame) -> DataFrame:
    """node and its shingles' hashes."""
    return _arrays(texts, lambda h: h.view(np.int64), "long")


def _counts(texts: DataFrame) -> DataFrame:
    """node and the number of its shingles in each range of hashes."""
    width = np.uint64((1 << 64) // RANGES)
    return _arrays(texts, lambda h: np.bincount((h // width).astype(np.int64), minlength=RANGES).astype(np.int32), "int")


def _where(pairs: DataFrame, texts: DataFrame, of_text: Callable[[DataFrame], DataFrame], n: Callable[[str], Column], same: Column) -> DataFrame:
    """a, b of the written pairs whose arrays x and y, from of_text, have n(x) and n(y) shingles and a similarity of 0.8 if they share `same`."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sides = materialize(of_text(texts.join(broadcast_if_small(ends), "node", "left_semi")))
    both = pairs.join(sides.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sides.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    out = materialize(both.filter(DEN * same >= NUM * (n("x") + n("y") - same)).select("a", "b"))
    del both
    discard(ends, sides)
    return out


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """src, dst of the pairs (a, b) that are similar enough, by their whole sets. Counts by ranges first rule out most of the others."""
    pairs = materialize(pairs.distinct())
    least = F.aggregate(F.zip_with("x", "y", lambda v, w: F.least(v, w)), F.lit(0), lambda n, v: n + v)
    left = _where(pairs, texts, _counts, lambda c: F.aggregate(c, F.lit(0), lambda n, v: n + v), least)
    out = _where(left, texts, _sets, F.size, F.size(F.array_intersect("x", "y")))
    discard(pairs, left)
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _close(texts: DataFrame) -> DataFrame:
    """a, b: the first text of each fingerprint with its other texts, and with that of one fingerprint three or fewer bits away, if any."""
    marked = materialize(fingerprints(texts, "node", size=SIZE))
    firsts = materialize(marked.groupBy("fp").agg(F.min("node").alias("first")))
    spread = firsts.select("fp").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = links(spread).groupBy("b").agg(F.min("a").alias("a"))  # the filter below finds all other links
    across = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("f")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("g")), "b")
    within = marked.join(firsts, "fp").filter("node <> first")
    out = materialize(across.select(F.col("f").alias("a"), F.col("g").alias("b")).unionByName(within.select(F.col("first").alias("a"), F.col("node").alias("b"))))
    discard(marked, firsts)
    return out


def _can_meet() -> Column:
    """Whether texts of m and k shingles that meet at their places p and q can be similar enough."""
    return (NUM + DEN) * F.least(F.col("m") - F.col("p"), F.col("k") - F.col("q")) >= NUM * (F.col("m") + F.col("k"))


def _largest() -> Column:
    """The largest k for which that can hold, whatever q."""
    return (DEN * F.col("m") - (NUM + DEN) * F.col("p")) / NUM


def _lists(heads: DataFrame) -> DataFrame:
    """h, node, m, p of heads whose shingle others have too, with a, k, q: node, size and place of the one that has it earliest."""
    at = Window.partitionBy("h").orderBy("p", "node")
    first = F.struct("p", "node", "m")
    cold = heads.filter("not hot").select("h", "node", "m", "p", F.first(first).over(at).alias("first"), F.lead("node").over(at).alias("next"))
    cold = cold.filter("node <> first.node or next is not null").drop("next")
    # hot shingles are known from the sample, so there are MAX_COMMON at most; their leaders are found by partial sums
    hot = heads.filter("hot").select("h", "node", "m", "p")
    leaders = hot.groupBy("h").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = cold.unionByName(hot.join(F.broadcast(leaders), "h"))
    return both.select("h", "node", "m", "p", F.col("first.node").alias("a"), F.col("first.m").alias("k"), F.col("first.p").alias("q"))


def _shared(lists: DataFrame) -> DataFrame:
    """The rows of lists (h, node, m, p) that aren't alone in theirs. A list has a text once at most, and a text is in dozens of lists."""
    at = Window.partitionBy("h").orderBy("node")
    near = lists.withColumns({"before": F.lag("node").over(at), "after": F.lead("node").over(at)})
    return near.filter("before is not null or after is not null").drop("before", "after")


def _across(lists: DataFrame, of: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """a, b of the pairs of different components that can meet in one list (h, node, m, p), and the members of the lists that are left out.

    Left out are lists with over `most` members outside their largest component; none if that is None.
    """
    rows = lists.join(broadcast_if_small(of), "node", "left").select("h", "node", "m", "p", F.coalesce("component", "node").alias("c"), _largest().alias("u"))
    rows = materialize(rows)
    kinds = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("u").alias("most"))
    seen = kinds.groupBy("h").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("kinds"), F.min("least").alias("least"), F.max("most").alias("most")).filter("kinds > 1")
    marked = materialize(rows.join(seen, "h").select("h", "node", "m", "p", "c", "u", (F.col("c") != F.col("main")).alias("other"), ((F.col("u") >= F.col("least")) & (F.col("m") <= F.col("most"))).alias("open")))
    others = marked.filter("other and open")
    per = others.groupBy("h").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("u").alias("most"))
    met = materialize(marked.filter("open").join(per, "h").filter("other or (m <= most and u >= least)").select("h", "node", "m", "p", "c", "other", "n"))
    discard(rows, marked)
    many = F.col("n") > most if most is not None else F.lit(False)
    now = met.filter(~many)
    found = now.filter("other").join(now.select("h", F.col("node").alias("a"), F.col("m").alias("k"), F.col("p").alias("q"), F.col("c").alias("d")), "h").filter("c <> d").filter(_can_meet())
    return found.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), met.filter(many)


def _classes(most: int) -> list[int]:
    """The sizes at which classes begin, up to that of `most`: texts that similar are of one class or of neighbouring ones."""
    at = [1]
    while at[-1] <= most:
        at.append(at[-1] * DEN // NUM + 1)
    return at


def parts_of(h: np.ndarray, begins: list[int]) -> np.ndarray:
    """Keys of a set's parts, for its size class and the next one; similar sets share one of them.

    Sets of up to K shingles that similar differ in d = 2 K (DEN - NUM) / (DEN + NUM) shingles at most, so of d + 1 parts or more
    they have k - d whole ones in common. A set with so many empty parts has a key for that, as those may be the common ones.
    """
    kind, out = int(np.searchsorted(begins, len(h), side="right")), []
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for group in (kind, kind + 1):
        most = begins[group] - 1
        differ = 2 * most * (DEN - NUM) // (DEN + NUM)
        k = int((differ + 1) * (1 + SPARE)) + 1
        part = ((mixed >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, part.astype(np.int64), mixed)
        some = np.flatnonzero(np.bincount(part.astype(np.int64), minlength=k))
        salt = np.uint64((group * 0x9E3779B97F4A7C15) & (2**64 - 1))
        keys = (sums[some] ^ (some.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) ^ salt) * np.uint64(0xD6E8FEB86659FD93)
        out.append(keys if k - len(some) < k - differ else np.append(keys, salt))
    return np.concatenate(out)


def _by_part(texts: DataFrame) -> DataFrame:
    """h, node, m, p (0): lists by the parts of the shingles of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in _by_parts(batches):
            begins = _classes(max(map(len, sets), default=1) * 2)
            keys = [parts_of(h, begins) if len(h) else h for h in sets]
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            columns = [np.concatenate(keys).view(np.int64), np.repeat(nodes, n), np.repeat(np.fromiter(map(len, sets), np.int32, len(sets)), n), np.zeros(n.sum(), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "m", "p"])

    return map_arrow(texts.select("node", "text"), run, "h long, node long, m int, p int")


def near_copy_components(texts: DataFrame) -> DataFrame:
    """node and component (smallest node reachable over similar pairs) of each linked node of texts (node, text; nodes are distinct)."""
    heads = materialize(prefixes(texts))
    lists = materialize(_lists(heads))
    discard(heads)
    led = lists.filter("node <> a").filter(_can_meet()).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    edges = _similar(_close(texts).unionByName(led), texts)
    of = materialize(connected_components(edges))
    few, members = _across(lists.select("h", "node", "m", "p"), of, MANY)
    found = materialize(few)
    many = materialize(members.select("node").distinct())
    if not many.isEmpty():
        chosen = texts.join(broadcast_if_small(many), "node", "left_semi")
        shared = materialize(_shared(_by_part(chosen)))
        found = found.unionByName(materialize(_across(shared, of, None)[0]))
        discard(shared)
    new = _similar(found, texts)
    discard(lists, many)
    out = materialize(connected_components(edges.unionByName(new)))
    return out


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Of each group of rows linked by similar texts the one with the smallest doc_id stays; a null doc_id comes last.

    Rows are told apart by a number of their own, so repeated and null doc_ids are rows like others. Null and empty texts, of
    no words, are copies of each other; very long texts are compared whole; other columns stay, whatever their names.
    """
    columns, aside = docs.columns, {c: fresh(f"{c}_", *docs.columns) for c in docs.columns if c.lower() in ("row", "said")}
    marked = with_node(docs.withColumnsRenamed(aside))
    known = marked.select("row", "doc_id", "said")
    one = materialize(known.groupBy("said").agg(F.min("row").alias("node")))
    nodes = materialize(known.join(one, "said").select("row", "doc_id", "node"))
    texts = marked.select(F.col("row").alias("node"), "text").join(broadcast_if_small(one.select("node")), "node", "left_semi")
    of = near_copy_components(texts)
    rows = nodes.join(broadcast_if_small(of), "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("c"))
    stay = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("f")).select(F.col("f.row").alias("row"))
    gone = materialize(nodes.select("row").join(stay, "row", "left_anti"))
    return marked.join(broadcast_if_small(gone), "row", "left_anti").select(*[F.col(aside.get(c, c)).alias(c) for c in columns])
