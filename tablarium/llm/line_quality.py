"""Quality classifier: a linear-chain conditional random field marks every line of a text good or bad.

A line's potential is the sum of weights of its binned features and of those of the lines before and after it; transitions
join neighbours. Forward-backward gives each line's probability of being good, and a text's score is their mean, weighted by
the lines' lengths. Weights are fitted on a bounded sample of labelled texts, whose lines all carry their text's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.llm.common import map_arrow, parts, read

FEATURES = ("length", "words", "word_length", "symbols", "capitals", "digits", "exclamations", "stops", "repeated_words", "commonest_run", "copy", "same_as_last")
#: Bytes by kind: space, small letter, capital, digit, symbol, exclamation or question mark, stop; what isn't ASCII is a small letter.
_SPACE, _SMALL, _CAPITAL, _DIGIT, _SYMBOL, _CRY, _STOP = range(7)
_KINDS = np.full(256, _SYMBOL, np.uint8)
_KINDS[128:] = _SMALL
_KINDS[: ord(" ") + 1] = _SPACE
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz'-", _SMALL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _CAPITAL), ("0123456789", _DIGIT), ("!?", _CRY), (".,;:", _STOP)):
    _KINDS[list(_chars.encode())] = _kind


@dataclass(frozen=True)
class Field:
    """A fitted field. cuts: of each feature; own, before, after: weights by feature and bin (the last bin: no such line); moves[a, b]: from a to b, 1 is good."""

    cuts: tuple[np.ndarray, ...]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES of each line of some texts (null: empty), how many lines each text has, and the lines' characters.

    A text of n newlines has n + 1 lines, so every text has one.
    """
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = split.flatten()
    count = np.diff(split.offsets.to_numpy())
    of = np.repeat(np.arange(len(count)), count)
    n = len(lines)
    chars = pc.utf8_length(lines).to_numpy().astype(np.int64)
    size = pc.binary_length(lines).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    # whole buffers of bytes: each kind is counted by running sums
    raw = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in pa.chunked_array([lines.cast(pa.binary())]).combine_chunks()), np.uint8) if n else np.empty(0, np.uint8)
    kinds = _KINDS[raw]

    def counted(of_kind: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of_kind, dtype=np.int64)))
        return total[ends] - total[ends - size]

    by = {k: counted(kinds == k) for k in (_SPACE, _CAPITAL, _DIGIT, _SYMBOL, _CRY, _STOP)}
    solid = np.maximum(size - by[_SPACE], 1)
    letters = np.maximum(solid - by[_DIGIT] - by[_SYMBOL] - by[_CRY] - by[_STOP], 1)
    split_words = pc.ascii_split_whitespace(lines)
    words = split_words.flatten()
    per_line = np.diff(split_words.offsets.to_numpy())
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # lines of spaces split into empty words
    word_line = np.repeat(np.arange(n), per_line)[filled]
    code = words.filter(pa.array(filled)).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_words = np.bincount(word_line, minlength=n)
    pairs, times = np.unique(word_line * (code.max(initial=0) + 1) + code, return_counts=True)
    at = pairs // (code.max(initial=0) + 1)
    distinct = np.bincount(at, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, at, times)
    line = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first = np.unique(of * (n + 1) + line, return_index=True)
    again = np.ones(n, bool)
    again[first] = False
    last = np.zeros(n, bool)
    last[1:] = (line[1:] == line[:-1]) & (of[1:] == of[:-1])
    some = np.maximum(n_words, 1)
    columns = (
        np.log1p(chars), np.log1p(n_words), solid / some, by[_SYMBOL] / solid, by[_CAPITAL] / letters, by[_DIGIT] / solid, by[_CRY] / solid, by[_STOP] / solid,
        1 - distinct / some, most / some, again & (size > 0), last,
    )
    return np.stack([np.asarray(c, np.float32) for c in columns], 1), count, chars


def _codes(features: np.ndarray, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """The bin of each line's features."""
    return np.stack([np.searchsorted(c, features[:, k]) for k, c in enumerate(cuts)], 1)


class _Chains:
    """Texts as chains of lines, worked on together: position by position, the longest texts first."""

    def __init__(self, count: np.ndarray):
        order = np.argsort(-count, kind="stable")
        first = (np.cumsum(count) - count)[order]
        active = np.searchsorted(-count[order], -np.arange(1, int(count.max(initial=0)) + 1), side="right")
        self.at = [first[:k] + t for t, k in enumerate(active.tolist())]
        starts = np.cumsum(count) - count
        self.has_before = np.ones(int(count.sum()), bool)
        self.has_before[starts] = False
        self.has_after = np.ones(int(count.sum()), bool)
        self.has_after[starts + count - 1] = False

    def shifted(self, codes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the lines before and after each; `none` where there is no such line."""
        before, after = np.full_like(codes, none), np.full_like(codes, none)
        before[self.has_before] = codes[:-1][self.has_before[1:]]
        after[self.has_after] = codes[1:][self.has_after[:-1]]
        return before, after

    def marginals(self, score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each line is good, given its score (good less bad), and the expected number of moves by kind."""
        fore, back = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        for t, now in enumerate(self.at):
            if t:
                was = fore[self.at[t - 1][: len(now)]]
                for y in (0, 1):
                    fore[now, y] = np.logaddexp(was[:, 0] + moves[0, y], was[:, 1] + moves[1, y])
            fore[now, 1] += score[now]
        pairs = np.zeros((2, 2))
        for t in range(len(self.at) - 2, -1, -1):
            then = self.at[t + 1]
            now = self.at[t][: len(then)]
            ahead = back[then] + np.stack((np.zeros(len(then)), score[then]), 1)
            for y in (0, 1):
                back[now, y] = np.logaddexp(ahead[:, 0] + moves[y, 0], ahead[:, 1] + moves[y, 1])
            both = fore[now][:, :, None] + moves + ahead[:, None, :]
            whole = np.logaddexp(fore[now, 0] + back[now, 0], fore[now, 1] + back[now, 1])
            share = np.exp(both - whole[:, None, None])
            pairs += (share * self.weight[now][:, None, None] if self.weight is not None else share).sum(0)
        total = fore + back
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700))), pairs

    #: If set, what each line's moves count for.
    weight: np.ndarray | None = None


def _potential(field: Field, codes: np.ndarray, chains: _Chains) -> np.ndarray:
    places = np.arange(codes.shape[1])
    before, after = chains.shifted(codes, field.own.shape[1] - 1)
    return field.own[places, codes].sum(1) + field.before[places, before].sum(1) + field.after[places, after].sum(1)


def fit(features: np.ndarray, count: np.ndarray, good: np.ndarray, *, bins: int = 12, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """A field from the lines of labelled texts (good: 1 or 0 by text). Each text weighs the same; Adam on the penalised log-likelihood.

    With texts of one class only, or none, every line has that class's share, or a half, as its probability.
    """
    quantiles = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) if len(f) else np.empty(0) for f in features.T] if len(count) else [np.empty(0)] * len(FEATURES)
    # rare values matter more than the common ones: a cut above zero is one too
    cuts = tuple(np.unique(np.concatenate((q, [f[f > 0].min() / 2, *np.quantile(f[f > 0], (0.5, 0.9))]))) if len(f) and (f > 0).any() else q for q, f in zip(quantiles, features.T, strict=True)) if len(count) else tuple(quantiles)
    width = max(len(c) for c in cuts) + 2
    shape = (len(FEATURES), width)
    share = float(good.mean()) if len(good) else 0.5
    w = np.zeros((3, *shape))
    moves = np.zeros((2, 2))
    if share in (0.0, 1.0) or not len(good):
        w[0, 0, :] = {0.0: -700.0, 1.0: 700.0}.get(share, 0.0)
        return Field(cuts, w[0], w[1], w[2], moves)
    codes, chains = _codes(features, cuts), _Chains(count)
    before, after = chains.shifted(codes, width - 1)
    flat = [(np.arange(len(FEATURES)) * width + c).ravel() for c in (codes, before, after)]
    label, weight = np.repeat(good, count).astype(float), np.repeat(1 / (count * len(count)), count)
    chains.weight = weight
    moved = np.zeros((2, 2))
    for y in (0, 1):  # labels never change within a text
        moved[y, y] = weight[chains.has_after & (label == y)].sum()
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        field = Field(cuts, w[0], w[1], w[2], moves)
        p, pairs = chains.marginals(_potential(field, codes, chains), moves)
        miss = np.repeat((p - label) * weight, len(FEATURES))
        slope = np.stack([np.bincount(f, miss, shape[0] * width).reshape(shape) for f in flat]) + ridge * w
        turn = pairs - moved + ridge * moves
        for k, (x, g) in enumerate(((w, slope), (moves, turn))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(cuts, w[0], w[1], w[2], moves)


def _marked(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's probability of being good, the lines of each text, and the lines' characters."""
    features, count, chars = line_features(texts)
    chains = _Chains(count)
    return chains.marginals(_potential(field, _codes(features, field.cuts), chains), field.moves)[0], count, chars


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the crc32 of the key as text falls into the fold; a null key doesn't."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, max_lines: int = 200) -> Field:
    """A field from docs (doc_id, text) and labels (doc_id, quality 0 or 1) outside the held-out fold.

    At most max_labelled texts of at most max_lines lines each reach the driver, as numbers, picked by a hash of the id.
    Of labels that differ the worse one counts; null labels, and those without a document, are left out.
    """
    picked = (
        labels.select("doc_id", "quality").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(lines <= max_lines)  # max_labelled rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in parts(batch.column(1)):
                part = batch.slice(s, e - s)
                if len(part):
                    features, count, _ = line_features(part.column(1))
                    edges = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32) * len(FEATURES))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(edges, pa.array(features.ravel()))], ["doc_id", "good", "f"])

    made = map_arrow(texts.select("doc_id", "text", "good"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, good int, f array<float>")
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("f")).limit(max_labelled).collect()  # repeated ids can't make more
    features = np.concatenate([np.array(r.f, np.float32) for r in rows] or [np.empty(0, np.float32)]).reshape(-1, len(FEATURES))
    return fit(features, np.array([len(r.f) // len(FEATURES) for r in rows], np.int64), np.array([r.good for r in rows], np.int64))


def mark_lines(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 0), start (characters before it), length, good (probability) of every line of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in parts(batch.column(1)):
                part = batch.slice(s, e - s)
                good, count, chars = _marked(field, part.column(1))
                row = np.repeat(np.arange(len(count)), count)
                line = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                before = np.cumsum(chars + 1) - chars - 1
                start = before - np.repeat(before[np.cumsum(count) - count], count)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(line.astype(np.int32)), pa.array(start), pa.array(chars), pa.array(good)], [key, "line", "start", "length", "good"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {dict(docs.dtypes)[key]}, line int, start long, length long, good double")


def score_texts(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row of docs: the mean probability of its lines, weighted by their characters and their newline.

    Null and empty texts are one empty line; very long ones are scored whole; repeated rows and null keys are rows like
    others; other columns aren't read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in parts(batch.column(1)):
                part = batch.slice(s, e - s)
                good, count, chars = _marked(field, part.column(1))
                row = np.repeat(np.arange(len(count)), count)
                score = np.bincount(row, good * (chars + 1), len(count)) / np.maximum(np.bincount(row, chars + 1, len(count)), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1))], [key, "score"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is at least `least`) of every row of docs; see learn() and score_texts()."""
    scored = score_texts(docs, learn(docs, labels, **limits))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op13_line_quality": op13_line_quality}
