"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features (Wang and Manning, 2012).

Features are the hashed character n-grams (3 to 6 characters, the edges of a
word counting as a character) of a text's distinct terms; a feature's value is
the number of distinct terms that hold the n-gram. Each is scaled by its naive
Bayes log-count ratio, and a logistic regression is fitted on the scaled
features. A text's score is a sum over its distinct terms, so whole texts of
any length are scored from whole words, in NumPy.

``fit`` uses at most ``max_rows`` labelled documents (the ones whose ids hash
lowest), the documented bound of the training sample. Their features stay on the
executors: each step sums the gradient by partition, so no task holds the sample,
however long its texts are. Scoring reads all rows.

A label row counts if it has a ``doc_id``, a 0 or 1 in ``toxic``, and a document
with that id; repeated labels count once, as toxic if any of them says so, and a labelled id with several texts counts with the one whose hash is least. With no label of
one of the two classes there is nothing to learn: every score is 0 and nothing is rejected.
Null, empty and termless texts score 0; a text that shares no n-gram with two labelled ones scores below 0.5, as the bias is held under ``BIAS_LIMIT``. A document is rejected if its score is
at least ``threshold``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import drop_stash, slices, stash, table, tree_sum
from sieveloom.llm.textarrays import TERMS, Tokens, mix64, tokenize

DIMENSIONS = 1 << 18
SIZES = (3, 4, 5, 6)
MAX_ROWS = 8000
FIT_TASKS = 8
PASSES = 24
THRESHOLD = 0.5
BIAS_LIMIT = -0.1
_Q = np.uint64(0x9E3779B97F4A7C15)


def _distinct_words(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, word) pairs without repeats, and the first token of each word."""
    _, at, inv = np.unique(t.hash, return_index=True, return_inverse=True)
    n = max(1, len(at))
    doc, word = np.divmod(np.unique(t.doc * n + inv), n)
    return doc, word, at, n


def _ngrams(t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all n-grams of the tokens ``at``, in order of words within each size."""
    size = t.end[at] - t.start[at]
    stop = np.cumsum(size + 1)
    src = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - 1, size + 1) + np.repeat(t.start[at], size + 1)
    body = t.data[np.minimum(src, len(t.data) - 1)].copy()
    body[stop - 1] = 32
    chars = np.frombuffer((b" " + body.tobytes()).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = chars == 32
    word = np.cumsum(space) - 1
    seen = np.concatenate([[0], np.cumsum(space)])
    words, features = [], []
    for n in SIZES:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = chars[:m].copy()
        for j in range(1, n):
            h = h * _Q + chars[j : j + m]
        keep = np.flatnonzero(seen[n - 1 : n - 1 + m] == seen[1 : 1 + m])  # no edge inside
        words.append(word[keep])
        features.append((mix64(h[keep] + np.uint64(n)) & np.uint64(DIMENSIONS - 1)).astype(np.int32))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(words), np.concatenate(features)


def scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probabilities of being toxic; texts without terms score 0."""
    out = np.zeros(len(column))
    for t in tokenize(column, TERMS):
        if not len(t.hash):
            continue
        doc, word, at, n = _distinct_words(t)
        w, f = _ngrams(t, at)
        total = np.bincount(doc, np.bincount(w, weights[f], n)[word], t.n_docs)
        some = np.flatnonzero(np.diff(t.off) > 0)
        out[t.first + some] = 1 / (1 + np.exp(-np.clip(total[some] + bias, -40, 40)))
    return out


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, value) of each document."""
    return [x for t in tokenize(column, TERMS) for x in _features(t)]


def _features(t: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
    if not len(t.hash):
        return [(np.zeros(0, np.int32), np.zeros(0, np.int32))] * t.n_docs
    out = []
    doc, word, at, n = _distinct_words(t)
    w, f = _ngrams(t, at)
    order = np.argsort(w, kind="stable")
    f, count = f[order], np.bincount(w, minlength=n)
    begin = np.cumsum(count) - count
    edge = np.searchsorted(doc, np.arange(t.n_docs + 1))
    for d in range(t.n_docs):
        of = word[edge[d] : edge[d + 1]]
        size = count[of]
        total = np.cumsum(size)
        i = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(begin[of], size)
        feature, value = np.unique(f[i], return_counts=True)
        out.append((feature.astype(np.int32), value.astype(np.int32)))
    return out


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of the labelled documents to train on: at most ``max_rows``, the same at every run."""
    there = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")  # a label without its document takes no place in the sample
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").join(there, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # the sample is bounded by max_rows whatever the tables hold: 12 bytes a row
    found = texts.join(F.broadcast(known) if max_rows <= 200_000 else known, "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


#: Rows are worked on in groups of about so many features, so that what is made on the way stays small.
_CHUNK = 1 << 18
_SLICES = 8
_MEMORY = 8  # steps that L-BFGS looks back


def feature_rows(sampled: DataFrame, tasks: int = FIT_TASKS) -> DataFrame:
    """(toxic, size, f binary, v binary) of groups of rows, stashed: their features and values one after the other, ``size`` of them each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in tokenize(b.column("text"), TERMS):  # sent on by chunks of texts: features take several times their room
                found = _features(t)
                yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic").slice(t.first, t.n_docs), "f": pa.array([x[0].tobytes() for x in found], pa.binary()), "v": pa.array([x[1].tobytes() for x in found], pa.binary())})

    rows = sampled.repartition(tasks, "doc_id").sortWithinPartitions("doc_id")
    return stash(rows.select("toxic", "text").mapInArrow(run, "toxic int, f binary, v binary"))


def _groups(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, features, values, row of each) of some rows at a time."""
    size = pc.binary_length(b.column("f")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    stop = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(stop, stop[i] + _CHUNK, "right")) - 1)
        f, v = (np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in b.column(c)[i:j]]) for c in ("f", "v"))
        yield b.column("toxic")[i:j].to_numpy(zero_copy_only=False).astype(np.float64), f, v, np.repeat(np.arange(j - i), size[i:j])
        i = j


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over partitions of what ``add(total, group)`` gathers in a vector of ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for group in _groups(b):
                add(total, *group)
        yield slices(total, _SLICES)

    return tree_sum(rows.mapInArrow(run, "slice int, part binary"), "float64", size)


def train(rows: DataFrame, passes: int = PASSES, alpha: float = 1.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights (the naive Bayes ratios included) and bias from ``feature_rows``, in ``passes`` passes over them.

    The loss of a logistic regression in which both classes count alike is lowered
    by L-BFGS (Liu and Nocedal, 1989), each step and each trial of a shorter one being a pass.
    """
    d = DIMENSIONS

    def counts(total, y, f, v, row):
        total[:d] += np.bincount(f, v * y[row], d)
        total[d : 2 * d] += np.bincount(f, v * (1 - y[row]), d)
        total[2 * d : 3 * d] += np.bincount(f, minlength=d)
        total[3 * d :] += len(y), y.sum()

    got = _summed(rows, 3 * d + 2, counts)
    n, positive = got[3 * d :]
    if positive in (0, n):
        return np.zeros(d, np.float32), -40.0
    p, q = got[:d] + alpha, got[d : 2 * d] + alpha
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[got[2 * d : 3 * d] < 2] = 0
    sc = rows.sparkSession.sparkContext

    def squares(total, y, f, v, row, ratio=sc.broadcast(ratio)):
        total[0] += ((v * ratio.value[f]) ** 2).sum()

    ratio = ratio / max(1e-9, (_summed(rows, 1, squares)[0] / n) ** 0.5)
    both = 0.5 / (1 - positive / n), 0.5 / (positive / n)

    def bias(c: float) -> float:
        """Without evidence a text isn't toxic, however few the clean labels."""
        return BIAS_LIMIT - float(np.logaddexp(0, c))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, c = x[:d], x[d]
        sent = sc.broadcast(((w * ratio).astype(np.float32), bias(c)))

        def add(total, y, f, v, row, sent=sent):
            weights, bias = sent.value
            z = np.clip(np.bincount(row, v * weights[f], len(y)) + bias, -500, 500)
            count = np.where(y == 1, both[1], both[0])
            g = count * (1 / (1 + np.exp(-z)) - y)
            total[:d] += np.bincount(f, v * g[row], d)
            total[d:] += g.sum(), (count * np.logaddexp(0, np.where(y == 1, -z, z))).sum()

        got = _summed(rows, d + 2, add) / n
        sent.unpersist()
        slope = -got[d] / (1 + np.exp(-c))
        return float(got[d + 1] + ridge / 2 * (w @ w)), np.append(ratio * got[:d] + ridge * w, slope)

    x = np.append(np.zeros(d), -3.0)
    value, g = loss(x)
    left, pairs = passes - 1, []
    while left:
        q, factors = g.copy(), []
        for s, y in reversed(pairs):
            factors.append((s @ q) / (s @ y))
            q -= factors[-1] * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1e-12, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(factors), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope, new = 1.0, float(g @ q), None
        while left:
            left -= 1
            new = loss(x - step * q)
            if new[0] <= value - 1e-4 * step * slope:
                break
            step, new = step / 3, None
        if new is None:
            break
        s, y = -step * q, new[1] - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - _MEMORY :], (s, y)]
        x, (value, g) = x + s, new
    return (x[:d] * ratio).astype(np.float32), bias(x[d])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """The model; the driver gets sums of a fixed size only."""
    rows = feature_rows(sample(docs, labels, max_rows))
    model = train(rows)
    drop_stash(rows)
    return model


def toxic_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, is_toxic) of the documents that are rejected; each document is scored.

    Texts are read as Arrow has them, and only what is rejected is sent back, so that a worker holds one copy of a batch.
    """
    model = fit(docs, labels, max_rows)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]  # 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scores(b.column("text"), weights.value, bias)
            at = np.flatnonzero(found >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(found[at])], ["doc_id", "toxicity"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id bigint, toxicity double").select("doc_id", F.round("toxicity", 6).alias("toxicity"), F.lit(True).alias("is_toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the rows that are rejected; columns as they were."""
    model = fit(docs, labels, max_rows)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(scores(b.column("text"), weights.value, bias) < threshold)
            yield b.take(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
