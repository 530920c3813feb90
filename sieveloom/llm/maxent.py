"""A hashed maximum-entropy language model with class-factored softmax.

The outputs are the leaves of a tree of classes: a node has 32 slots, of which
half are outputs and half are classes with a node of their own; at the last
level all are outputs. The most frequent terms of the whole corpus (counted by
hash, over every document) have outputs of their own, the more frequent the
nearer to the root; the others share the last outputs by hash. The model is the
product of P(slot | context, node) along a term's path. A slot's share of its node by
the counts is a feature that any context has. The context features are
the previous term, the one before it (a skip), the two together, and the
previous one with the third last (a skip bigram); each is hashed, for the root
alone and for each deeper node together with the node, into a row of 32 weights.

How much is gathered grows with the corpus, by the root of its bytes (``Shape``):
the counted hashes, the depth of the tree and with it the outputs, and the rows of weights.
As what a task sends in a round grows with the rows, the tasks of a round grow
by the root too, so that all they send grows in proportion to the corpus. The
weights are broadcast, so the rows end at ``MOST_ROWS`` (340 MB), which a corpus of
about a terabyte reaches; the hashes end at ``MOST_BUCKETS``.

Training reads every document once, in ``ROUNDS`` disjoint shares by document.
In a round each task takes gradient steps (Adagrad by row) from the shared
weights on its documents; the updates meet in a tree on the executors, slice by
slice, each row weighted by how often a task saw it. So the weights depend on how
the corpus is partitioned.

Scores: the mean log2 probability of a text's terms, and the perplexity that
follows. An output's probability is divided among its term hashes by their
counts (one added to each), so a rare term scores below a frequent one of its
output; terms of one hash still score alike. Null, empty and termless texts have no terms and null scores. Texts are
read whole. Rows that repeat a ``doc_id`` are scored each; rows without
``doc_id`` train the model but have no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import slices, table, tree_sum
from sieveloom.llm.textarrays import TERMS, Tokens, mix64, tokenize

WIDTH = 32
_INNER = WIDTH // 2  # slots of a node that are outputs, unless it is of the last level
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 22
LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 21
ROUNDS = 2
RATE = 0.08
_FEATURES = 4
_BATCH = 1 << 16  # tokens of a gradient step
_BLOCK = 1 << 11  # tokens or rows whose weights are in the cache at once
_PIECE = 8  # rows of a segment that are summed one after the other
_LIMIT = 30.0  # a sum of weights is held within this, so that no exponential overflows
_ONES = np.ones(WIDTH, np.float32)
_NODE = np.uint64(0x9E3779B97F4A7C15)


def _power_of_two(x: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << math.ceil(math.log2(max(1.0, x)))))


def _outputs(depth: int) -> int:
    return sum(_INNER**k for k in range(1, depth)) + _INNER ** (depth - 1) * WIDTH


@dataclass(frozen=True)
class Shape:
    """The sizes of a model: counted term hashes, levels of the tree, rows of weights of the root and of deeper nodes, tasks of a round."""

    buckets: int = LEAST_BUCKETS
    depth: int = 2
    first: int = LEAST_ROWS // 4
    deep: int = LEAST_ROWS
    tasks: int = 1

    @classmethod
    def of(cls, n_bytes: int) -> Shape:
        """For a corpus of so many bytes of text: all grow by the root of it."""
        root = math.sqrt(max(1, n_bytes))
        rows = _power_of_two(2 * root, LEAST_ROWS, MOST_ROWS)
        depth = 2
        while _outputs(depth) < root / 5:
            depth += 1
        return cls(_power_of_two(16 * root, LEAST_BUCKETS, MOST_BUCKETS), depth, rows // 4, rows, max(1, math.ceil(root / 1800)))

    @property
    def outputs(self) -> int:
        return _outputs(self.depth)

    @property
    def own(self) -> int:
        """The outputs of one term hash each: all but a quarter of those of the last level."""
        return self.outputs - _INNER ** (self.depth - 1) * WIDTH // 4

    @property
    def rows(self) -> int:
        return self.first + self.deep

    @cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, slot) of each level and output; the node is -1 below an output's own level. The root is node 0."""
        nodes, slots = np.full((self.depth, self.outputs), -1, np.int64), np.zeros((self.depth, self.outputs), np.int64)
        begin, offset = 0, [(_INNER**k - 1) // (_INNER - 1) for k in range(self.depth)]
        for level in range(self.depth):
            wide = WIDTH if level == self.depth - 1 else _INNER
            n = _INNER**level * wide
            of = slice(begin, begin + n)
            node, slot = np.divmod(np.arange(n), wide)
            for k in range(level, -1, -1):
                nodes[k, of], slots[k, of] = offset[k] + node, slot
                node, slot = node // _INNER, _INNER + node % _INNER
            begin += n
        return nodes, slots


def shape_of(docs: DataFrame) -> Shape:
    return Shape.of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def _n_slices(n_bytes: int) -> int:
    """Slices of about a megabyte."""
    return max(16, n_bytes >> 20)


def buckets_of(t: Tokens, shape: Shape) -> np.ndarray:
    return (t.hash & np.uint64(shape.buckets - 1)).astype(np.int64)


def term_counts(docs: DataFrame, shape: Shape) -> np.ndarray:
    """The counts of all terms of all documents, by term hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shape.buckets, np.int64)
        for b in batches:
            for t in tokenize(b.column(0), TERMS):
                n += np.bincount(buckets_of(t, shape), minlength=shape.buckets)
        yield slices(n, _n_slices(8 * shape.buckets))

    texts = docs.select("text")
    return tree_sum(texts.coalesce(min(shape.tasks, texts.rdd.getNumPartitions())).mapInArrow(run, "slice int, part binary"), "int64", shape.buckets)


def outputs_of(counts: np.ndarray, shape: Shape) -> np.ndarray:
    """The output of each term hash."""
    rank = np.argsort(-counts, kind="stable")
    out = np.empty(len(counts), np.int32)
    out[rank] = np.where(np.arange(len(counts)) < shape.own, np.arange(len(counts)), shape.own + rank % (shape.outputs - shape.own))
    return out


def shares_of(counts: np.ndarray, outputs: np.ndarray, shape: Shape) -> np.ndarray:
    """The natural log of each term hash's share of its output, by the counts."""
    n = counts + 1.0  # a hash that the corpus lacks has a share too
    return np.log(n / np.bincount(outputs, n, shape.outputs)[outputs]).astype(np.float32)


def prior_of(counts: np.ndarray, outputs: np.ndarray, shape: Shape) -> np.ndarray:
    """The log of each slot's share of its node by the counts (nodes, 32): the feature that any context has.

    So an untrained model is the unigram model of the corpus, and the other features learn what contexts change in it.
    """
    nodes, slots = shape.tree
    n, total = np.bincount(outputs, counts + 1.0, shape.outputs), np.zeros(((_INNER**shape.depth - 1) // (_INNER - 1)) * WIDTH)
    for level in range(shape.depth):
        some = np.flatnonzero(nodes[level] >= 0)
        total += np.bincount(nodes[level, some] * WIDTH + slots[level, some], n[some], len(total))
    total = np.maximum(total.reshape(-1, WIDTH), 1e-9)
    return np.log(total / total.sum(1, keepdims=True)).astype(np.float32)


def contexts(t: Tokens) -> np.ndarray:
    """The features of each token (4, n): hashes of the terms before it; 0 stands for what is before a text."""
    place = np.arange(len(t.hash)) - t.off[t.doc]
    a, b, c = (np.where(place >= k, t.hash[np.maximum(np.arange(len(t.hash)) - k, 0)], np.uint64(0)) for k in (1, 2, 3))
    one, two, three = np.uint64(1), np.uint64(2), np.uint64(3)
    return np.stack([mix64(a), mix64(b + one), mix64(a * _NODE + b + two), mix64(a * _NODE + mix64(c + three))])


class Model:
    """The rows of weights: the root's, then those of deeper nodes."""

    def __init__(self, shape: Shape, prior: np.ndarray, weights: np.ndarray | None = None):
        self.shape, self.tree, self.prior = shape, shape.tree, prior
        self.w = np.zeros((shape.rows, WIDTH), np.float32) if weights is None else weights

    def steps(self, y: np.ndarray, features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, nodes, rows (4, n), slots) of each level, for a batch of outputs."""
        nodes, slots = self.tree
        yield np.arange(len(y)), np.zeros(len(y), np.int64), self._rows(features, 0, self.shape.first), slots[0, y]
        for level in range(1, self.shape.depth):
            node = nodes[level, y]
            some = np.flatnonzero(node >= 0)
            if len(some):
                h = mix64(features[:, some] + node[some].astype(np.uint64) * _NODE)
                yield some, node[some], self._rows(h, self.shape.first, self.shape.deep), slots[level, y[some]]

    @staticmethod
    def _rows(h: np.ndarray, begin: int, n: int) -> np.ndarray:
        """A quarter of the rows for each feature, so that the many pairs don't fill the rows of single terms."""
        part = n // _FEATURES
        return ((h & np.uint64(part - 1)).astype(np.int32) + (begin + part * np.arange(_FEATURES, dtype=np.int32))[:, None]).astype(np.int32)

    def _sums(self, nodes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the prior and the weights summed over the features (n, 32), their exponentials); ``rows`` (4, n) index ``w``."""
        z = np.take(self.prior, nodes, axis=0)
        for r in rows:
            z += np.take(self.w, r, axis=0)
        np.clip(z, -_LIMIT, _LIMIT, out=z)
        return z, np.exp(z)

    def score(self, y: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's output."""
        out = np.zeros(len(y))
        for i in range(0, len(y), _BATCH):
            s = slice(i, i + _BATCH)
            for some, nodes, rows, target in self.steps(y[s], features[:, s]):
                for b in _blocks(len(some)):
                    z, e = self._sums(nodes[b], rows[:, b])
                    out[i + some[b]] += z[np.arange(len(z)), target[b]] - np.log(e @ _ONES)
        return out

    def learn(self, y: np.ndarray, features: np.ndarray, power: np.ndarray, seen: np.ndarray, rate: float = RATE) -> None:
        """One pass of gradient steps; ``power`` is the Adagrad state and ``seen`` counts the uses of each row."""
        for i in range(0, len(y), _BATCH):
            s = slice(i, i + _BATCH)
            for some, nodes, rows, target in self.steps(y[s], features[:, s]):
                g = np.empty((len(some), WIDTH), np.float32)
                for b in _blocks(len(some)):
                    _, e = self._sums(nodes[b], rows[:, b])
                    e *= (1 / (e @ _ONES))[:, None]
                    e[np.arange(len(e)), target[b]] -= 1
                    g[b] = e
                for j in range(_FEATURES):
                    order = _sorted(rows[j])
                    r = rows[j][order]
                    begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    length = np.diff(begin, append=len(order))
                    total, of = segment_sums(g, order, begin, length)
                    r = r[begin[of]]
                    power[r] += np.einsum("ij,ij->i", total, total) / WIDTH
                    step = rate / np.sqrt(power[r] + 1e-6)
                    for b in _blocks(len(r)):
                        self.w[r[b]] = np.take(self.w, r[b], axis=0) - step[b, None] * total[b]
                    seen[r] += length[of]


def _blocks(n: int) -> Iterator[slice]:
    return (slice(i, i + _BLOCK) for i in range(0, n, _BLOCK))


def segment_sums(x: np.ndarray, order: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the rows ``x[order]`` over segments, the segment of each sum); the sums come in an order of their own.

    The first rows of all segments are added at once, then the second ones, and so on. So that long segments need no more
    steps than short ones, they are summed in pieces of ``_PIECE`` rows, and then the pieces.
    """
    size = np.minimum(length, _PIECE + 1)
    by = np.argsort(size.astype(np.uint8), kind="stable")[::-1].copy()
    more = len(by) - np.cumsum(np.bincount(size, minlength=_PIECE + 2))  # segments of more than k rows
    n = int(more[_PIECE])
    total = np.empty((len(by), x.shape[1]), x.dtype)
    if n:
        long = by[:n]
        pieces = -(-length[long] // _PIECE)
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(begin[long] - first * _PIECE, pieces) + np.arange(pieces.sum()) * _PIECE
        parts, of = segment_sums(x, order, starts, np.minimum(np.repeat(begin[long] + length[long], pieces) - starts, _PIECE))
        place = np.empty_like(of)
        place[of] = np.arange(len(of))
        total[:n], of = segment_sums(parts, place, first, pieces)
        by[:n] = long[of]
    at, short = begin[by[n:]], total[n:]
    if len(at):
        np.take(x, order[at], axis=0, out=short, mode="clip")
    for k in range(1, _PIECE):
        m = int(more[k]) - n
        if m <= 0:
            break
        short[:m] += np.take(x, order[at[:m] + k], axis=0)
    return total, by


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The order of row numbers, by two radix sorts of 16 bits."""
    order = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    high = (rows >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def fit(docs: DataFrame, shape: Shape, outputs: np.ndarray, prior: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The weights, trained on all documents."""
    sc = docs.sparkSession.sparkContext
    weights = Model(shape, prior).w
    power = np.zeros(len(weights), np.float32)
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.length("text")), F.lit(rounds))
    n_slices = _n_slices(weights.nbytes)
    for k in range(rounds):
        sent = sc.broadcast((weights, power, outputs, prior))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start, before, outputs, prior = sent.value
            model, power, seen = Model(shape, prior, start.copy()), before.copy(), np.zeros(len(start), np.float32)
            for b in batches:
                for t in tokenize(b.column(0), TERMS):
                    if len(t.hash):
                        model.learn(outputs[buckets_of(t, shape)], contexts(t), power, seen, rate)
            if seen.any():
                update = (model.w - start) * seen[:, None]
                yield slices(np.hstack([update, seen[:, None], ((power - before) * seen)[:, None]]).astype(np.float32), n_slices)

        part = docs.where(share == k).select("text")
        part = part.coalesce(min(shape.tasks, part.rdd.getNumPartitions()))
        got = tree_sum(part.mapInArrow(run, "slice int, part binary"), "float32", weights.size + 2 * len(weights)).reshape(len(weights), WIDTH + 2)
        n = np.maximum(got[:, WIDTH], 1)
        weights = weights + got[:, :WIDTH] / n[:, None]
        power = power + got[:, WIDTH + 1] / n
    return weights


def score(docs: DataFrame, shape: Shape, outputs: np.ndarray, prior: np.ndarray, weights: np.ndarray, shares: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_terms, log2_probability, perplexity); the log is a mean over the terms, or over their outputs if there are no ``shares``."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, outputs, prior, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, outputs, prior, shares = sent.value
        model = Model(shape, prior, weights)
        for b in batches:
            for t in tokenize(b.column(1), TERMS):
                n = np.diff(t.off)
                total = np.zeros(t.n_docs)
                if len(t.hash):
                    bucket = buckets_of(t, shape)
                    logs = model.score(outputs[bucket], contexts(t))
                    if shares is not None:
                        logs += shares[bucket]
                    total = np.bincount(t.doc, logs, t.n_docs)
                mean = total / np.maximum(n, 1) / np.log(2)
                none = n == 0
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(t.first, t.n_docs), "n_terms": pa.array(n.astype(np.int32)), "log2_probability": pa.array(mean, mask=none), "perplexity": pa.array(np.exp2(-mean), mask=none)})

    return docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, n_terms int, log2_probability double, perplexity double")


def perplexities(docs: DataFrame, trained_on: DataFrame | None = None) -> DataFrame:
    """The scores of ``docs`` by a model that is trained on them, or on other documents."""
    corpus = docs if trained_on is None else trained_on
    shape = shape_of(corpus)
    counts = term_counts(corpus, shape)
    outputs = outputs_of(counts, shape)
    prior = prior_of(counts, outputs, shape)
    return score(docs, shape, outputs, prior, fit(corpus, shape, outputs, prior), shares_of(counts, outputs, shape)).withColumns({c: F.round(c, 6) for c in ("log2_probability", "perplexity")})


def query(spark, sf_dir: str) -> DataFrame:
    return perplexities(table(spark, sf_dir, "documents"))
