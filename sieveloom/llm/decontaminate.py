"""Benchmark decontamination by latent semantic retrieval.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, ASCII
capitals made small. A document's passages are its windows of 32 terms, every
16 terms (``BLOCK``); texts are read whole.

1. Every document is mapped to the benchmark's terms (a term that no item has
   can't match anything; it keeps its place). The number of passages that hold
   each term is counted over all documents.
2. The TF-IDF matrix of all passages goes through a randomised SVD: each task
   multiplies its rows by a seeded Gaussian matrix and back, the sums meet, and
   the right singular vectors follow from the sketch (the one-pass Nystrom form
   of Halko, Martinsson and Tropp, 2011).
3. Items are cut into passages as documents are. All are projected on the
   leading ``RANK`` directions. A passage of a document whose cosine with one of
   an item is ``COSINE`` or more is a candidate for it; none is dropped for their
   number. A candidate that holds less than ``OVERLAP`` of the informative terms
   of the item's passage is done with. A term in a share of all passages beyond
   ``INFORMATIVE`` is not informative; an item without any informative term has
   no direction, and is compared with every passage.
4. For each candidate the longest common subsequence of the whole item and the
   surroundings that would hold it is taken, and the share of the item's answer
   (its last sentence; of an item of one sentence its last third) that they
   hold. A document is contaminated by an item if the subsequence covers
   ``VERBATIM`` of the item, or ``PARAPHRASE`` of it with ``ANSWER`` of the
   answer there.

Null and empty texts, and items without terms, match nothing. Items that repeat
an ``item_id`` are items each; rows that repeat a ``doc_id`` count once in the
result. Rows without ``doc_id`` take no part and stay. A task holds one portion
of the benchmark in memory: one of more than ``PORTION_BYTES`` is searched in
portions, each of them in all documents, and one item is never cut.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import documents, drop_stash, slices, stash, table, tree_sum, without
from sieveloom.llm.textarrays import TERMS, tokenize

BLOCK = 16
RANK, OVERSAMPLE = 64, 8
COSINE = 0.25
INFORMATIVE = 0.02  # a term in a larger share of all passages has no weight
OVERLAP = 0.4
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
PORTION_BYTES = 16 << 20
_CELLS = 1 << 22  # so many cosines at once
SEED = 7
_SLICES = 8


class Items:
    """The benchmark: vocabulary by term hash, the items' term numbers (from 1) and their answers."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted((i, t) for i, t in rows if i is not None and t)
        hashes, tails = [], []
        for t in tokenize(pa.array([t for _, t in rows], pa.large_string()), TERMS):
            hashes += [t.hash[t.off[d] : t.off[d + 1]] for d in range(t.n_docs)]
        for (_, text), h in zip(rows, hashes, strict=True):
            tail = re.split(r"[.!?]\s+", re.sub(r"[.!?\s]+\Z", "", text))
            n = sum(len(t.hash) for t in tokenize(pa.array([tail[-1]], pa.large_string()), TERMS)) if len(tail) > 1 else 0
            tails.append(n if 3 <= n < len(h) else max(1, len(h) // 3))
        keep = [i for i, h in enumerate(hashes) if len(h)]
        self.ids = [rows[i][0] for i in keep]
        self.vocabulary = np.unique(np.concatenate([hashes[i] for i in keep])) if keep else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, hashes[i]).astype(np.int32) + 1 for i in keep]
        self.answers = [Counter(t[-tails[i] :].tolist()) for i, t in zip(keep, self.terms, strict=True)]
        pieces = [(i, k * BLOCK) for i, t in enumerate(self.terms) for k in range(int(n_passages(len(t))))]
        self.item_of, self.start_of = (np.array(x, np.int64) for x in (zip(*pieces, strict=True) if pieces else ((), ())))
        self.lookup = np.full(1 << 20, -1, np.int32)
        slot = (self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)
        self.lookup[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.crowded = len(np.unique(slot)) < len(slot)

    def passages(self) -> list[np.ndarray]:
        """The term numbers of the items' passages."""
        return [self.terms[i][k : k + 2 * BLOCK] for i, k in zip(self.item_of.tolist(), self.start_of.tolist(), strict=True)]

    def number(self, h: np.ndarray) -> np.ndarray:
        """Term numbers from 1 of term hashes, 0 for terms that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        if self.crowded:
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        else:
            at = self.lookup[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        return np.where((at >= 0) & (self.vocabulary[at] == h), at + 1, 0).astype(np.int32)


def n_passages(n_terms: np.ndarray | int):
    """Passages of a document: windows of two blocks, at least one."""
    return np.maximum(1, -(-np.asarray(n_terms) // BLOCK) - 1)


def mapped(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n_terms, pos binary of int32, term binary of int32): the places of the benchmark's terms in each document that has any."""

    known = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        for b in batches:
            ids = b.column(0)
            for t in tokenize(b.column(1), TERMS):
                term = items.number(t.hash)
                at = np.flatnonzero(term)
                doc = t.doc[at]
                pos = (at - t.off[doc]).astype(np.int32)
                term = term[at]
                cut = np.searchsorted(doc, np.arange(t.n_docs + 1))
                some = np.flatnonzero(np.diff(t.off))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(some + t.first)), "n_terms": pa.array(np.diff(t.off)[some].astype(np.int32)), "pos": pa.array([pos[cut[d] : cut[d + 1]].tobytes() for d in some], pa.binary()), "term": pa.array([term[cut[d] : cut[d + 1]].tobytes() for d in some], pa.binary())})

    return docs.mapInArrow(run, "doc_id bigint, n_terms int, pos binary, term binary")


def _blocks(b: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, term) of each place in rows lo to hi, and the first block of each document, with one block more at the end of each."""
    n = b.column("n_terms").to_numpy(zero_copy_only=False)[lo:hi].astype(np.int64)
    pos = [np.frombuffer(x.as_buffer(), np.int32) for x in b.column("pos")[lo:hi]]
    size = [len(p) for p in pos]
    blocks = np.maximum(2, -(-n // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    at = np.concatenate([*pos, np.zeros(0, np.int32)]) // BLOCK + np.repeat(first[:-1], size)
    term = np.concatenate([*(np.frombuffer(x.as_buffer(), np.int32) for x in b.column("term")[lo:hi]), np.zeros(0, np.int32)])
    return at, term, first, np.array(size)


def _rows(b: pa.RecordBatch, terms: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many terms."""
    total = np.concatenate([[0], np.cumsum(b.column("n_terms").to_numpy(zero_copy_only=False).astype(np.int64))])
    i = 0
    while i < b.num_rows:
        j = min(b.num_rows, max(i + 1, int(np.searchsorted(total, total[i] + terms, "right")) - 1))
        yield i, j
        i = j


def passage_counts(places: DataFrame, n_vocabulary: int) -> tuple[np.ndarray, int]:
    """(number of passages that hold each term, number of passages), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_vocabulary + 1, np.int64)
        for b in batches:
            for lo, hi in _rows(b):
                at, term, first, _ = _blocks(b, lo, hi)
                key = np.unique(at * (n_vocabulary + 1) + term)
                block, term = np.divmod(key, n_vocabulary + 1)
                # of the two passages with a block, the first isn't counted again if the block before has the term
                start, last = np.zeros(first[-1] + 1, bool), np.zeros(first[-1] + 1, bool)
                start[first[:-1]], last[first[1:] - 1] = True, True
                has_previous = np.isin(key - (n_vocabulary + 1), key, assume_unique=True) & ~start[block]
                df += np.bincount(term[~start[block] & ~has_previous], minlength=n_vocabulary + 1)
                df += np.bincount(term[~last[block]], minlength=n_vocabulary + 1)
                df[0] += int((np.diff(first) - 1).sum())
        yield slices(df, _SLICES)

    df = tree_sum(places.mapInArrow(run, "slice int, part binary"), "int64", n_vocabulary + 1)
    return df[1:], int(df[0])


def _block_sums(at: np.ndarray, term: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sum of the terms' rows of ``weights`` in each of ``n`` blocks; ``at`` is sorted."""
    out = np.zeros((n, weights.shape[1]), np.float32)
    if len(at):
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[begin]] = np.add.reduceat(weights[term], begin, axis=0)
    return out


def singular_vectors(places: DataFrame, idf: np.ndarray, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = SEED) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF matrix of all passages, each divided by its singular value.

    So divided, every direction counts alike; else the few that frequent terms span would decide all cosines.
    """
    v = len(idf)
    size = min(v, rank + oversample)
    omega = np.random.Generator(np.random.PCG64(seed)).standard_normal((v, size)).astype(np.float32)
    sent = places.sparkSession.sparkContext.broadcast((idf.astype(np.float32), omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = sent.value
        weights = np.vstack([np.zeros((1, size), np.float32), idf[:, None] * omega])
        z = np.zeros((v + 1, size), np.float32)
        for b in batches:
            for lo, hi in _rows(b, 1 << 16):
                at, term, first, _ = _blocks(b, lo, hi)
                live = np.flatnonzero(idf[term - 1] > 0)
                at, term = at[live], term[live]
                sums = _block_sums(at, term, weights, int(first[-1]))
                passage = sums[:-1] + sums[1:]
                passage[first[1:-1] - 1] = 0  # no passage goes from one document into the next
                both = np.zeros_like(sums)  # of the passages that hold the block
                both[:-1] += passage
                both[1:] += passage
                order = np.argsort(term, kind="stable")
                begin = np.flatnonzero(np.diff(term[order], prepend=-1))
                if len(begin):
                    z[term[order][begin]] += np.add.reduceat(both[at[order]], begin, axis=0)
        yield slices(z[1:] * idf[:, None], _SLICES)

    z = tree_sum(places.mapInArrow(run, "slice int, part binary"), "float32", v * size).reshape(v, size).astype(np.float64)
    # Nystrom: A'A ~ Z (O'Z)^+ Z'
    core = omega.astype(np.float64).T @ z
    s, u = np.linalg.eigh((core + core.T) / 2)
    good = s > max(s.max(initial=0), 0) * 1e-10
    half = z @ (u[:, good] / np.sqrt(s[good])) if good.any() else np.zeros((v, 1))
    left, sigma, _ = np.linalg.svd(half, full_matrices=False)
    left, sigma = left[:, :rank], sigma[:rank]
    return (left / np.where(sigma > 1e-9 * max(sigma.max(initial=0), 1e-300), sigma, np.inf)).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro, 2004)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _verify(item: np.ndarray, answer: Counter, pos: np.ndarray, term: np.ndarray, lo: int, hi: int) -> tuple[float, float]:
    """(share of the item in the subsequence, share of the answer) in the places ``lo`` to ``hi``."""
    a, b = np.searchsorted(pos, [lo, hi])
    near = term[a:b].tolist()
    return lcs(item.tolist(), near) / len(item), sum((Counter(near) & answer).values()) / sum(answer.values())


def leaks_in(places: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item, subsequence, answer) of the contaminated documents, ``item`` being the number of the item."""
    weights = np.vstack([np.zeros((1, basis.shape[1]), np.float32), idf[:, None].astype(np.float32) * basis])
    pieces = items.passages()
    latent = np.array([weights[t].sum(0) for t in pieces], np.float32).reshape(len(pieces), -1)
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = latent / np.maximum(norm, 1e-12)
    # an item of which no passage has a direction is compared with every passage
    blind = np.setdiff1d(items.item_of, items.item_of[norm[:, 0] > 1e-9])
    # the informative terms of each passage of an item, as sorted keys
    informative = np.concatenate([[False], idf > 0])
    v = len(informative)
    need = np.array([OVERLAP * informative[t].sum() for t in pieces])
    keys = np.unique(np.concatenate([k * v + t[informative[t]].astype(np.int64) for k, t in enumerate(pieces)]))
    sent = places.sparkSession.sparkContext.broadcast((weights, latent, blind, items.terms, items.answers, items.item_of, items.start_of, keys, need, informative))

    def candidates(at, term, first, sent):
        """(passage of the documents, passage of the items) of the candidates."""
        weights, latent, _, _, _, _, _, keys, need, informative = sent
        live = informative[term]  # other terms have no weight and are no key
        at, term = at[live], term[live]
        sums = _block_sums(at, term, weights, int(first[-1]))
        passage = sums[:-1] + sums[1:]
        passage[first[1:-1] - 1] = 0
        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", passage, passage)), 1e-12)
        edge = np.searchsorted(at, np.arange(first[-1] + 1))
        step = max(1, _CELLS // max(1, len(latent)))
        for i in range(0, len(passage), step):
            hit, piece = np.nonzero(passage[i : i + step] @ latent.T >= length[i : i + step, None] * cosine)
            hit += i
            enough = edge[hit + 2] - edge[hit] >= need[piece]  # a passage shares no more terms than it has
            hit, piece = hit[enough], piece[enough]
            # the places of the two blocks of each candidate, to count the informative terms of the item's passage among them
            for some in np.array_split(np.arange(len(hit)), max(1, len(hit) >> 17)):
                begin = edge[hit[some]]
                count = edge[hit[some] + 2] - begin
                total = np.cumsum(count)
                place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count - begin, count)
                key = np.repeat(piece[some], count) * np.int64(v) + term[place]
                found = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
                shared = np.bincount(np.repeat(np.arange(len(some)), count), found, len(some))
                ok = some[shared >= need[piece[some]]]
                yield hit[ok], piece[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, blind, terms, answers, item_of, start_of, _, _, _ = sent.value
        for b in batches:
            found = []
            for lo, hi in _rows(b):
                at, term, first, size = _blocks(b, lo, hi)
                cut = np.concatenate([[0], np.cumsum(size)])
                tries = set()
                for hit, piece in candidates(at, term, first, sent.value):
                    doc = np.searchsorted(first, hit, "right") - 1
                    # where the item would begin, to a quarter of the slack that its surroundings have anyhow
                    begin = (hit - first[doc]) * BLOCK - start_of[piece]
                    item = item_of[piece]
                    grain = np.array([_slack(len(terms[i])) // 4 for i in item.tolist()], np.int64)
                    tries.update(zip(doc.tolist(), item.tolist(), (begin // np.maximum(grain, 1)).tolist(), strict=True))
                if len(blind):
                    more = np.setdiff1d(np.arange(int(first[-1]) - 1), first[1:-1] - 1)
                    doc = np.searchsorted(first, more, "right") - 1
                    for i in blind.tolist():
                        grain = max(1, _slack(len(terms[i])) // 4)
                        tries.update(zip(doc.tolist(), [i] * len(doc), ((more - first[doc]) * BLOCK // grain).tolist(), strict=True))
                best: dict[tuple[int, int], tuple[float, float]] = {}
                for d, i, q in sorted(tries):
                    if best.get((d, i), (0.0, 0.0))[0] == 1.0:
                        continue
                    pos, n = np.frombuffer(b.column("pos")[lo + d].as_buffer(), np.int32), len(terms[i])
                    slack = _slack(n)
                    start = q * max(1, slack // 4)
                    got = _verify(terms[i], answers[i], pos, term[cut[d] : cut[d + 1]], start - slack, start + n + 2 * slack)
                    if got > best.get((d, i), (0.0, 0.0)):
                        best[d, i] = got
                found += [(lo + d, i, *x) for (d, i), x in best.items() if x[0] >= VERBATIM or x[0] >= PARAPHRASE and x[1] >= ANSWER]
            if found:
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array([x[0] for x in found])), "item": pa.array([x[1] for x in found], pa.int32()), "subsequence": pa.array([x[2] for x in found]), "answer": pa.array([x[3] for x in found])})

    return places.mapInArrow(run, "doc_id bigint, item int, subsequence double, answer double")


def _slack(n: int) -> int:
    """How far an item may begin or end from where a passage puts it: passages are a block apart, and words may be more or fewer."""
    return max(2 * BLOCK, n // 4)


def _leaks_of(docs: DataFrame, rows: list[tuple[int, str]], cosine: float, rank: int) -> DataFrame | None:
    items = Items(rows)
    if not items.ids:
        return None
    places = stash(mapped(docs, items))
    df, n = passage_counts(places, len(items.vocabulary))
    # a frequent term tells nothing about an item; it still counts in the subsequence
    idf = np.where((df > 0) & (df <= INFORMATIVE * n), np.log((1 + n) / (1 + df)), 0)
    found = stash(leaks_in(places, items, idf, singular_vectors(places, idf, rank), cosine))
    drop_stash(places)
    # as many names as a portion has items
    ids = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item int, item_id bigint")
    return found.join(ids, "item").select("doc_id", "item_id", "subsequence", "answer")


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """(doc_id, item_id, subsequence, answer): the documents that hold a benchmark item, with both shares."""
    spark = docs.sparkSession
    texts = documents(docs.select(F.col("doc_id").cast("bigint"), "text"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = -(-size // portion_bytes)
    found = []
    for k in range(portions):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k)
        leaks = _leaks_of(texts, [(r[0], r[1]) for r in part.collect()], cosine, rank)
        found += [] if leaks is None else [leaks]
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, subsequence double, answer double")
    return functools.reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.round(F.max("subsequence"), 6).alias("subsequence"), F.round(F.max("answer"), 6).alias("answer"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the contaminated documents; columns as they were."""
    return without(docs, contaminated(docs, benchmark))


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
