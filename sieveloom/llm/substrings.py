"""Substring dedup on a de Bruijn graph of tokens.

A window of ``length`` words (runs of bytes other than ASCII white space,
compared exactly) is an edge of a de Bruijn graph whose nodes are the
``length - 1`` words at its ends. A window is a duplicate if the same words
stand at an earlier source coordinate (``doc_id``, then position). The words of
duplicate windows are the duplicate spans; the first occurrence is never one.

How it is found, for all windows of all documents:

1. a window's anchor is the least of the hashes of its ``seed``-word pieces.
   Consecutive windows of one anchor are a segment: a piece of a path of the
   graph, compacted where it is read, of some twelve windows. Equal windows have
   equal anchors, so only segments whose anchor occurs again (a count by anchor,
   combined before it is sent) can hold repeats; most go no further;
2. segments meet on their anchor by joins. If all segments of an anchor hold the
   same words, they are one nonbranching path: every copy repeats the first
   source coordinate as a whole;
3. where segments of one anchor differ, the path branches. Each distinct segment
   is taken once, at its first coordinate, and split into its windows; windows
   join on their words, and runs of windows that have their source in one piece
   are compacted again. The copies of a segment join on it;
4. paths of one document that touch or overlap become one span.

What repeats is verified by the words at the two coordinates: segments and
windows are equal if the MD5 of their words (128 bits) is. Anchors, which are
weaker hashes, only say where to look.

Null and empty texts and texts of fewer than ``length`` words have no spans.
Rows without ``doc_id`` take no part and stay. Rows that repeat a ``doc_id``
with the same text are one document. Different texts under one ``doc_id`` are
documents of their own, told apart by ``version``: each is cut by its own spans.
They share the coordinate, so words at the same position of both aren't
duplicates of each other, and ``duplicate_spans``, which names the ``doc_id``
alone, joins their spans where they overlap. A document of one word many times over
keeps its first word and is otherwise a repeat of itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm.common import documents, drop_stash, stash, table
from sieveloom.llm.textarrays import Tokens, rolling, sliding_max, sliding_min, tokenize

LENGTH = 50
SEED = 25
_LOOPS = 1 << 32  # what a segment that may hold a window twice adds to its anchor's count
_CHUNK = 1 << 17


def anchors(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of one document's token hashes."""
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r = rolling(h, seed)
    w = length - seed + 1
    least = sliding_min(r, w)
    full = np.concatenate([np.full(w - 1, least[0]), least, np.full(w - 1, least[-1])])
    full[: w - 1] = 0
    full[len(full) - (w - 1) :] = 0
    at = np.flatnonzero(sliding_max(full, w) == r)
    return at, r[at]


def segments(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, loops) of one document; a segment that may hold a window twice loops."""
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    w = length - seed + 1
    least = sliding_min(rolling(h, seed), w)
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    anchor = least[lo]
    at, value = anchors(h, length, seed)
    order = np.argsort(value, kind="stable")
    again = (value[order][1:] == value[order][:-1]) & (np.diff(at[order]) <= w)
    loops = np.isin(anchor, value[order][1:][again]) if again.any() else np.zeros(len(lo), bool)
    return anchor, lo, np.diff(np.append(lo, len(least))), loops


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Words:
    """A group's words with one space between them, to be hashed from one place to another."""

    def __init__(self, t: Tokens):
        inside = t.data != 0
        keep = inside.copy()
        keep[t.end[t.end < len(inside)]] = True  # one byte after each word
        place = np.cumsum(keep) - 1
        self.start, self.end = place[t.start], place[t.end - 1] + 1
        self.body = memoryview(np.where(inside, t.data, 32)[keep].astype(np.uint8).tobytes())

    def md5(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Two int64 for the words ``first`` to ``last`` (inclusive)."""
        body, md5 = self.body, hashlib.md5
        return np.frombuffer(b"".join([md5(body[a:b]).digest() for a, b in zip(self.start[first].tolist(), self.end[last].tolist(), strict=True)]), np.int64).reshape(-1, 2)


def several_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, texts) of the ids that stand for several texts: their hashes, in order. Stashed, so that Spark knows its size."""
    return stash(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h")).where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("h")).alias("texts")).where("size(texts) > 1"))


def with_version(docs: DataFrame, several: DataFrame, name: str) -> DataFrame:
    """``docs`` with an int column ``name``: 0, or the place of the text among those of its ``doc_id``."""
    several = several.select(F.col("doc_id").alias("__several_id"), F.col("texts").alias("__texts"))
    joined = docs.join(several, F.col("doc_id").cast("bigint") == F.col("__several_id"), "left")
    return joined.withColumn(name, F.coalesce(F.array_position("__texts", F.xxhash64("text")), F.lit(0)).cast("int")).drop("__several_id", "__texts")


def segment_rows(docs: DataFrame, length: int, seed: int, words: bool) -> DataFrame:
    """(h, uses) of every segment of (doc_id, text, version), and with ``words`` also the MD5 (g1, g2), lo, n, doc_id and version.

    ``uses`` is 1, or ``_LOOPS`` if the segment loops.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for t in tokenize(b.column(1)):
                some = np.flatnonzero(np.diff(t.off) >= length)
                if not len(some):
                    continue
                found = [segments(t.hash[t.off[d] : t.off[d + 1]], length, seed) for d in some]
                size = [len(x[0]) for x in found]
                h, lo, n, loops = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = {"h": _signed(h), "uses": pa.array(np.where(loops, _LOOPS, 1))}
                if words:
                    first = lo + np.repeat(t.off[some], size)
                    g = _Words(t).md5(first, first + n + length - 2)
                    rows = np.repeat(t.first + some, size)
                    columns |= {"g1": pa.array(g[:, 0]), "g2": pa.array(g[:, 1]), "lo": pa.array(lo.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "doc_id": pa.array(ids[rows]), "version": pa.array(versions[rows])}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, "h bigint, uses bigint" + (", g1 bigint, g2 bigint, lo int, n int, doc_id bigint, version int" if words else ""))


def window_rows(docs: DataFrame, length: int) -> DataFrame:
    """From (doc_id, text, version, segs array of (lo, n, copies)): the windows, with the MD5 of their words (k1, k2), ``off`` within the segment from ``lo`` on, and ``copies``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions, segs = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            for t in tokenize(b.column(1)):
                mine = segs.slice(t.first, t.n_docs)
                flat, size = mine.flatten(), mine.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(t.n_docs), size)
                lo, n, copies = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n", "copies"))
                words, stop = _Words(t), np.cumsum(n)
                # so many windows at a time, as a long text of few words may have millions in one segment
                for begin in range(0, int(stop[-1]) if len(stop) else 0, _CHUNK):
                    at = np.arange(begin, min(begin + _CHUNK, int(stop[-1])))
                    seg = np.searchsorted(stop, at, "right")
                    off = at - (stop - n)[seg]
                    first = lo[seg] + off + t.off[doc[seg]]
                    k, row = words.md5(first, first + length - 1), t.first + doc[seg]
                    yield pa.RecordBatch.from_pydict({"k1": pa.array(k[:, 0]), "k2": pa.array(k[:, 1]), "doc_id": pa.array(ids[row]), "version": pa.array(versions[row]), "lo": pa.array(lo[seg].astype(np.int32)), "off": pa.array(off.astype(np.int32)), "copies": pa.array(copies[seg])})

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, version int, lo int, off int, copies bigint")


_SEGMENT = ["h", "g1", "g2"]


def _compacted(source: DataFrame, of: list[str]) -> DataFrame:
    """(of, parts): runs of windows whose sources (d, p) follow one another, as (off, n, d, p)."""
    runs = source.groupBy(*of, "d", (F.col("p") - F.col("off")).alias("shift")).agg(F.sort_array(F.collect_list("off")).alias("offs"))
    # the places of a run without one before them, and those without one after them
    edge = lambda other, d: F.expr(f"transform(filter(zip_with(offs, {other}, (x, y) -> named_struct('x', x, 'y', y)), z -> z.y <> z.x {d} 1), z -> z.x)")
    opens, closes = edge("concat(array(-2), slice(offs, 1, size(offs) - 1))", "-"), edge("concat(slice(offs, 2, size(offs) - 1), array(-2))", "+")
    part = F.expr("zip_with(o, c, (x, y) -> named_struct('off', x, 'n', y - x + 1, 'd', d, 'p', x + shift))")
    return runs.withColumn("o", opens).withColumn("c", closes).select(*of, F.explode(part).alias("part")).groupBy(*of).agg(F.collect_list("part").alias("parts"))


def paths(docs: DataFrame, several: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, version, start, n, first_doc_id, first_start): ``n`` windows from ``start`` on that repeat those at the first coordinate. Stashed."""
    docs = with_version(documents(docs.select(F.col("doc_id").cast("bigint"), "text"), "text"), several, "version")
    repeated = segment_rows(docs, length, seed, False).groupBy("h").agg(F.sum("uses").alias("u")).where("u > 1").select("h")
    found = stash(segment_rows(docs, length, seed, True).join(repeated, "h"))
    kinds = found.groupBy("h").agg((F.max("uses") > 1).alias("loops"), *(f(c).alias(f"{c}_{k}") for c in ("g1", "g2") for k, f in (("lo", F.min), ("hi", F.max))))
    distinct = found.groupBy(*_SEGMENT).agg(F.min(F.struct("doc_id", "lo", "version", "n")).alias("at"), F.count("*").alias("copies")).join(kinds, "h")
    distinct = stash(distinct.select(*_SEGMENT, "at.*", "copies", (F.col("loops") | (F.col("g1_lo") != F.col("g1_hi")) | (F.col("g2_lo") != F.col("g2_hi"))).alias("branches")))
    whole = distinct.where("not branches and copies > 1").select(*_SEGMENT, F.expr("array(named_struct('off', 0, 'n', n, 'd', doc_id, 'p', lo))").alias("parts"))
    branching = distinct.where("branches")
    split = branching.groupBy("doc_id", "version").agg(F.collect_list(F.struct("lo", "n", "copies")).alias("segs"))
    windows = stash(window_rows(docs.join(split.hint("shuffle_hash"), ["doc_id", "version"]).select("doc_id", "text", "version", "segs"), length))
    first = windows.groupBy("k1", "k2").agg(F.sum("copies").alias("c"), F.min(F.struct("doc_id", (F.col("lo") + F.col("off")).alias("pos"))).alias("first")).where("c > 1")
    source = windows.join(first, ["k1", "k2"]).select("doc_id", "version", "lo", "off", F.col("first.doc_id").alias("d"), F.col("first.pos").alias("p"))
    at = ["doc_id", "version", "lo"]
    parts = _compacted(source, at).join(branching, at).select(*_SEGMENT, "parts")
    out = stash(
        found.join(whole.unionByName(parts), _SEGMENT)
        .select("doc_id", "version", "lo", F.explode("parts").alias("x"))
        .where("x.d <> doc_id or x.p <> lo + x.off")
        .select("doc_id", "version", (F.col("lo") + F.col("x.off")).alias("start"), F.col("x.n").alias("n"), F.col("x.d").alias("first_doc_id"), F.col("x.p").alias("first_start"))
    )
    drop_stash(found, distinct, windows)
    return out


def _spans(p: DataFrame, length: int, *by: str) -> DataFrame:
    """The paths that touch or overlap, as one span; ``by`` names the columns that a span has in common."""
    w = Window.partitionBy(*by).orderBy("start")
    p = p.withColumn("end", F.col("start") + F.col("n") + F.lit(length - 1))
    p = p.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("span", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*by, "span").agg(F.min("start").alias("start_token"), F.max("end").alias("end_token"), F.min_by(F.struct("first_doc_id", "first_start"), "start").alias("f"))


def duplicate_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, start_token, end_token, first_doc_id, first_token), one row for each longest span of duplicate words.

    ``end_token`` is exclusive. ``first_doc_id`` and ``first_token`` are the
    earliest coordinate of the span's first window.
    """
    found = _spans(paths(docs, several_texts(docs), length, seed), length, "doc_id")
    return found.select("doc_id", "start_token", "end_token", F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_start").alias("first_token"))


def _cut(t: Tokens, d: int, spans: list[tuple[int, int]]) -> bytes:
    """A document's bytes without the words of the spans, nor the white space after them."""
    a, b = int(t.off[d]), int(t.off[d + 1])
    lo, hi = int(t.bounds[d]), int(t.bounds[d + 1])
    out, at = [], lo
    for s, e in sorted(spans):
        out.append(t.raw[at : t.start[a + s]].tobytes())
        at = int(t.start[a + e]) if a + e < b else hi
    return b"".join([*out, t.raw[at:hi].tobytes()])


def remove_duplicates(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` without the words of duplicate spans; documents of which no word is left are gone.

    ``text`` (and ``n_chars``, where there is such a column) changes in documents
    with spans only; the other columns stay as they are.
    """
    several = several_texts(docs)
    spans = _spans(paths(docs, several, length, seed), length, "doc_id", "version").groupBy(F.col("doc_id").alias("__span_doc"), F.col("version").alias("__span_version")).agg(F.sort_array(F.collect_list(F.struct("start_token", "end_token"))).alias("__spans"))
    own = (F.col("doc_id").cast("bigint") == F.col("__span_doc")) & (F.col("__version") == F.col("__span_version"))
    joined = with_version(docs, several, "__version").join(spans.hint("shuffle_hash"), own, "left").drop("__span_doc", "__span_version", "__version")
    n_chars = "n_chars" in docs.columns
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("__spans")
            some = np.flatnonzero(np.asarray(spans.is_valid()))
            if not len(some):
                yield b.select(names)
                continue
            take = pa.array(some)
            texts, marks = b.column("text").take(take), spans.take(take).to_pylist()
            new = {}
            for t in tokenize(texts, hashes=False):
                for d in range(t.n_docs):
                    i = t.first + d
                    new[int(some[i])] = _cut(t, d, [(m["start_token"], m["end_token"]) for m in marks[i]]).decode()
            text = b.column("text").to_pylist()
            for i, x in new.items():
                text[i] = x
            keep = pa.array([i for i in range(b.num_rows) if i not in new or new[i].strip("\t\n\x0b\x0c\r ")])
            columns = []
            for name in names:
                column = b.column(name)
                if name == "text":
                    column = pa.array(text, column.type)
                elif name == "n_chars" and n_chars:
                    old = column.to_pylist()
                    column = pa.array([len(new[i]) if i in new else v for i, v in enumerate(old)], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names).take(keep)

    return joined.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents"))


ORACLE = f"""
with w as (
  select doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '') as t from documents
), win as (
  select doc_id, p - 1 as pos, array_to_string(t[p : p + {LENGTH - 1}], ' ') as g
  from (select doc_id, t, unnest(range(1, len(t) - {LENGTH} + 2)) as p from w where len(t) >= {LENGTH})
), f as (
  select doc_id, pos, first_value(struct_pack(d := doc_id, p := pos)) over (partition by g order by doc_id, pos) as src from win
), dup as (
  select doc_id, pos, src, lag(pos) over (partition by doc_id order by pos) as before from f where src.d <> doc_id or src.p <> pos
), isl as (
  select *, sum(case when before is null or pos > before + {LENGTH} then 1 else 0 end) over (partition by doc_id order by pos) as span from dup
)
select doc_id, cast(min(pos) as int) as start_token, cast(max(pos) + {LENGTH} as int) as end_token,
  min_by(src, pos).d as first_doc_id, cast(min_by(src, pos).p as int) as first_token
from isl group by doc_id, span
"""
