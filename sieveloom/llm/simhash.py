"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

A document's code has 128 bits: each distinct term votes with the 128 bits of
its MD5, and a bit is set if more than half of the terms set it. Two documents
are near duplicates if their codes differ in at most ``radius`` bits; groups are
the connected components of that relation. All pairs of distinct codes are
compared, except pairs of tiles (and of blocks in them) whose population counts
differ beyond the radius, and, within large tiles, pairs of which none of eight
parts is near enough, which can't be within the radius: so the search is exact.
Tiles whose codes share their parts are compared in blocks. A pair of tiles sends no pairs
of codes: each code's number of links, and one edge to the least code it is
linked with, directly or through others of the two tiles. So the groups and all
counts are whole, and m copies of a text cost m rows, not m squared.

A document is a ``doc_id`` with a text: repeated rows are one document, and
different texts under one ``doc_id`` are documents of their own, in the result
and in ``deduplicate``. Null and empty texts, and texts without terms, have no
code and are in no group. Of a group, the document with the smallest id stays
(of one id with several texts in the group, the one whose code, then hash, is
least). Rows without ``doc_id`` take no part and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import tiles
from sieveloom.llm.common import drop_stash, stash, table
from sieveloom.llm.components import components
from sieveloom.llm.textarrays import TERMS, tokenize

RADIUS = 24
TILE = 32768
_BLOCK_A, _BLOCK_B = 32, 2048
_HELD = 1 << 21  # so many links of two tiles are held at once
PARTS = 8
_PIECE = 1 << 16  # so many pairs are compared at once
_FEW = 1 << 24  # so many pairs take as long in blocks as the search by parts takes for its masks
_SHARE = 0.15  # of all pairs: with more candidates, blocks are faster
_SAMPLED = 16


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes as (n, 16) bytes, has a code) of a string column."""
    n = len(column)
    out, has = np.zeros((n, 16), np.uint8), np.zeros(n, bool)
    for t in tokenize(column, TERMS):
        if not len(t.hash):
            continue
        _, at, inv = np.unique(t.hash, return_index=True, return_inverse=True)
        view, start, end = memoryview(t.data), t.start[at].tolist(), t.end[at].tolist()
        md5 = hashlib.md5
        bits = np.unpackbits(np.frombuffer(b"".join([md5(view[s:e]).digest() for s, e in zip(start, end, strict=True)]), np.uint8).reshape(-1, 16), axis=1)
        key = np.unique(t.doc * len(at) + inv)
        doc, term = np.divmod(key, len(at))
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(np.append(first, len(doc)))
        # the votes of a document are summed; a few documents at a time, as each vote is 128 bytes
        for i in range(0, len(first), 256):
            lo, hi = first[i], (first[i + 256] if i + 256 < len(first) else len(doc))
            for a in ([lo] if hi - lo <= 65536 else first[i : i + 256]):
                b = hi if hi - lo <= 65536 else a + size[np.searchsorted(first, a)]
                starts = first[(first >= a) & (first < b)]
                votes = np.add.reduceat(bits[term[a:b]], starts - a, axis=0, dtype=np.int32)
                d = t.first + doc[starts]
                out[d] = np.packbits(votes * 2 > size[np.searchsorted(first, starts)][:, None], axis=1)
                has[d] = True
    return out, has


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, code) of each row that has terms; ``h`` is the hash of the text, ``code`` is 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, has = codes_of(b.column(2))
            at = pa.array(np.flatnonzero(has))
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(code), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), codes.take(at)], ["doc_id", "h", "code"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id bigint, h bigint, code binary")


def spanning(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes is linked with by the edges (x, y), directly or through others."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, least[x], m)
        np.minimum.at(new, least[y], m)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def limits(radius: int) -> list[int]:
    """How near the 16-bit parts of two codes must be: of codes within ``radius``, one part at least is within its limit, as all beyond them make ``radius`` + 1 bits."""
    each, more = divmod(radius + 1, PARTS)
    return [each - (k >= more) for k in range(PARTS)]


def _masks(limit: int) -> np.ndarray:
    """All differences of two parts within a limit."""
    m = np.arange(1 << 16, dtype=np.uint16)
    return m[np.bitwise_count(m) <= limit]


def candidates(a: np.ndarray, b: np.ndarray, radius: int, step: int = _SAMPLED) -> int:
    """About how many pairs of codes ``by_parts`` compares, from every ``step``-th code of ``a``."""
    total, a, b = 0, a.view(np.uint16)[::step], b.view(np.uint16)
    for k, limit in enumerate(limits(radius)):
        count = np.bincount(b[:, k], minlength=1 << 16)
        total += sum(int(count.take(a[:, k] ^ m).sum()) for m in _masks(limit))
    return total * step


def by_parts(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the pairs of codes within the radius, each once: those are compared that are near enough in one part (multi-index hashing, Norouzi et al., 2012)."""
    parts_a, parts_b, limit = a.view(np.uint16), b.view(np.uint16), limits(radius)
    rows = np.arange(len(a))
    for k in range(PARTS):
        order_a = np.argsort(parts_a[:, k], kind="stable")
        order_b = order_a if same else np.argsort(parts_b[:, k], kind="stable")
        value, size = parts_a[order_a, k].astype(np.int64), np.bincount(parts_b[:, k], minlength=1 << 16)
        start, half = np.cumsum(size) - size, k * 2 // PARTS
        far_a, far_b, own_a, own_b = a[order_a, 1 - half], b[order_b, 1 - half], a[order_a, half], b[order_b, half]
        for m in _masks(limit[k]).tolist():
            of = value ^ m
            n = size.take(of, mode="clip")  # no index is out of bounds: "clip" saves the check
            if same and m:
                n[of < value] = 0  # the other of the two has this pair
            end = np.cumsum(n)
            low = start.take(of, mode="clip") - end + n
            i, done = 0, 0
            while done < end[-1]:
                j = max(i + 1, int(np.searchsorted(end, done + _PIECE, "right")))
                x = np.repeat(rows[i:j], n[i:j])
                y = np.arange(done, done + len(x)) + low.take(x, mode="clip")
                i, done = j, int(end[j - 1])
                d = np.bitwise_count(far_a.take(x, mode="clip") ^ far_b.take(y, mode="clip"))
                hit = np.flatnonzero(d <= radius)
                x, y = x.take(hit), y.take(hit)
                ok = d.take(hit) + np.bitwise_count(own_a.take(x) ^ own_b.take(y)) <= radius
                x, y = order_a[x[ok]], order_b[y[ok]]
                ok = ~(np.bitwise_count(parts_a[x, :k] ^ parts_b[y, :k]) <= np.array(limit[:k], int)).any(axis=1)  # an earlier part has those
                if same and not m:
                    ok &= x < y
                if ok.any():
                    yield x[ok], y[ok]


def by_blocks(a: np.ndarray, b: np.ndarray, ka: np.ndarray, kb: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the pairs of codes within the radius, each once: all are compared, but for blocks whose population counts differ too much."""
    a0, a1, b0, b1 = (np.ascontiguousarray(x) for x in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]))
    for j in range(0, len(b), _BLOCK_B):
        jj = slice(j, j + _BLOCK_B)
        klo, khi = int(kb[jj].min()), int(kb[jj].max())
        for i in range(0, min(len(a), j + _BLOCK_B) if same else len(a), _BLOCK_A):
            ii = slice(i, i + _BLOCK_A)
            if int(ka[ii].min()) - khi > radius or klo - int(ka[ii].max()) > radius:
                continue
            d = np.bitwise_count(a0[ii, None] ^ b0[None, jj])
            d += np.bitwise_count(a1[ii, None] ^ b1[None, jj])
            x, y = np.divmod(np.flatnonzero(d <= radius), d.shape[1])
            x, y = x + i, y + j
            if same:
                ok = x < y
                x, y = x[ok], y[ok]
            if len(x):
                yield x, y


def _near(radius: int):
    def kernel(ia, ka, ca, ib, kb, cb, same):
        a, b = np.ascontiguousarray(ca).view(np.uint64), np.ascontiguousarray(cb).view(np.uint64)
        shift = 0 if same else len(a)
        n = shift + len(b)
        # either way finds all pairs: few codes, a large radius, or codes that share their parts take fewer steps in blocks
        crowded = len(a) * len(b) < _FEW or sum(len(_masks(t)) for t in limits(radius)) > _SHARE * (1 << 16) or candidates(a, b, radius) > _SHARE * len(a) * len(b)
        found = by_blocks(a, b, ka, kb, same, radius) if crowded else by_parts(a, b, same, radius)
        links, least, left, right, held = np.zeros(n, np.int64), np.arange(n), [], [], 0

        def fold():
            """What has been found so far is held as one edge a node."""
            nonlocal links, least, left, right, held
            if held:
                x, y = np.concatenate(left), np.concatenate(right)
                links += np.bincount(x, minlength=n) + np.bincount(y, minlength=n)
                old = np.flatnonzero(least != np.arange(n))
                least = spanning(np.concatenate([old, x]), np.concatenate([least[old], y]), n)
                left, right, held = [], [], 0

        for x, y in found:
            left.append(x)
            right.append(y + shift)
            held += len(x)
            if held > _HELD:
                fold()
        fold()
        both = ca if same else np.vstack([ca, cb])
        some = np.flatnonzero(links)
        code = lambda at: pa.array([r.tobytes() for r in both[at]], pa.binary())
        return {"code": code(some), "least": code(least[some]), "links": pa.array(links[some])}

    return kernel


def groups(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(code, n_links, group_id, kept_h, kept_code) of the codes in groups of two documents or more; ``prints`` is a stashed result of ``fingerprints``.

    ``n_links`` is the number of other codes within the radius, ``group_id`` the
    smallest ``doc_id`` of the group; the last two tell which text of it is kept.
    """
    document = F.struct("doc_id", "code", "h")
    distinct = stash(prints.groupBy("code").agg(F.min(document).alias("low"), F.max(document).alias("high")))
    key = F.expr("bit_count(cast(conv(hex(substring(code, 1, 4)), 16, 10) as bigint)) + bit_count(cast(conv(hex(substring(code, 5, 4)), 16, 10) as bigint)) + bit_count(cast(conv(hex(substring(code, 9, 4)), 16, 10) as bigint)) + bit_count(cast(conv(hex(substring(code, 13, 4)), 16, 10) as bigint))")
    packed = stash(tiles.pack(distinct.select(F.lit(0).cast("bigint").alias("id"), key.cast("int").alias("key"), "code"), distinct.count(), tile))
    near = stash(tiles.compare(packed, packed.count(), radius, _near(radius), "code binary, least binary, links bigint"))
    roots = components(near, "code", "least").withColumnRenamed("node", "code")
    links = near.groupBy("code").agg(F.sum("links").alias("n_links"))
    # a code without links is a group if it stands for several documents
    members = distinct.join(links.join(roots, "code"), "code", "left").where("root is not null or low <> high").withColumn("root", F.coalesce("root", "code"))
    firsts = members.groupBy("root").agg(F.min("low").alias("first"))
    found = stash(members.join(firsts, "root").select("code", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.doc_id").alias("group_id"), F.col("first.h").alias("kept_h"), F.col("first.code").alias("kept_code")))
    drop_stash(distinct, packed, near, roots)
    return found


_KEPT = "doc_id = group_id and h = kept_h and code = kept_code"


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, group_id, n_links, is_kept): every document that has a near duplicate, with the group's smallest id and the number of other codes that it is linked with.

    Documents of one code are copies of each other; they share their links.
    """
    prints = stash(fingerprints(docs))
    return prints.join(groups(prints, radius, tile), "code").groupBy("doc_id", "h", "group_id").agg(F.first("n_links").cast("int").alias("n_links"), F.first(F.expr(_KEPT)).alias("is_kept")).drop("h")


def deduplicate(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs`` with one document of each group, each document once; columns as they were."""
    prints = stash(fingerprints(docs))
    dropped = stash(prints.join(groups(prints, radius, tile), "code").where(f"not ({_KEPT})").select("doc_id", "h").distinct())
    repeated = stash(prints.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h"))
    drop_stash(prints)
    if repeated.isEmpty():
        return _less(docs, dropped)
    # both stashed tables name documents, not texts: only the rows of repeated ones are grouped by their text
    kept = _less(docs, dropped.unionByName(repeated))
    twice = _rows(docs, repeated.join(dropped, ["doc_id", "h"], "left_anti"), "left_semi")
    return kept.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def _rows(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    named = named.select(F.col("doc_id").alias("__named_id"), F.col("h").alias("__named_h"))
    return docs.join(named.hint("shuffle_hash"), (F.col("doc_id").cast("bigint") == F.col("__named_id")) & (F.xxhash64("text") == F.col("__named_h")), how)


def _less(docs: DataFrame, named: DataFrame) -> DataFrame:
    return _rows(docs, named, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    votes = ", ".join(f"sum((h{k} >> {i}) & 1) as v{k}_{i}" for k in (1, 2) for i in range(64))
    word = lambda k: " + ".join(f"(case when 2 * v{k}_{i} > n then {1 << i}::hugeint else 0 end)" for i in range(64))
    return f"""
with recursive d as (
  select doc_id, text, row_number() over () as r from (select distinct doc_id, text from documents where doc_id is not null)
), t as (
  select r, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))) as term from d
), h as (
  select r, ('0x' || substr(md5(term), 1, 16))::ubigint::hugeint as h1, ('0x' || substr(md5(term), 17, 16))::ubigint::hugeint as h2 from t
), v as (
  select r, count(*) as n, {votes} from h group by r
), code as (
  select r, doc_id, ({word(1)})::hugeint as c1, ({word(2)})::hugeint as c2 from v join d using (r)
), kind as (
  select c1, c2, row_number() over () as k, count(*) as copies from code group by c1, c2
), pairs as (
  select a.k as x, b.k as y from kind a join kind b on a.k <> b.k and bit_count(xor(a.c1, b.c1)) + bit_count(xor(a.c2, b.c2)) <= {RADIUS}
), reach(node, other) as (
  select k, k from kind union select reach.node, pairs.y from reach join pairs on reach.other = pairs.x
), root as (
  select node as k, min(other) as root from reach group by node
), links as (
  select x as k, count(*) as n from pairs group by x
), member as (
  select doc_id, root, coalesce(links.n, 0)::int as n_links, copies, r, c1, c2 from code join kind using (c1, c2) join root using (k) left join links using (k)
)
select doc_id, min(doc_id) over (partition by root) as group_id, n_links, row_number() over (partition by root order by doc_id, c1, c2, r) = 1 as is_kept from member where copies > 1 or n_links > 0
"""


ORACLE = _oracle()
