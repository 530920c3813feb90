"""Document fingerprints: quartile bucket digests of byte triplets, compared by a bounded difference score.

From every window of five bytes of a text's UTF-8 form six triplets are hashed
into 128 buckets. A bucket is encoded by the quartile its count falls in (0 to
3); the header holds the logarithm of the length and the ratios of the first and
the second quartile to the third. The difference of two digests adds up

- per bucket, the difference of the quartiles, a difference of 3 counting 6;
- the circular differences (mod 16) of the two ratios, and the difference of the
  lengths' logarithms: d if d <= 1, else 12 (d - 1) for a ratio and 12 d for a length.

Scores beyond ``BOUND`` are not told apart: two digests match if their score is
at most ``BOUND``. All pairs of distinct digests are compared, except pairs of
tiles whose lengths alone put them beyond the bound, so the search is exact.

Documents of one digest are a class, named by its smallest ``doc_id``.
``classes``, the query, has a row for each document: its class, the number of
other classes that match it, and the nearest of these. Pairs of tiles send
counts and nearest classes, not pairs, so m copies cost m rows.
``near_pairs`` gives the matching pairs of classes, which may be many.

Null texts, texts of fewer than ``MIN_BYTES`` bytes and texts that fill fewer
than half of the buckets, or whose third quartile is zero, have no digest, no class and no match.
Ties of the score go to the smallest class id. Rows that repeat a ``doc_id`` have
a row each, with the class of their own text. Rows without ``doc_id`` are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm import tiles
from sieveloom.llm.common import documents, drop_stash, stash, table
from sieveloom.llm.textarrays import groups, string_buffers

BUCKETS = 128
MIN_BYTES = 50
BOUND = 30
TILE = 16384
#: The triplets of a window: the places of its three bytes, and the factors of its hash.
TRIPLETS = ((4, 3, 2, 40503, 9973, 31337), (4, 3, 1, 52711, 7919, 28657), (4, 2, 1, 47057, 6151, 25841), (4, 2, 0, 61631, 12289, 17393), (4, 3, 0, 57667, 3079, 21701), (4, 1, 0, 44917, 24593, 14503))
_SHIFT = 9
_BLOCK_A, _BLOCK_B = 32, 2048


def bucket(x, y, z, p, q, r):
    return ((x * p + y * q + z * r) >> _SHIFT) & (BUCKETS - 1)


def length_code(n: np.ndarray) -> np.ndarray:
    """Eight steps to a doubling of the length; integer arithmetic, so that it is the same everywhere."""
    n = np.asarray(n, np.int64)
    e = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    e -= (np.int64(1) << e) > n
    e += (np.int64(1) << (e + 1)) <= n
    return (8 * e + np.where(e >= 3, (n >> np.maximum(e - 3, 0)) - 8, 0)).astype(np.int64)


def digests_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(digests as (n, 35) bytes, has one): length code, the two ratios, 32 bytes of quartiles (bucket 0 in the lowest bits of the first)."""
    raw, offsets = string_buffers(column)
    out, has = np.zeros((len(offsets) - 1, 35), np.uint8), np.zeros(len(offsets) - 1, bool)
    size = np.diff(offsets)
    for i, j in groups(offsets, 1 << 18):
        b = raw[offsets[i] : offsets[j]].astype(np.int32)
        if len(b) < 5:
            continue
        n = j - i
        doc = np.repeat(np.arange(n, dtype=np.int32), size[i:j])
        inside = doc[:-4] == doc[4:]
        base = (doc[4:] * BUCKETS)[inside]
        at = [b[k : len(b) - 4 + k][inside] for k in range(5)]
        counts = np.zeros(n * BUCKETS, np.int64)
        for x, y, z, p, q, r in TRIPLETS:
            counts += np.bincount(base + bucket(at[x], at[y], at[z], p, q, r), minlength=n * BUCKETS)
        counts = counts.reshape(n, BUCKETS)
        s = np.sort(counts, axis=1)
        q1, q2, q3 = s[:, BUCKETS // 4 - 1], s[:, BUCKETS // 2 - 1], s[:, 3 * BUCKETS // 4 - 1]
        ok = (size[i:j] >= MIN_BYTES) & ((counts > 0).sum(1) >= BUCKETS // 2) & (q3 > 0)
        code = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
        code = code.reshape(n, 32, 4)
        body = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
        safe = np.maximum(q3, 1)
        out[i:j] = np.column_stack([np.minimum(length_code(size[i:j]), 255), (q1 * 100 // safe) % 16, (q2 * 100 // safe) % 16, body]).astype(np.uint8)
        has[i:j] = ok
    return out, has


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest binary); digest is null where a text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, has = digests_of(b.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "digest": pa.array([x.tobytes() if h else None for x, h in zip(d, has, strict=True)], pa.binary())})

    return documents(docs.select(F.col("doc_id").cast("bigint"), "text"), "text").mapInArrow(run, "doc_id bigint, digest binary")


def difference(a: bytes, b: bytes) -> int:
    """The score of two digests, plainly."""
    total = abs(a[0] - b[0])
    total = total if total <= 1 else 12 * total
    for k in (1, 2):
        d = (a[k] - b[k]) % 16
        d = min(d, 16 - d)
        total += d if d <= 1 else 12 * (d - 1)
    for x, y in zip(a[3:], b[3:], strict=True):
        for s in (0, 2, 4, 6):
            d = abs((x >> s & 3) - (y >> s & 3))
            total += 6 if d == 3 else d
    return total


def _planes(d: np.ndarray) -> np.ndarray:
    """Three bit planes (n, 6) uint64 of the quartiles: at least 1, at least 2, at least 3; an exclusive-or of planes counts the differences."""
    code = np.stack([d[:, 3:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(d), BUCKETS)
    return np.hstack([np.packbits(code >= k, axis=1).view(np.uint64) for k in (1, 2, 3)])


def _pairs(bound: int):
    """A search of two tiles for all pairs within ``bound``, in portions: (row in the first, row in the second, score)."""
    circle = np.array([[min((x - y) % 16, (y - x) % 16) for x in range(16)] for y in range(16)])
    ratio = np.where(circle <= 1, circle, 12 * (circle - 1)).astype(np.int32)

    def search(ka, ca, kb, cb, same):
        pa_, pb = _planes(ca), np.ascontiguousarray(_planes(cb).T)
        for j in range(0, len(kb), _BLOCK_B):
            jj = slice(j, j + _BLOCK_B)
            klo, khi = int(kb[jj].min()), int(kb[jj].max())
            for i in range(0, min(len(ka), j + _BLOCK_B) if same else len(ka), _BLOCK_A):
                ii = slice(i, i + _BLOCK_A)
                if 12 * (int(ka[ii].min()) - khi) > bound or 12 * (klo - int(ka[ii].max())) > bound:
                    continue
                near = np.flatnonzero((kb[jj] >= int(ka[ii].min()) - bound // 12) & (kb[jj] <= int(ka[ii].max()) + bound // 12)) + j
                if not len(near):
                    continue
                lo, hi = near[0], near[-1] + 1  # sorted by length
                head = np.bitwise_count(pa_[ii, 0, None] ^ pb[0, None, lo:hi])
                for k in range(1, 6):
                    head += np.bitwise_count(pa_[ii, k, None] ^ pb[k, None, lo:hi])
                hit = np.flatnonzero(head <= bound)
                if not len(hit):
                    continue
                x, y = np.divmod(hit, hi - lo)
                x, y = x + i, y + lo
                if same:
                    x, y = x[x < y], y[x < y]
                total = head.reshape(-1)[(x - i) * (hi - lo) + y - lo].astype(np.int32)
                far = sum(np.bitwise_count((pa_[x, k] ^ pb[k, y]) & (pa_[x, 2 + k] ^ pb[2 + k, y]) & (pa_[x, 4 + k] ^ pb[4 + k, y])).astype(np.int32) for k in (0, 1))
                total += 3 * far
                d = np.abs(ka[x] - kb[y])
                total += np.where(d <= 1, d, 12 * d) + ratio[ca[x, 1], cb[y, 1]] + ratio[ca[x, 2], cb[y, 2]]
                ok = total <= bound
                if ok.any():
                    yield x[ok], y[ok], total[ok]

    return search


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in codes], pa.binary())


def _linked(bound: int):
    search = _pairs(bound)

    def kernel(ia, ka, ca, ib, kb, cb, same):
        shift = 0 if same else len(ia)
        ids, codes = (ia, ca) if same else (np.concatenate([ia, ib]), np.vstack([ca, cb]))
        links, score, other = np.zeros(len(ids), np.int64), np.full(len(ids), bound + 1), np.zeros(len(ids), np.int64)
        for x, y, s in search(ka, ca, kb, cb, same):
            y = y + shift
            a, b, s = np.concatenate([x, y]), ids[np.concatenate([y, x])], np.concatenate([s, s])
            order = np.lexsort((b, s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.flatnonzero(np.diff(a, prepend=-1))
            links[a[first]] += np.diff(np.append(first, len(a)))
            a, b, s = a[first], b[first], s[first]
            better = (s < score[a]) | (s == score[a]) & (b < other[a])
            score[a[better]], other[a[better]] = s[better], b[better]
        some = np.flatnonzero(links)
        return {"digest": _binary(codes[some]), "links": pa.array(links[some]), "score": pa.array(score[some].astype(np.int32)), "other": pa.array(other[some])}

    return kernel


def _all_within(bound: int):
    search = _pairs(bound)

    def kernel(ia, ka, ca, ib, kb, cb, same):
        found = list(search(ka, ca, kb, cb, same))
        x, y, s = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in (zip(*found, strict=True) if found else ((), (), ())))
        pairs = [sorted((p.tobytes(), q.tobytes())) for p, q in zip(ca[x], cb[y], strict=True)]
        return {"digest": pa.array([p[0] for p in pairs], pa.binary()), "other": pa.array([p[1] for p in pairs], pa.binary()), "score": pa.array(s.astype(np.int32))}

    return kernel


def _packed(distinct: DataFrame, tile: int) -> DataFrame:
    key = F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("int")
    return stash(tiles.pack(distinct.select(F.col("class_id").alias("id"), key.alias("key"), F.col("digest").alias("code")), distinct.count(), tile))


def near_pairs(prints: DataFrame, bound: int = BOUND, tile: int = TILE) -> DataFrame:
    """(digest, other, score) of every pair of distinct digests within ``bound``, once each, the smaller digest first.

    From the result of ``digests``, stashed. Rows of one digest are exact copies
    by it: joined to ``prints`` on either side, a pair stands for each of them.
    """
    packed = _packed(stash(prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))), tile)
    return tiles.compare(packed, packed.count(), bound // 12, _all_within(bound), "digest binary, other binary, score int")


def classes(docs: DataFrame, bound: int = BOUND, tile: int = TILE) -> DataFrame:
    """(doc_id, digest hex, class_id, n_links, nearest_class_id, score) of every document.

    ``n_links`` is the number of other digests within ``bound``; the last two are null where there is none.
    """
    prints = stash(digests(docs))
    distinct = stash(prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    packed = _packed(distinct, tile)
    near = tiles.compare(packed, packed.count(), bound // 12, _linked(bound), "digest binary, links bigint, score int, other bigint")
    near = near.groupBy("digest").agg(F.sum("links").alias("links"), F.min(F.struct("score", "other")).alias("m"))
    own = stash(distinct.join(near, "digest", "left"))
    drop_stash(distinct, packed)
    return prints.join(own, "digest", "left").select("doc_id", F.lower(F.hex("digest")).alias("digest"), "class_id", F.coalesce("links", F.lit(0)).cast("int").alias("n_links"), F.col("m.other").alias("nearest_class_id"), F.col("m.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    triplet = " union all ".join(f"select doc_id, ((b{x} * {p} + b{y} * {q} + b{z} * {r}) >> {_SHIFT}) & {BUCKETS - 1} as k from w" for x, y, z, p, q, r in TRIPLETS)
    quartile = "cast(c > q1 as int) + cast(c > q2 as int) + cast(c > q3 as int)"
    ratio = lambda k: f"case when least((a.{k} - b.{k} + 16) % 16, (b.{k} - a.{k} + 16) % 16) <= 1 then least((a.{k} - b.{k} + 16) % 16, (b.{k} - a.{k} + 16) % 16) else 12 * (least((a.{k} - b.{k} + 16) % 16, (b.{k} - a.{k} + 16) % 16) - 1) end"
    return f"""
with d as (
  select doc_id, hex(encode(text)) as h, strlen(text) as n from documents where doc_id is not null
), bytes as (
  select doc_id, unnest(range(0, n)) as p, unnest(list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as int))) as b0 from d where n >= {MIN_BYTES}
), windows as (
  select doc_id, b0, lead(b0, 1) over o as b1, lead(b0, 2) over o as b2, lead(b0, 3) over o as b3, lead(b0, 4) over o as b4 from bytes window o as (partition by doc_id order by p)
), w as (
  select * from windows where b4 is not null
), t as ({triplet}
), counted as (
  select doc_id, k, count(*) as c from t group by all
), filled as (
  select x.doc_id, g.k, coalesce(counted.c, 0) as c from (select distinct doc_id from w) x cross join (select unnest(range({BUCKETS})) as k) g left join counted on counted.doc_id = x.doc_id and counted.k = g.k
), q as (
  select doc_id, list(c order by c)[{BUCKETS // 4}] as q1, list(c order by c)[{BUCKETS // 2}] as q2, list(c order by c)[{3 * BUCKETS // 4}] as q3, count(*) filter (c > 0) as used from filled group by doc_id
), code as (
  select doc_id, q1, q2, q3, list({quartile} order by k) as v from filled join q using (doc_id) where used >= {BUCKETS // 2} and q3 > 0 group by all
), header as (
  select code.doc_id, v, least(8 * e + case when e >= 3 then (n >> greatest(e - 3, 0)) - 8 else 0 end, 255) as l, (q1 * 100 // q3) % 16 as r1, (q2 * 100 // q3) % 16 as r2
  from code join (select doc_id, n, length(bin(n)) - 1 as e from d) using (doc_id)
), digest as (
  select *, lower(printf('%02x%02x%02x', l, r1, r2) || array_to_string(list_transform(range(0, 32), lambda i: printf('%02x', v[4*i+1] + 4 * v[4*i+2] + 16 * v[4*i+3] + 64 * v[4*i+4])), '')) as digest from header
), kind as (
  select digest, min(doc_id) as class_id, any_value(v) as v, any_value(l) as l, any_value(r1) as r1, any_value(r2) as r2 from digest group by digest
), pairs as (
  select a.digest, b.class_id as other, case when abs(a.l - b.l) <= 1 then abs(a.l - b.l) else 12 * abs(a.l - b.l) end + {ratio('r1')} + {ratio('r2')}
    + list_sum(list_transform(list_zip(a.v, b.v), lambda z: case when abs(z[1] - z[2]) = 3 then 6 else abs(z[1] - z[2]) end)) as score
  from kind a join kind b on a.digest <> b.digest and abs(a.l - b.l) <= {BOUND // 12}
), best as (
  select digest, count(*)::int as n_links, arg_min(other, score * 1000000000000 + other) as nearest_class_id, cast(min(score) as int) as score from pairs where score <= {BOUND} group by digest
)
select d.doc_id, digest.digest, kind.class_id, coalesce(n_links, 0) as n_links, nearest_class_id, best.score
from d left join digest using (doc_id) left join kind on kind.digest = digest.digest left join best on best.digest = digest.digest
"""


ORACLE = _oracle()
