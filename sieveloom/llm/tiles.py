"""Exact all-pairs comparison of binary codes in tiles.

Codes are sorted by a bounding key (for bit codes the population count) and
packed into tiles of ``tile`` codes. A pair of tiles is compared only if their
key ranges come within ``reach``; a tile's copies meet in one group by pair, so
a task holds two tiles whatever the size of the corpus. Work is quadratic in
the number of distinct codes (less what the key rules out); the data sent are
``codes * tiles / 2`` at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tile list is broadcast while it is below this size; beyond it, Spark joins without a hint.
BROADCAST_BYTES = 4 << 20
MOST_PARTITIONS = 8192


def pack(codes: DataFrame, n: int, tile: int) -> DataFrame:
    """(tile, lo, hi, ids, keys, codes) from (id bigint, key int, code binary of one width); ``n`` is the number of rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, keys, body, held = [], [], [], 0

        def full(last: bool):
            nonlocal ids, keys, body, held, k
            if not held:
                return
            i, q, c = np.concatenate(ids), np.concatenate(keys), np.concatenate(body)
            at = 0
            while len(i) - at >= tile or last and at < len(i):
                s = slice(at, at + tile)
                yield pa.RecordBatch.from_pydict({"tile": pa.array([(part << 32) | k], pa.int64()), "lo": pa.array([int(q[s].min())], pa.int32()), "hi": pa.array([int(q[s].max())], pa.int32()), "ids": pa.array([i[s].tobytes()], pa.binary()), "keys": pa.array([q[s].tobytes()], pa.binary()), "codes": pa.array([c[s].tobytes()], pa.binary())})
                k, at = k + 1, at + tile
            ids, keys, body, held = [i[at:]], [q[at:]], [c[at:]], len(i) - at

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            keys.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int32))
            body.append(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1))
            held += b.num_rows
            yield from full(False)
        yield from full(True)

    return codes.select("id", "key", "code").repartitionByRange(max(1, -(-n // tile)), "key", "code").sortWithinPartitions("key", "code").mapInArrow(build, "tile bigint, lo int, hi int, ids binary, keys binary, codes binary")


def compare(tiles: DataFrame, n_tiles: int, reach: int, kernel: Callable, schema: str) -> DataFrame:
    """Runs ``kernel(ids_a, keys_a, codes_a, ids_b, keys_b, codes_b, same)`` on each pair of tiles within ``reach``.

    ``tiles`` must be a stashed table. The kernel gives a dict of arrays in the order of ``schema``.
    """
    meta = tiles.select(F.col("tile").alias("other"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    if n_tiles * 32 <= BROADCAST_BYTES:
        meta = F.broadcast(meta)
    near = (F.col("olo") - F.col("hi") <= reach) & (F.col("lo") - F.col("ohi") <= reach)
    copies = tiles.join(meta, near).select(F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "ids", "keys", "codes")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = sorted(range(group.num_rows), key=lambda r: group["tile"][r].as_py())
        sides = []
        for r in rows:
            ids = np.frombuffer(group["ids"][r].as_buffer(), np.int64)
            sides += [ids, np.frombuffer(group["keys"][r].as_buffer(), np.int32), np.frombuffer(group["codes"][r].as_buffer(), np.uint8).reshape(len(ids), -1)]
        same = len(rows) == 1
        return pa.table(kernel(*sides, *(sides if same else []), same))

    # a pair of tiles is much work for its bytes: as many partitions as pairs, up to a number that keeps a large cluster busy
    pairs = min(n_tiles * (n_tiles + 1) // 2, MOST_PARTITIONS)
    return copies.repartition(max(1, pairs), "t1", "t2").groupBy("t1", "t2").applyInArrow(run, schema)
