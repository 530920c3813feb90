"""Mixing sources to target weights by capped water-filling.

A source's size is the number of characters of its texts. The target is as many
characters as the table holds (times ``scale``), shared among the sources in
proportion to their weights. A source that would be repeated more than
``max_epochs`` times is clamped there, and what it can't take is shared among
the others in proportion to their weights, until no share is beyond its clamp;
if all are clamped, the mix is smaller than the target. A source's share over
its size is its number of epochs: each of its documents is repeated the whole
part of it, and once more where a hash of the seed and the id, seen as a number
from 0 to 1, is below the fraction.

The clamping rounds end at the level where the sources, in order of clamp by
weight, stop being clamped; that level follows from running sums over the
sources, so the plan has no loop. Only the list of sources is broadcast, while
it has at most ``BROADCAST_SOURCES`` rows.

A null source is a source of its own. Without ``weights`` all sources weigh the
same; with them, a source that they don't name (or name with 0 or less) is left
out. Null and empty texts have no size, and are sampled at the epochs of their source; a
source of only such texts is kept once. Rows without ``doc_id``, and repeated
rows, are sampled like others (a null id hashes as the empty string), so
repeated rows have the same fate. An empty table gives an empty mix. A column
``repetition`` of the input is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.llm.common import table

MAX_EPOCHS = 4
SCALE = 1
SEED = 17
BROADCAST_SOURCES = 20_000


def shares(docs: DataFrame, weights: dict[str | None, float] | None = None, max_epochs: int = MAX_EPOCHS, scale: float = SCALE) -> DataFrame:
    """(source, size, weight, epochs), one row for each source that takes part."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "name string, weight double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    filled = sizes.where("size > 0")
    everyone = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("clamp") / F.col("weight"), F.col("source"))
    filled = (
        filled.withColumn("clamp", F.col("size") * F.lit(float(max_epochs)))
        .withColumn("target", F.sum("size").over(everyone) * F.lit(float(scale)))
        .withColumn("clamped", F.coalesce(F.sum("clamp").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("target") - F.col("clamped")) / F.col("rest"))
        # the first source in this order that holds its share sets the level of all after it
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("clamp"))
        .withColumn("water", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("epochs", F.coalesce(F.col("water") * F.col("weight") / F.col("size"), F.lit(float(max_epochs))))
    )
    return filled.select("source", "size", "weight", "epochs").unionByName(sizes.where("size = 0").select("source", "size", "weight", F.lit(1.0).alias("epochs")))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, max_epochs: int = MAX_EPOCHS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as it is repeated; ``repetition`` counts from 1."""
    names = [c for c in docs.columns if c != "repetition"]
    epochs = shares(docs, weights, max_epochs, scale).select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"))
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        epochs = F.broadcast(epochs)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    times = F.floor("__epochs") + F.when(u < F.col("__epochs") - F.floor("__epochs"), 1).otherwise(0)
    picked = docs.select(*names).join(epochs, F.col("source").eqNullSafe(F.col("__source")))
    return picked.withColumn("__times", times.cast("int")).where("__times > 0").select(*names, F.explode(F.sequence(F.lit(1), "__times")).alias("repetition"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "repetition")


def oracle(documents: str = "documents", columns: str = "doc_id, source") -> str:
    """SQL for the mix of a table or subquery."""
    return f"""
with recursive mix_docs as (select * from {documents}
), sizes as (
  select source, coalesce(sum(length(text)), 0)::bigint as size from mix_docs group by source
), fill as (
  select source, size, {float(MAX_EPOCHS)}::double * size as clamp, row_number() over (order by size, source) as k, count(*) over () as n, sum(size) over () * {float(SCALE)}::double as target from sizes where size > 0
), rounds(k, level) as (
  select 0, max(target) / max(n) from fill
  union all
  select r.k + 1, (f.target - (select sum(clamp) from fill g where g.k <= r.k + 1)) / (f.n - r.k - 1)
  from rounds r join fill f on f.k = r.k + 1 where r.level > f.clamp and f.n > r.k + 1
), epochs as (
  select source, least({float(MAX_EPOCHS)}::double, (select arg_max(level, k) from rounds) / size) as e from fill union all select source, 1.0::double from sizes where size = 0
), times as (
  select d.*, (floor(e) + case when ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 12))::bigint / {float(16**12)}::double < e - floor(e) then 1 else 0 end)::int as times
  from mix_docs d join epochs on d.source is not distinct from epochs.source
)
select {columns}, unnest(range(1, times + 1))::int as repetition from times where times > 0
"""


ORACLE = oracle()
