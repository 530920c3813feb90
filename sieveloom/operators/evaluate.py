"""Experiments: samples by model and condition, how they were accounted for, and what the rules found in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK, Dialect
from sieveloom.operators.lint import finding_arrays

CONDITIONS = ("raw", "compiled")
KEYS = ["model", "condition"]


def usable(d: Dialect, html: str) -> str:
    """Whether a response holds a page worth scoring."""
    return f"(length({html}) >= 200 and {d.has(html, r'<(?:!doctype|html|head|body)')})"


def dense_cells(samples: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(model, condition): both conditions of every model, whether or not there are samples; ``models`` (model) names those without any."""
    named = samples.select("model") if models is None else samples.select("model").unionByName(models.select("model"))
    return named.distinct().crossJoin(F.broadcast(samples.sparkSession.createDataFrame([(c,) for c in CONDITIONS], "condition string")))


def accounting(samples: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(model, condition, attempted, errored, extraction_failed, scored); ``kind`` of a sample is html or error."""
    good = (F.col("kind") == "html") & F.expr(usable(SPARK, "coalesce(html, '')"))
    counts = samples.groupBy(*KEYS).agg(F.count("*").alias("attempted"), F.count_if(F.col("kind") == "error").alias("errored"), F.count_if((F.col("kind") == "html") & ~good).alias("extraction_failed"), F.count_if(good).alias("scored"))
    columns = ("attempted", "errored", "extraction_failed", "scored")
    return dense_cells(samples, models).join(counts, KEYS, "left").select(*KEYS, *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def scored_samples(samples: DataFrame, overrides: DataFrame | None = None, rules: list | None = None) -> DataFrame:
    """(model, condition, sample_id, n_tells, n_violations, tells) of usable samples; a tell is a rule that fired."""
    good = samples.where((F.col("kind") == "html") & F.expr(usable(SPARK, "coalesce(html, '')")))
    ids = [*KEYS, "sample_id"]
    found = finding_arrays(good.select(*ids, "html"), rules, overrides, ids)
    return found.select(*ids, F.expr("array_sort(array_distinct(transform(findings, x -> x.rule_id)))").alias("tells"), F.size("findings").cast("bigint").alias("n_violations")).select(*ids, F.size("tells").alias("n_tells"), "n_violations", "tells")


def cells(samples: DataFrame, scored: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """``accounting`` with ``mean_tells``."""
    sums = scored.groupBy(*KEYS).agg(F.sum("n_tells").alias("t"))
    return accounting(samples, models).join(sums, KEYS, "left").withColumn("mean_tells", F.coalesce("t", F.lit(0)) / F.greatest(F.lit(1), "scored")).drop("t")


def tell_frequency(scored: DataFrame) -> DataFrame:
    """(model, condition, tell, frequency): the share of a cell's scored samples that have the tell."""
    n = scored.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return scored.select(*KEYS, F.explode_outer("tells").alias("tell")).where("tell is not null").groupBy(*KEYS, "tell").agg(F.count("*").alias("c")).join(n, KEYS).select(*KEYS, "tell", (F.col("c") / F.col("n")).alias("frequency"))


def deltas(cells: DataFrame) -> DataFrame:
    """One row for each model: both means, their difference, the reduction in percent, and what a report shows for it."""
    side = lambda c, column: F.max(F.when(F.col("condition") == c, F.col(column)))
    by = cells.groupBy("model").agg(*(F.coalesce(side(c, k), F.lit(0)).alias(f"{c}_{k}") for c in CONDITIONS for k in ("mean_tells", "scored")))
    delta = F.col("raw_mean_tells") - F.col("compiled_mean_tells")
    both = (F.col("raw_scored") > 0) & (F.col("compiled_scored") > 0)
    percent = F.when(both & (F.col("raw_mean_tells") > 0), delta / F.col("raw_mean_tells") * 100).otherwise(0.0)
    return by.select("model", "raw_mean_tells", "compiled_mean_tells", delta.alias("delta"), percent.alias("reduction_pct"), "raw_scored", "compiled_scored", F.when(both, F.format_string("%.1f%%", percent)).otherwise("inconclusive").alias("shown"))


def tell_pivot(frequency: DataFrame, models: list[str]) -> DataFrame:
    """(tell, a column for each model and condition); 0 where a tell never fired. The columns are given, so that the pivot needs no pass of its own."""
    columns = [f"{m}_{c}" for m in models for c in CONDITIONS]
    return frequency.withColumn("cell", F.concat_ws("_", "model", "condition")).groupBy("tell").pivot("cell", columns).agg(F.first("frequency")).na.fill(0.0, columns)


def canonical(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """``cells`` with ``canonical_id`` from a manifest (sanitized_id, canonical_id, ord): the first match, or the model itself."""
    first = manifest.groupBy("sanitized_id").agg(F.min_by("canonical_id", "ord").alias("canonical_id"))
    return cells.join(first, cells["model"] == first["sanitized_id"], "left").withColumn("canonical_id", F.coalesce("canonical_id", "model")).drop("sanitized_id")


def first_seen(rows: DataFrame, order: str, key: str = "model") -> DataFrame:
    """(key, rank): each once, ranked from 1 by where it is first seen in ``order``."""
    first = rows.groupBy(key).agg(F.min(order).alias("__at"))
    return first.select(key, F.row_number().over(Window.orderBy("__at", key)).alias("rank"))  # models are few


def request_ids(responses: DataFrame) -> DataFrame:
    """(canonical_id, ids, conditions): the request ids of each model, in order, and the conditions that it was run under."""
    return responses.groupBy("canonical_id").agg(F.array_sort(F.collect_list("request_id")).alias("ids"), F.array_sort(F.collect_set("condition")).alias("conditions"))


def upsert_manifest(previous: DataFrame, new: DataFrame, key: str = "sanitized_id") -> DataFrame:
    """What ``previous`` has of models that weren't run again, and ``new``."""
    return previous.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def wilson(successes, n, z: float = 1.959963984540054):
    """(low, high) of Wilson's interval (1927); an addition of ours."""
    p, zz = successes / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n)) * z / (1 + zz / n)
    return mid - half, mid + half
