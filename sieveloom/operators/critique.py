"""Verdicts of a vision critic and of image runs, which come as tables of responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISION_RULES = {
    "require-asymmetry": "Nothing breaks the symmetry.",
    "bento-has-anchor": "A tile grid without a leading tile.",
    "no-corporate-memphis": "Flat figures with long limbs.",
    "no-ai-illustration": "Illustration with a generated look.",
    "no-iridescent-blob": "An iridescent blob.",
    "no-laptop-office-stock": "Stock photograph of laptops in an office.",
    "mesh-has-counterforce": "A mesh gradient that nothing holds against.",
    "wordmark-not-dot-grotesque": "A sans wordmark with a dot.",
    "icons-not-monoline-default": "Thin outline icons of a stock set.",
    "image/no-malformed-anatomy": "Malformed anatomy.",
    "image/no-midjourney-face-symmetry": "Faces of perfect symmetry.",
    "image/no-decorative-cursive-in-render": "Meaningless cursive within an image.",
    "image/no-stock-diversity-casting": "Cast like a stock photograph.",
    "layout-deadspace": "Large empty areas without purpose.",
}
FAILED = "critic-parse-failed"
VERDICT = "fired array<variant>, rationale map<string, string>"


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(list(VISION_RULES.items()), "rule_id string, description string")


def verdicts(responses: DataFrame, keys: list[str], rules: DataFrame | None = None) -> DataFrame:
    """(keys, rule_id, message): the known rules that each response names, or one row that says that it can't be read.

    A response counts from its first to its last brace. ``fired`` must be a list; what isn't a text there, and unknown rules, are passed over.
    """
    known = rules if rules is not None else catalogue(responses.sparkSession)
    body = F.regexp_extract("response_text", r"(?s)(\{.*\})", 1)
    read = responses.select(*keys, F.try_parse_json(F.when(body != "", body)).alias("v"))
    fired = F.expr("try_variant_get(v, '$.fired', 'array<variant>')")
    read = read.select(*keys, fired.alias("fired"), F.expr("try_variant_get(v, '$.rationale', 'map<string, variant>')").alias("rationale"))
    failed = read.where("fired is null").select(*keys, F.lit(FAILED).alias("rule_id"), F.lit("the response can't be read").alias("message"))
    said = read.where("fired is not null").select(*keys, "rationale", F.explode("fired").alias("f")).where("schema_of_variant(f) = 'STRING'").withColumn("rule_id", F.expr("variant_get(f, '$', 'string')"))
    found = said.join(known, "rule_id").select(*keys, "rule_id", F.coalesce(F.expr("try_variant_get(rationale[rule_id], '$', 'string')"), "description").alias("message"))
    return found.unionByName(failed)


def frequencies(found: DataFrame, samples: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, raw, compiled, raw_scored, compiled_scored, raw_pct, compiled_pct): each finding counts, not each sample; percent is null without samples."""
    n = samples.agg(F.count_if(F.col("condition") == "raw").alias("raw_scored"), F.count_if(F.col("condition") == "compiled").alias("compiled_scored"))
    count = found.groupBy("rule_id").agg(F.count_if(F.col("condition") == "raw").alias("raw"), F.count_if(F.col("condition") == "compiled").alias("compiled"))
    all_ = rules.select("rule_id").join(count, "rule_id", "full_outer").select("rule_id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("compiled", F.lit(0)).alias("compiled"))
    percent = lambda c: F.round(F.try_divide(F.col(c) * 100, F.col(f"{c}_scored")), 0).alias(f"{c}_pct")
    return all_.crossJoin(F.broadcast(n)).select("*", percent("raw"), percent("compiled"))


def image_cells(samples: DataFrame) -> DataFrame:
    """(model, condition, attempted, errored, critiqued, mean_tells) from (model, condition, status, n_violations); the mean counts all findings."""
    ok = F.col("status") == "critiqued"
    return samples.groupBy("model", "condition").agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "error").alias("errored"), F.count_if(ok).alias("critiqued"), (F.coalesce(F.sum(F.when(ok, F.col("n_violations"))), F.lit(0)) / F.greatest(F.lit(1), F.count_if(ok))).alias("mean_tells"))


def image_frequency(found: DataFrame, samples: DataFrame) -> DataFrame:
    """(model, condition, rule_id, frequency): findings of a rule over a cell's critiqued samples. Every finding counts, so it can be beyond 1."""
    n = samples.groupBy("model", "condition").agg(F.count_if(F.col("status") == "critiqued").alias("n"))
    counts = found.groupBy("model", "condition", "rule_id").agg(F.count("*").alias("c"))
    return counts.join(n, ["model", "condition"]).select("model", "condition", "rule_id", F.coalesce(F.try_divide("c", "n"), F.lit(0.0)).alias("frequency"))


def critic_of(spec: str | None, critics: dict) -> Callable:
    """The critic of a name, from those given (a critic is a function of a sample's fields that returns a text); without a name, the first."""
    if not critics:
        raise ValueError("no critics")
    name = spec or next(iter(critics))
    if name not in critics:
        raise ValueError(f"unknown critic {name}; there are: {', '.join(critics)}")
    return critics[name]


def image_deltas(cells: DataFrame) -> DataFrame:
    """(model, raw_mean, compiled_mean, delta, reduction_pct, is_inconclusive). The percentage stands even if one side has no data; the flag says so."""
    side = lambda c, k: F.coalesce(F.max(F.when(F.col("condition") == c, F.col(k))), F.lit(0))
    by = cells.groupBy("model").agg(side("raw", "mean_tells").alias("raw_mean"), side("compiled", "mean_tells").alias("compiled_mean"), ((side("raw", "critiqued") == 0) | (side("compiled", "critiqued") == 0)).alias("is_inconclusive"))
    delta = F.col("raw_mean") - F.col("compiled_mean")
    return by.select("model", "raw_mean", "compiled_mean", delta.alias("delta"), F.when(F.col("raw_mean") > 0, delta / F.col("raw_mean") * 100).otherwise(0.0).alias("reduction_pct"), "is_inconclusive")


def limited(samples: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` samples in ``order``; all of them if ``n`` is 0."""
    return samples.orderBy(order).limit(n) if n else samples


def mock_verdicts(samples: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(sample_id, rule_id) from fixtures (key, fired): a sample's url, else its context, else ``default`` is the key."""
    key = F.coalesce("url", "context", F.lit("default"))
    return samples.withColumn("key", key).join(fixtures, "key", "left").select("sample_id", F.explode("fired").alias("rule_id"))
