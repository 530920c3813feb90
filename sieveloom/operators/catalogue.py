"""The catalogue of rules of all engines as a table, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.operators.critique import VISION_RULES
from sieveloom.operators.rules import RULES

MOBILE_RULES = (
    ("mobile/viewport-meta-present", "error", "stable", "No viewport of the device's width."),
    ("mobile/no-horizontal-overflow", "error", "stable", "Content beyond the right edge."),
    ("mobile/tap-target-size", "warn", "stable", "A target too low to be hit."),
    ("mobile/body-font-size", "warn", "stable", "Running text too small to read."),
    ("mobile/scrollable-no-affordance", "warn", "experimental", "A scrolling area that doesn't show it."),
    ("mobile/list-mark-alignment", "warn", "experimental", "List marks out of line."),
)
CROSS_RULES = (("no-broken-internal-links", "error", "stable", "A link within the site to a page that isn't there."),)
ENGINES = ("source", "cross-file", "vision", "mobile")
#: The rules that read style sheets alone.
CSS_RULES = ("no-default-grotesque", "no-flat-dark-mode", "weight-variety", "require-type-pairing", "no-uniform-radius", "no-indiscriminate-glass", "single-shadow-style", "respect-reduced-motion", "line-height-per-size", "body-measure", "require-named-grid", "tracking-per-size", "radius-hierarchy", "no-shimmer-decoration")


def rows() -> list[tuple[str, str, str, str, str]]:
    source = [(r.rule_id, "source", r.severity, r.status, r.description) for r in RULES]
    vision = [(k, "vision", "warn", "stable", v) for k, v in VISION_RULES.items()]
    return source + [(i, "cross-file", s, t, d) for i, s, t, d in CROSS_RULES] + vision + [(i, "mobile", s, t, d) for i, s, t, d in MOBILE_RULES]


def rules_table(spark: SparkSession) -> DataFrame:
    """(rule_id, engine, severity, status, description)"""
    return spark.createDataFrame(rows(), "rule_id string, engine string, severity string, status string, description string")


def ranked(rules: DataFrame) -> DataFrame:
    """The catalogue in order of engine and id, with ``rank``: the order is in the column, as tables have none."""
    engine = F.array_position(F.array(*map(F.lit, ENGINES)), F.col("engine"))
    return rules.withColumn("rank", F.concat(F.lpad(engine.cast("string"), 2, "0"), F.lit(":"), "rule_id"))


def counts(rules: DataFrame) -> DataFrame:
    """(engine, total, stable, experimental, deprecated), and a row for all engines."""
    n = [F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("stable", "experimental", "deprecated"))]
    return rules.rollup("engine").agg(*n).withColumn("engine", F.coalesce("engine", F.lit("all")))


def recommended(rules: DataFrame) -> DataFrame:
    """(rule_id, level) of an editor's default configuration: notes and rules that aren't stable are off."""
    level = F.when((F.col("status") != "stable") | (F.col("severity") == "info"), "off").otherwise(F.col("severity"))
    return rules.where("engine = 'source'").select("rule_id", level.alias("level"))


def parity(spec: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, problem): ids that only one side has, and severities that differ."""
    s, r = spec.select(F.col("rule_id").alias("a"), F.col("severity").alias("sa")), rules.select(F.col("rule_id").alias("b"), F.col("severity").alias("sb"))
    problem = F.when(F.col("b").isNull(), "not in the catalogue").when(F.col("a").isNull(), "not in the document").when(F.col("sa") != F.col("sb"), "severity")
    return s.join(r, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("rule_id"), problem.alias("problem")).where("problem is not null")
