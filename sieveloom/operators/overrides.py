"""Overrides of rules by project and style, as tables (rule_id, severity, reason)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK, Dialect

SEVERITIES = ("error", "warn", "info")
_META = [
    r"<meta[^>]+name\s*=\s*[\x22\x27]style-token[\x22\x27][^>]+content\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]",
    r"<meta[^>]+content\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27][^>]+name\s*=\s*[\x22\x27]style-token[\x22\x27]",
    r"<!--\s*style-token:\s*([\w-]+)\s*-->",
]


def applied(rules: list, overrides: DataFrame | dict[str, str] | None) -> list:
    """The rules as overridden; the catalogue is a few dozen rules, so this is settled before a plan is made. The last override of a rule counts."""
    if overrides is None:
        return list(rules)
    if not isinstance(overrides, dict):
        wanted = overrides.where(F.col("rule_id").isin([r.rule_id for r in rules]))
        if "ord" in overrides.columns:
            wanted = last_of_each(wanted, "ord")
        elif wanted.groupBy("rule_id").count().where("count > 1").count():
            raise ValueError("a rule is overridden twice: the order must be in a column ord")
        overrides = dict(wanted.select("rule_id", "severity").collect())
    return [replace(r, severity=overrides.get(r.rule_id, r.severity)) for r in rules if overrides.get(r.rule_id) != "off"]


def last_of_each(overrides: DataFrame, order: str) -> DataFrame:
    """One row for each rule: the one with the greatest ``order``."""
    columns = [c for c in overrides.columns if c not in ("rule_id", order)]
    return overrides.groupBy("rule_id").agg(F.max_by(F.struct(*columns), order).alias("o")).select("rule_id", "o.*")


def override(findings: DataFrame, overrides: DataFrame, order: str = "ord") -> DataFrame:
    """Findings with their severities overridden; those of rules that are off are gone."""
    last = last_of_each(overrides, order).select(F.col("rule_id").alias("__rule"), F.col("severity").alias("__severity"))
    joined = findings.join(last, F.col("rule_id") == F.col("__rule"), "left").where("__severity is null or __severity <> 'off'")
    return joined.withColumn("severity", F.coalesce("__severity", "severity")).drop("__rule", "__severity")


def merge(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """All of ``primary``, and of ``fallback`` what it doesn't name."""
    return primary.unionByName(fallback.join(primary.select("rule_id").distinct(), "rule_id", "left_anti").select(*primary.columns))


def from_style(styles: DataFrame) -> DataFrame:
    """(style, rule_id, severity, reason) from a style's lists of rules that it switches off or makes errors."""
    part = lambda column, severity: styles.select("style", F.explode_outer(column).alias("r")).where("r is not null").select("style", F.col("r.rule_id").alias("rule_id"), F.lit(severity).alias("severity"), F.col("r.reason").alias("reason"))
    return part("disable", "off").unionByName(part("enable_strict", "error"))


def validated(overrides: DataFrame, prefix: str = "") -> DataFrame:
    """``overrides`` with ``problem``: the first thing that is wrong with a row, or null. Rule ids must start with ``prefix``."""
    problem = (
        F.when(F.col("rule_id").isNull() | ~F.startswith("rule_id", F.lit(prefix)), "rule id")
        .when(F.col("severity").isNull() | ~F.col("severity").isin(*SEVERITIES, "off"), "severity")
        .when(F.length(F.trim(F.coalesce("reason", F.lit("")))) < 10, "reason")
    )
    return overrides.withColumn("problem", problem)


def active_style(d: Dialect, html: str) -> str:
    """The style a document names, in a meta element (either order of attributes) or a comment; null if none."""
    return "coalesce(" + ", ".join(f"nullif({d.trim(d.one(html, p, 1))}, '')" for p in _META) + ")"


def detect_styles(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("style", F.expr(active_style(SPARK, "html")))


def first_style(corpus: DataFrame, order: str) -> DataFrame:
    """(style): what the first document in ``order`` with a style names."""
    return detect_styles(corpus).where("style is not null").agg(F.min_by("style", order).alias("style"))


def effective_rules(rules: DataFrame, overrides: DataFrame, order: str = "ord") -> DataFrame:
    """The catalogue as overridden, with ``is_overridden``."""
    last = last_of_each(overrides, order).select(F.col("rule_id"), F.col("severity").alias("__severity"))
    return rules.join(last, "rule_id", "left").where("__severity is null or __severity <> 'off'").select("rule_id", F.coalesce("__severity", "severity").alias("severity"), F.col("__severity").isNotNull().alias("is_overridden"))
