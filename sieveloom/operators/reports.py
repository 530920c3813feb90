"""Markdown reports and event streams read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headers(reports: DataFrame, text: str = "content") -> DataFrame:
    """``reports`` with ``kind``, ``style``, ``run_at``, ``brief``, ``n`` and ``models`` (id, provider) from the head of each."""
    title = r"(?m)^# (?:\w+ )?(eval-image|eval|critique)[ ·\s]+([^\n·]+?)\s*[·]\s*(\S+)"
    one = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s+-\s+`[^`]+`\s+\([^)]+\)\s+·\s+spec\s+`[^`]+`"), F.lit(0))
    models = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"spec\s+`([^`]+)`", 1).alias("id"), F.regexp_extract(x, r"\(([^)]+)\)", 1).alias("provider")))
    critic = one(r"(?m)^critic: +`([^`]+)`")
    each = F.regexp_extract_all(text, F.lit(r"\(n=(\d+)\)"), F.lit(1))
    n = F.coalesce(one(r"(?m)^-\s+Samples per cell:\s+[*]{2}(\d+)[*]{2}").cast("int"), F.when(F.size(each) > 0, F.aggregate(each, F.lit(0), lambda a, x: a + x.cast("int"))))
    kind = one(title, 1)
    return reports.withColumns({"kind": F.when(kind == "eval", "eval-live").otherwise(kind), "style": one(title, 2), "run_at": one(title, 3), "brief": one(r"(?m)^- +Brief: +`([^`]+)`"), "n": n, "models": F.when((kind == "critique") & (F.size(models) == 0) & critic.isNotNull(), F.array(F.struct(critic.alias("id"), F.lit("critic").alias("provider")))).otherwise(models)})


def without_record(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Reports (path) without a record (path) beside them."""
    return reports.join(records.select(F.regexp_replace("path", r"\.replay\.json$", ".md").alias("path")), "path", "left_anti")


def backfill(reports: DataFrame, records: DataFrame) -> DataFrame:
    """(path, state) of each report (path, content): skipped if there is a record beside it, failed if its head can't be read, else written."""
    known = records.select(F.regexp_replace("path", r"\.replay\.json$", ".md").alias("path"), F.lit(True).alias("known")).distinct()
    read = headers(reports).join(known, "path", "left")
    bad = F.col("kind").isNull() | F.col("style").isNull() | F.col("run_at").isNull()
    return read.select("path", F.when(F.col("known"), "skipped").when(bad, "failed").otherwise("written").alias("state"))


def backfill_counts(states: DataFrame) -> DataFrame:
    """(scanned, written, skipped, failed) in one row."""
    return states.agg(F.count("*").alias("scanned"), *(F.count_if(F.col("state") == s).alias(s) for s in ("written", "skipped", "failed")))


def last_message(outputs: DataFrame, text: str = "stdout") -> DataFrame:
    """``outputs`` with ``message``: the last event of an agent that has text; without one, the whole output. Lines that aren't JSON are passed over."""
    said = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("{"))), _event), lambda x: x != "")
    return outputs.withColumn("message", F.coalesce(F.try_element_at(said, F.lit(-1)), F.col(text)))


def _event(line):
    get = lambda p: F.get_json_object(line, p)
    is_agent = (F.coalesce(get("$.type"), F.lit("")) == "agent_message") | (F.coalesce(get("$.event"), F.lit("")) == "agent_message") | (F.coalesce(get("$.item.type"), F.lit("")) == "agent_message")
    value = F.coalesce(get("$.item.text"), get("$.text"), get("$.content"), get("$.item.content"))
    return F.when(is_agent & ~F.startswith(F.coalesce(value, F.lit("")), F.lit("[")), F.coalesce(value, F.lit(""))).otherwise("")


def ids_in(markdown: DataFrame, text: str = "content") -> DataFrame:
    """(rule_id, severity) of the rows of Markdown tables that start with an id in backticks; severity is the third cell."""
    return markdown.select(F.explode(F.split(text, "\n")).alias("row")).where(F.col("row").rlike(r"^\|\s*`[\w/-]+`")).select(F.regexp_extract("row", "`([^`]+)`", 1).alias("rule_id"), F.trim(F.split_part("row", F.lit("|"), F.lit(4))).alias("severity"))
