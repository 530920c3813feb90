"""Live experiments: a plan of samples, a bounded number of calls at a time, and the pages in the responses.

A runner is any picklable function of (model, prompt, seed) that returns a text; what it raises is kept with its sample.
Calls cost money, so a retried task must not repeat them: give ``done`` the samples that are stored already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK
from sieveloom.operators.adapters import html_of, provider, sanitized, without_reasoning
from sieveloom.operators.evaluate import CONDITIONS

RESPONSE = "model string, condition string, sample int, sample_id string, seed int, response_text string, error string"


def plan(spark: SparkSession, models: list[str], n: int) -> DataFrame:
    """(model, condition, sample, sample_id, seed): ``n`` samples of every model under both conditions; seeds count from 1."""
    specs = spark.createDataFrame([(m,) for m in models], "model string").crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in CONDITIONS], "condition string")))
    known = specs.where(F.expr(provider(SPARK, "model")).isNotNull())
    return known.select("model", "condition", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample")).select("*", F.format_string("sample-%03d", "sample").alias("sample_id"), F.col("sample").alias("seed"))


def run(planned: DataFrame, prompts: dict[str, str], runner: Callable[[str, str, int], str], cap: int = 1, done: DataFrame | None = None) -> DataFrame:
    """``planned`` with ``response_text`` or ``error``; at most ``cap`` calls at a time, as there are ``cap`` partitions. ``prompts`` is by condition."""
    keys = ["model", "condition", "sample"]
    left = planned if done is None else planned.join(done.select(*keys), keys, "left_anti")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                try:
                    said, error = runner(r["model"], prompts[r["condition"]], r["seed"]), None
                except Exception as e:  # whatever an outside call raises is the sample's result
                    said, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{**r, "response_text": said, "error": error}], pa.schema([("model", pa.string()), ("condition", pa.string()), ("sample", pa.int32()), ("sample_id", pa.string()), ("seed", pa.int32()), ("response_text", pa.string()), ("error", pa.string())]))

    return left.select("model", "condition", "sample", "sample_id", "seed").repartition(cap).mapInArrow(call, RESPONSE)


def samples(responses: DataFrame) -> DataFrame:
    """(model, condition, sample_id, kind, html) as ``evaluate`` takes them; a response without a page is an empty page. The model's name is made fit for a path."""
    cleaned = responses.withColumn("c", F.expr(without_reasoning(SPARK, "coalesce(response_text, '')")))
    return cleaned.select(F.expr(sanitized(SPARK, "model")).alias("model"), "condition", "sample_id", F.when(F.col("error").isNotNull(), "error").otherwise("html").alias("kind"), F.coalesce("error", F.expr(html_of(SPARK, "c"))).alias("html"))


def _page(title: str, style: str, body: str) -> str:
    return f"```html\n<!doctype html><html><head><title>{title}</title><style>{style}</style></head><body>{body}{'<p>Text that fills the page.</p>' * 8}</body></html>\n```"


def mock_runner(model: str, prompt: str, seed: int) -> str:
    """Two models that need no network: one that does everything wrong, and one that doesn't."""
    if model == "mock-slop":
        return _page("Unleash", "body{font-family:Inter;background:linear-gradient(indigo, purple)}a{animation:x 1s}", '<div class="text-center"><h1>Unleash seamless growth</h1></div><img src="a.png"><button></button>')
    if model == "mock-swiss":
        return _page("Plain", "body{font-family:Soehne;line-height:1.5}h1{font-family:Tiempos;line-height:1.05;font-weight:700}p{font-weight:400}b{font-weight:500}", "<h1>Prices</h1>")
    raise ValueError(f"unknown model: {model}")
