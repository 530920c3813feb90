"""Reproducibility: hashes of inputs against those that a run's record names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sieveloom.functions.canonical import hash_canonical

CHECK = "field string, expected string, actual string, ok boolean, reason string"


def hashed(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with ``bytes_hash`` and ``canonical_hash`` (of the content as YAML, which takes in JSON; null if it is neither)."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            out = []
            for text in b.column("content").to_pylist():
                try:
                    out.append(hash_canonical(yaml.load(text, _loader())) if text is not None else None)
                except yaml.YAMLError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "bytes_hash", "canonical_hash"])

    frame = files.withColumn("bytes_hash", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("canonical_hash", StringType())]))


def _loader():
    """YAML 1.2's core types: no dates, no yes and no, no sexagesimals."""
    import re

    import yaml

    class Core(yaml.SafeLoader):
        pass

    Core.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))

    def integer(loader, node):
        text = loader.construct_scalar(node)
        return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)

    Core.add_constructor("tag:yaml.org,2002:int", integer)
    Core.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(loader.construct_scalar(node).replace(".inf", "inf").replace(".nan", "nan")))
    return Core


def read_yaml(text: str):
    import yaml

    return yaml.load(text, _loader())


def verify(records: DataFrame, files: DataFrame) -> DataFrame:
    """(run, field, expected, actual, ok, reason) for (run, field, path, hash) of records against ``hashed`` files.

    A style is compared by its canonical hash; a brief by its bytes first, then by its canonical hash.
    """
    j = records.join(files.select(F.col("path").alias("__path"), "bytes_hash", "canonical_hash"), records["path"] == F.col("__path"), "left")
    by_bytes = (F.col("field") == "brief") & F.coalesce(F.col("bytes_hash") == F.col("hash"), F.lit(False))
    actual = F.when(by_bytes, F.col("bytes_hash")).otherwise(F.col("canonical_hash"))
    ok = F.coalesce(actual == F.col("hash"), F.lit(False))
    reason = F.when(F.col("__path").isNull(), "file not found").when(ok, F.lit(None)).when(F.col("canonical_hash").isNull(), "file can't be read").otherwise("contents have changed since the run")
    return j.select("run", "field", F.col("hash").alias("expected"), actual.alias("actual"), ok.alias("ok"), reason.alias("reason"))


def verdict(checks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run, ok): whether every check of a run is ok. A run of ``runs`` (run) without checks is ok."""
    found = checks.groupBy("run").agg(F.bool_and("ok").alias("ok"))
    return found if runs is None else runs.select("run").distinct().join(found, "run", "left").select("run", F.coalesce("ok", F.lit(True)).alias("ok"))
