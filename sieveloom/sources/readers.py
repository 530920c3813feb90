"""Sources: sites, sample trees, styles, briefs, configurations, manifests, run records and reports as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("node_modules", "dist-types", "coverage", "build-cache", "vendor", "out-tsc")
OVERRIDES = "project string, overrides array<struct<ruleId: string, severity: string, reason: string>>"
MANIFEST = "token string, briefPath string, n int, maxTokens int, runAt string, models array<struct<spec: string, canonicalId: string, sanitizedId: string, provider: string, addedAt: string, note: string>>"
RECORD = "schema_version int, kind string, invoked_at string, argv array<string>, token struct<path: string, hash: string>, brief struct<path: string, hash: string>, sampling struct<n: int, temperature: double, seed: int>, models array<struct<id: string, provider: string, provider_request_ids: array<string>>>, conditions struct<requested: array<string>, effective: array<string>>, backfilled boolean, _corrupt string"


def texts(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content): whole files under ``path`` (or files named one by one in a list)."""
    found = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return found.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("content"))


def lint_input(files: DataFrame, root: str = "") -> DataFrame:
    """(file, html, css) of files: style sheets go to ``css`` by their ending, and ``root`` is cut from paths."""
    is_css = F.col("path").rlike(r"(?i)\.css$")
    root = root.rstrip("/")
    file = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 1, 1 << 20)).otherwise(F.col("path")) if root else F.col("path")
    return files.select(file.alias("file"), F.when(is_css, "").otherwise(F.col("content")).alias("html"), F.when(is_css, F.col("content")).otherwise("").alias("css"))


def site(spark: SparkSession, root: str, extra: list[str] | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(file, html, css) of the HTML, CSS and SVG files under ``root``, without hidden and skipped folders, and of files named in ``extra``; each path once."""
    found = texts(spark, root, "*.{html,css,svg}")
    below = F.split(F.replace("path", F.lit(root.rstrip("/")), F.lit("")), "/")
    found = found.where(~F.exists(below, lambda s: F.startswith(s, F.lit(".")) | s.isin(*skipped)))
    if extra:
        found = found.unionByName(texts(spark, extra, recursive=False)).dropDuplicates(["path"])
    return lint_input(found, root)


def inline(spark: SparkSession, rows: list[tuple[str, str, str]], most: int = 1 << 20) -> DataFrame:
    """(file, html, css) given as values; texts beyond ``most`` bytes and paths beyond 2048 characters are refused."""
    for file, html, css in rows:
        if len(file) > 2048 or max(len(html.encode()), len(css.encode())) > most:
            raise ValueError(f"too large: {file[:80]}")
    return spark.createDataFrame(rows, "file string, html string, css string")


def samples(spark: SparkSession, root: str) -> DataFrame:
    """(model, condition, sample_id, kind, html) of ``root/<model>/{raw,compiled}/*.html|*.error.txt``; a missing folder has none."""
    schema = "model string, condition string, sample_id string, kind string, html string"
    if not os.path.isdir(root) and "://" not in root:
        return spark.createDataFrame([], schema)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    kind = F.when(name.rlike(r"(?i)\.html$"), "html").when(F.endswith(name, F.lit(".error.txt")), "error")
    files = texts(spark, root, "*").select(F.element_at(parts, -3).alias("model"), F.element_at(parts, -2).alias("condition"), name.alias("sample_id"), kind.alias("kind"), F.col("content").alias("html"))
    return files.where("kind is not null and condition in ('raw', 'compiled')")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, base64, mime): the type is told from the first bytes."""
    head = F.hex(F.substring("content", 1, 12))
    mime = F.when(F.startswith(head, F.lit("89504E47")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("47494638")), "image/gif").when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp").otherwise("image/png")
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("base64"), mime.alias("mime"))


def models(spark: SparkSession, root: str) -> DataFrame:
    """(model) of the folders under ``root``, those without samples too."""
    names = sorted(n for n in os.listdir(root) if os.path.isdir(os.path.join(root, n))) if os.path.isdir(root) else []
    return spark.createDataFrame([(n,) for n in names], "model string")


def critique_samples(spark: SparkSession, root: str) -> DataFrame:
    """The pages among ``samples``: what a critic is shown."""
    return samples(spark, root).where("kind = 'html'")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, severity, reason, ord) of a JSON configuration, in its order; one that isn't valid is refused as it is loaded.

    ``ruleId`` in a file has a name space before the rule's own id, which is cut.
    """
    from sieveloom.operators.overrides import validated

    read = spark.read.schema(OVERRIDES + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    if any(r["_corrupt"] is not None for r in read.select("project", "_corrupt").collect()):
        raise ValueError(f"{path}: not a JSON object")
    rows = read.select(F.posexplode("overrides").alias("ord", "o")).select(F.col("o.ruleId").alias("rule_id"), "o.severity", "o.reason", "ord")
    bad = validated(rows).where("problem is not null or rule_id not like '_%/_%'").orderBy("ord").head()  # a configuration is a small file
    if bad:
        raise ValueError(f"{path}: overrides[{bad['ord']}]: {bad['problem'] or 'rule id without a name space'}")
    return rows.withColumn("rule_id", F.regexp_replace("rule_id", "^[^/]+/", ""))


def find_config(folder: str, names: tuple[str, ...] = ("lint.config.json", ".lintrc.json")) -> str | None:
    return next((p for p in (os.path.join(folder, n) for n in names) if os.path.isfile(p)), None)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each model of a run's manifest; none if there is no file."""
    if not os.path.exists(path) and "://" not in path:
        return spark.createDataFrame([], MANIFEST).selectExpr("token", "0 as ord", "inline(models)")
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select("token", F.posexplode("models").alias("ord", "m")).select("token", "ord", "m.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(run, the columns of ``RECORD``, problem) of run records; a file that can't be read has a problem, not an error."""
    read = spark.read.schema(RECORD).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.replay.json").json(path)
    found = read.select(F.col("_metadata.file_path").alias("run"), "*")
    problem = F.when(F.col("_corrupt").isNotNull(), "can't be read").when(F.col("schema_version").isNull() | (F.col("schema_version") != 1), "schema version").when(F.col("token.hash").isNull() | ~F.col("token.hash").rlike("^sha256:[0-9a-f]{64}$"), "token hash").when(F.size("models") < 1, "models")
    return found.withColumn("problem", problem)


def record_inputs(records: DataFrame) -> DataFrame:
    """(run, field, path, hash): the inputs that records name, as ``audit.verify`` takes them."""
    return records.select("run", F.explode(F.array(F.struct(F.lit("token").alias("field"), "token.path", "token.hash"), F.struct(F.lit("brief").alias("field"), "brief.path", "brief.hash"))).alias("i")).select("run", "i.*").where("path is not null")


def style(folder: str, name: str) -> dict:
    """A style file by its id: small letters, digits and hyphens, within the folder."""
    import re

    from sieveloom.operators.audit import read_yaml

    path = os.path.realpath(os.path.join(folder, f"{name}.yml"))
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", name) or os.path.dirname(path) != os.path.realpath(folder):
        raise ValueError(f"not a style id: {name}")
    with open(path, encoding="utf-8") as f:
        return read_yaml(f.read())


def styles(folder: str) -> list[str]:
    return sorted(n[:-4] for n in os.listdir(folder) if n.endswith(".yml"))


def yaml_rows(files: DataFrame) -> DataFrame:
    """(path, value, error, ok): each file's content as JSON, or why it can't be read."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        from sieveloom.functions.canonical import canonical
        from sieveloom.operators.audit import read_yaml

        for b in batches:
            values, errors = [], []
            for text in b.column("content").to_pylist():
                try:
                    values.append(canonical(read_yaml(text or "")))
                    errors.append(None)
                except yaml.YAMLError as e:
                    values.append(None)
                    errors.append(str(e).splitlines()[0])
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(values, pa.string()), pa.array(errors, pa.string())], ["path", "value", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, value string, error string").withColumn("ok", F.col("error").isNull())
