"""Sinks: reports as text, JSON and Markdown, samples as partitioned files, manifests and schemas.

Reports are small tables by nature (rules, cells, models); their writers take rows in order to the driver. Findings themselves are written by Spark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.canonical import shell_quote, shorten


def report_lines(findings: DataFrame) -> DataFrame:
    """(file, line) of a text report: severity in five places, rule in thirty-six."""
    place = F.when(F.col("line").isNull(), F.col("file")).otherwise(F.concat_ws(":", "file", F.col("line").cast("string")))
    text = F.concat(F.rpad("severity", 5, " "), F.lit(" "), F.rpad("rule_id", F.greatest(F.lit(36), F.length("rule_id")), " "), F.lit(" "), place, F.lit("  "), "message")
    return findings.select("file", "rule_ord", "match_ord", text.alias("text"))


def write_report(findings: DataFrame, path: str) -> None:
    """The lines as text files, in the order of files and rules."""
    report_lines(findings).orderBy("file", "rule_ord", "match_ord").select("text").write.mode("overwrite").text(path)


def summary(findings: DataFrame) -> dict[str, int]:
    found = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return {s: found.get(s, 0) for s in ("error", "warn", "info")}


BADGES = {False: "full", True: "source-only"}


def lint_json(findings: DataFrame, files: int, rules_run: list[str], overrides: list[dict] | None = None) -> str:
    """The report of a lint as JSON: findings, counts of each severity, and the badge, which says whether a page is an empty shell.

    Findings go to the driver, as a report is one document; large corpora write theirs by Spark instead.
    """
    rows = [r.asDict() for r in findings.orderBy("file", "rule_ord", "match_ord").collect()]
    n = {s: sum(r["severity"] == s for r in rows) for s in ("error", "warn", "info")}
    shell = any(r["rule_id"] == "spa-shell-detected" for r in rows)
    shown = [{k: r[k] for k in ("rule_id", "severity", "file", "line", "message", "snippet") if r[k] is not None} for r in rows]
    return json.dumps({"violations": shown, "rules_run": rules_run, "files": files, "overrides": overrides or [], **n, "badge": BADGES[shell], "source_only": shell}, indent=2, ensure_ascii=False)


def totals_line(counts: dict[str, int], files: int, rules: int) -> str:
    if not sum(counts.values()):
        return f"clean · {files} files · {rules} rules"
    return " · ".join([*(f"{counts[s]} {s}" for s in ("error", "warn", "info")), f"{files} files", f"{rules} rules"])


def exit_code(findings: DataFrame) -> int:
    return int(bool(findings.agg(F.bool_or(F.col("severity") == "error")).first()[0]))


def write_findings(findings: DataFrame, path: str, kind: str = "parquet") -> None:
    findings.write.mode("overwrite").format(kind).save(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as Parquet, a folder for each model and condition."""
    samples.write.mode("overwrite").partitionBy("model", "condition").parquet(path)


def write_sample_files(responses: DataFrame, root: str) -> int:
    """Files ``root/<model>/<condition>/<sample_id>``: ``.html`` and ``.raw.txt``, or ``.error.txt``; the number of samples written.

    From (model, condition, sample_id, kind, html, response_text); executors write to ``root``, a folder that all share.
    A file appears whole or not at all, so a task that is run again does no harm.
    """
    import os

    import pyarrow as pa

    def put(path: str, text: str) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}.part", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{path}.{os.getpid()}.part", path)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                base = os.path.join(root, r["model"], r["condition"], r["sample_id"])
                if r["kind"] == "error":
                    put(f"{base}.error.txt", r["html"] or "")
                else:
                    put(f"{base}.html", r["html"] or "")
                    put(f"{base}.raw.txt", r["response_text"] or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return responses.select("model", "condition", "sample_id", "kind", "html", "response_text").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_prompts(folder: str, made: dict) -> list[str]:
    """A file for each target's prompt, and the specification; the names."""
    import os

    os.makedirs(folder, exist_ok=True)
    texts = {f"{k}.md": v for k, v in made["prompts"].items()} | {"spec.json": json.dumps(made["spec"], indent=2, ensure_ascii=False) + "\n"}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return sorted(texts)


def write_record(record: dict, path: str) -> None:
    """A run's record beside its report, as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(record, indent=2, ensure_ascii=False) + "\n")


def audit_json(url: str, findings: DataFrame, run_at: str, width: int = 375, height: int = 812) -> str:
    """The report of one page's layout audit or critique as JSON."""
    rows = [r.asDict() for r in findings.orderBy("rule_id", "node_id").collect()]
    return json.dumps({"url": url, "viewport": {"width": width, "height": height}, "run_at": run_at, "violations": rows}, indent=2, ensure_ascii=False)


def _table(head: list[str], rows: list[list]) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(c) for c in r) + " |" for r in rows)])


def evaluation_markdown(style: str, run_at: str, deltas: DataFrame, frequency: DataFrame, cells: DataFrame) -> str:
    rows = deltas.orderBy("model").collect()
    names = [(r["model"], c) for r in rows for c in ("raw", "compiled")]
    share = {(r["tell"], r["model"], r["condition"]): r["frequency"] for r in frequency.collect()}
    counted = {(r["model"], r["condition"]): r for r in cells.collect()}
    mean = lambda x, n: f"{x:.2f}" if n else "—"
    parts = [f"# Evaluation · {style} · {run_at}", _table(["model", "raw", "compiled", "reduction"], [[r["model"], mean(r["raw_mean_tells"], r["raw_scored"]), mean(r["compiled_mean_tells"], r["compiled_scored"]), r["shown"]] for r in rows])]
    parts.append(_table(["cell", "attempted", "errored", "no page", "scored"], [[f"{m} / {c}", *(counted[m, c][k] for k in ("attempted", "errored", "extraction_failed", "scored"))] for m, c in names if (m, c) in counted]))
    parts.append(_table(["tell", *(f"{m} / {c}" for m, c in names)], [[t, *(f"{100 * share.get((t, m, c), 0):.0f}%" for m, c in names)] for t in sorted({k[0] for k in share})]))
    return "\n\n".join(parts) + "\n"


def critique_markdown(style: str, run_at: str, critic: str, frequencies: DataFrame) -> str:
    rows = frequencies.orderBy("rule_id").collect()
    n = rows[0] if rows else {"raw_scored": 0, "compiled_scored": 0}
    percent = lambda x: "—" if x is None else f"{x:.0f}%"
    return f"# Critique · {style} · {run_at}\n\ncritic: `{critic}`\n\n" + _table(["tell", f"raw (n={n['raw_scored']})", f"compiled (n={n['compiled_scored']})"], [[r["rule_id"], percent(r["raw_pct"]), percent(r["compiled_pct"])] for r in rows]) + "\n"


def image_markdown(style: str, run_at: str, deltas: DataFrame) -> str:
    return f"# Image evaluation · {style} · {run_at}\n\n" + _table(["model", "raw", "compiled", "reduction"], [[r["model"], f"{r['raw_mean']:.2f}", f"{r['compiled_mean']:.2f}", "inconclusive" if r["is_inconclusive"] else f"{r['reduction_pct']:.1f}%"] for r in deltas.orderBy("model").collect()]) + "\n"


def layout_text(findings: DataFrame) -> str:
    rows = findings.orderBy("page", "rule_id", "node_id").collect()
    return "\n".join(f"{r['severity']:<5} {r['rule_id']:<36} {r['page']}#{r['node_id']}" for r in rows) + f"\n{len(rows)} findings\n"


def verification_text(checks: DataFrame) -> str:
    rows = checks.orderBy("run", "field").collect()
    lines = [f"{'ok' if r['ok'] else 'FAIL':<4} {r['run']} {r['field']} {shorten(r['expected'])}" + ("" if r["ok"] else f" ({r['reason']})") for r in rows]
    return "\n".join([*lines, "verified" if all(r["ok"] for r in rows) else "not verified"]) + "\n"


def record_block(record: dict) -> str:
    """A run's record for a report: hashes shortened, request ids as a count, arguments quoted."""
    ids = sum(len(m.get("provider_request_ids") or []) for m in record.get("models", []))
    brief = record.get("brief")
    lines = [f"- kind: {record['kind']}", f"- style: {record['token']['path']} ({shorten(record['token']['hash'])})"]
    lines += [f"- brief: {brief['path']} ({shorten(brief['hash'])})"] if brief else []
    return "\n".join([*lines, f"- models: {', '.join(m['id'] for m in record.get('models', []))}", f"- request ids: {ids}", f"- command: {' '.join(map(shell_quote, record.get('argv', [])))}"]) + "\n"


_JSON_TYPES = {"string": "string", "boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number"}


def json_schema(kind) -> dict:
    """A JSON Schema document of a Spark type; fields that can't be null are required."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": _JSON_TYPES.get(kind.simpleString(), "string")}


def schema_json(frame: DataFrame) -> str:
    return json.dumps(json.loads(frame.schema.json()), indent=2, sort_keys=True)
