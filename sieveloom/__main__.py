"""python -m sieveloom VERB: the engine from a shell. See ``--help``."""

from __future__ import annotations

import argparse
import json
import sys

from sieveloom.operators import audit, briefs, catalogue, critique, evaluate, generate, host, layout, overrides, reports, tools
from sieveloom.operators.lint import lint_site, rules_run
from sieveloom.sources import readers, sinks


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _overrides(spark, path):
    return overrides.last_of_each(readers.overrides(spark, path), "ord") if path else None


def do_lint(a) -> int:
    spark = session()
    pages = readers.site(spark, a.root)
    over = _overrides(spark, a.config)
    cross = None if a.site else []  # a few files alone don't tell which links are broken
    found = lint_site(pages, cross=cross, overrides=over).cache()
    files, ran = pages.count(), rules_run(cross=cross, overrides=over)
    if a.json:
        print(sinks.lint_json(found, files, ran, [r.asDict() for r in over.collect()] if over is not None else []))
    else:
        for r in sinks.report_lines(found).orderBy("file", "rule_ord", "match_ord").toLocalIterator():
            print(r["text"])
        print(sinks.totals_line(sinks.summary(found), files, len(ran)))
    return sinks.exit_code(found)


def do_rules(a) -> int:
    for rule in catalogue.rows():
        if not a.engine or rule[1] == a.engine:
            print(f"{rule[2]:<5} {rule[0]:<42} {rule[4]}")
    return 0


def do_eval(a) -> int:
    spark = session()
    samples = readers.samples(spark, a.root)
    scored = evaluate.scored_samples(samples, _overrides(spark, a.config)).cache()
    cells = evaluate.cells(samples, scored, readers.models(spark, a.root)).cache()
    print(sinks.evaluation_markdown(a.style, a.run_at, evaluate.deltas(cells), evaluate.tell_frequency(scored), cells))
    return 0


def do_critique(a) -> int:
    spark = session()
    said = spark.read.parquet(a.responses)
    found = critique.verdicts(said, ["model", "condition", "sample"])
    print(sinks.critique_markdown(a.style, a.run_at, a.critic, critique.frequencies(found, said, critique.catalogue(spark))))
    return 0


def do_validate(a) -> int:
    bad = 0
    for name in readers.styles(a.folder):
        problems = briefs.style_problems(readers.style(a.folder, name))
        bad += bool(problems)
        print(f"{name}: {', '.join(problems) or 'ok'}")
    return int(bool(bad))


def do_list(a) -> int:
    print("\n".join(readers.styles(a.folder)))
    return 0


def do_show(a) -> int:
    print(json.dumps(readers.style(a.folder, a.style), indent=2, ensure_ascii=False))
    return 0


def do_compile(a) -> int:
    with open(a.brief, encoding="utf-8") as f:
        brief = audit.read_yaml(f.read())
    problems = briefs.brief_problems(brief)
    if problems:
        print("\n".join(problems), file=sys.stderr)
        return 1
    made = briefs.compiled(brief, readers.style(a.folder, a.style), a.final)
    if a.out:
        print("\n".join(sinks.write_prompts(a.out, made)))
        return 0
    print(json.dumps(made["spec"], indent=2, ensure_ascii=False) if a.target == "spec" else made["prompts"][a.target])
    return 0


def do_verify(a) -> int:
    spark = session()
    records = readers.records(spark, a.records)
    checks = audit.verify(readers.record_inputs(records), audit.hashed(readers.texts(spark, a.root)))
    text = sinks.verification_text(checks)
    print(text)
    return int(text.endswith("not verified\n"))


def do_run(a) -> int:
    """A live experiment with the models that need no network; others are given to ``generate.run`` as functions."""
    spark = session()
    planned = generate.plan(spark, host.first_models(["mock-slop", "mock-swiss"], a.model), host.whole(a.n, 3, 1, 1000))
    with open(a.brief, encoding="utf-8") as f:
        brief = audit.read_yaml(f.read())
    prompts = {"raw": briefs.as_prose(brief), "compiled": briefs.compiled(brief, readers.style(a.folder, a.style), True)["prompts"]["generic"]}
    responses = generate.run(planned, prompts, generate.mock_runner).cache()
    keys = ["model", "condition", "sample_id"]
    made = generate.samples(responses).join(responses.select(*keys, "response_text"), keys)
    print(f"{sinks.write_sample_files(made, a.out)} samples in {a.out}")
    return 0


def do_submission(a) -> int:
    """Whether a run's manifest has what a submission needs; missing fields are named once, whatever the model."""
    spark = session()
    manifest = spark.read.schema(readers.MANIFEST).json(a.manifest, multiLine=True)
    problems = [r["problem"] for r in briefs.manifest_problems(manifest).orderBy("problem").collect()]
    print("\n".join(f"missing: {p}" for p in problems) or "ok")
    return int(bool(problems))


def do_audit_layout(a) -> int:
    spark = session()
    found = layout.audit(spark.read.parquet(a.elements)).cache()
    print(sinks.audit_json(a.elements, found, a.run_at) if a.json else sinks.layout_text(found))
    return int(not found.where("severity = 'error'").isEmpty())


def do_serve(a) -> int:
    sys.stdout.writelines(tools.served(sys.stdin, tools.tools(session(), a.folder)))
    return 0


def do_reports(a) -> int:
    spark = session()
    if a.backfill:
        states = reports.backfill(readers.texts(spark, a.root, "*.md"), readers.texts(spark, a.root, "*.replay.json")).cache()
        for r in states.where("state = 'failed'").orderBy("path").collect():
            print(f"failed: {r['path']}")
        n = reports.backfill_counts(states).first()
        print(" ".join(f"{k}={n[k]}" for k in ("scanned", "written", "skipped", "failed")))
        return int(n["failed"] > 0)
    reports.headers(readers.texts(spark, a.root, "*.md")).drop("content").show(1000, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveloom", description=__doc__)
    verbs = parser.add_subparsers(required=True)

    def verb(name, f, *arguments):
        p = verbs.add_parser(name)
        p.set_defaults(run=f)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)

    config = ("--config", {"default": None})
    named = (("--style", {"default": ""}), ("--run-at", {"default": ""}))
    verb("lint", do_lint, ("root", {}), config, ("--json", {"action": "store_true"}), ("--site", {"action": "store_true"}))
    verb("rules", do_rules, ("--engine", {"choices": catalogue.ENGINES}))
    verb("eval", do_eval, ("root", {}), config, *named)
    verb("critique", do_critique, ("responses", {}), ("--critic", {"default": "table"}), *named)
    verb("validate-styles", do_validate, ("folder", {}))
    verb("list", do_list, ("folder", {}))
    verb("show", do_show, ("folder", {}), ("style", {}))
    verb("compile", do_compile, ("brief", {}), ("folder", {}), ("style", {}), ("--target", {"choices": (*briefs.TARGETS, "spec"), "default": "generic"}), ("--final", {"action": "store_true"}), ("--out", {"default": None}))
    verb("run", do_run, ("brief", {}), ("folder", {}), ("style", {}), ("out", {}), ("--model", {"action": "append"}), ("--n", {"default": None}))
    verb("validate-submission", do_submission, ("manifest", {}))
    verb("audit-layout", do_audit_layout, ("elements", {}), ("--json", {"action": "store_true"}), ("--run-at", {"default": ""}))
    verb("serve", do_serve, ("folder", {}))
    verb("verify", do_verify, ("records", {}), ("root", {}))
    verb("reports", do_reports, ("root", {}), ("--backfill", {"action": "store_true"}))
    a = parser.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
