"""Parsers, hashes, sources, sinks and streams."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveloom.functions.canonical import canonical, hash_canonical, number, shell_quote, shorten
from sieveloom.functions.dialect import SPARK
from sieveloom.functions.markup import prose
from sieveloom.operators import briefs, evaluate
from sieveloom.operators.audit import read_yaml
from sieveloom.operators.parsed_rules import resolve, root_variables
from sieveloom.sources import readers, sinks
from sieveloom.streaming import landing


def test_prose():
    found = prose("<ul><li>One <strong>two</strong>\n<li>three <code>no <span>yes</span></code></ul><p>a<p>b")
    assert [(t, x.strip()) for t, _, x in found] == [("li", "One two"), ("strong", "two"), ("li", "three"), ("span", "yes"), ("p", "a"), ("p", "b")]
    assert [line for _, line, _ in found] == [1, 1, 2, 2, 2, 2]


def test_variables():
    variables = root_variables([(":root", "--a: 1px; --a: 2px;"), ("p", "--b: 3px;")])
    assert variables == {"a": "2px"}
    assert resolve("x: var(--a, 9) var(--b, 4px)", variables) == "x: 2px var(--b)"


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1e-7, "1e-7"), (123456.75, "123456.75"), (-2.5e-8, "-2.5e-8"), (1e20, "100000000000000000000"), (0.000001, "0.000001")])
def test_numbers(x, text):
    assert number(x) == text


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8))
@settings(max_examples=100, deadline=None)
def test_canonical_reads_back(value):
    assert json.loads(canonical(value)) == value


def test_canonical_order():
    assert canonical({"b": 1, "10": 2, "2": 3, "a": [2.0]}) == '{"2":3,"10":2,"a":[2],"b":1}'
    assert hash_canonical({"a": 1, "b": 2}) == hash_canonical({"b": 2, "a": 1})
    assert shorten(hash_canonical(1)).startswith("sha256:") and len(shorten(hash_canonical(1))) == 19
    assert shell_quote("a b") == "'a b'"


def test_yaml_is_core():
    assert read_yaml("a: yes\nb: 2020-01-01\nc: 010\nd: 1:30\ne: true\nf: ~\ng: 0x1f") == {"a": "yes", "b": "2020-01-01", "c": 10, "d": "1:30", "e": True, "f": None, "g": 31}


@given(st.text(alphabet="ab\n<", max_size=40))
@settings(max_examples=25, deadline=None)
def test_lines_of_matches(spark, text):
    got = spark.createDataFrame([(text,)], "s string").selectExpr(f"{SPARK.matches('s', 'a+')} as m").first()["m"]
    import re

    assert [(m["line"], m["text"]) for m in got] == [(text.count("\n", 0, x.start()) + 1, x[0]) for x in re.finditer("a+", text)]


def test_site_and_samples(spark, tmp_path):
    for name, text in (("index.html", "<p>a"), ("a/b.css", "p{}"), (".git/x.html", "no"), ("node_modules/y.html", "no"), ("z.txt", "no")):
        (tmp_path / "site" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / name).write_text(text)
    found = {r["file"]: (r["html"], r["css"]) for r in readers.site(spark, str(tmp_path / "site")).collect()}
    assert found == {"/index.html": ("<p>a", ""), "/a/b.css": ("", "p{}")}
    usable = "<!doctype html><body>" + "x" * 200
    for cell, name, text in (("raw", "1.html", usable), ("raw", "2.html", usable), ("raw", "3.html", "thin"), ("raw", "4.error.txt", "e"), ("compiled", "1.html", usable)):
        (tmp_path / "runs" / "m" / cell).mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / "m" / cell / name).write_text(text)
    cells = {r["condition"]: tuple(r)[2:] for r in evaluate.accounting(readers.samples(spark, str(tmp_path / "runs"))).collect()}
    assert cells == {"raw": (4, 1, 1, 2), "compiled": (1, 0, 0, 1)}
    assert readers.samples(spark, str(tmp_path / "nowhere")).count() == 0


def test_manifest_and_overrides(spark, tmp_path):
    assert readers.manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"token": "t", "models": [{"spec": "s", "sanitizedId": "a", "canonicalId": "A"}]}))
    assert readers.manifest(spark, str(tmp_path / "m.json")).first()["canonicalId"] == "A"
    (tmp_path / "lint.config.json").write_text(json.dumps({"overrides": [{"ruleId": "ns/r", "severity": "off", "reason": "because of it"}]}))
    assert readers.find_config(str(tmp_path)).endswith("lint.config.json")
    assert readers.overrides(spark, readers.find_config(str(tmp_path))).first()["severity"] == "off"


BRIEF = {"intent": "A page ", "surfaces": ["web"], "mustInclude": ["prices"], "mustAvoid": ["carousels"]}
STYLE = {"id": "plain", "name": "Plain", "version": "1", "type": {}, "colour": {"space": "oklch", "contrast-tier": "WCAG-AA", "palette": {"ink": "#111"}}, "grid": {}, "space": {}, "surface": {}, "forbidden": [f"f{k}" for k in range(8)], "required-quirks": ["q"], "prompt-fragments": {"system": "Be plain.", "negative": "No glitter."}}


def test_briefs():
    assert briefs.brief_problems(BRIEF) == [] and briefs.style_problems(STYLE) == []
    assert briefs.brief_problems({"intent": "", "surfaces": [], "x": 1}) == ["unknown key x", "intent", "surfaces"]
    assert "forbidden" in briefs.style_problems({**STYLE, "forbidden": ["a"]})
    made = briefs.compiled(BRIEF, STYLE, final=True)
    assert made["spec"]["forbidden"][-1] == "carousels" and made["spec"]["required"] == ["q", "prices"]
    assert set(made["prompts"]) == set(briefs.TARGETS) and "style-token" in made["prompts"]["gpt"]
    assert briefs.as_prose(BRIEF).splitlines()[-1] == "- carousels"
    assert briefs.image_prompt(BRIEF, STYLE)["compiled"].startswith("A page. Be plain.")


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([("a.html", "r1", "error", 0, 0, 3, "m", None), ("a.html", "r2", "warn", 1, 0, None, "n", None)], "file string, rule_id string, severity string, rule_ord int, match_ord int, line int, message string, snippet string")
    assert sinks.summary(found) == {"error": 1, "warn": 1, "info": 0} and sinks.exit_code(found) == 1
    lines = [r["text"] for r in sinks.report_lines(found).orderBy("rule_ord").collect()]
    assert lines[0] == f"error {'r1':<36} a.html:3  m"
    assert "schema" not in sinks.schema_json(found) and json.loads(sinks.schema_json(found))["type"] == "struct"


def test_stream(spark, tmp_path):
    usable = "<!doctype html><body><img>" + "x" * 200
    batch = spark.createDataFrame([("m", "raw", "1", "html", usable), ("m", "raw", "2", "error", None)], "model string, condition string, sample_id string, kind string, html string").selectExpr("*", "timestamp'2026-01-01' as at")
    batch.write.parquet(str(tmp_path / "in"))
    landing.write(landing.findings(landing.landing(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["rule_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a11y/img-without-alt"]
    counts = landing.counts(landing.landing(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(60)
    assert tuple(spark.table("cells").first()) == ("m", "raw", 2, 1, 1)
