"""Gates, overrides, rules across files, audits, writers, tools and what is done beside the tables."""

import io
import json
import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK
from sieveloom.operators import audit, briefs, critique, evaluate, generate, host, layout, overrides, reports, tools
from sieveloom.operators.lint import CrossRule, cross_findings, finding_arrays, lint, lint_site, rules_run
from sieveloom.operators.rules import NATIVE, RULES, Rule
from sieveloom.plans.corpus import FRAGMENTS
from sieveloom.sources import readers, sinks

PIECES = ["initial={a} " * 4, "animate={b} " * 4, "motion-fade-up " * 4, "framer-motion " * 4, "data-aos " * 4, '<img src="https://randomuser.me/x">', '<img src="ui-faces.com">', "uifaces.co", "https://prod.spline.design/abc/scene.splinecode", "orb.splinecode", "iridescent-blob", "As Seen In <svg></svg><svg></svg><img>", "Backed By <img><img><img>", '<div class="items-center justify-center"><h1>x</h1>', '<div class="mx-auto max-w-3xl"><h1>x</h1></div>', '<section class="x">', '<i class="shadow shadow shadow">', "<style>a{TRANSITION: all 300ms}</style>", "<style>@KEYFRAMES x{}</style>", '<i style="Animation: x 1s">', '<div class="grid cols-3"><li>1<li>2<li>3</div>', '<span class="rounded-md bg-violet-200"><Cpu/>', "<STYLE>p{BACKDROP-FILTER: blur(2px)} q{backdrop-filter:blur(3px)}</STYLE>", "<FOOTER>product company legal</FOOTER>", '<BUTTON></BUTTON>', '<A href="#"></A>', "<H1>a</H1><H4>b</H4>", '<svg viewBox="0 0 9 9"><i stroke-width=1.5/><i stroke-width=1.5/><i stroke-width=1.5/><i stroke-width=1.5/></svg>', '<a class="from-pink-500">x &rarr;</a>', '<style>h1{font-size:60px}</style>', "<style>p{text-transform:uppercase}</style>", "<p>a &mdash; b</p>", "<style>body{max-width:20ch}</style>", '<div id="pricing">tier plan tier best value</div>']


def key(df):
    return sorted(map(repr, df.collect()))


def test_gates_hide_nothing(spark):
    """Every rule finds the same with its gate and without it."""
    rnd = random.Random(3)
    pages = [*FRAGMENTS, *PIECES, *("\n".join(rnd.sample([*FRAGMENTS, *PIECES], 4)) for _ in range(120))]
    corpus = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    gated = lint(corpus, RULES, keys=["page_id"])
    assert key(gated) == key(lint(corpus, [replace(r, gate=()) for r in RULES], keys=["page_id"]))
    fired = {r["rule_id"] for r in gated.select("rule_id").distinct().collect()}
    assert len(fired) >= 36


def test_motion_with_initial(spark):
    page = spark.createDataFrame([("a", "<x initial={a} /> " * 4)], "file string, html string")
    assert [r["rule_id"] for r in lint(page, [r for r in RULES if r.rule_id == "motion-has-intent"]).collect()] == ["motion-has-intent"]


def test_many_matches_on_one_page(spark):
    page = "\n".join(f"<p>{k}</p><img src='{k}.png'>" for k in range(32_000))
    corpus = spark.createDataFrame([(page,)], "html string")
    rule = [r for r in RULES if r.rule_id == "a11y/img-without-alt"]
    lint(corpus, rule, keys=["html"]).count()
    start = time.perf_counter()
    found = lint(corpus.withColumn("n", F.lit(1)), rule, keys=["n"]).select("line").orderBy("line").collect()
    assert [r["line"] for r in found] == list(range(1, 32_001))
    assert time.perf_counter() - start < 20


def test_control_characters_in_lines(spark):
    got = spark.createDataFrame([("\x01a\n\x02a\x01\na",)], "s string").selectExpr(f"{SPARK.matches('s', 'a')} as m").first()["m"]
    assert [(m["line"], m["text"]) for m in got] == [(1, "a"), (2, "a"), (3, "a")]


def test_all_rules_in_one_scan(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    plan = lint(pages, keys=["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_samples_are_scored_without_a_shuffle(spark):
    samples = spark.createDataFrame([("m", "raw", "1", "html", "<!doctype html><body><img><img>" + "x" * 200)], "model string, condition string, sample_id string, kind string, html string")
    scored = evaluate.scored_samples(samples, rules=NATIVE)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    r = scored.first()
    assert (r["n_tells"], r["n_violations"], r["tells"]) == (1, 2, ["a11y/img-without-alt"])


def test_a_bad_rule_ends_no_other(spark):
    page = spark.createDataFrame([("a", "<img>")], "file string, html string")
    bad = Rule("own/bad", "warn", "", (), lambda d: "no_such_function(html)")
    raising = Rule("own/raising", "info", "")
    good = [r for r in RULES if r.rule_id == "a11y/img-without-alt"]

    def fails(html, css):
        raise KeyError("x")

    found = {r["rule_id"]: r["message"] for r in lint(page, [bad, raising, *good], functions={"own/raising": fails}).collect()}
    assert found["own/bad"].startswith("rule threw") and found["own/raising"] == "rule threw: 'x'" and "a11y/img-without-alt" in found


def test_overrides_of_files(spark, tmp_path):
    def load(*rows):
        (tmp_path / "c.json").write_text(json.dumps({"project": "p", "overrides": list(rows)}))
        return readers.overrides(spark, str(tmp_path / "c.json"))

    good = {"ruleId": "ns/a11y/img-without-alt", "severity": "off", "reason": "decorative images only"}
    again = {"ruleId": "ns/a11y/img-without-alt", "severity": "info", "reason": "but they are to be seen"}
    assert [tuple(r) for r in load(good, again).orderBy("ord").collect()] == [("a11y/img-without-alt", "off", good["reason"], 0), ("a11y/img-without-alt", "info", again["reason"], 1)]
    page = spark.createDataFrame([("a", "<img>")], "file string, html string")
    rule = [r for r in RULES if r.rule_id == "a11y/img-without-alt"]
    assert lint(page, rule, load(good)).count() == 0
    assert [r["severity"] for r in lint(page, rule, load(good, again)).collect()] == ["info"]
    for bad in ({**good, "ruleId": "bare"}, {**good, "severity": "loud"}, {**good, "reason": "short"}, {"rule_id": "x", "severity": "off", "reason": "a reason of some length"}):
        with pytest.raises(ValueError, match=r"overrides\[1\]"):
            load(good, bad)
    (tmp_path / "c.json").write_text("not json")
    with pytest.raises(ValueError, match="JSON"):
        readers.overrides(spark, str(tmp_path / "c.json"))
    twice = spark.createDataFrame([("a11y/img-without-alt", "off"), ("a11y/img-without-alt", "warn")], "rule_id string, severity string")
    with pytest.raises(ValueError, match="twice"):
        overrides.applied(rule, twice)


SITE = [("/index.html", '<h1>A</h1><img><a href="/gone">x</a><a href="/b">y</a>'), ("/b.html", '<h1>A</h1><a href="/">z</a>')]


def test_rules_across_files(spark):
    site = spark.createDataFrame(SITE, "file string, html string")
    found = [(r["file"], r["rule_id"], r["severity"], r["snippet"]) for r in cross_findings(site).collect()]
    assert found == [("/index.html", "no-broken-internal-links", "error", "/gone")]
    assert [r["severity"] for r in cross_findings(site, overrides={"no-broken-internal-links": "info"}).collect()] == ["info"]
    assert cross_findings(site, overrides={"no-broken-internal-links": "off"}).count() == 0
    bad = CrossRule("own/bad", "warn", "", lambda c: c.select("nothing"))
    good = CrossRule("own/good", "warn", "said", lambda c: c.select("file", F.lit(2).alias("line"), F.lit(None).cast("string").alias("message"), F.lit("s").alias("snippet")))
    found = {(r["rule_id"], r["message"][:23]) for r in cross_findings(site, [bad, good]).collect()}
    assert found == {("own/bad", "cross-file rule threw: "), ("own/good", "said")}
    both = lint_site(site, overrides={"no-broken-internal-links": "off"})
    assert {r["rule_id"] for r in both.collect()} >= {"a11y/img-without-alt"} and both.where("rule_id = 'no-broken-internal-links'").count() == 0
    assert "no-broken-internal-links" not in rules_run(overrides={"no-broken-internal-links": "off"}) and len(rules_run()) == len(RULES) + 1


def test_reports_of_a_lint(spark):
    found = lint_site(spark.createDataFrame(SITE, "file string, html string"))
    said = json.loads(sinks.lint_json(found, 2, rules_run()))
    assert said["error"] == sum(v["severity"] == "error" for v in said["violations"]) and said["badge"] == "full" and len(said["rules_run"]) == len(RULES) + 1
    shell = '<html><body><div id="root"></div><script src="/assets/a.js"></script></body></html>'
    assert json.loads(sinks.lint_json(lint_site(spark.createDataFrame([("/x.html", shell)], "file string, html string")), 1, []))["badge"] == "source-only"
    assert sinks.totals_line({"error": 1, "warn": 0, "info": 2}, 3, 4) == "1 error · 0 warn · 2 info · 3 files · 4 rules"
    assert sinks.totals_line({"error": 0, "warn": 0, "info": 0}, 3, 4) == "clean · 3 files · 4 rules"


def test_layout_audit_survives_a_rule(spark):
    columns = "page string, node_id bigint, parent_id bigint, ancestor_ids array<bigint>, tag string, class string, text string, is_target boolean, height double, width double, font_px double, x double, y double, right double, overflow_x string, scroll_w double, client_w double, has_cue boolean"
    elements = spark.createDataFrame([("p", 1, None, [], "a", "", "go", True, 10.0, 30.0, 16.0, 0.0, 0.0, 30.0, "visible", 0.0, 0.0, False)], columns)
    corpus = spark.createDataFrame([("p", "<head></head>")], "page string, html string")
    found = {(r["page"], r["rule_id"], r["severity"], r["node_id"]) for r in layout.audit(elements, corpus).collect()}
    assert found == {("p", "mobile/tap-target-size", "warn", 1), ("p", "mobile/viewport-meta-present", "error", None)}
    broken = {r["rule_id"]: r for r in layout.audit(elements.drop("font_px")).collect()}
    assert broken["mobile/body-font-size"]["severity"] == "error" and broken["mobile/body-font-size"]["message"].startswith("rule threw") and "mobile/tap-target-size" in broken
    assert "1 findings" in sinks.layout_text(layout.audit(elements)) and json.loads(sinks.audit_json("u", layout.audit(elements), "now"))["violations"][0]["rule_id"] == "mobile/tap-target-size"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_run_once(spark):
    """No filter below the explosion has the rules again."""
    rule = Rule("own", "warn", "", find=lambda d: f"case when {d.has('html', 'zzq')} then {d.row('null', 'null')} else {d.none()} end")
    corpus = spark.createDataFrame([(1, "zzq"), (2, ""), (3, None)], "page_id int, html string")
    found = lint(corpus, [rule])
    assert optimized(found.groupBy("severity").count()).count("zzq") == 1 and [r["page_id"] for r in found.collect()] == [1]


def test_links_are_read_once(spark):
    from sieveloom.operators.links import broken_links

    files = ["index.html", "a/index.html", "b.html", "c/.html", "d.txt", "/e/"]
    hrefs = ["/", "/a", "/a/", "/a/index.html", "/a.html", "/b", "/b/", "/b.html", "/b.html/", "/c/", "/c/.html", "/d", "/e", "//", "/index", "/nowhere?x#y"]
    page = "\n".join(f'<a href="{h}">x</a>' for h in hrefs)
    broken = broken_links(spark.createDataFrame([(f, page if f == "b.html" else "x") for f in files], "file string, html string"), ["file"])
    assert optimized(broken).count("array_repeat") == 1
    known = {"/index.html", "/", "/index", "/a/index.html", "/a", "/a/", "/a/index", "/b.html", "/b", "/b.html/", "/c/.html", "/c/", "/c/.html/"}
    bare = {h: "/" if h.split("?")[0] == "/" else h.split("?")[0].removesuffix("/") for h in hrefs}
    expected = sorted(h for h in hrefs if not any(bare[h] + end in known for end in ("", "/", ".html", "/index.html")))
    assert sorted(r["href"] for r in broken.collect()) == expected and "/d" in expected and "/b" not in expected


def test_boundaries(spark):
    """A boundary beside a word character is spelled shorter, and means the same."""
    import re

    texts = ["href", "xhref", "-href", "_href", "href1", "h1", "<h1>", "<h1a", "a", "ab", "\u00e9href\u00e9", "x a", "", "9px", "px9", '"b', '"bc']
    for p in (r"\bhref", r"href\b", r"\bhref\b", r"<h1\b", r"\ba?b", r"\x22\bb", r"\d\bx?", r"\b\d", r"\b(?:px|a)\b"):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").where(SPARK.has("t", p))
        assert sorted(r["i"] for r in df.collect()) == [i for i, t in enumerate(texts) if re.search(p, t, re.I | re.A)], p


def test_tells_are_counted_in_one_pass(spark):
    rule = Rule("own", "warn", "", find=lambda d: f"case when {d.has('html', 'zzq')} then {d.row('null', 'null')} else {d.none()} end")
    pages = ["<html>" + "x" * 300, "<html>zzq" + "x" * 300]
    samples = spark.createDataFrame([("m", "raw", k, "html", p) for k, p in enumerate(pages)], "model string, condition string, sample_id int, kind string, html string")
    shares = evaluate.tell_frequency(evaluate.scored_samples(samples, rules=[rule]))
    assert optimized(shares).count("zzq") == 1 and [tuple(r) for r in shares.collect()] == [("m", "raw", "own", 0.5)]


def test_layout_limits_at_repeated_node_ids(spark):
    """What a limit takes of rows with one ``node_id`` doesn't hang on their order in the table."""
    rows = [("p", 1, "p" if k < 8 else "a", "", f"{k:02} " + "long text " * 8, k >= 8, 10.0, 30.0, 10.0 + k) for k in range(20)]
    columns = "page string, node_id bigint, tag string, class string, text string, is_target boolean, height double, width double, font_px double"
    fonts, targets = set(), set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        elements = spark.createDataFrame(rows, columns).coalesce(1)
        fonts.add(tuple(sorted(r["font_px"] for r in layout.body_font(elements).collect())))
        targets.add(tuple(sorted(r["text"][:2] for r in layout.tap_targets(elements).collect())))
    assert fonts == {(10.0, 11.0, 12.0, 13.0)} and targets == {tuple(f"{k:02}" for k in range(8, 16))}


STYLE = "id: plain\nname: Plain\nversion: '1'\ntype: {scale: 1.2}\ncolour: {space: oklch, contrast-tier: WCAG-AA, palette: {ink: '#111'}, roles: {text: ink}}\ngrid: {}\nspace: {}\nsurface: {}\nforbidden: [a, b, c, d, e, f, g, h]\nrequired-quirks: [q]\nprompt-fragments: {system: Be plain., negative: No glitter.}\n"


def test_tools(spark, tmp_path):
    (tmp_path / "plain.yml").write_text(STYLE)
    of = tools.tools(spark, str(tmp_path))
    assert of["list_styles"]({}) == {"styles": ["plain"]} and of["type_system"]({"token": "plain"}) == {"scale": 1.2}
    assert of["palette"]({"token": "plain"}) == {"palette": {"ink": "#111"}, "roles": {"text": "ink"}}
    assert of["reference"]({"token": "plain"})["required"] == ["q"] and len(of["vision_rules"]({})["rules"]) == 14
    assert "gpt" in of["brief"]({"intent": "x", "token": "plain", "surfaces": ["web"]})["prompts"]
    assert of["lint"]({"html": "<img>"})["violations"][0]["rule_id"] == "a11y/img-without-alt"
    for name, bad in (("style", {"id": "../x"}), ("style", {}), ("brief", {"intent": "", "token": "plain", "surfaces": []}), ("list_styles", {"x": 1})):
        with pytest.raises(tools.BadArguments):
            of[name](bad)
    asked = [{"id": 1, "method": "tools/list"}, {"method": "note"}, {"id": 2, "method": "tools/call", "params": {"name": "list_styles"}}, {"id": 3, "method": "tools/call", "params": {"name": "style", "arguments": {"id": "none"}}}, {"id": 4, "method": "nothing"}, {"id": 5, "method": "initialize"}]
    text = "\n".join(map(json.dumps, asked)) + "\n{broken\n[]"
    said = [json.loads(x) for x in tools.served([text[i : i + 7] for i in range(0, len(text), 7)], of)]
    assert [(r["id"], r.get("error", {}).get("code")) for r in said] == [(1, None), (2, None), (3, -32602), (4, -32601), (5, None), (None, -32700), (None, -32600)]
    assert len(said[0]["result"]["tools"]) == 8


def test_host(tmp_path):
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='two words'\nC=\n\nnonsense\n")
    env = {"A": "kept"}
    assert host.read_env(str(tmp_path / ".env"), env) == {"A": "1", "B": "two words", "C": ""} and env == {"A": "kept", "B": "two words", "C": ""}
    assert host.read_env(str(tmp_path / "none"), env) == {}
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "mark").write_text("")
    assert host.find_root(str(tmp_path / "a/b/c"), ("mark",)) == str(tmp_path) and host.find_root(str(tmp_path / "a/b/c"), ("mark",), 3) is None
    assert host.whole(None, 3) == 3 and host.whole("7", 3, 1, 9) == 7
    for bad in ("x", "1.5", "0", "10"):
        with pytest.raises(ValueError):
            host.whole(bad, 3, 1, 9)
    assert host.slug("Hello, World!", 0) == "19700101-000000-hello-world"
    now, asked = [0.0], []
    r = host.Refusals(60, lambda: now[0])
    check = lambda h: r.check(h, lambda x: asked.append(x) or ("private" if x == "bad" else None))
    assert [check("bad"), check("bad"), check("good"), check("good")] == ["private", "private", None, None] and asked == ["bad", "good", "good"]
    now[0] = 61
    assert check("bad") == "private" and asked[-1] == "bad"
    slept = []
    p = host.Pace(2, lambda: now[0], slept.append)
    p.wait("x")
    now[0] += 0.5
    p.wait("x")
    p.wait("y")
    assert slept == [1.5]
    assert host.first_models(["a", "b", "c"]) == ["a", "b"] and host.first_models(["a", "b"], ["b"]) == ["b"]


def test_critics():
    critics = {"mock": lambda **_: "{}"}
    assert critique.critic_of(None, critics) is critics["mock"] and critique.critic_of("mock", critics) is critics["mock"]
    with pytest.raises(ValueError, match="there are: mock"):
        critique.critic_of("other", critics)


def test_sample_files(spark, tmp_path):
    responses = generate.run(generate.plan(spark, ["mock-swiss"], 2), {"raw": "x", "compiled": "y"}, generate.mock_runner)
    keys = ["model", "condition", "sample_id"]
    made = generate.samples(responses).join(responses.select(*keys, "response_text"), keys)
    failed = spark.createDataFrame([("mock-swiss", "raw", "sample-009", "error", "ValueError: x", None)], made.schema)
    assert sinks.write_sample_files(made.unionByName(failed), str(tmp_path)) == 5
    back = readers.samples(spark, str(tmp_path))
    assert {(r["condition"], r["sample_id"], r["kind"]) for r in back.collect()} == {("raw", "sample-001.html", "html"), ("raw", "sample-002.html", "html"), ("compiled", "sample-001.html", "html"), ("compiled", "sample-002.html", "html"), ("raw", "sample-009.error.txt", "error")}
    assert not list(tmp_path.rglob("*.part")) and readers.critique_samples(spark, str(tmp_path)).count() == 4
    (tmp_path / "empty").mkdir()
    cells = {(r["model"], r["condition"]): r["attempted"] for r in evaluate.accounting(back, readers.models(spark, str(tmp_path))).collect()}
    assert cells == {("mock-swiss", "raw"): 3, ("mock-swiss", "compiled"): 2, ("empty", "raw"): 0, ("empty", "compiled"): 0}


def test_documents(spark, tmp_path):
    made = {"spec": {"a": 1}, "prompts": {"gpt": "hi"}}
    assert sinks.write_prompts(str(tmp_path), made) == ["gpt.md", "spec.json"] and json.loads((tmp_path / "spec.json").read_text()) == {"a": 1}
    schema = sinks.json_schema(spark.createDataFrame([], "a string not null, b array<struct<c: int>>, d map<string, double>").schema)
    assert schema["required"] == ["a"] and schema["properties"]["b"]["items"]["properties"]["c"] == {"type": "integer"} and schema["properties"]["d"]["additionalProperties"] == {"type": "number"}
    record = {"kind": "eval-live", "token": {"path": "t.yml", "hash": "sha256:" + "a" * 64}, "models": [{"id": "m", "provider_request_ids": ["x", "y"]}], "argv": ["a b"]}
    sinks.write_record(record, str(tmp_path / "r.replay.json"))
    assert json.loads((tmp_path / "r.replay.json").read_text()) == record and "request ids: 2" in sinks.record_block(record) and "'a b'" in sinks.record_block(record)
    files = spark.createDataFrame([("a.yml", "x: 1"), ("b.yml", "{"), ("c.yml", None)], "path string, content string")
    assert {(r["path"], r["ok"]) for r in readers.yaml_rows(files).collect()} == {("a.yml", True), ("b.yml", False), ("c.yml", True)}
    for head, name in (("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpeg"), ("474946383961", "gif"), ("524946460000000057454250", "webp")):
        (tmp_path / f"x.{name}").write_bytes(bytes.fromhex(head) + b"\0" * 20)
        assert readers.images(spark, str(tmp_path / f"x.{name}")).first()["mime"] == f"image/{name}"
    with pytest.raises(ValueError, match="too large"):
        readers.inline(spark, [("f", "x" * (1 << 21), "")])
    assert readers.site(spark, str(tmp_path), [str(tmp_path / "gpt.md")]).count() == 1


def test_runs_without_checks(spark):
    checks = spark.createDataFrame([("a", True), ("a", False)], "run string, ok boolean")
    assert {tuple(r) for r in audit.verdict(checks, spark.createDataFrame([("a",), ("b",)], "run string")).collect()} == {("a", False), ("b", True)}


def test_markdown_reports(spark):
    frequencies = spark.createDataFrame([("r", 1, 0, 2, 0, 50.0, None)], "rule_id string, raw int, compiled int, raw_scored int, compiled_scored int, raw_pct double, compiled_pct double")
    assert "| r | 50% | — |" in sinks.critique_markdown("s", "t", "c", frequencies)
    deltas = spark.createDataFrame([("m", 2.0, 1.0, 1.0, 50.0, False)], "model string, raw_mean double, compiled_mean double, delta double, reduction_pct double, is_inconclusive boolean")
    assert "| m | 2.00 | 1.00 | 50.0% |" in sinks.image_markdown("s", "t", deltas)
    checks = spark.createDataFrame([("r", "token", "sha256:" + "a" * 64, None, False, "file not found")], "run string, field string, expected string, actual string, ok boolean, reason string")
    assert sinks.verification_text(checks).endswith("not verified\n")
    assert reports.backfill_counts(reports.backfill(spark.createDataFrame([("a.md", "# x eval · s · 2026-01-01T00:00:00Z\n"), ("b.md", "no head"), ("c.md", "x")], "path string, content string"), spark.createDataFrame([("c.replay.json",)], "path string"))).first()[:] == (3, 1, 1, 1)


def test_submission(spark, tmp_path, capsys):
    from sieveloom.__main__ import main

    (tmp_path / "m.json").write_text(json.dumps({"token": "t", "n": 1, "models": [{"spec": "s", "sanitizedId": "a", "canonicalId": "A"}, {"spec": "s"}]}))
    manifest = spark.read.schema(readers.MANIFEST).json(str(tmp_path / "m.json"), multiLine=True)
    assert {r["problem"] for r in briefs.manifest_problems(manifest).collect()} == {"briefPath", "maxTokens", "runAt", "models[].canonicalId", "models[].sanitizedId", "models[].provider"}
    (tmp_path / "plain.yml").write_text(STYLE)
    assert main(["list", str(tmp_path)]) == 0 and "plain" in capsys.readouterr().out


def test_arrays_keep_rows_without_findings(spark):
    pages = spark.createDataFrame([(1, "<img>"), (2, "<p>x</p>"), (3, None)], "page_id int, html string")
    assert {r["page_id"]: len(r["findings"]) for r in finding_arrays(pages, keys=["page_id"]).collect()}[2] == 0
    assert finding_arrays(pages, [], keys=["page_id"]).count() == 3 and lint(pages, [], keys=["page_id"]).count() == 0


def test_serve_reads_a_stream(spark, tmp_path):
    (tmp_path / "plain.yml").write_text(STYLE)
    asked = io.StringIO('{"id": 1, "method": "tools/call", "params": {"name": "list_styles"}}\n')
    said = list(tools.served(asked, tools.tools(spark, str(tmp_path))))
    assert json.loads(json.loads(said[0])["result"]["content"][0]["text"]) == {"styles": ["plain"]}
