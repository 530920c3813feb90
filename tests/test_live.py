"""Live experiments with mock models, and the command line."""

import json

from sieveloom.__main__ import main
from sieveloom.operators import evaluate, generate


def test_live(spark):
    planned = generate.plan(spark, ["mock-slop", "mock-swiss", "gpt-x", "nobody"], 2)
    assert planned.count() == 12
    said = generate.run(planned, {"raw": "p", "compiled": "q"}, generate.mock_runner, cap=3)
    samples = generate.samples(said).cache()
    cells = {(r["model"], r["condition"]): r for r in evaluate.cells(samples, evaluate.scored_samples(samples)).collect()}
    assert cells["gpt-x", "raw"]["errored"] == 2 and cells["gpt-x", "raw"]["scored"] == 0
    assert cells["mock-slop", "raw"]["mean_tells"] >= 6 > 1 > cells["mock-swiss", "raw"]["mean_tells"]
    deltas = {r["model"]: r["shown"] for r in evaluate.deltas(evaluate.cells(samples, evaluate.scored_samples(samples))).collect()}
    assert deltas["gpt-x"] == "inconclusive" and deltas["mock-slop"] == "0.0%"
    assert generate.run(planned, {"raw": "p", "compiled": "q"}, generate.mock_runner, done=said).count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "index.html").write_text('<img src="x">\n<a href="/gone">g</a><a href="/">h</a>')
    (tmp_path / "off.json").write_text(json.dumps({"overrides": [{"rule_id": "a11y/img-without-alt", "severity": "off", "reason": "a test of it"}]}))
    assert main(["lint", str(tmp_path / "site")]) == 1
    out = capsys.readouterr().out
    assert "a11y/img-without-alt" in out and "/gone" in out and '"error": 1' in out
    main(["lint", str(tmp_path / "site"), "--config", str(tmp_path / "off.json")])
    assert "a11y/img-without-alt" not in capsys.readouterr().out
    assert main(["rules", "--engine", "mobile"]) == 0 and capsys.readouterr().out.count("\n") == 6
