"""A query for each rule that SQL can say, with its SQL; and the flagship, all of them by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveloom.functions.dialect import DUCK
from sieveloom.operators.lint import lint, rule_findings
from sieveloom.operators.rules import NATIVE, RULES, Rule
from sieveloom.plans.corpus import CORPUS_SQL, corpus


def _query(rule: Rule):
    return lambda spark, sf_dir: rule_findings(corpus(spark, sf_dir), rule.rule_id, ["page_id"])


SOURCES_SQL = f"(select *, '' || chr(10) || style as cs, '' || chr(10) || style || chr(10) || html as csh from (select *, {DUCK.style('html')} as style from {CORPUS_SQL}))"


def findings_sql(rule: Rule) -> str:
    return f"select page_id, f.line as line, f.text as snippet from (select page_id, unnest({rule.find(DUCK)}) as f from {SOURCES_SQL})"


def all_findings_sql(rules: list[Rule] = NATIVE) -> str:
    """(page_id, rule_id, severity, line, snippet)"""
    return " union all ".join(f"select page_id, '{r.rule_id}' as rule_id, '{r.severity}' as severity, line, snippet from ({findings_sql(r)})" for r in rules)


def flagship(spark, sf_dir):
    """Findings by rule over the whole corpus, native rules only."""
    found = lint(corpus(spark, sf_dir), NATIVE, keys=["page_id"])
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("page_id").alias("n_pages"))


def full_lint(spark, sf_dir):
    """All rules, the parsed ones too."""
    return lint(corpus(spark, sf_dir), RULES, keys=["page_id"]).select("page_id", "rule_id", "severity", "line", "snippet")


QUERIES = {f"rule_{r.name}": _query(r) for r in NATIVE} | {"flagship_corpus_lint": flagship, "full_lint": full_lint}
ORACLES = {f"rule_{r.name}": findings_sql(r) for r in NATIVE} | {"flagship_corpus_lint": f"select rule_id, severity, count(*) as n_findings, count(distinct page_id) as n_pages from ({all_findings_sql()}) group by all"}
