"""Documents in, findings out: all rules over a corpus in one pass, with overrides of severity.

The rules that SQL can say are one projection, an array of findings; a gate on a
plain word ends most of them before a regex runs. The parsed rules add theirs to
the array in one Arrow pass over the same scan. Nothing is shuffled; the array is
exploded once, or counted where it stands. Overrides are a small table, settled
before a plan is made. Rules across files take the whole corpus as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK
from sieveloom.operators.links import broken_links
from sieveloom.operators.overrides import applied
from sieveloom.operators.parsed_rules import PARSED
from sieveloom.operators.rules import BY_ID, RULES, Rule

FINDING = "rule_id string, severity string, rule_ord int, match_ord int, line int, message string, snippet string"


def sources(corpus: DataFrame) -> DataFrame:
    """``corpus`` (with ``html`` and ``css``, nulls as empty) and what the rules read: ``cs``, ``csh`` and small-letter copies for the gates."""
    texts = corpus.withColumns({"html": F.coalesce("html", F.lit("")), "css": F.coalesce("css", F.lit(""))})
    style = F.when(F.contains(F.lower("html"), F.lit("<style")), F.expr(SPARK.style("html"))).otherwise("")
    return texts.withColumn("cs", F.concat_ws("\n", "css", style)).withColumn("csh", F.concat_ws("\n", "cs", "html")).withColumn("low", F.lower("csh"))


def _gated(rule: Rule) -> str:
    gate = " or ".join(f"contains(low, {SPARK.text(w)})" for w in rule.gate)
    found = f"coalesce({rule.find(SPARK)}, {SPARK.none()})"
    return f"case when {gate} then {found} else {SPARK.none()} end" if gate else found


def _native(rules: list[Rule]) -> str:
    rows = []
    for r in rules:
        ord_ = RULES.index(r) if r in RULES else _ORDER.get(r.rule_id, len(RULES))
        rows.append(f"transform({_gated(r)}, (x, i) -> named_struct('rule_id', {SPARK.text(r.rule_id)}, 'severity', {SPARK.text(r.severity)}, 'rule_ord', {ord_}, 'match_ord', i, 'line', x.line, 'message', {SPARK.text(r.description)}, 'snippet', x.text))")
    return f"flatten(array({', '.join(rows)}))" if rows else f"cast(array() as array<struct<{FINDING.replace(' ', ': ').replace(',:', ',')}>>)"


def _with_parsed(frame: DataFrame, rules: list[Rule], keys: list[str], functions: dict) -> DataFrame:
    """(keys, findings): what the parsed rules find comes after what is there. A rule that raises gives one finding that says so, and the others go on."""
    chosen = [(r.rule_id, r.severity, r.description, _ORDER.get(r.rule_id, len(_ORDER)), r.gate) for r in rules]
    kinds = pa.struct([("rule_id", pa.string()), ("severity", pa.string()), ("rule_ord", pa.int32()), ("match_ord", pa.int32()), ("line", pa.int32()), ("message", pa.string()), ("snippet", pa.string())])

    def of_page(html: str, css: str) -> list[tuple]:
        rows, low = [], f"{css}\n{html}".lower()
        for rule_id, severity, description, ord_, gate in chosen:
            if gate and not any(w in low for w in gate):
                continue
            message = description
            try:
                found = functions[rule_id](html, css)
            except Exception as e:  # a finding of its own, as the contract of custom rules has it
                found, message = [(None, None)], f"rule threw: {e}"
            rows += [(rule_id, severity, ord_, i, line, message, text) for i, (line, text) in enumerate(found)]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of_page(html, css) for html, css in zip(b.column("html").to_pylist(), b.column("css").to_pylist(), strict=True)]
            made = [dict(zip(kinds.names, r, strict=True)) for page in rows for r in page]
            stop = [0]
            for page in rows:
                stop.append(stop[-1] + len(page))
            parsed = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(made, kinds))
            yield pa.RecordBatch.from_arrays([*b.select([*keys, "findings"]).columns, parsed], [*keys, "findings", "parsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys, "findings").schema.fields)
    array = frame.schema["findings"].dataType.simpleString()
    return frame.select(*keys, "html", "css", "findings").mapInArrow(run, f"{schema}, parsed {array}").select(*keys, F.concat("findings", "parsed").alias("findings"))


_ORDER = {r.rule_id: k for k, r in enumerate(RULES)}


def finding_arrays(corpus: DataFrame, rules: list[Rule] | None = None, overrides: DataFrame | dict | None = None, keys: list[str] | None = None, functions: dict | None = None) -> DataFrame:
    """(keys, findings): a row for each row of ``corpus``, with an array of its findings (``FINDING``) in the order of rules.

    ``rules`` can hold rules of one's own: with ``find``, or with a Python
    function of (html, css) in ``functions``. Rules that overrides switch off are left out of the plan.
    A native rule whose expression Spark refuses gives one finding a row that says so.
    """
    keys = keys or [c for c in corpus.columns if c not in ("html", "css")]
    if "css" not in corpus.columns:
        corpus = corpus.withColumn("css", F.lit(""))
    chosen = applied(RULES if rules is None else rules, overrides)
    native, parsed = [r for r in chosen if r.find], [r for r in chosen if not r.find]
    read = sources(corpus)
    own = [r for r in native if r.rule_id not in _ORDER]  # the catalogue's own are known to be well formed
    native = [_checked(read, r) if r in own else r for r in native]
    columns = [*keys, "html", "css"] if parsed else keys
    found = read.select(*dict.fromkeys(columns), F.expr(_native(native)).alias("findings"))
    return _with_parsed(found, parsed, keys, {**PARSED, **(functions or {})}) if parsed else found


def _checked(read: DataFrame, rule: Rule) -> Rule:
    try:
        read.select(F.expr(rule.find(SPARK)))
        return rule
    except Exception as e:  # what a rule of one's own gets wrong mustn't end the others
        said = f"rule threw: {str(e).splitlines()[0][:200]}"
        return replace(rule, gate=(), description=said, find=lambda d: d.row("null", "null"))


def lint(corpus: DataFrame, rules: list[Rule] | None = None, overrides: DataFrame | dict | None = None, keys: list[str] | None = None, functions: dict | None = None) -> DataFrame:
    """(keys, rule_id, severity, rule_ord, match_ord, line, message, snippet): ``finding_arrays``, a row for each finding."""
    keys = keys or [c for c in corpus.columns if c not in ("html", "css")]
    # not inline: Spark would ask for arrays that aren't empty first, below the projection, and so run every rule again (and the sources for each use of them)
    return finding_arrays(corpus, rules, overrides, keys, functions).select(*keys, F.inline_outer("findings")).where("rule_id is not null")


@dataclass(frozen=True)
class CrossRule:
    """A rule across files: ``find`` takes the corpus (file, html, css) and gives (file, line, message, snippet)."""

    rule_id: str
    severity: str
    description: str
    find: Callable[[DataFrame], DataFrame]


def _broken(corpus: DataFrame) -> DataFrame:
    return broken_links(corpus.where("html <> ''"), ["file"]).select("file", "line", F.lit(None).cast("string").alias("message"), F.col("href").alias("snippet"))


CROSS = [CrossRule("no-broken-internal-links", "error", "A link within the site to a page that isn't there.", _broken)]


def cross_findings(corpus: DataFrame, rules: list[CrossRule] | None = None, overrides: DataFrame | dict | None = None) -> DataFrame:
    """(file, the columns of ``FINDING``) of the rules across files. A null message is the rule's description.

    Overrides change a rule's severity or leave it out. A rule that can't be planned
    gives one finding, without a file, that says so; the others go on.
    """
    spark = corpus.sparkSession
    parts = []
    for k, rule in enumerate(applied(CROSS if rules is None else rules, overrides)):
        try:
            found = rule.find(corpus).select("file", F.col("line").cast("int").alias("line"), F.coalesce("message", F.lit(rule.description)).alias("message"), "snippet")
        except Exception as e:
            found = spark.createDataFrame([(None, None, f"cross-file rule threw: {str(e).splitlines()[0][:200]}", None)], "file string, line int, message string, snippet string")
        order = F.row_number().over(_by_file()) - 1
        parts.append(found.select("file", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(len(RULES) + k).alias("rule_ord"), order.cast("int").alias("match_ord"), "line", "message", "snippet"))
    if not parts:
        return spark.createDataFrame([], f"file string, {FINDING}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("line", "snippet")


def lint_site(corpus: DataFrame, rules: list[Rule] | None = None, cross: list[CrossRule] | None = None, overrides: DataFrame | dict | None = None, functions: dict | None = None) -> DataFrame:
    """(file, the columns of ``FINDING``) of (file, html, css): the rules within files and those across them, with one set of overrides."""
    return lint(corpus, rules, overrides, ["file"], functions).unionByName(cross_findings(corpus, cross, overrides))


def rules_run(rules: list[Rule] | None = None, cross: list[CrossRule] | None = None, overrides: DataFrame | dict | None = None) -> list[str]:
    """The ids of the rules that run: all that overrides don't switch off, fired or not."""
    return [r.rule_id for r in [*applied(RULES if rules is None else rules, overrides), *applied(CROSS if cross is None else cross, overrides)]]


def rule_findings(corpus: DataFrame, rule_id: str, keys: list[str]) -> DataFrame:
    """(keys, line, snippet) of one rule."""
    return lint(corpus, [BY_ID[rule_id]], keys=keys).select(*keys, "line", "snippet")
