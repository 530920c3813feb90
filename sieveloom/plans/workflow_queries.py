"""Queries on rules across files, parsed rules, whole audits, backfills and prompts, each with its SQL.

The SQL of the rules here is written by hand from what the rules say, not built from the engine's own expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveloom.operators import briefs, critique, evaluate, layout, reports
from sieveloom.operators.lint import CrossRule, cross_findings, lint_site, rule_findings
from sieveloom.operators.rules import RULES
from sieveloom.plans import analysis_queries as base
from sieveloom.plans.corpus import CORPUS_SQL, corpus

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Rules across files.


def _titles(pages):
    """Pages that share their heading with another page."""
    heads = pages.select("file", F.nullif(F.trim(F.regexp_extract("html", "(?i)<h1>([^<]*)</h1>", 1)), F.lit("")).alias("head")).where("head is not null")
    shared = heads.groupBy("head").agg(F.countDistinct("file").alias("n")).where("n > 1")
    return heads.join(shared, "head").select("file", F.lit(None).cast("int").alias("line"), F.format_string("shared by %d files", "n").alias("message"), F.col("head").alias("snippet"))


SAME_HEAD = CrossRule("same-heading", "info", "A heading that several files share.", _titles)


def _fails(pages):
    raise ValueError("no such table")


@query(f"with b as (select l.file, b.line, b.href from ({base._BROKEN}) b join {base.LINKED_SQL} l using (page_id)) select file, 'no-broken-internal-links' as rule_id, 'warn' as severity, line, href as snippet from b")
def cross_rule_overridden(spark, sf_dir):
    found = cross_findings(base.linked(spark, sf_dir), overrides={"no-broken-internal-links": "warn"})
    return found.select("file", "rule_id", "severity", "line", "snippet")


@query(f"""with linked as {base.LINKED_SQL}, heads as (
  select file, nullif(trim(regexp_extract(html, '(?i)<h1>([^<]*)</h1>', 1)), '') as head from linked
), shared as (select head, count(distinct file) as n from heads where head is not null group by head having count(distinct file) > 1)
select file, 'same-heading' as rule_id, 'error' as severity, 'shared by ' || n || ' files' as message, head as snippet from heads join shared using (head)
union all select null, 'broken-rule', 'info', 'cross-file rule threw: no such table', null""")
def custom_cross_rules(spark, sf_dir):
    """A rule of one's own, made an error by an override; one that is switched off; and one that fails, which ends no other."""
    rules = [SAME_HEAD, CrossRule("switched-off", "warn", "", _titles), CrossRule("broken-rule", "info", "", _fails)]
    found = cross_findings(base.linked(spark, sf_dir), rules, {"same-heading": "error", "switched-off": "off"})
    return found.select("file", "rule_id", "severity", "message", "snippet")


@query(f"select severity, count(*) as n from (select severity from ({base._FOUND}) union all select 'error' from ({base._BROKEN}) union all select severity from (values ('x')) v(x), (select 'none' as severity) where false) group by severity")
def site_lint(spark, sf_dir):
    """Rules within files and across them, over pages as files; the native ones, so that SQL can say them."""
    pages = base.linked(spark, sf_dir)
    # what a page's own links add has no rule within files, so the findings are those of the corpus
    return lint_site(pages.select("file", "html"), [r for r in RULES if r.find]).groupBy("severity").agg(F.count("*").alias("n"))


# Rules that are evaluated on a parsed document, on the fragments alone: SQL lists what SURVEY's cases say of them.

_PARSED_CASES = [
    '<div class="text-transparent bg-gradient-to-r from-x">The future is here</div>',
    '<style>.shine{background-clip: text}</style>\n<h2 class="big shine">Intelligence\nfor all</h2><h2 class="shiny">AI</h2>',
    '<h1 class="bg-clip-text bg-gradient-to-r">Plain words</h1>',
    "<p>Unleash your team. UNLEASH it.</p>\n<li>Seamless <em>flow</em></li>",
    "<p>Ship <b>faster</b> now</p><code>seamless</code>",
    "<p>one \u2014 two</p>\n<pre>a \u2014 b</pre><h2>c &mdash; d</h2>",
    "<style>h1{font-size:48px}p{text-transform:uppercase}</style>",
    "<style>h1{font-size:3rem;letter-spacing:-0.02em}p{text-transform:uppercase;letter-spacing:.05em}</style>",
    "<style>:root{--t:4rem;}h1{font-size:var(--t)}p{font-size:47px}</style>",
    '<html><body><div id="root"></div><script src="/assets/index-1.js"></script></body></html>',
    '<html><body><div id="root"><p>text</p></div><script src="/assets/index-1.js"></script></body></html>',
    '<html><body><div id="app"></div><div id="other"></div><script src="/assets/a.js"></script></body></html>',
    '<html><body><div id="__next"></div><noscript>Enable it</noscript><script src="/_next/static/a.js"></script></body></html>',
    "<p>nothing to see</p>",
]
_N = len(_PARSED_CASES)
#: Findings of a rule by case: (line, snippet).
_EXPECTED = {
    "no-gradient-text": {0: [(1, _PARSED_CASES[0])], 1: [(2, '<h2 class="big shine">Intelligence\nfor all</h2>')]},
    "no-slop-copy": {3: [(1, "Unleash your team. UNLEASH it."), (2, "Seamless flow")], 4: [(1, "Ship faster now")]},
    "no-em-dashes-in-prose": {5: [(1, "one \u2014 two"), (2, "c \u2014 d")]},
    "tracking-per-size": {6: [(None, "large type"), (None, "all capitals")], 8: [(None, "large type")]},
    "spa-shell-detected": {9: [(1, '<body><div id="root"></div><script src="/assets/index-1.js"></script></body>')], 12: [(1, '<body><div id="__next"></div><noscript>Enable it</noscript><script src="/_next/static/a.js"></script></body>'[:140])]},
}


def _cases(spark, sf_dir):
    case = F.element_at(F.array(*map(F.lit, _PARSED_CASES)), (F.col("page_id") % _N + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", case.alias("html"))


def _expected_sql(rule_id: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = [f"({k}, {'null::int' if line is None else line}, {quoted(text)})" for k, found in _EXPECTED[rule_id].items() for line, text in found]
    return f"select page_id, c.line, c.snippet from pages join (values {', '.join(rows)}) as c(k, line, snippet) on page_id % {_N} = c.k"


def _parsed(rule_id: str):
    return lambda spark, sf_dir: rule_findings(_cases(spark, sf_dir), rule_id, ["page_id"])


for _rule in _EXPECTED:
    QUERIES[f"cases_{_rule.replace('-', '_')}"] = _parsed(_rule)
    ORACLES[f"cases_{_rule.replace('-', '_')}"] = _expected_sql(_rule)


# Native rules again, against SQL of their own.

_HAND = {
    "a11y/img-without-alt": "select page_id, 1 + length(before) - length(replace(before, chr(10), '')) as line, left(tag, 140) as snippet from (select page_id, tag, array_to_string(parts[1:k], '') || array_to_string(tags[1:k-1], '') as before from (select page_id, string_split_regex(html, '(?i)<img\\b[^>]*>') as parts, regexp_extract_all(html, '(?i)<img\\b[^>]*>') as tags, unnest(range(1, len(tags) + 1)) as k, tags[k] as tag from {c})) where not regexp_matches(tag, '(?i)\\balt\\s*=')",
    "require-type-pairing": "select page_id, null::int as line, null::varchar as snippet from (select page_id, list_distinct(list_filter(list_transform(regexp_extract_all(css, '(?i)font-family\\s*:\\s*([^};]+)', 1), lambda x: lower(replace(replace(trim(split_part(trim(x), ',', 1)), '\"', ''), chr(39), ''))), lambda x: x not in ('', 'serif', 'sans-serif', 'monospace', 'inherit', 'system-ui'))) as f from {s}) where len(f) = 1",
    "line-height-per-size": "select page_id, null::int as line, null::varchar as snippet from {s} where len(list_distinct(list_transform(regexp_extract_all(css, '(?i)line-height\\s*:\\s*([^};]+)', 1), lambda x: lower(trim(x))))) = 1",
    "respect-reduced-motion": "select page_id, null::int as line, null::varchar as snippet from {s} where (regexp_matches(css, '(?i)@keyframes\\s') or regexp_matches(css, '(?i)\\banimation\\s*:') or regexp_matches(css, '(?i)\\btransition\\s*:[^};]*[0-9][0-9]+ms')) and not regexp_matches(css, '(?i)@media\\s*\\([^)]*prefers-reduced-motion')",
    "motion-has-intent": "select page_id, null::int as line, null::varchar as snippet from (select page_id, style || chr(10) || html as t from {h}) where len(regexp_extract_all(t, '(?i)\\b(?:animate-fade-up|animate-slide-up|motion-fade-up|motion-slide-up|data-aos|framer-motion|initial=\\{|animate=\\{)\\b')) >= 4 and not regexp_matches(t, '(?i)data-motion|data-aos-delay|stagger-|delayChildren')",
    "svg/palette-bounds": "select page_id, null::int as line, null::varchar as snippet from {c} where contains(html, '<svg') and len(list_distinct(list_transform(regexp_extract_all(html, '(?i)#(?:[0-9a-f]{6}|[0-9a-f]{3})\\b'), lambda x: lower(x)))) > 6",
}
_STYLE = "array_to_string(regexp_extract_all(html, '(?i)<style[^>]*>([\\s\\S]*?)</style>', 1), chr(10))"
#: The motion fragments of the corpus have no braces; these pages have.
MOTION = '<m.div initial={a} /><m.div initial={b} /><m.p initial={c} /><m.i initial={d} />'


def _by_hand(rule_id: str):
    def run(spark, sf_dir):
        pages = corpus(spark, sf_dir)
        return rule_findings(pages.withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit(MOTION))).otherwise(F.col("html"))), rule_id, ["page_id"])

    return run


_C = f"(select page_id, case when page_id % 7 = 0 then html || '{MOTION}' else html end as html from {CORPUS_SQL})"
for _rule, _sql in _HAND.items():
    _name = "byhand_" + _rule.replace("/", "_").replace("-", "_")
    QUERIES[_name] = _by_hand(_rule)
    ORACLES[_name] = _sql.replace("{c}", _C).replace("{s}", f"(select page_id, chr(10) || coalesce({_STYLE}, '') as css from {_C})").replace("{h}", f"(select page_id, html, chr(10) || coalesce({_STYLE}, '') as style from {_C})")


# Whole audits.

_AUDIT = [("layout_overflow", "mobile/no-horizontal-overflow", "error"), ("layout_tap_targets", "mobile/tap-target-size", "warn"), ("layout_body_font", "mobile/body-font-size", "warn"), ("layout_hidden_scroll", "mobile/scrollable-no-affordance", "warn"), ("layout_list_marks", "mobile/list-mark-alignment", "warn")]


@query("select rule_id, severity, count(*) as n, count(distinct page) as pages from (" + " union all ".join(f"select page, '{r}' as rule_id, '{s}' as severity from ({base.ORACLES[q]})" for q, r, s in _AUDIT) + ") group by all")
def layout_audit(spark, sf_dir):
    return layout.audit(base.elements(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))


@query("select page_id from pages where page_id % 3 <> 1")
def layout_viewport_cases(spark, sf_dir):
    """Pages with a viewport, with one of another width, and without any."""
    head = F.element_at(F.array(*map(F.lit, ("<head></head>", '<head><META content="width=device-width, initial-scale=1" name="viewport"></head>', '<meta name="viewport" content="width=1024">'))), (F.col("page_id") % 3 + 1).cast("int"))
    return layout.no_viewport(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", head.alias("html"))).select("page_id")


# Experiments and reports.


@query("with p as (select 'm' as model, 'c' || page_id % 2 as condition, 'r' || page_id % 3 as rule_id from pages where page_id % 5 <> 0), n as (select condition, count(*) as n from p group by 1) select model, condition, rule_id, count(*) / any_value(n)::double as frequency from p join n using (condition) group by all")
def image_tell_frequency(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    i = F.col("page_id")
    samples = pages.select(F.lit("m").alias("model"), F.concat(F.lit("c"), (i % 2).cast("string")).alias("condition"), F.when(i % 5 == 0, "error").otherwise("critiqued").alias("status"), i)
    return critique.image_frequency(samples.where("status = 'critiqued'").select("model", "condition", F.concat(F.lit("r"), (i % 3).cast("string")).alias("rule_id")), samples)


@query("select count(*) as scanned, count(*) filter (page_id % 4 <> 0 and page_id % 3 <> 0) as written, count(*) filter (page_id % 3 = 0) as skipped, count(*) filter (page_id % 4 = 0 and page_id % 3 <> 0) as failed from pages")
def backfill_counts(spark, sf_dir):
    pages = base._reports(spark, sf_dir).withColumn("p", F.concat(F.lit("r/"), F.col("page_id").cast("string")))
    texts = pages.select(F.concat("p", F.lit(".md")).alias("path"), F.when(F.col("page_id") % 4 == 0, "# notes").otherwise(F.col("content")).alias("content"))
    return reports.backfill_counts(reports.backfill(texts, pages.select(F.concat(F.when(F.col("page_id") % 3 == 0, F.col("p")).otherwise(F.concat(F.lit("other/"), "p")), F.lit(".replay.json")).alias("path"))))


@query("select model, cast(row_number() over (order by seen, model) as int) as rank from (select 'u' || user_id % 7 as model, min(event_id) as seen from events group by 1)")
def models_first_seen(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.first_seen(events.select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("model"), "event_id"), "event_id")


@query("select 'm' || event_id % 4 as canonical_id, list_sort(list('r' || event_id)) as ids, list_sort(list(distinct case when event_id % 3 = 0 then 'raw' else 'compiled' end)) as conditions from events group by 1")
def request_ids_by_model(spark, sf_dir):
    i = F.col("event_id")
    responses = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("m"), (i % 4).cast("string")).alias("canonical_id"), F.concat(F.lit("r"), i.cast("string")).alias("request_id"), F.when(i % 3 == 0, "raw").otherwise("compiled").alias("condition"))
    return evaluate.request_ids(responses)


@query("select case page_id % 3 when 0 then 'models[].provider' when 1 then 'token' else 'models[].a.1' end as field, count(*) as n from pages group by 1")
def submission_issues(spark, sf_dir):
    i = F.col("page_id")
    path = F.when(i % 3 == 0, F.concat(F.lit("models."), i.cast("string"), F.lit(".provider"))).when(i % 3 == 1, "token").otherwise(F.concat(F.lit("models."), i.cast("string"), F.lit(".a.1")))
    return briefs.issue_groups(spark.read.parquet(f"{sf_dir}/pages.parquet").select(path.alias("path")))


# Prompts and documents.


@query("""select page_id, 'Design intent: page ' || page_id || case when page_id % 2 = 0 then chr(10) || 'Audience: all' else '' end || chr(10) || 'Surfaces: web, email'
|| case when page_id % 3 = 0 then chr(10) || 'Must include:' || chr(10) || '- a' || chr(10) || '- b' else '' end || case when page_id % 5 = 0 then chr(10) || 'Must avoid:' || chr(10) || '- c' else '' end as prose from pages""")
def briefs_as_prose(spark, sf_dir):
    i, listed = F.col("page_id"), lambda *x: F.array(*map(F.lit, x))
    prose = briefs.prose_column(F.concat(F.lit(" page "), i.cast("string")), F.when(i % 2 == 0, " all "), listed("web", "email"), F.when(i % 3 == 0, listed("a", "b")), F.when(i % 5 == 0, listed("c")).otherwise(F.array().cast("array<string>")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", prose.alias("prose"))


_VISION = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in critique.VISION_RULES.items()) + ") as v(rule_id, description)"


@query(f"select '{briefs._CRITIC}' || chr(10) || string_agg('- ' || rule_id || ': ' || description, chr(10) order by rule_id) as prompt from {_VISION}")
def critic_prompt(spark, sf_dir):
    return briefs.critic_prompts(critique.catalogue(spark))


@query("select 'rule-' || page_id as rule_id, case when page_id % 2 = 0 then 'warn' else 'error' end as severity from pages")
def markdown_ids(spark, sf_dir):
    i = F.col("page_id").cast("string")
    row = F.concat(F.lit("# Rules\n\n| id | what | severity |\n|---|---|---|\n| `rule-"), i, F.lit("` | text `code` | "), F.when(F.col("page_id") % 2 == 0, "warn").otherwise("error"), F.lit(" |\ntext `other`\n"))
    return reports.ids_in(spark.read.parquet(f"{sf_dir}/pages.parquet").select(row.alias("content")))
