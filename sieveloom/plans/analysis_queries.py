"""Queries on links, overrides, experiments, critiques, audits, adapters, catalogue and layout, each with its SQL.

Their inputs come from the page, document and event tables by the same arithmetic in Spark and in SQL:
a page's model and condition from its number, layouts from line items. No query leaves rows of its tables out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.functions.dialect import DUCK, SPARK
from sieveloom.operators import adapters, audit, catalogue, critique, evaluate, layout, links, overrides, reports
from sieveloom.operators.lint import lint
from sieveloom.operators.rules import NATIVE
from sieveloom.plans.corpus import CORPUS_SQL, corpus
from sieveloom.plans.rule_queries import all_findings_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Links. Pages are files at their URL's path; a share of the corpus' fragments link to paths that exist.

_PATH = r"^https?://[^/?#]*([^?#]*)"


def _file(d) -> str:
    path = d.sub(d.one("url", _PATH, 1), "/$", "", False)
    return f"case when {d.has(path, '[.]html$', False)} then {path} else {path} || '/index.html' end"


def linked(spark, sf_dir) -> DataFrame:
    """(page_id, url, file, html): each page with a link to its own path and one to that path with a suffix."""
    pages = corpus(spark, sf_dir).withColumn("file", F.expr(_file(SPARK)))
    return pages.withColumn("html", F.concat("html", F.lit('\n<a href="'), F.regexp_extract("url", _PATH, 1), F.lit('?q=1#top">here</a> <a href=\''), F.regexp_extract("url", _PATH, 1), F.lit("x'>gone</a>")))


LINKED_SQL = f"""(select page_id, url, {_file(DUCK)} as file, html || chr(10) || '<a href="' || {DUCK.one('url', _PATH, 1)} || '?q=1#top">here</a> <a href=''' || {DUCK.one('url', _PATH, 1)} || 'x''>gone</a>' as html from {CORPUS_SQL})"""
_BROKEN = f"""
with linked as {LINKED_SQL}, known as (
  select distinct unnest([p, w, case when w <> '/' and not ends_with(w, '/') then w || '/' end, regexp_replace(p, '[.]html$', '')]) as path
  from (select file as p, case when regexp_replace(file, '/index[.]html$', '') = '' then '/' else regexp_replace(file, '/index[.]html$', '') end as w from linked where ends_with(file, '.html'))
), hrefs as (
  select page_id, h.line as line, {links.raw_target(DUCK, 'h.text')} as href from (select page_id, unnest({links.hrefs(DUCK, 'html')}) as h from linked)
), targets as (
  select *, {links.target(DUCK, 'href')} as target from hrefs where {links.is_internal(DUCK, 'href')}
)
select page_id, line, href from targets t where not exists (select 1 from known k where k.path = t.target) and not exists (select 1 from known k where k.path = t.target || '/')
  and not exists (select 1 from known k where k.path = t.target || '.html') and not exists (select 1 from known k where k.path = t.target || '/index.html')
"""


@query(_BROKEN)
def broken_links(spark, sf_dir):
    return links.broken_links(linked(spark, sf_dir), ["page_id"])


@query(f"select page_id, count(*) as n_broken from ({_BROKEN}) group by page_id")
def broken_links_by_page(spark, sf_dir):
    return broken_links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n_broken"))


_KNOWN = f"""
with linked as {LINKED_SQL}
select distinct unnest([p, w, case when w <> '/' and not ends_with(w, '/') then w || '/' end, regexp_replace(p, '[.]html$', '')]) as path
from (select file as p, case when regexp_replace(file, '/index[.]html$', '') = '' then '/' else regexp_replace(file, '/index[.]html$', '') end as w from linked where ends_with(file, '.html'))
"""


@query(f"select path from ({_KNOWN}) where path is not null")
def known_paths(spark, sf_dir):
    return links.known_paths(linked(spark, sf_dir))


# Findings in general, and overrides.

_FOUND = all_findings_sql()


def found(spark, sf_dir, over=None) -> DataFrame:
    return lint(corpus(spark, sf_dir), NATIVE, over, ["page_id"])


@query(f"select severity, count(*) as n from ({_FOUND}) group by severity")
def severity_summary(spark, sf_dir):
    return found(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"select bool_or(severity = 'error') as has_error, bool_or(rule_id = 'a11y/heading-skip') as has_skip, count(distinct rule_id) as n_rules from ({_FOUND})")
def badge_and_exit(spark, sf_dir):
    return found(spark, sf_dir).agg(F.bool_or(F.col("severity") == "error").alias("has_error"), F.bool_or(F.col("rule_id") == "a11y/heading-skip").alias("has_skip"), F.countDistinct("rule_id").alias("n_rules"))


OVERRIDES = [("a11y/img-without-alt", "off", "decorative only", 1), ("no-fake-testimonials", "info", "stock on purpose", 2), ("a11y/heading-skip", "off", "legacy outline", 3), ("a11y/heading-skip", "error", "outline matters", 4), ("unknown-rule", "warn", "of another engine", 5)]
_OVER = "(values " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in OVERRIDES) + ") as o(rule_id, severity, reason, ord)"
STYLE_OVERRIDES = [("a11y/img-without-alt", "error", "strict style", 1), ("radius-hierarchy", "off", "one radius only", 2)]
_STYLE_OVER = "(values " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in STYLE_OVERRIDES) + ") as o(rule_id, severity, reason, ord)"


def _overrides(spark, rows=OVERRIDES):
    return spark.createDataFrame(rows, "rule_id string, severity string, reason string, ord int")


@query(f"with last as (select rule_id, arg_max(severity, ord) as s from {_OVER} group by rule_id) select f.rule_id, coalesce(s, f.severity) as severity, count(*) as n from ({_FOUND}) f left join last on f.rule_id = last.rule_id where s is null or s <> 'off' group by all")
def override_apply(spark, sf_dir):
    return overrides.override(found(spark, sf_dir), _overrides(spark)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"select rule_id, severity, reason, ord from {_OVER} union all select rule_id, severity, reason, ord from {_STYLE_OVER} where rule_id not in (select rule_id from {_OVER})")
def override_merge(spark, sf_dir):
    return overrides.merge(_overrides(spark), _overrides(spark, STYLE_OVERRIDES))


_RULES = "(values " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + "')" for r in catalogue.rows()) + ") as r(rule_id, engine, severity, status, description)"


@query(f"with last as (select rule_id, arg_max(severity, ord) as s from {_OVER} group by rule_id) select r.rule_id, coalesce(s, r.severity) as severity, s is not null as is_overridden from {_RULES} left join last on r.rule_id = last.rule_id where s is null or s <> 'off'")
def effective_rules(spark, sf_dir):
    return overrides.effective_rules(catalogue.rules_table(spark), _overrides(spark))


@query(f"select rule_id, severity, case when severity not in ('error', 'warn', 'info', 'off') then 'severity' when length(trim(reason)) < 10 then 'reason' end as problem from (select rule_id, severity, substr(reason, 1, 9 + ord) as reason from {_OVER})")
def override_validation(spark, sf_dir):
    return overrides.validated(_overrides(spark).withColumn("reason", F.expr("substr(reason, 1, 9 + ord)"))).select("rule_id", "severity", "problem")


_STYLES = [("swiss", [("a", "not for print"), ("b", "own grid here")], [("c", None)]), ("green", [], [("a", None), ("d", None)]), ("plain", None, None)]


@query("values ('swiss', 'a', 'off', 'not for print'), ('swiss', 'b', 'off', 'own grid here'), ('swiss', 'c', 'error', null), ('green', 'a', 'error', null), ('green', 'd', 'error', null)".replace("values", "select * from (values", 1) + ") as t(style, rule_id, severity, reason)")
def style_overrides(spark, sf_dir):
    item = "array<struct<rule_id: string, reason: string>>"
    return overrides.from_style(spark.createDataFrame(_STYLES, f"style string, disable {item}, enable_strict {item}"))


@query(f"select style, count(*) as n from (select {overrides.active_style(DUCK, 'html')} as style from {CORPUS_SQL}) group by style")
def style_detection(spark, sf_dir):
    return overrides.detect_styles(corpus(spark, sf_dir)).groupBy("style").agg(F.count("*").alias("n"))


@query(f"select arg_min(style, page_id) as style from (select page_id, {overrides.active_style(DUCK, 'html')} as style from {CORPUS_SQL}) where style is not null")
def first_style(spark, sf_dir):
    return overrides.first_style(corpus(spark, sf_dir), "page_id")


@query(f"select page_id, count(*) as n_blocks, sum(length(b)) as n_body from (select page_id, unnest({DUCK.bodies('style')}) as b from (select page_id, {DUCK.style('html')} as style from {CORPUS_SQL})) group by page_id")
def css_blocks(spark, sf_dir):
    style = corpus(spark, sf_dir).select("page_id", F.expr(SPARK.style("html")).alias("style"))
    return style.select("page_id", F.explode(F.expr(SPARK.bodies("style"))).alias("b")).groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("b")).alias("n_body"))


@query(f"select page_id, {DUCK.newlines('html')} + 1 as n_lines, sha256(html) as digest, 'sha256:' || left(sha256(html), 12) as short from {CORPUS_SQL}")
def sha256_bytes(spark, sf_dir):
    digest = F.sha2("html", 256)
    return corpus(spark, sf_dir).select("page_id", F.expr(SPARK.newlines("html") + " + 1").alias("n_lines"), digest.alias("digest"), F.concat(F.lit("sha256:"), F.left(digest, F.lit(12))).alias("short"))


# Experiments: a page is a sample of model and condition by its number.


def samples(spark, sf_dir) -> DataFrame:
    """(model, condition, sample_id, kind, html): every 23rd is an error, of every 19th no page came out; the last model has raw samples only."""
    i = F.col("page_id")
    model = F.concat(F.lit("m"), (i % 5).cast("string"))
    return corpus(spark, sf_dir).select(
        model.alias("model"),
        F.when((i % 2 == 0) | (i % 5 == 4), "raw").otherwise("compiled").alias("condition"),
        i.alias("sample_id"),
        F.when(i % 23 == 0, "error").otherwise("html").alias("kind"),
        F.when(i % 19 == 0, "").otherwise(F.col("html")).alias("html"),
    )


SAMPLES_SQL = f"(select 'm' || page_id % 5 as model, case when page_id % 2 = 0 or page_id % 5 = 4 then 'raw' else 'compiled' end as condition, page_id as sample_id, case when page_id % 23 = 0 then 'error' else 'html' end as kind, case when page_id % 19 = 0 then '' else html end as html from {CORPUS_SQL})"
_GOOD = f"kind = 'html' and {evaluate.usable(DUCK, 'html')}"
_DENSE = f"(select model, condition from (select distinct model from {SAMPLES_SQL}), (values ('raw'), ('compiled')) as c(condition))"
_ACCOUNT = f"select d.model, d.condition, count(s.sample_id) as attempted, count(*) filter (kind = 'error') as errored, count(*) filter (kind = 'html' and not ({_GOOD})) as extraction_failed, count(*) filter ({_GOOD}) as scored from {_DENSE} d left join {SAMPLES_SQL} s on d.model = s.model and d.condition = s.condition group by all"
_TELLS = f"(select s.model, s.condition, s.sample_id, f.rule_id from {SAMPLES_SQL} s join ({_FOUND}) f on f.page_id = s.sample_id where {_GOOD})"
_SCORED = f"(select s.model, s.condition, s.sample_id, count(distinct rule_id) as n_tells, count(rule_id) as n_violations from (select * from {SAMPLES_SQL} where {_GOOD}) s left join {_TELLS} t using (sample_id) group by all)"
_CELLS = f"select a.*, coalesce(t, 0) / greatest(1, scored) as mean_tells from ({_ACCOUNT}) a left join (select model, condition, sum(n_tells) as t from {_SCORED} group by all) using (model, condition)"
_FREQ = f"select model, condition, tell, c / n as frequency from (select model, condition, rule_id as tell, count(distinct sample_id) as c from {_TELLS} group by all) join (select model, condition, count(*) as n from {_SCORED} group by all) using (model, condition)"


@query(f"select * from {_DENSE}")
def cells_dense(spark, sf_dir):
    return evaluate.dense_cells(samples(spark, sf_dir))


@query(_ACCOUNT)
def cell_accounting(spark, sf_dir):
    return evaluate.accounting(samples(spark, sf_dir))


@query(f"select * from {_SCORED}")
def scored_samples(spark, sf_dir):
    return evaluate.scored_samples(samples(spark, sf_dir), rules=NATIVE).drop("tells")


def _cells(spark, sf_dir):
    s = samples(spark, sf_dir)
    return evaluate.cells(s, evaluate.scored_samples(s, rules=NATIVE))


@query(_CELLS)
def cell_mean_tells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(_FREQ)
def tell_frequency(spark, sf_dir):
    return evaluate.tell_frequency(evaluate.scored_samples(samples(spark, sf_dir), rules=NATIVE))


_DELTA = f"select model, coalesce(max(mean_tells) filter (condition = 'raw'), 0) as raw_mean_tells, coalesce(max(mean_tells) filter (condition = 'compiled'), 0) as compiled_mean_tells, coalesce(max(scored) filter (condition = 'raw'), 0) as raw_scored, coalesce(max(scored) filter (condition = 'compiled'), 0) as compiled_scored from ({_CELLS}) group by model"


@query(f"select *, raw_mean_tells - compiled_mean_tells as delta, case when raw_scored > 0 and compiled_scored > 0 and raw_mean_tells > 0 then (raw_mean_tells - compiled_mean_tells) / raw_mean_tells * 100 else 0 end as reduction_pct from ({_DELTA})")
def delta_report(spark, sf_dir):
    return evaluate.deltas(_cells(spark, sf_dir)).drop("shown")


@query(f"select model, case when raw_scored > 0 and compiled_scored > 0 then 'shown' else 'inconclusive' end as verdict from ({_DELTA})")
def delta_guard(spark, sf_dir):
    return evaluate.deltas(_cells(spark, sf_dir)).select("model", F.when(F.col("shown") == "inconclusive", "inconclusive").otherwise("shown").alias("verdict"))


_MODELS = [f"m{k}" for k in range(5)]
_PIVOT = ", ".join(f"coalesce(max(frequency) filter (model = '{m}' and condition = '{c}'), 0) as {m}_{c}" for m in _MODELS for c in evaluate.CONDITIONS)


@query(f"select tell, {_PIVOT} from ({_FREQ}) group by tell")
def tell_pivot(spark, sf_dir):
    return evaluate.tell_pivot(tell_frequency(spark, sf_dir), _MODELS)


_MANIFEST = [("m0", "vendor/m-zero", 1), ("m0", "vendor/other", 2), ("m2", "vendor/m-two", 3), ("m9", "vendor/unused", 4)]
_MANIFEST_SQL = "(values " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _MANIFEST) + ") as m(sanitized_id, canonical_id, ord)"


@query(f"select model, condition, coalesce(canonical_id, model) as canonical_id from {_DENSE} d left join (select sanitized_id, arg_min(canonical_id, ord) as canonical_id from {_MANIFEST_SQL} group by 1) m on d.model = m.sanitized_id")
def manifest_join(spark, sf_dir):
    return evaluate.canonical(evaluate.dense_cells(samples(spark, sf_dir)), spark.createDataFrame(_MANIFEST, "sanitized_id string, canonical_id string, ord int"))


@query(f"select sanitized_id, canonical_id, ord from {_MANIFEST_SQL} where sanitized_id not in (select model from {SAMPLES_SQL}) union all select distinct model, 'run/' || model, 0 from {SAMPLES_SQL}")
def manifest_upsert(spark, sf_dir):
    new = samples(spark, sf_dir).select(F.col("model").alias("sanitized_id"), F.concat(F.lit("run/"), "model").alias("canonical_id"), F.lit(0).alias("ord")).distinct()
    return evaluate.upsert_manifest(spark.createDataFrame(_MANIFEST, "sanitized_id string, canonical_id string, ord int"), new)


@query(f"select model, condition, (p + z * z / (2 * n)) / (1 + z * z / n) - sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / (1 + z * z / n) as low, (p + z * z / (2 * n)) / (1 + z * z / n) + sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / (1 + z * z / n) as high from (select model, condition, count(*) as n, count(*) filter (n_tells > 0) / count(*) as p, 1.959963984540054::double as z from {_SCORED} group by all)")
def wilson_interval(spark, sf_dir):
    n = evaluate.scored_samples(samples(spark, sf_dir), rules=NATIVE).groupBy("model", "condition").agg(F.count("*").alias("n"), F.count_if(F.col("n_tells") > 0).alias("k"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return n.select("model", "condition", low.alias("low"), high.alias("high"))


# Critiques: a response for each page.

_VISION = list(critique.VISION_RULES)
_SHAPES = [
    'Here: {"fired": ["%s", "unknown", 3], "rationale": {"%s": "because"}} done',
    '{"fired": ["%s", "layout-deadspace"]}',
    '{"fired": []} %s',
    "nothing to see %s",
    '{"fired": "%s"}',
    '{"fired": ["%s", }',
]


def responses(spark, sf_dir) -> DataFrame:
    """(page_id, condition, response_text)"""
    i = F.col("page_id")
    rule = F.element_at(F.array(*map(F.lit, _VISION)), (i % len(_VISION) + 1).cast("int"))
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (i % len(_SHAPES) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(i % 2 == 0, "raw").otherwise("compiled").alias("condition"), F.replace(shape, F.lit("%s"), rule).alias("response_text"))


_VERDICTS = f"""(
with said as (
  select page_id, case when page_id % 2 = 0 then 'raw' else 'compiled' end as condition, page_id % {len(_SHAPES)} as shape, ([{', '.join(f"'{v}'" for v in _VISION)}])[page_id % {len(_VISION)} + 1] as rule from pages
), fired as (
  select page_id, condition, rule as rule_id, case when shape = 0 then 'because' end as why from said where shape in (0, 1) union all select page_id, condition, 'layout-deadspace', null from said where shape = 1
), vision as (select rule_id, description from {_RULES} where engine = 'vision')
select page_id, condition, rule_id, coalesce(why, description) as message from fired join vision using (rule_id)
union all select page_id, condition, '{critique.FAILED}', 'the response can''t be read' from said where shape in (3, 4, 5))"""


@query(f"select * from {_VERDICTS}")
def verdict_parse(spark, sf_dir):
    return critique.verdicts(responses(spark, sf_dir), ["page_id", "condition"])


@query(f"""select coalesce(v.rule_id, r.rule_id) as rule_id, coalesce("raw", 0) as "raw", coalesce(compiled, 0) as compiled, n.raw_scored, n.compiled_scored, round(100.0 * coalesce("raw", 0) / nullif(raw_scored, 0)) as raw_pct, round(100.0 * coalesce(compiled, 0) / nullif(compiled_scored, 0)) as compiled_pct
from (select rule_id from {_RULES} where engine = 'vision') r full outer join (select rule_id, count(*) filter (condition = 'raw') as "raw", count(*) filter (condition = 'compiled') as compiled from {_VERDICTS} group by 1) v on r.rule_id = v.rule_id,
(select count(*) filter (page_id % 2 = 0) as raw_scored, count(*) filter (page_id % 2 = 1) as compiled_scored from pages) n""")
def critique_frequency(spark, sf_dir):
    said = responses(spark, sf_dir)
    return critique.frequencies(critique.verdicts(said, ["page_id", "condition"]), said, critique.catalogue(spark))


_IMAGES = "(select 'i' || page_id % 3 as model, case when page_id % 2 = 0 or page_id % 3 = 2 then 'raw' else 'compiled' end as condition, case when page_id % 7 = 0 then 'error' when page_id % 11 = 0 then 'no-critique' else 'critiqued' end as status, (page_id % 4)::int as n_violations from pages)"
_IMAGE_CELLS = f"select model, condition, count(*) as attempted, count(*) filter (status = 'error') as errored, count(*) filter (status = 'critiqued') as critiqued, coalesce(sum(n_violations) filter (status = 'critiqued'), 0) / greatest(1, count(*) filter (status = 'critiqued')) as mean_tells from {_IMAGES} group by all"


@query(_IMAGE_CELLS)
def image_cells(spark, sf_dir):
    i = F.col("page_id")
    runs = table(spark, sf_dir, "pages").select(F.concat(F.lit("i"), (i % 3).cast("string")).alias("model"), F.when((i % 2 == 0) | (i % 3 == 2), "raw").otherwise("compiled").alias("condition"), F.when(i % 7 == 0, "error").when(i % 11 == 0, "no-critique").otherwise("critiqued").alias("status"), (i % 4).cast("int").alias("n_violations"))
    return critique.image_cells(runs)


@query(f"select model, r as raw_mean, c as compiled_mean, r - c as delta, case when r > 0 then (r - c) / r * 100 else 0 end as reduction_pct, nr = 0 or nc = 0 as is_inconclusive from (select model, coalesce(max(mean_tells) filter (condition = 'raw'), 0) as r, coalesce(max(mean_tells) filter (condition = 'compiled'), 0) as c, coalesce(max(critiqued) filter (condition = 'raw'), 0) as nr, coalesce(max(critiqued) filter (condition = 'compiled'), 0) as nc from ({_IMAGE_CELLS}) group by model)")
def image_deltas(spark, sf_dir):
    return critique.image_deltas(image_cells(spark, sf_dir))


@query("select url from pages order by url limit 20")
def critique_limit(spark, sf_dir):
    return critique.limited(table(spark, sf_dir, "pages").select("url"), 20, "url")


@query("select page_id as sample_id, unnest(case page_id % 3 when 0 then ['a', 'b'] when 1 then ['c'] else ['d'] end) as rule_id from pages")
def mock_verdicts(spark, sf_dir):
    i = F.col("page_id")
    asked = table(spark, sf_dir, "pages").select(i.alias("sample_id"), F.when(i % 3 == 0, "u").alias("url"), F.when(i % 3 == 1, "c").alias("context"))
    return critique.mock_verdicts(asked, spark.createDataFrame([("u", ["a", "b"]), ("c", ["c"]), ("default", ["d"])], "key string, fired array<string>"))


# Adapters.

_WRAPS = ["```html\n%s\n```", "<think>a <div> b</think>Sure:\n%s", "%s", "only prose", "<html><body>x</body></html> tail", "<reasoning>x</reasoning><section>loose</section> "]


def _wrapped(spark, sf_dir) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, _WRAPS)), (F.col("page_id") % len(_WRAPS) + 1).cast("int"))
    return corpus(spark, sf_dir).select("page_id", F.replace(shape, F.lit("%s"), F.col("html")).alias("response_text"))


_WRAPPED_SQL = f"(select page_id, replace(([{', '.join(DUCK.text(w) for w in _WRAPS)}])[page_id % {len(_WRAPS)} + 1], '%s', html) as response_text from {CORPUS_SQL})"


@query(f"select page_id, {adapters.html_of(DUCK, 'c')} as html from (select page_id, {adapters.without_reasoning(DUCK, 'response_text')} as c from {_WRAPPED_SQL})")
def extract_html(spark, sf_dir):
    cleaned = _wrapped(spark, sf_dir).select("page_id", F.expr(adapters.without_reasoning(SPARK, "response_text")).alias("c"))
    return cleaned.select("page_id", F.expr(adapters.html_of(SPARK, "c")).alias("html"))


@query("select model, array_to_string(list_sort(list(id)), ',') as ids from (select 'm' || event_id % 5 as model, case when event_id % 4 = 0 then 'r' || event_id when event_id % 4 = 1 then 'x' || event_id when event_id % 4 = 2 then 'c' || event_id end as id from events) where id is not null group by model")
def request_ids(spark, sf_dir):
    i = F.col("event_id")
    text = i.cast("string")
    headers = F.create_map(F.lit("request-id"), F.when(i % 4 == 0, F.concat(F.lit("r"), text)).otherwise(""), F.lit("x-request-id"), F.when(i % 4 <= 1, F.concat(F.lit("x"), text)).otherwise(""), F.lit("cf-ray"), F.when(i % 4 == 2, F.concat(F.lit("c"), text)))
    ids = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), (i % 5).cast("string")).alias("model"), headers.alias("headers")).select("model", F.expr(adapters.request_id(SPARK, "headers")).alias("id"))
    return ids.where("id is not null").groupBy("model").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


_SPECS = ["mock-slop", "mock-swiss", "mock-other", "claude-code:x", "claude-x", "codex-cli:gpt", "gemini-cli:g", "gemini-pro", "gpt-5", "o1-mini", "o0", "ollama:llama", "hf:a/b", "cf:@cf/x", "other", "@cf/moonshotai/kimi-k2.6"]
_SPECS_SQL = "(select unnest([" + ", ".join(f"'{s}'" for s in _SPECS) + "]) as spec)"


@query(f"select spec, {adapters.provider(DUCK, 'spec')} as provider, {adapters.sanitized(DUCK, 'spec')} as sanitized, {adapters.body_knobs(DUCK, 'spec')} as knobs from {_SPECS_SQL}")
def runner_dispatch(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in _SPECS], "spec string").select("spec", F.expr(adapters.provider(SPARK, "spec")).alias("provider"), F.expr(adapters.sanitized(SPARK, "spec")).alias("sanitized"), F.expr(adapters.body_knobs(SPARK, "spec")).alias("knobs"))


@query(f"select page_id, {adapters.sanitized(DUCK, 'url')} as sanitized from pages")
def sanitize_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(adapters.sanitized(SPARK, "url")).alias("sanitized"))


_ADDRESSES = ["http://127.0.0.1/", "https://10.2.3.4:80/x", "http://172.16.0.1", "http://172.32.0.1", "http://192.168.1.1/?q", "http://169.254.169.254/latest", "http://100.64.0.1", "http://8.8.8.8/", "http://[::1]/", "http://[fe80::1]/", "http://[fd00::1]:8080/", "http://[2001:4860::8888]/", "http://[::ffff:7f00:1]", "http://localhost:3000", "https://printer.local", "https://10.0.0.1.nip.io", "https://a.cluster.local/", "ftp://example.org", "https://user:pw@example.org", "https://example.org/a@b", "nonsense", "http:///x", "http://224.0.0.1", "http://255.255.255.255"]
_ADDRESSES_SQL = "(select unnest([" + ", ".join(f"'{a}'" for a in _ADDRESSES) + "]) as url union all select url from pages)"


@query(f"select url, {adapters.blocked_reason(DUCK, 'url')} as reason from {_ADDRESSES_SQL}")
def private_url(spark, sf_dir):
    return spark.createDataFrame([(a,) for a in _ADDRESSES], "url string").unionByName(table(spark, sf_dir, "pages").select("url")).select("url", F.expr(adapters.blocked_reason(SPARK, "url")).alias("reason"))


_GATEWAYS = ["acc/gate", "acc/gate/x", "https://gateway.ai.cloudflare.com/v1/a/b//", "http://gateway.ai.cloudflare.com/v1", "https://evil.example/v1", "", "https://huggingface.co/api", "https://x.endpoints.huggingface.cloud/", "https://huggingface.co.evil.example"]
_GATEWAYS_SQL = "(select unnest([" + ", ".join(f"'{a}'" for a in _GATEWAYS) + "]) as raw)"


@query(f"select raw, {adapters.gateway_base(DUCK, 'raw')} as base, {adapters.hf_endpoint_ok(DUCK, 'raw')} as is_allowed from {_GATEWAYS_SQL}")
def gateway_hosts(spark, sf_dir):
    return spark.createDataFrame([(a,) for a in _GATEWAYS], "raw string").select("raw", F.expr(adapters.gateway_base(SPARK, "raw")).alias("base"), F.expr(adapters.hf_endpoint_ok(SPARK, "raw")).alias("is_allowed"))


_EVENTS = ['{"item":{"text":"first %s","type":"agent_message"},"type":"item.completed"}', '{"event":"agent_message","content":"second %s"}', "warning %s", '{"type":"agent_message","text":""}', '{"type":"tool","text":"no %s"}', "{broken %s"]


@query("select page_id, case page_id % 3 when 0 then 'second ' || page_id when 1 then 'first ' || page_id else 'warning ' || page_id || chr(10) || '{broken ' || page_id end as message from pages")
def agent_messages(spark, sf_dir):
    e = [F.replace(F.lit(x), F.lit("%s"), F.col("page_id").cast("string")) for x in _EVENTS]
    lines = F.when(F.col("page_id") % 3 == 0, F.concat_ws("\n", e[0], e[1], e[2], e[3])).when(F.col("page_id") % 3 == 1, F.concat_ws("\n", e[0], e[4], e[5])).otherwise(F.concat_ws("\n", e[2], e[5]))
    return reports.last_message(table(spark, sf_dir, "pages").select("page_id", lines.alias("stdout"))).select("page_id", "message")


# Reports, records and the catalogue.

_REPORT = "# lab eval · style-%s · 2026-01-0%sT00:00:00Z\n\n- Brief: `briefs/%s.yml`\n- Samples per cell: **%s**\n- Models:\n  - `m1` (vendor) · spec `v:m1`\n  - `m2` (other) · spec `o:m2`\n"
_CRITIQUE = "# lab critique · style-%s · 2026-01-0%sT00:00:00Z\n\ncritic: `c%s`\n\n| tell | raw (n=%s) | compiled (n=2) |\n"


def _reports(spark, sf_dir) -> DataFrame:
    digit = (F.col("page_id") % 9 + 1).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", F.replace(F.when(F.col("page_id") % 2 == 0, F.lit(_REPORT)).otherwise(F.lit(_CRITIQUE)), F.lit("%s"), digit).alias("content"))


@query("""select page_id, case when page_id % 2 = 0 then 'eval-live' else 'critique' end as kind, 'style-' || d as style, '2026-01-0' || d || 'T00:00:00Z' as run_at, case when page_id % 2 = 0 then 'briefs/' || d || '.yml' end as brief,
cast(case when page_id % 2 = 0 then d else d + 2 end as int) as n, case when page_id % 2 = 0 then 'v:m1/vendor,o:m2/other' else 'c' || d || '/critic' end as models from (select page_id, page_id % 9 + 1 as d from pages)""")
def report_headers(spark, sf_dir):
    found = reports.headers(_reports(spark, sf_dir))
    return found.select("page_id", "kind", "style", "run_at", "brief", "n", F.array_join(F.transform("models", lambda m: F.concat_ws("/", m["id"], m["provider"])), ",").alias("models"))


@query("select 'r/' || page_id || '.md' as path from pages where page_id % 3 <> 0")
def reports_without_record(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("r/"), F.col("page_id").cast("string")).alias("p"))
    return reports.without_record(pages.select(F.concat("p", F.lit(".md")).alias("path")), pages.select(F.concat(F.when(F.col("page_id") % 3 == 0, F.col("p")).otherwise(F.concat(F.lit("other/"), "p")), F.lit(".replay.json")).alias("path")))


@query("""select page_id % 10 as run, bool_and(case page_id % 5 when 0 then true when 1 then true when 2 then false when 3 then false else true end) as ok from pages group by 1""")
def verify_verdict(spark, sf_dir):
    i = F.col("page_id")
    path = F.concat(F.lit("f/"), i.cast("string"))
    content = F.concat(F.lit("b: "), i.cast("string"), F.lit("\na: [1, 2.0]\n"))
    # every fifth file is elsewhere
    files = table(spark, sf_dir, "pages").select(F.when(i % 5 == 2, F.concat(F.lit("elsewhere/"), path)).otherwise(path).alias("path"), content.alias("content"))
    canonical = F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit('{"a":[1,2],"b":'), i.cast("string"), F.lit("}")), 256))
    plain = F.concat(F.lit("sha256:"), F.sha2(content, 256))
    # a style by canonical hash; a brief by bytes; no file; another hash; a brief by canonical hash
    records = table(spark, sf_dir, "pages").select((i % 10).alias("run"), F.when(i % 5 == 0, "token").otherwise("brief").alias("field"), path.alias("path"), F.when(i % 5 == 1, plain).when(i % 5 == 3, "sha256:0").otherwise(canonical).alias("hash"))
    return audit.verdict(audit.verify(records, audit.hashed(files)))


@query(f"select coalesce(engine, 'all') as engine, count(*) as total, count(*) filter (status = 'stable') as stable, count(*) filter (status = 'experimental') as experimental, count(*) filter (status = 'deprecated') as deprecated from {_RULES} group by rollup (engine)")
def catalogue_counts(spark, sf_dir):
    return catalogue.counts(catalogue.rules_table(spark))


@query(f"select rule_id, engine, printf('%02d:%s', list_position([{', '.join(f'{chr(39)}{e}{chr(39)}' for e in catalogue.ENGINES)}], engine), rule_id) as rank from {_RULES}")
def catalogue_order(spark, sf_dir):
    return catalogue.ranked(catalogue.rules_table(spark)).select("rule_id", "engine", "rank")


@query(f"select rule_id, case when status <> 'stable' or severity = 'info' then 'off' else severity end as level from {_RULES} where engine = 'source'")
def recommended_config(spark, sf_dir):
    return catalogue.recommended(catalogue.rules_table(spark))


@query(f"select rule_id, severity from {_RULES} where rule_id in ({', '.join(f'{chr(39)}{r}{chr(39)}' for r in catalogue.CSS_RULES)})")
def css_rule_subset(spark, sf_dir):
    css = spark.createDataFrame([(r,) for r in catalogue.CSS_RULES], "rule_id string")
    return catalogue.rules_table(spark).join(F.broadcast(css), "rule_id", "left_semi").select("rule_id", "severity")


_SPEC = [("no-slop-copy", "warn"), ("a11y/heading-skip", "error"), ("only-in-spec", "warn")]
_SPEC_SQL = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _SPEC) + ") as s(rule_id, severity)"


@query(f"select coalesce(s.rule_id, r.rule_id) as rule_id, case when r.rule_id is null then 'not in the catalogue' when s.rule_id is null then 'not in the document' else 'severity' end as problem from {_SPEC_SQL} full outer join {_RULES} on s.rule_id = r.rule_id where s.rule_id is null or r.rule_id is null or s.severity <> r.severity")
def document_parity(spark, sf_dir):
    return catalogue.parity(spark.createDataFrame(_SPEC, "rule_id string, severity string"), catalogue.rules_table(spark))


# Layout: an order is a page, a line item an element of it.


def elements(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("page"),
        n.alias("node_id"),
        F.when(n > 1, F.lit(1)).alias("parent_id"),
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))).alias("ancestor_ids"),
        F.when(F.col("l_partkey") % 3 == 0, "p").when(F.col("l_partkey") % 3 == 1, "a").otherwise("button").alias("tag"),
        F.when(F.col("l_suppkey") % 4 == 0, "caption").otherwise("x").alias("class"),
        F.repeat(F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string"), F.lit(" ")), (F.col("l_partkey") % 40).cast("int")).alias("text"),
        (F.col("l_suppkey") % 2 == 0).alias("is_target"),
        F.col("l_quantity").alias("height"),
        F.col("l_quantity").alias("width"),
        (F.col("l_quantity") % 12 + 8).alias("font_px"),
        (F.col("l_partkey") % 5).cast("double").alias("x"),
        n.cast("double").alias("y"),
        (F.col("l_quantity") * 10).alias("right"),
        F.when(F.col("l_suppkey") % 50 == 0, "auto").otherwise("visible").alias("overflow_x"),
        (F.col("l_quantity") * 10).alias("scroll_w"),
        F.lit(100.0).alias("client_w"),
        (F.col("l_partkey") % 2 == 0).alias("has_cue"),
    )


_ELEMENTS = "(select l_orderkey as page, l_linenumber as node_id, case l_partkey % 3 when 0 then 'p' when 1 then 'a' else 'button' end as tag, case when l_suppkey % 4 = 0 then 'caption' else 'x' end as class, repeat('t' || l_suppkey % 3 || ' ', l_partkey % 40) as text, l_suppkey % 2 = 0 as is_target, l_quantity as height, l_quantity % 12 + 8 as font_px, (l_partkey % 5)::double as x, l_quantity * 10 as \"right\", l_suppkey % 50 = 0 as scrolls, l_partkey % 2 = 0 as has_cue from lineitem)"


@query(f"select page, node_id, tag, text from (select *, row_number() over (partition by page order by node_id) as k from (select page, node_id, tag, trim(left(text, 40)) as text, row_number() over (partition by page, tag, trim(left(text, 40)) order by node_id) as d from {_ELEMENTS} where is_target and height >= 2 and height < 32 and trim(left(text, 40)) <> '') where d = 1) where k <= 8")
def layout_tap_targets(spark, sf_dir):
    return layout.tap_targets(elements(spark, sf_dir))


@query(f"select page, node_id, font_px from (select *, row_number() over (partition by page order by node_id) as k from {_ELEMENTS} where tag = 'p' and class <> 'caption' and length(trim(text)) >= 80) where k <= 5 and font_px < 14")
def layout_body_font(spark, sf_dir):
    return layout.body_font(elements(spark, sf_dir))


@query(f"select page, node_id from (select *, row_number() over (partition by page order by node_id) as k from (select *, row_number() over (partition by page, tag, class order by node_id) as d from {_ELEMENTS} where scrolls and \"right\" > 104 and not has_cue) where d = 1) where k <= 6")
def layout_hidden_scroll(spark, sf_dir):
    return layout.hidden_scroll(elements(spark, sf_dir))


@query(f"select page, 1 as node_id, max(spread) as spread from (select page, tag, count(*) as c, count(distinct node_id) as n_rows, max(x) - min(x) as spread from {_ELEMENTS} where node_id > 1 group by all) where c >= 2 and n_rows = c and spread > 2 group by page")
def layout_list_marks(spark, sf_dir):
    return layout.list_marks(elements(spark, sf_dir))


_WIDE = f"(select e.* from {_ELEMENTS} e where \"right\" > 376 and height >= 1 and not exists (select 1 from {_ELEMENTS} s where s.page = e.page and s.scrolls and (s.node_id < e.node_id or e.node_id = 1 and s.node_id = 1)))"


@query(f"""with recursive wide as materialized {_WIDE}, chain(page, node_id, run) as (
  select page, node_id, 0 from wide union all select c.page, c.node_id, c.run + 1 from chain c join wide w on w.page = c.page and w.node_id = c.node_id - c.run - 1
), runs as (select page, node_id, max(run) as run from chain group by all)
select page, node_id from (select *, row_number() over (partition by page order by node_id) as k from runs r where (case when node_id = 1 then 1 else run end) % 2 = 0) where k <= 6""")
def layout_overflow(spark, sf_dir):
    # the elements of a page are a chain, each within the one before it; the first stands for its own ancestor
    return layout.overflow(elements(spark, sf_dir))


@query(f"select page_id from {CORPUS_SQL} where not (regexp_matches(html, '(?i)<meta[^>]*name=.?viewport') and regexp_matches(html, '(?i)width\\s*=\\s*device-width'))")
def layout_no_viewport(spark, sf_dir):
    return layout.no_viewport(corpus(spark, sf_dir)).select("page_id")
