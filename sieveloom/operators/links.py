"""Internal links whose target no page of the corpus serves: an anti-join on paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.dialect import SPARK, Dialect

ASSETS = ("/_app/", "/_astro/", "/_next/", "/assets/", "/static/")
_FILES = r"\.(?:avif|css|eot|gif|gz|ico|jpe?g|js|json|map|mjs|mp3|mp4|ogg|otf|pdf|png|svg|ttf|txt|wav|webm|webmanifest|webp|woff2?|xml|zip)$"
_HREF = r"\bhref\s*=\s*(?:\x22[^\x22]+\x22|\x27[^\x27]+\x27)"


def hrefs(d: Dialect, html: str) -> str:
    """Array of (line, text) of link attributes."""
    return d.matches(html, _HREF)


def raw_target(d: Dialect, attribute: str) -> str:
    return d.sub(d.sub(attribute, r"^href\s*=\s*[\x22\x27]", ""), r"[\x22\x27]$", "")


def is_internal(d: Dialect, raw: str) -> str:
    starts = " or ".join(f"starts_with({raw}, {d.text(p)})" if d is not SPARK else f"startswith({raw}, {d.text(p)})" for p in ASSETS)
    begins = f"startswith({raw}, '/')" if d is SPARK else f"starts_with({raw}, '/')"
    return f"({begins} and not ({starts}) and not {d.has(d.sub(raw, r'[?#][\s\S]*$', ''), _FILES)})"


def target(d: Dialect, raw: str) -> str:
    """Without fragment, query and one closing slash."""
    bare = d.sub(raw, r"[?#][\s\S]*$", "")
    return f"case when {bare} = '/' then '/' else {d.sub(bare, '/$', '')} end"


def known_paths(files: DataFrame, file: str = "file", site: str | None = None) -> DataFrame:
    """The paths under which the HTML files can be asked for, four for each."""
    path = F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), "^(?!/)", "/")
    without = F.regexp_replace("path", r"/index\.html$", "")
    keys = [site] if site else []
    paths = files.where(F.endswith(file, F.lit(".html"))).select(*keys, path.alias("path")).withColumn("without", F.when(without == "", "/").otherwise(without))
    every = F.array("path", "without", F.when((F.col("without") != "/") & ~F.endswith("without", F.lit("/")), F.concat("without", F.lit("/"))), F.regexp_replace("path", r"\.html$", ""))
    return paths.select(*keys, F.explode(every).alias("path")).where("path is not null").distinct()


def internal_links(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, href, target) of the links within the site."""
    rows = corpus.select(*keys, F.inline(F.expr(hrefs(SPARK, "coalesce(html, '')")))).withColumn("href", F.expr(raw_target(SPARK, "text")))
    return rows.where(F.expr(is_internal(SPARK, "href"))).select(*keys, "line", "href", F.expr(target(SPARK, "href")).alias("target"))


def broken_links(corpus: DataFrame, keys: list[str], file: str = "file", site: str | None = None) -> DataFrame:
    """(keys, line, href) of internal links to nowhere. ``site`` names a column that keeps sites apart.

    A path serves itself and what is left of it without a closing slash, ``.html`` or ``/index.html``; what is so served is one table, and the links,
    read from the pages once, lose those whose target is in it.
    """
    apart = [site] if site else []
    links = internal_links(corpus, list(dict.fromkeys([*keys, *apart])))
    less = [F.when(F.endswith("path", F.lit(end)), F.expr(f"left(path, length(path) - {len(end)})")) for end in ("/", ".html", "/index.html")]
    served = known_paths(corpus, file, site).select(*apart, F.explode(F.array("path", *less)).alias("target")).distinct()
    return links.join(served, [*apart, "target"], "left_anti").select(*keys, "line", "href")
