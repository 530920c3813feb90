"""Rules on a page's layout, over a table of laid-out elements (a browser makes it; here it is an input).

Elements are in document order by ``node_id``; limits are part of the rules. Where a ``node_id`` repeats
within a page, a limit takes its rows by what is returned of them, the least first.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, SLACK = 375, 1
_SKIP = ("head", "link", "meta", "script", "style", "title")
_LABELS = r"(?i)\b(byline|caption|eyebrow|footnote|kicker|label|meta|micro|muted|small)\b"


def _first(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """The first ``n`` rows of each page. ``ties`` are what else is returned: rows of one ``node_id`` then come in the same order, however they are stored."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("page").orderBy("node_id", *ties))).where(F.col("__n") <= n).drop("__n")


def squeezed(text):
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def overflow(elements: DataFrame, n: int = 6) -> DataFrame:
    """(page, node_id): the first ``n`` elements beyond the right edge, unless an ancestor scrolls or the parent is one already.

    Whether a parent counts depends on its own parent, all the way up; but a child is only passed over for a parent that is itself reported. Along a
    chain of elements that are too wide every second one is: so the parity of the unbroken run of them above decides, which is found from the list of ancestors.
    """
    wide = elements.where((F.col("width") >= 1) & (F.col("height") >= 1) & (F.col("right") > WIDTH + SLACK) & ~F.col("tag").isin(*_SKIP))
    scrolling = elements.where(F.col("overflow_x").isin("auto", "scroll")).groupBy("page").agg(F.collect_set("node_id").alias("scrolling"))
    wide = wide.join(scrolling, "page", "left").where(~F.coalesce(F.arrays_overlap("ancestor_ids", "scrolling"), F.lit(False)))
    wide = wide.select("page", "node_id", "ancestor_ids").distinct()
    ids = wide.groupBy("page").agg(F.collect_set("node_id").alias("wide_ids"))
    # ancestors from the parent up; how many of them, without a gap, are too wide
    run = F.expr("aggregate(reverse(ancestor_ids), named_struct('n', 0, 'open', true), (a, x) -> if(a.open and array_contains(wide_ids, x), named_struct('n', a.n + 1, 'open', true), named_struct('n', a.n, 'open', false)), a -> a.n)")
    return _first(wide.join(ids, "page").where(run % 2 == 0), n).select("page", "node_id")


def tap_targets(elements: DataFrame, n: int = 8, least: float = 32) -> DataFrame:
    """(page, node_id, tag, text): the first ``n`` low targets, one for each tag and text."""
    shown = squeezed(F.substring("text", 1, 40))
    low = elements.where(F.col("is_target") & (F.col("width") >= 2) & (F.col("height") >= 2) & (F.col("height") < least)).withColumn("text", shown).where("text <> ''")
    first = low.withColumn("__k", F.row_number().over(Window.partitionBy("page", "tag", "text").orderBy("node_id"))).where("__k = 1").drop("__k")
    return _first(first, n, "tag", "text").select("page", "node_id", "tag", "text")


def body_font(elements: DataFrame, n: int = 5, least: float = 14) -> DataFrame:
    """(page, node_id, font_px): of the first ``n`` long paragraphs, those in small type. The limit comes before the test."""
    text = elements.where((F.col("tag") == "p") & ~F.coalesce(F.col("class"), F.lit("")).rlike(_LABELS) & (F.length(F.trim("text")) >= 80))
    return _first(text, n, "font_px").where(F.col("font_px") < least).select("page", "node_id", "font_px")


def hidden_scroll(elements: DataFrame, n: int = 6) -> DataFrame:
    """(page, node_id): the first ``n`` areas that scroll without any sign of it, one for each tag and class."""
    area = elements.where(F.col("overflow_x").isin("auto", "scroll") & (F.col("scroll_w") > F.col("client_w") + 4) & ~F.coalesce("has_cue", F.lit(False)))
    first = area.withColumn("__k", F.row_number().over(Window.partitionBy("page", "tag", F.coalesce("class", F.lit(""))).orderBy("node_id"))).where("__k = 1").drop("__k")
    return _first(first, n).select("page", "node_id")


def list_marks(elements: DataFrame, n: int = 6, most: float = 2) -> DataFrame:
    """(page, node_id, spread): the first ``n`` parents whose stacked children of one tag don't line up; ``node_id`` is the parent's."""
    groups = elements.where("parent_id is not null").groupBy("page", "parent_id", "tag").agg(F.count("*").alias("c"), (F.max("x") - F.min("x")).alias("spread"), F.countDistinct("y").alias("rows"))
    bad = groups.where((F.col("c") >= 2) & (F.col("rows") == F.col("c")) & (F.col("spread") > most)).groupBy("page", F.col("parent_id").alias("node_id")).agg(F.max("spread").alias("spread"))
    return _first(bad, n).select("page", "node_id", "spread")


def audit(elements: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(page, rule_id, severity, node_id, message): the findings of all layout rules as one table. ``corpus`` (page, html) adds the rule on the source.

    A rule that can't be planned gives one finding, an error without a page, that says so; the others go on.
    """
    from sieveloom.operators.catalogue import MOBILE_RULES

    spark = elements.sparkSession
    rules = {"mobile/no-horizontal-overflow": lambda: overflow(elements), "mobile/tap-target-size": lambda: tap_targets(elements), "mobile/body-font-size": lambda: body_font(elements), "mobile/scrollable-no-affordance": lambda: hidden_scroll(elements), "mobile/list-mark-alignment": lambda: list_marks(elements)}
    if corpus is not None:
        rules["mobile/viewport-meta-present"] = lambda: no_viewport(corpus).select("page", F.lit(None).alias("node_id"))
    parts = []
    for rule_id, severity, _, description in MOBILE_RULES:
        if rule_id in rules:
            try:
                found = rules[rule_id]().select("page", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.col("node_id").cast("bigint").alias("node_id"), F.lit(description).alias("message"))
            except Exception as e:
                found = spark.createDataFrame([(rule_id, "error", f"rule threw: {str(e).splitlines()[0][:200]}")], "rule_id string, severity string, message string").select(F.lit(None).cast(elements.schema["page"].dataType).alias("page"), "rule_id", "severity", F.lit(None).cast("bigint").alias("node_id"), "message")
            parts.append(found)
    return functools.reduce(DataFrame.unionByName, parts)


def no_viewport(corpus: DataFrame) -> DataFrame:
    """``corpus`` less the pages whose source has a viewport of the device's width: as far as source can tell."""
    meta = r"(?i)<meta(?=[^>]*\bname\s*=\s*[\"']?viewport)(?=[^>]*width\s*=\s*device-width)[^>]*>"
    return corpus.where(~F.coalesce("html", F.lit("")).rlike(meta))
