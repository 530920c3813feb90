"""URL filters: host words by unigram Viterbi, scored by multinomial naive Bayes.

A URL's names are the letter runs of its host and of its path and query (ASCII,
capitals made small); a run of digits is the name ``0``. Names are split into
words by the most probable segmentation under a unigram model:

- a word's count is the number of its uses in the text of all pages (markup,
  scripts and styles left out) and among the hyphenated parts of all hosts;
- a known word has the probability count / total; an unknown piece of n letters
  has 1 / (total * 10^(n - 1)) (after Norvig, 2009), so it is split only where
  words are found. Of equal segmentations, the one whose last word is longest
  goes first.

Only the substrings of names are looked up among the counted words, by a join:
neither the words nor the names are ever broadcast or collected. Substrings of up to
``PREFIX`` letters are looked up whole, the longer words by their first ``PREFIX``
letters, so words of any length are found without a name's square of substrings.

The classifier is trained on weak labels: a URL whose host has one of ``SEEDS``
as a delimited part is unwanted, all others count as wanted. (A table of labels
(url, unwanted) can be given instead.) Tokens are words, those of the host apart from those of
the path; each use counts. As a name's words are the same wherever it stands, a
name has one score, and a URL's score is the sum over its names plus the prior's log odds.

Null URLs, and URLs without host, have null scores and aren't unwanted; so has
every URL where the labels have one class only. Null pages have no text. Rows
without ``page_id`` are left out of the result but count for the model; rows that repeat a
``page_id`` have a row for each distinct URL. Names of any length are split
whole, into words of any length. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.llm.common import stash, table
from sieveloom.llm.textarrays import TERMS, tokenize

PREFIX = 24
ALPHA = 1.0
SEEDS = ("adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cheap", "cialis", "clickbait", "crack", "dating", "escort", "farm", "gambling", "hentai", "keygen", "loan", "loans", "lottery", "malware", "nude", "payday", "pharma", "phish", "pills", "poker", "porn", "replica", "seo", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx")
_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


def words_of(column: pa.Array) -> Iterator[pa.RecordBatch]:
    """(word, n) of the terms of letters a to z only, counted within groups of texts."""
    for t in tokenize(column, TERMS):
        if not len(t.hash):
            continue
        plain = np.concatenate([[0], np.cumsum((t.data < 97) | (t.data > 122))])
        ok = np.flatnonzero(plain[t.end] == plain[t.start])
        _, at, n = np.unique(t.hash[ok], return_index=True, return_counts=True)
        start, size = t.start[ok[at]], (t.end - t.start)[ok[at]]
        stop = np.cumsum(size)
        body = t.data[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size - start, size)]
        offsets = np.concatenate([[0], stop]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())), pa.array(n.astype(np.int64))], ["word", "n"])


def _host(url):
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, names array of (zone, name)) of the rows with a URL that has a host."""
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").withColumn("host", _host(F.col("url"))).where("host <> ''")
    path = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?[^/?#]*(.*)$", 1))
    runs = lambda c, zone: F.transform(F.regexp_extract_all(c, F.lit("([a-z]+|[0-9]+)"), F.lit(1)), lambda x: F.struct(F.lit(zone).alias("zone"), F.when(x.rlike("^[0-9]"), "0").otherwise(x).alias("name")))
    return urls.withColumn("names", F.concat(runs(F.col("host"), "h"), runs(path, "p")))


def word_counts(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(word, n) over the texts of all pages and the hyphenated parts of all hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from words_of(b.column(0))

    texts = pages.select(F.regexp_replace("html", _MARKUP, " ").alias("text")).mapInArrow(run, "word string, n bigint")
    labels = urls.select(F.explode(F.split("host", r"\.")).alias("label")).where("contains(label, '-')")
    parts = labels.select(F.explode(F.regexp_extract_all("label", F.lit("([a-z]+)"), F.lit(1))).alias("word"), F.lit(1).cast("bigint").alias("n"))
    return texts.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The words of a name; ties go to the longest last word."""
    logs, ten = math.log(max(total, 1)), math.log(10)
    of_size: dict[int, dict[str, float]] = {}
    for word, n in counts.items():
        of_size.setdefault(len(word), {})[word] = math.log(n) - logs
    sizes = sorted(of_size, reverse=True)
    best, back = [0.0], [0]
    # the best begin of an unknown piece that ends here: every letter more costs the same, so it only changes for a better one
    unknown, begin = -math.inf, 0
    for j in range(1, len(name) + 1):
        unknown -= ten
        if best[j - 1] - logs > unknown + 1e-9:
            unknown, begin = best[j - 1] - logs, j - 1
        top, at = unknown, begin
        for size in sizes:
            if size <= j:
                p = of_size[size].get(name[j - size : j])
                if p is not None:
                    p += best[j - size]
                    if p > top + 1e-9 or p > top - 1e-9 and j - size < at:
                        top, at = max(p, top), j - size
        best.append(top)
        back.append(at)
    out, j = [], len(name)
    while j:
        out.append(name[back[j] : j])
        j = back[j]
    return out[::-1]


_ROWS = 1 << 16


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of a table of distinct names."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(left, words):
            return pa.RecordBatch.from_pydict({"name": pa.array(left, pa.string()), "word": pa.array(words, pa.string())})

        for b in batches:
            left, words = [], []
            for name in b.column(0).to_pylist():
                found = sorted({name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + PREFIX) + 1)})
                left += [name] * len(found)
                words += found
                if len(left) >= _ROWS:
                    yield made(left, words)
                    left, words = [], []
            yield made(left, words)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pydict({"name": b.column(0), "words": pa.array([segment(name, {k["word"]: k["n"] for k in known if k["word"] is not None}, total) for name, known in rows], pa.list_(pa.string()))})

    short = names.mapInArrow(pieces, "name string, word string").join(counts.where(F.length("word") <= PREFIX), "word", "left").select("name", "word", "n")
    starts = names.where(F.length("name") > PREFIX).select("name", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(name) - {PREFIX}), i -> substring(name, i, {PREFIX}))"))).alias("start"))
    words = counts.where(F.length("word") > PREFIX).withColumn("start", F.substring("word", 1, PREFIX))
    long = starts.join(words, "start").where(F.contains("name", "word")).select("name", "word", "n")
    known = short.unionByName(long).groupBy("name").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))
    return known.select("name", "known").mapInArrow(split, "name string, words array<string>")


def scored(pages: DataFrame, labels: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """(page_id, url, host_words, score, is_unwanted); ``score`` is the log odds of being unwanted, ``host_words`` the host's names in order, split."""
    urls = parsed(pages)
    if labels is None:
        delimited = F.split("host", "[.-]")
        marked = urls.withColumn("unwanted", F.arrays_overlap(delimited, F.array(*map(F.lit, SEEDS))).cast("int"))
    else:
        known = labels.select(F.col("url").alias("__url"), F.col("unwanted").cast("int").alias("unwanted")).where("__url is not null and unwanted in (0, 1)").groupBy("__url").agg(F.max("unwanted").alias("unwanted"))
        marked = urls.join(known, F.col("url") == F.col("__url"), "left").drop("__url")
    marked = stash(marked)
    uses = marked.select("unwanted", F.explode("names").alias("t")).select("t.zone", "t.name", "unwanted")
    names = stash(uses.groupBy("zone", "name").agg(F.sum("unwanted").alias("bad"), F.sum(F.lit(1) - F.col("unwanted")).alias("good")))
    counts = stash(word_counts(pages, marked))
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = stash(segmented(names.select("name").distinct(), counts, total))
    split = names.join(words, "name")
    # classes: how many URLs, how many uses of words; a few numbers whatever the data
    n_bad, n_good = marked.agg(F.coalesce(F.sum("unwanted"), F.lit(0)), F.coalesce(F.sum(F.lit(1) - F.col("unwanted")), F.lit(0))).first()
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").where("page_id is not null").distinct()
    if not n_bad or not n_good:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("host_words"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_unwanted"))
    tokens = split.select("zone", F.explode("words").alias("word"), "bad", "good").groupBy("zone", "word").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tokens = stash(tokens)
    size, bad, good = tokens.agg(F.count("*"), F.sum("bad"), F.sum("good")).first()
    ratio = F.log((F.col("bad") + alpha) / (bad + alpha * size)) - F.log((F.col("good") + alpha) / (good + alpha * size))
    weights = tokens.select("zone", "word", ratio.alias("w"))
    by_name = split.select("zone", "name", "words", F.explode("words").alias("word")).join(weights, ["zone", "word"]).groupBy("zone", "name", "words").agg(F.sum("w").alias("w"))
    used = marked.where("page_id is not null").select("page_id", "url", "names").dropDuplicates(["page_id", "url"]).select("page_id", "url", F.posexplode("names").alias("pos", "t")).select("page_id", "url", "pos", "t.zone", "t.name")
    host_words = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == "h", F.struct("pos", "words")))), lambda x: x["words"])), " ")
    sums = used.join(by_name, ["zone", "name"]).groupBy("page_id", "url").agg(host_words.alias("host_words"), (F.sum("w") + F.lit(math.log(n_bad / n_good))).alias("score"))
    return pages.join(sums, ["page_id", "url"], "left").select("page_id", "url", "host_words", F.round("score", 6).alias("score"), F.coalesce(F.col("score") > 0, F.lit(False)).alias("is_unwanted"))


def query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "pages"))
