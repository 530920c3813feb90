"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveloom.llm import chat, common, decontaminate, digests, licenses, maxent, mixing, simhash, substrings, toxicity, urls

CLASH = ("id", "key", "code", "n", "h", "pos", "tile", "a", "b", "u", "v", "m", "w", "score", "toxic", "toxicity", "item", "item_id", "term", "source_", "size", "epochs", "weight", "node", "root", "group_id", "start", "first", "digest", "spans", "words", "host", "said", "context")
WORDS = [f"w{k}" for k in range(400)]
SENTENCE = " ".join(WORDS[:80])


def rows():
    long = " ".join(f"x{k}" for k in range(60_000))
    return [
        (1, SENTENCE, "en", "s", 1),
        (2, SENTENCE, "en", "s", None),
        (2, SENTENCE, "en", "s", None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (5, " \n\t ", None, "t", 3),
        (None, SENTENCE, "en", "s", 1),
        (None, None, None, None, None),
        (6, long, "en", "s", 1),
        (7, long + " end", "en", None, 1),
        (8, " ".join(WORDS[100:300]) + " " + SENTENCE, "en", "t", 1),
        (9, "same same " * 200, "en", "t", 1),
        (10, "\U0001f680 né " * 30, "fr", "t", 1),
        (11, "you idiot clown moron " * 5, "en", "t", 1),
        (12, "an idiot and a clown", "en", "t", 1),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(11, 0, 1), (12, 0, 1), (1, 1, 0), (8, 1, 0), (9, None, 0), (None, 0, 1), (5, 0, None), (1, 1, 0), (77, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[120:150])), (2, None), (3, ""), (None, "x y z"), (1, " ".join(WORDS[120:150])), (4, "q q q")], "item_id bigint, text string")


def same(a, b):
    key = lambda df: sorted(map(repr, df.collect()))
    return key(a) == key(b)


@pytest.mark.parametrize("f", [licenses.detections, simhash.near_duplicates, digests.classes, substrings.duplicate_spans, maxent.perplexities], ids=lambda f: f.__name__)
def test_document_operators(docs, clashing, empty, f):
    assert same(f(docs), f(clashing))
    assert f(empty).count() == 0
    assert f(docs).where("doc_id is null").count() == 0


def test_simhash(docs):
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == [(1, 1, 0, True), (2, 1, 0, False), (6, 6, 1, True), (7, 6, 1, False)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 8, 9, 10, 11, 12)] + [(True, 0), (True, 0)]


def test_repeated_row_counts_once_in_dedup(spark):
    twice = spark.createDataFrame([(1, SENTENCE, 5), (1, SENTENCE, 5), (2, "other words here", 1), (2, "quite different text", 1)], "doc_id bigint, text string, x int")
    assert sorted(r[0] for r in simhash.deduplicate(twice).collect()) == [1, 2, 2]


def test_simhash_of_two_texts_under_one_id(spark):
    """Texts of one id are documents of their own: no group is joined through the id, and no text goes with another's."""
    other = " ".join(f"v{k}" for k in range(90))
    rows = [(1, SENTENCE), (2, SENTENCE), (2, other), (2, other), (3, other + " end"), (4, SENTENCE + " x"), (4, SENTENCE + " y"), (0, other + " end."), (0, "one more, alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "group_id", "is_kept").collect())
    assert found == [(0, 0, True), (1, 1, True), (2, 0, False), (2, 1, False), (3, 0, False), (4, 1, False), (4, 1, False)]
    assert sorted(map(tuple, simhash.deduplicate(docs).collect())) == [(0, "one more, alone"), (0, other + " end."), (1, SENTENCE)]
    alone = spark.createDataFrame([(2, other), (2, other), (2, SENTENCE), (1, SENTENCE)], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.deduplicate(alone).collect())) == [(1, SENTENCE), (2, other)]


def test_digests(docs):
    rows = digests.classes(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and found[1]["class_id"] == found[2]["class_id"] == 1
    assert found[6]["class_id"] == found[7]["class_id"] == 6
    for k in (3, 4, 5):
        assert found[k]["digest"] is None and found[k]["class_id"] is None and found[k]["nearest_class_id"] is None and found[k]["n_links"] == 0


def test_digest_of_two_texts_under_one_id(spark):
    """Two texts of one id are two classes; they may match each other, as their texts differ."""
    base = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    docs = spark.createDataFrame([(1, base), (1, base + " end"), (2, SENTENCE)], "doc_id bigint, text string")
    rows = [(r["doc_id"], r["class_id"], r["n_links"]) for r in digests.classes(docs).collect()]
    assert sorted(rows) == [(1, 1, 1), (1, 1, 1), (2, 2, 0)]


def test_substrings(docs):
    spans = {(r[0], r[1], r[2], r[3]) for r in substrings.duplicate_spans(docs).collect()}
    assert (2, 0, 80, 1) in spans and (8, 200, 280, 1) in spans and (9, 1, 400, 9) in spans or (9, 2, 400, 9) in spans
    assert (7, 0, 60000, 6) in spans and not any(s[0] in (1, 6) for s in spans)
    left = {r["doc_id"]: r for r in substrings.remove_duplicates(docs).where("doc_id is not null").collect()}
    assert 2 not in left and left[7]["text"] == "end" and left[7]["n_chars"] == 3 and left[8]["text"].split() == WORDS[100:300]
    assert left[1]["text"] == SENTENCE and left[3]["text"] is None and left[4]["text"] == ""


def test_substrings_of_two_texts_under_one_id(spark, tmp_path):
    """A position of one text isn't looked up in the other, and each text is cut by its own spans."""
    said = [f"y{k}" for k in range(300)]
    own = [f"z{k}" for k in range(120)]
    rows = [(1, " ".join(said)), (2, " ".join(own)), (2, " ".join([*own[:60], *said[100:300]])), (3, " ".join(said[120:200]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    assert sorted(map(tuple, substrings.duplicate_spans(docs).collect())) == sorted(con.sql(substrings.ORACLE).fetchall())
    left = sorted((r["doc_id"], r["text"].split()) for r in substrings.remove_duplicates(docs).collect())
    assert left == [(1, said), (2, own[:60]), (2, own)]


def test_toxicity(spark, docs, clashing, empty, labels):
    found = [r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()]
    assert sorted(found) == [11, 12]
    assert sorted(r["doc_id"] for r in toxicity.toxic_documents(clashing, labels).collect()) == [11, 12]
    kept = toxicity.keep_clean(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == docs.count() - 2
    none = labels.limit(0)
    assert toxicity.toxic_documents(docs, none).count() == 0 and toxicity.keep_clean(docs, none).count() == docs.count()
    assert toxicity.toxic_documents(empty, labels).count() == 0


def test_toxicity_sample_is_of_labels_with_documents(spark, docs):
    labels = spark.createDataFrame([*((k, 0, k % 2) for k in range(1000, 1200)), (11, 0, 1), (12, 0, 1), (1, 1, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert sorted((r["doc_id"], r["toxic"]) for r in toxicity.sample(docs, labels, max_rows=4).collect()) == [(1, 0), (8, 0), (11, 1), (12, 1)]


def test_decontamination(docs, clashing, empty, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(8, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(clashing, benchmark).collect()} == found
    kept = decontaminate.decontaminate(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == docs.count() - 1
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(empty, benchmark).count() == 0


def test_mixing(docs, clashing, empty):
    mixed = mixing.mix(clashing)
    assert mixed.columns == [*clashing.columns, "repetition"]
    assert same(mixing.mix(docs), mixed.select(*docs.columns, "repetition"))
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, {"t": 1.0, None: 1.0, "gone": 2.0, "s": 0.0}).select("source").distinct().count() == 2
    twice = mixed.where("doc_id = 2").groupBy("repetition").count().collect()
    assert all(r["count"] == 2 for r in twice)


def test_chat(spark):
    rows = [(1, 0, "system", "s", 1), (1, 1, "user", "<|end|> hi", 1), (1, 2, "assistant", "yo", 1), (1, 2, "assistant", "yo", 1), (1, 3, None, None, 1), (1, 4, "assistant", "", 1), (1, None, "assistant", "early", 1), (None, 0, "assistant", "x", 1), (2, 0, "assistant", "lone", 1), (3, 0, "user", "only", 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, said int")
    found = {(r["conv_id"], r["turn"], r["n_context"]): r for r in chat.examples(turns).collect()}
    assert set(found) == {(1, None, 0), (1, 2, 3), (1, 2, 4), (2, 0, 0)}
    r = found[1, 2, 3]
    text = r["prompt"] + r["target"]
    assert text[r["train_start"] : r["train_end"]] == "yo<|end|>\n" and "<​|end|> hi" in r["prompt"] and "early" in r["prompt"]
    assert chat.examples(turns.limit(0)).count() == 0


def test_chat_of_a_long_conversation(spark):
    """Every reply of a long conversation has all that was said before it, and clashing columns are out of the way."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"said {k}") for k in range(601)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", *(F.lit("x").alias(c) for c in ("said", "context", "prompt", "target", "n_context", "train_start")))
    found = {r["turn"]: r for r in chat.examples(turns).collect()}
    assert set(found) == set(range(1, 601, 2)) and all(r["n_context"] == k for k, r in found.items())
    last = found[599]
    assert [x for x in range(599) if f"said {x}<" not in last["prompt"]] == [] and last["target"].startswith("said 599<")
    assert last["train_start"] == len(last["prompt"]) and last["train_end"] == last["train_start"] + len(last["target"])


def test_mixing_ties(spark):
    """Sources of one size and weight get the same, in whatever order; a clamp that is met exactly is no clamp."""
    docs = spark.createDataFrame([(k, "x" * 10, f"s{k % 4}") for k in range(80)], "doc_id bigint, text string, source string")
    assert {r["epochs"] for r in mixing.shares(docs).collect()} == {1.0}
    two = spark.createDataFrame([*((k, "x", "a") for k in range(10)), *((k, "x", "b") for k in range(10, 80))], "doc_id bigint, text string, source string")
    assert {r["source"]: r["epochs"] for r in mixing.shares(two).collect()} == {"a": 4.0, "b": pytest.approx(40 / 70)}


def test_nulls_and_long_texts_of_licences_and_scores(spark, docs):
    long = "x " * 200_000 + "SPDX-License-Identifier: MIT"
    said = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (None, long)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["licence"], r["end"]) for r in licenses.detections(said).collect()) == [(3, "MIT", len(long))] * 2
    scored = sorted(((r["doc_id"], r["n_terms"], r["log2_probability"] is None, r["perplexity"] is None) for r in maxent.perplexities(said).collect()))
    assert scored == [(1, 0, True, True), (2, 0, True, True), (3, 200_004, False, False), (3, 200_004, False, False)]


def test_stashes_are_deleted(spark, docs, tmp_path):
    """Only what was stashed goes, whatever a folder is called; a mark keeps what is older."""
    mine = str(tmp_path / "sieveloom-mine")
    docs.write.parquet(mine)
    own = spark.read.parquet(mine)
    old = common.stash(docs)
    mark = common.stash_mark()
    new, kept = common.stash(docs), common.stash(docs)
    common.drop_stashes(spark, mark, kept)
    common.drop_stash(own)
    assert own.count() == old.count() == kept.count() == docs.count()
    with pytest.raises(Exception, match="(?i)exist"):
        new.count()
    common.drop_stashes(spark, mark)
    common.drop_stash(old)
    with pytest.raises(Exception, match="(?i)exist"):
        old.count()


@pytest.mark.parametrize("k", range(3))
def test_stages_keep_both_texts_of_an_id(spark, sf, k):
    """An id with two texts loses neither to the first three stages."""
    rows = [(7, " ".join(f"v{k}" for k in range(90)), "en", "s", 1), (7, " ".join(f"u{k}" for k in range(70)), "en", "s", 1), (8, "short text", "en", "s", 1)]
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(r[:2] for r in rows)


def test_urls(spark):
    html = "<p>cheap pills and casino win</p><script>nothing</script>" * 3
    rows = [(1, "http://cheap-pills.example.com/a/1", html, 1), (2, "https://cheappills.example.org/b?x=9", html, 1), (3, "https://www.win.example.org/casinowin", None, 1), (4, None, html, 1), (5, "", html, 1), (None, "http://casino.example.com", html, 1), (1, "http://cheap-pills.example.com/a/1", html, 1), (6, "http://" + "a" * 300 + ".org/", "", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, score int")
    found = {r["page_id"]: r for r in urls.scored(pages).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    assert found[2]["host_words"].startswith("cheap pills") and found[1]["is_unwanted"]
    assert found[4]["score"] is None and found[5]["score"] is None and not found[4]["is_unwanted"]
    assert urls.scored(pages.limit(0)).count() == 0
    one_class = urls.scored(pages.where("page_id = 2"))
    assert one_class.first()["score"] is None


@pytest.mark.parametrize("k", range(5), ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stages(spark, docs, clashing, empty, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, clashing, sf)
    assert out.columns == clashing.columns + (["repetition"] if k == 4 else [])
    assert stage(spark, empty, sf).count() == 0
    out.write.format("noop").mode("overwrite").save()
