"""Operators against plain versions of themselves, or held-out labels."""

import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sieveloom.llm import decontaminate, digests, licenses, maxent, mixing, simhash, substrings, toxicity, urls
from sieveloom.llm.common import table
from sieveloom.llm.license_rules import rules
from sieveloom.llm.textarrays import TERMS, WORDS, tokenize

RULES = rules()


def test_rules_have_their_keywords():
    assert len(RULES) > 300 and len({r.name for r in RULES}) == len(RULES)
    assert all(r.keyword == r.keyword.lower() and not re.search(r"\s", r.keyword) for r in RULES)


def check_keyword(rule):
    @given(st.from_regex(rule.regex))
    @settings(max_examples=12, deadline=None, database=None)
    def holds(text):
        assert all(rule.keyword in m[0].lower() for m in rule.regex.finditer(text))

    holds()


@pytest.mark.parametrize("part", range(4))
def test_keywords_are_in_every_match(part):
    for rule in RULES[part::4]:
        check_keyword(rule)


def plain_detections(text: str):
    found = [(r.priority, *m.span(r.group), k) for k, r in enumerate(RULES) for m in r.regex.finditer(text)]
    stay = []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        inside = any(s[1] <= d[1] and d[2] <= s[2] for s in stay)
        beaten = any(s[0] > d[0] and max(s[1], d[1]) < min(s[2], d[2]) for s in stay)
        if not inside and not beaten:
            stay.append(d)
    return sorted((RULES[k].name, s, e) for _, s, e, k in stay)


LICENSED = [
    "x " * 3000 + "Licensed under the Apache License,\n * Version 2.0. SPDX-License-Identifier: GPL-3.0-only",
    "Released under the MIT License. See LICENSE file. Copyright (c) 2020-2024 all rights reserved",
    "GNU Lesser General Public License v2.1 or the GPL v3 or later; creative commons attribution-sharealike 4.0",
    "https://www.gnu.org/licenses/gpl-3.0.html BSD-3-Clause new BSD license, licence, 'as is'",
    "no words of that kind",
]


@pytest.mark.parametrize(
    "said, expected",
    [
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("SPDX-License-Identifier: LicenseRef-x OR (ISC)", ["ISC"]),
        ("SPDX-License-Identifier: MITx OR unknown", []),
    ],
)
def test_operands_of_tags(spark, said, expected):
    docs = spark.createDataFrame([(1, "text\n" + said + "\nmore")], "doc_id bigint, text string")
    assert [r["licence"] for r in licenses.detections(docs).orderBy("start").collect()] == expected


def test_licenses(spark, sf):
    texts = LICENSED + [r["text"] for r in table(spark, sf, "documents").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["rule"], r["start"], r["end"]) for r in licenses.detections(docs).collect())
    assert got == sorted((i, *d) for i, t in enumerate(texts) for d in plain_detections(t))
    assert got


def plain_groups(codes, radius):
    """(number of links, least code of the component) of each code that has links."""
    n = len(codes)
    near = [[j for j in range(n) if j != i and np.unpackbits(codes[i] ^ codes[j]).sum() <= radius] for i in range(n)]
    out = {}
    for i in range(n):
        if near[i]:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            out[codes[i].tobytes()] = (len(near[i]), min(codes[j].tobytes() for j in seen))
    return out


@pytest.mark.parametrize("held", [1, 1 << 21])
def test_simhash_kernel_against_all_pairs(monkeypatch, held):
    """Three tiles' link counts add up, and their edges span the components, whether links are held or reduced on the way."""
    monkeypatch.setattr(simhash, "_HELD", held)
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    codes[150:200] = codes[:50] ^ (rng.random((50, 16)) < 0.1).astype(np.uint8)
    codes[200:240] = codes[60] ^ (rng.random((40, 16)) < 0.05).astype(np.uint8)
    codes = np.unique(codes, axis=0)
    ids, keys = np.arange(len(codes)), np.unpackbits(codes, axis=1).sum(1).astype(np.int32)
    order = np.argsort(keys)
    a, b, near = order[:170], order[170:], simhash._near(24)
    links, edges = Counter(), []
    for x, y, same in ((a, a, True), (b, b, True), (a, b, False)):
        r = near(ids[x], keys[x], codes[x], ids[y], keys[y], codes[y], same)
        links.update(dict(zip(r["code"].to_pylist(), r["links"].to_pylist(), strict=True)))
        edges += list(zip(r["code"].to_pylist(), r["least"].to_pylist(), strict=True))
        assert len(edges) <= 2 * len(codes) * 3
    expected = plain_groups(codes, 24)
    assert links == {k: n for k, (n, _) in expected.items()}
    root = {k: k for k in expected}
    for _ in range(len(expected)):
        for p, q in edges:
            root[p] = root[q] = min(root[p], root[q])
    assert root == {k: least for k, (_, least) in expected.items()}


def test_simhash_by_parts(monkeypatch):
    """Large tiles are searched without comparing most pairs, and find all; codes that share their parts are compared in blocks."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (9000, 16), dtype=np.uint8)
    for rate, at in ((0.01, 2000), (0.1, 3000), (0.16, 4000), (0.19, 5000)):  # copies from near to just beyond the radius
        codes[at : at + 1000] = codes[:1000] ^ np.packbits(rng.random((1000, 128)) < rate, axis=1)
    codes[8800:] = codes[8800] ^ np.packbits(rng.random((200, 128)) < 0.04, axis=1)
    codes = rng.permutation(np.unique(codes, axis=0))
    a, b = codes[:4500], codes[4500:]
    words = lambda x: np.ascontiguousarray(x).view(np.uint64)
    for radius, piece in ((0, 1 << 16), (3, 1 << 16), (24, 1000), (24, 1 << 16), (30, 1 << 16)):
        monkeypatch.setattr(simhash, "_PIECE", piece)
        for x, y, same in ((a, b, False), (a, a, True)):
            d = np.vstack([np.bitwise_count(words(x)[i : i + 100, None] ^ words(y)[None]).sum(2) for i in range(0, len(x), 100)]) <= radius
            found = [(min(p, q), max(p, q)) if same else (p, q) for ps, qs in simhash.by_parts(words(x), words(y), same, radius) for p, q in zip(ps.tolist(), qs.tolist(), strict=True)]
            assert sorted(map(list, found)) == np.argwhere(np.triu(d, 1) if same else d).tolist()  # each once
    assert simhash.candidates(words(a), words(b), 24) < 0.1 * len(a) * len(b)
    crowd = codes.copy()
    crowd[:, :8] = codes[0, :8]  # half of the code is one for all
    near = simhash._near(24)
    for of, taken in ((codes, "by_parts"), (crowd, "by_blocks")):
        keys, ran = np.unpackbits(of, axis=1).sum(1).astype(np.int32), []
        for way in ("by_parts", "by_blocks"):
            monkeypatch.setattr(simhash, way, lambda *args, f=getattr(simhash, way), way=way: ran.append(way) or f(*args))
        got = near(None, keys[:4500], of[:4500], None, keys[4500:], of[4500:], False)
        monkeypatch.undo()
        assert ran == [taken]
        hits = sum(int((np.bitwise_count(words(of[i : i + 100])[:, None] ^ words(of[4500:])[None]).sum(2) <= 24).sum()) for i in range(0, 4500, 100))
        assert sum(got["links"].to_pylist()) == 2 * hits > 0


def test_tiles_of_any_size_give_the_same(spark, sf):
    docs = table(spark, sf, "documents")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(simhash.near_duplicates(docs, tile=16)) == key(simhash.near_duplicates(docs))
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(digests.classes(docs, tile=16)) == text(digests.classes(docs))


def test_digest_classes(spark, sf):
    """Every link between different digests is counted, and the nearest is the least by score and id, also in groups of copies."""
    texts = [r["text"] for r in table(spark, sf, "documents").collect()]
    base = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    texts += [base, base, base + " end", base + " end", *(base + f" end{k}" for k in range(12))]
    made, has = digests.digests_of(pa.array(texts))
    code = [m.tobytes() if h else None for m, h in zip(made, has, strict=True)]
    kind = {}
    for i, c in enumerate(code):
        kind.setdefault(c, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    some = 0
    for tile in (16, digests.TILE):
        got = {r["doc_id"]: r for r in digests.classes(docs, tile=tile).collect()}
        assert len(got) == len(texts)
        for i, r in got.items():
            if code[i] is None:
                assert (r["digest"], r["class_id"], r["n_links"], r["nearest_class_id"], r["score"]) == (None, None, 0, None, None)
                continue
            near = [(d, k) for c, k in kind.items() if c is not None and c != code[i] and (d := digests.difference(code[i], c)) <= digests.BOUND]
            some += bool(near)
            assert (r["digest"], r["class_id"], r["n_links"]) == (code[i].hex(), kind[code[i]], len(near))
            assert (r["score"], r["nearest_class_id"]) == min(near, default=(None, None))
    assert some > 20


def test_all_near_pairs_of_digests(spark, sf):
    """X and Y are near and each has an exact copy: a nearest document names the copy only, a pair links X and Y."""
    texts = [r["text"] for r in table(spark, sf, "documents").collect()]
    base = " ".join(f"word{k * 7919 % 1000}" for k in range(400))
    texts += [base, base, base + " end", base + " end"]
    made, has = digests.digests_of(pa.array(texts))
    some = sorted({m.tobytes() for m, h in zip(made, has, strict=True) if h})
    plain = {(a, b, d) for a, b in itertools.combinations(some, 2) if abs(a[0] - b[0]) <= 2 and (d := digests.difference(a, b)) <= digests.BOUND}
    prints = digests.stash(digests.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    for tile in (16, digests.TILE):
        got = [(bytes(r["digest"]), bytes(r["other"]), r["score"]) for r in digests.near_pairs(prints, tile=tile).collect()]
        assert len(got) == len(plain) and set(got) == plain
    x, y = sorted((made[-4].tobytes(), made[-2].tobytes()))
    assert x != y and any(p[:2] == (x, y) for p in plain)


@given(st.lists(st.text(alphabet="ab \n\té_9Z", max_size=90), max_size=5))
@settings(max_examples=60, deadline=None)
def test_tokens(texts):
    for table_, pattern in ((WORDS, r"[^\t\n\x0b\x0c\r ]+"), (TERMS, r"[0-9a-zA-Z\x80-\U0010ffff]+")):
        for chunk in (3, 1 << 20):
            got = [[t.token(i).decode() for i in range(t.off[d], t.off[d + 1])] for t in tokenize(pa.array(texts, pa.string()), table_, chunk) for d in range(t.n_docs)]
            assert got == [[w.lower() if table_ is TERMS and w.isascii() else w if table_ is WORDS else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(pattern, x)] for x in texts]


def plain_spans(texts: list[str], length: int):
    first, dup = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            if g in first:
                dup.setdefault(i, set()).update(range(p, p + length))
            first.setdefault(g, (i, p))
    return {(i, x) for i, xs in dup.items() for x in xs}


@given(st.data())
@settings(max_examples=12, deadline=None)
def test_substrings(spark, data):
    pool = data.draw(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=14).map(" ".join), min_size=1, max_size=3))
    texts = data.draw(st.lists(st.lists(st.sampled_from([*pool, "d e f g"]), min_size=0, max_size=4).map(" ".join), min_size=1, max_size=6))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], x) for r in substrings.duplicate_spans(docs, 6, 3).collect() for x in range(r["start_token"], r["end_token"])}
    assert got == plain_spans(texts, 6)


def test_substring_removal(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts)
    dup = plain_spans([texts[i] for i in order], substrings.LENGTH)
    expected = {i: [w for x, w in enumerate(texts[i].split()) if (k, x) not in dup] for k, i in enumerate(order)}
    got = {r["doc_id"]: r["text"].split() for r in substrings.remove_duplicates(docs).collect()}
    assert got == {i: w for i, w in expected.items() if w or not texts[i].split()}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
@settings(max_examples=100, deadline=None)
def test_lcs(a, b):
    assert decontaminate.lcs(a, b) == plain_lcs(a, b)


def plain_share(item: list[str], text: list[str]) -> float:
    """The most of an item that is a subsequence of words near each other in a text, tried at every place."""
    n = len(item)
    return max(plain_lcs(item, text[k : k + n + n // 4 + 8]) / n for k in range(0, max(1, len(text) - n // 2), max(1, n // 3)))


@pytest.mark.parametrize("lengths", [(12, 45), (40, 41), (400, 401), (1000, 1001)])
def test_decontamination_recall(spark, lengths):
    """Items planted whole, with words exchanged, and with a word in six left out; documents without any stay."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [say(int(rng.integers(*lengths))) for _ in range(30)]
    docs, truth = [], set()
    for i in range(300 if lengths[1] < 100 else 120):
        text = say(int(rng.integers(30, 400)))
        if i % 3 == 0:
            k, w = i % 30, items[i % 30].split()
            if i % 2:
                w = [x for j, x in enumerate(w) if j % 6 != 3]
            else:
                w[1:3] = w[1:3][::-1]
            text = f"{text} {' '.join(w)} {say(50)}"
            truth.add((i, k))
        docs.append((i, text))
    docs_, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["subsequence"] for r in decontaminate.contaminated(docs_, bench).collect()}
    assert len(set(found) & truth) >= 0.95 * len(truth) and len(set(found) - truth) <= 1
    # in portions, the same documents
    parts = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_, bench, portion_bytes=sum(map(len, items)) // 3).collect()}
    assert len(parts & truth) >= 0.95 * len(truth) and len(parts - truth) <= 1
    if lengths[1] < 100:  # by brute force, too: every item against some documents
        plain = {(i, k) for i, t in docs[:30] for k, x in enumerate(items) if plain_share(x.split(), t.split()) >= decontaminate.VERBATIM}
        assert plain
        assert len(plain - set(found)) <= 0.05 * len(plain)


def test_passage_counts(spark, sf):
    bench = decontaminate.Items([(r[0], r[1]) for r in table(spark, sf, "benchmark").collect()])
    docs = table(spark, sf, "documents").select("doc_id", "text")
    df, n = decontaminate.passage_counts(decontaminate.mapped(docs, bench), len(bench.vocabulary))
    plain, total = Counter(), 0
    for r in docs.collect():
        for t in tokenize(pa.array([r["text"]]), TERMS):
            terms = bench.number(t.hash)
            if not len(terms):
                continue
            for p in range(int(decontaminate.n_passages(len(terms)))):
                total += 1
                plain.update(set(terms[p * 16 : p * 16 + 32].tolist()) - {0})
    assert n == total and {k + 1: int(v) for k, v in enumerate(df) if v} == dict(plain)


def test_singular_vectors_span_the_leading_space(spark):
    """Against a dense decomposition of the matrix of all passages, of a corpus of few topics."""
    rng = np.random.default_rng(0)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[rng.integers(6)], int(rng.integers(20, 90)))) for _ in range(120)]
    bench = decontaminate.Items([(k, " ".join(t)) for k, t in enumerate(topics)])
    places = decontaminate.mapped(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench)
    idf = rng.uniform(1, 2, len(bench.vocabulary))
    rows = []
    for x in texts:
        terms = bench.number(np.concatenate([t.hash for t in tokenize(pa.array([x]), TERMS)]))
        rows += [np.bincount(terms[p * 16 : p * 16 + 32], minlength=len(idf) + 1)[1:] * idf for p in range(int(decontaminate.n_passages(len(terms))))]
    _, s, vt = np.linalg.svd(np.array(rows), full_matrices=False)
    got = decontaminate.singular_vectors(places, idf, rank=6, oversample=20)
    assert s[5] > 2 * s[6]
    q, _ = np.linalg.qr(got.astype(np.float64))
    assert np.linalg.svd(vt[:6] @ q)[1] == pytest.approx(1, abs=0.05)
    assert np.linalg.norm(got, axis=0) == pytest.approx(1 / s[:6], rel=0.1)


def test_toxicity_on_labels_left_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, train).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in held.collect()}
    tp = sum(1 for i, t in truth.items() if t and i in found)
    assert tp >= 0.9 * sum(truth.values())
    assert sum(1 for i, t in truth.items() if not t and i in found) <= 0.01 * len(truth)


def test_toxicity_fit_does_not_depend_on_partitions(spark, sf):
    """The fit sums over partitions: one or five give the same model, and its loss is that of a dense computation."""
    rng = np.random.default_rng(0)
    words = ["idiot", "moron", "clown", "garden", "river", "stone", "school", "bread"]
    rows = [(k, k % 2, " ".join(rng.choice(words[:5] if k % 2 else words[3:], 12))) for k in range(60)]
    sampled = spark.createDataFrame(rows, "doc_id bigint, toxic int, text string")
    w1, b1 = toxicity.train(toxicity.feature_rows(sampled, 1), passes=6)
    w5, b5 = toxicity.train(toxicity.feature_rows(sampled, 5), passes=6)
    assert np.allclose(w1, w5, atol=1e-4) and b1 == pytest.approx(b5, abs=1e-4)
    p = toxicity.scores(pa.array([r[2] for r in rows]), w1, b1)
    assert all((x >= 0.5) == bool(r[1]) for x, r in zip(p, rows, strict=True)) and b1 <= toxicity.BIAS_LIMIT


def test_toxicity_in_small_memory(spark, monkeypatch):
    """Texts aren't copied to pandas, only rejected rows come back, and features leave a worker chunk by chunk, the same however many there are."""
    rows = [(i, "vile scum " * 5 if i % 2 else "good day " * 5, i % 2) for i in range(200)] + [(200, None, None), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.toxic_documents(docs, docs.where("doc_id < 100").select("doc_id", "toxic"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    assert found.count() == 100 and all(r["doc_id"] % 2 and r["is_toxic"] and r["toxicity"] >= 0.5 for r in found.collect())
    sizes = []
    real = toxicity._features
    monkeypatch.setattr(toxicity, "_features", lambda t: sizes.append(t.n_docs) or real(t))
    texts = [f"{w} " * 40_000 for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")]
    assert len(toxicity.features(pa.array(texts))) == sum(sizes) == 6 and len(sizes) > 1
    monkeypatch.undo()
    long = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(texts)], "doc_id long, toxic int, text string")
    got = sorted((r["toxic"], bytes(r["f"]), bytes(r["v"])) for r in toxicity.feature_rows(long, 1).collect())
    assert got == sorted((i % 2, *(y.tobytes() for y in toxicity.features(pa.array([x]))[0])) for i, x in enumerate(texts))


def test_toxicity_score_is_of_whole_texts():
    rng = np.random.default_rng(0)
    weights = rng.standard_normal(toxicity.DIMENSIONS).astype(np.float32)
    texts = ["one two one", None, "", "..", "é two", "long " * 5000 + "tail"]
    got = toxicity.scores(pa.array(texts), weights, 0.25)
    for text, p in zip(texts, got, strict=True):
        f = toxicity.features(pa.array([text], pa.string()))[0]
        z = float((weights[f[0]] * f[1]).sum())
        assert abs(p - (1 / (1 + math.exp(-max(-40, min(40, z + 0.25)))) if len(f[0]) else 0)) < 1e-4


def plain_levels(sizes: dict, weights: dict, most: float):
    """Water-filling round by round."""
    target, open_, share = sum(sizes.values()), dict(weights), {}
    while open_:
        level = (target - sum(share.values())) / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not over:
            return {s: (share[s] if s in share else level * weights[s]) / sizes[s] for s in weights}
        for s in over:
            share[s] = most * sizes[s]
            del open_[s]
    return {s: share[s] / sizes[s] for s in weights}


@given(st.lists(st.tuples(st.integers(1, 200), st.integers(1, 9)), min_size=1, max_size=7))
@settings(max_examples=12, deadline=None)
def test_mixing(spark, sources):
    sizes = {f"s{k}": n for k, (n, _) in enumerate(sources)}
    weights = {f"s{k}": float(w) for k, (_, w) in enumerate(sources)}
    docs = spark.createDataFrame([(k, "x" * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id bigint, text string, source string")
    got = {r["source"]: r["epochs"] for r in mixing.shares(docs, weights).collect()}
    assert got == pytest.approx(plain_levels(sizes, weights, mixing.MAX_EPOCHS))


def test_mixing_fractions(spark):
    docs = spark.createDataFrame([(k, "x" * 10, "a" if k < 300 else "b") for k in range(1300)], "doc_id bigint, text string, source string")
    n = {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert abs(n["a"] - 650) < 60 and abs(n["b"] - 650) < 60


def every_split(name: str):
    for cuts in itertools.product((0, 1), repeat=len(name) - 1):
        out, last = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                out.append(name[last:k])
                last = k
        yield [*out, name[last:]]


@given(st.text(alphabet="ab", min_size=1, max_size=9), st.dictionaries(st.text(alphabet="ab", min_size=1, max_size=4), st.integers(1, 50), max_size=8))
@settings(max_examples=80, deadline=None)
def test_segmentation(name, counts):
    total = sum(counts.values()) + 1
    p = lambda ws: sum((math.log(counts[w]) if w in counts else -math.log(10) * (len(w) - 1)) - math.log(total) for w in ws)
    assert p(urls.segment(name, counts, total)) == pytest.approx(max(map(p, every_split(name))))


def test_words_of_any_length(spark):
    """A word longer than the looked-up prefix is found within a longer name, and an unknown name of any length is one piece."""
    word = "donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"http://my{word}kapitan.example.org/", f"<p>my {word} kapitan</p>" * 60), (2, "http://" + "zq" * 150 + ".org/", "")]
    found = {r["name"]: r["words"] for r in _segments(spark, rows)}
    assert found[f"my{word}kapitan"] == ["my", word, "kapitan"] and found["zq" * 150] == ["zq" * 150]


def _segments(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    parsed = urls.parsed(pages)
    counts = urls.word_counts(pages, parsed)
    names = parsed.selectExpr("explode(names) as t").selectExpr("t.name").distinct()
    return urls.segmented(names, counts, counts.agg({"n": "sum"}).first()[0]).collect()


def test_urls_of_undelimited_hosts(spark):
    """Hosts that write their words as one, so that no weak label marks them, are told apart by the words they share with marked ones."""
    rng = np.random.default_rng(0)
    bad, good, both = ["casino", "poker", "bonus", "jackpot", "slots"], ["garden", "history", "museum", "school", "library"], ["online", "best", "world", "club"]
    text = "<p>" + " ".join([*bad, *good, *both] * 4) + "</p>"
    rows, truth = [], {}
    for i in range(400):
        kind = bad if i % 4 == 0 else good
        words = [str(rng.choice(kind)), str(rng.choice(both)), str(rng.choice(kind))]
        sep = "" if i % 8 < 4 else "-"
        rows.append((i, f"https://www.{sep.join(words)}.example.org/{rng.choice(both)}/{i}", text))
        truth[i] = kind is bad and not sep
    found = {r["page_id"]: r["is_unwanted"] for r in urls.scored(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    hidden = [i for i, t in truth.items() if t]
    clean = [i for i in truth if i % 4]
    assert sum(found[i] for i in hidden) >= 0.9 * len(hidden) and sum(found[i] for i in clean) <= 0.02 * len(clean)


def test_urls_against_a_plain_model(spark, sf):
    pages = table(spark, sf, "pages")
    rows = pages.collect()
    counts = Counter()
    for r in rows:
        text = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ", r["html"])
        low = "".join(c.lower() if c.isascii() else c for c in text)
        counts.update(w for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", low) if re.fullmatch("[a-z]+", w))
    parts = {r["page_id"]: re.match(r"https?://([^/:?#]*)[^/?#]*(.*)", r["url"].lower()).groups() for r in rows}
    for host, _ in parts.values():
        for label in host.split("."):
            if "-" in label:
                counts.update(re.findall("[a-z]+", label))
    total = sum(counts.values())
    split = {}

    def tokens(i):
        for zone, text in zip("hp", parts[i], strict=True):
            for name in re.findall("[a-z]+|[0-9]+", text):
                name = "0" if name[0].isdigit() else name
                if name not in split:
                    split[name] = urls.segment(name, counts, total)
                yield from ((zone, w) for w in split[name])

    bad = {i: bool(set(re.split("[.-]", h)) & set(urls.SEEDS)) for i, (h, _) in parts.items()}
    by = {c: Counter(t for i in parts if bad[i] == c for t in tokens(i)) for c in (True, False)}
    size = len(set(by[True]) | set(by[False]))
    n = {c: sum(by[c].values()) for c in by}
    score = lambda i: math.log(sum(bad.values()) / (len(bad) - sum(bad.values()))) + sum(math.log((by[True][t] + 1) / (n[True] + size)) - math.log((by[False][t] + 1) / (n[False] + size)) for t in tokens(i))
    got = {r["page_id"]: r["score"] for r in urls.scored(pages).collect()}
    assert got == pytest.approx({i: score(i) for i in parts}, abs=1e-5)


def plain_counts(docs, shape):
    counts = np.zeros(shape.buckets, np.int64)
    for t in tokenize(pa.array([r["text"] for r in docs.collect()]), TERMS):
        counts += np.bincount(maxent.buckets_of(t, shape), minlength=shape.buckets)
    return counts


def test_language_model(spark, sf):
    docs = table(spark, sf, "documents")
    for shape in (maxent.Shape(), maxent.Shape(depth=3)):
        counts = maxent.term_counts(docs, shape)
        assert (counts == plain_counts(docs, shape)).all()
        outputs = maxent.outputs_of(counts, shape)
        prior = maxent.prior_of(counts, outputs, shape)
        weights = maxent.fit(docs, shape, outputs, prior)
        t = next(tokenize(pa.array([docs.first()["text"]]), TERMS))
        y, features = outputs[maxent.buckets_of(t, shape)][:40], maxent.contexts(t)[:, :40]
        model = maxent.Model(shape, prior, weights)
        got = model.score(y, features)
        nodes, slots = shape.tree
        for i in range(len(y)):  # the product of the softmaxes along the path
            expected = 0.0
            for level in range(shape.depth):
                node = int(nodes[level, y[i]])
                if node >= 0:
                    k = features[:, i] if level == 0 else maxent.mix64(features[:, i] + np.uint64(node) * maxent._NODE)
                    part = (shape.deep if level else shape.first) // 4
                    rows = [(shape.first if level else 0) + j * part + int(k[j]) % part for j in range(4)]
                    z = (prior[node].astype(np.float64) + weights[rows].sum(0)).clip(-30, 30)
                    expected += z[slots[level, y[i]]] - math.log(np.exp(z).sum())
            assert got[i] == pytest.approx(expected, abs=1e-3)
    shuffled = spark.createDataFrame([(0, " ".join(np.random.default_rng(0).permutation(docs.first()["text"].split())))], "doc_id bigint, text string")
    as_is = spark.createDataFrame([(0, docs.first()["text"])], "doc_id bigint, text string")
    score = lambda d: maxent.score(d, shape, outputs, prior, weights).first()["log2_probability"]
    assert score(as_is) > score(shuffled)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_tree_is_a_distribution(depth):
    """Every output has a path of its own, and an untrained model gives the outputs' shares of the counts."""
    shape = maxent.Shape(depth=depth)
    nodes, slots = shape.tree
    assert len({(*n, *s) for n, s in zip(nodes.T.tolist(), slots.T.tolist(), strict=True)}) == shape.outputs
    outputs = np.arange(shape.outputs)
    counts = np.random.default_rng(0).integers(0, 50, shape.outputs)
    prior = maxent.prior_of(counts, outputs, shape)
    some = np.random.default_rng(1).integers(0, shape.outputs, 300)
    got = maxent.Model(shape, prior).score(some, np.zeros((4, 300), np.uint64))
    assert np.exp(got) == pytest.approx((counts[some] + 1) / (counts + 1).sum(), rel=1e-3)


def test_model_grows_with_the_corpus():
    sizes = [maxent.Shape.of(n) for n in (10**6, 10**8, 10**10, 10**12, 10**14)]
    assert all(a.buckets <= b.buckets and a.depth <= b.depth and a.rows <= b.rows and a.tasks < b.tasks for a, b in itertools.pairwise(sizes))
    assert sizes[0].rows < sizes[1].rows < sizes[2].rows and sizes[0].outputs < sizes[2].outputs < sizes[4].outputs
    assert all(s.rows <= maxent.MOST_ROWS * 5 // 4 and s.buckets <= maxent.MOST_BUCKETS for s in sizes)


def test_language_model_on_documents_left_out(spark):
    """Trained on nine documents of ten, it gives the tenth a lower perplexity than the unigram model of the same hashes."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    train, held = docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0")
    shape = maxent.shape_of(train)
    counts = plain_counts(train, shape) + 1.0
    logs, n = 0.0, 0
    for t in tokenize(pa.array([r["text"] for r in held.collect()]), TERMS):
        logs += np.log2(counts / counts.sum())[maxent.buckets_of(t, shape)].sum()
        n += len(t.hash)
    rows = maxent.perplexities(held, train).where("n_terms > 0").collect()
    model = sum(r["n_terms"] * r["log2_probability"] for r in rows)
    assert sum(r["n_terms"] for r in rows) == n
    assert model / n > logs / n + 0.05


def test_terms_share_their_output_by_count(spark, sf):
    docs = table(spark, sf, "documents")
    shape = maxent.shape_of(docs)
    counts = maxent.term_counts(docs, shape)
    outputs = maxent.outputs_of(counts, shape)
    shares = maxent.shares_of(counts, outputs, shape)
    assert np.bincount(outputs, np.exp(shares.astype(np.float64)), shape.outputs) == pytest.approx(1, abs=1e-4)
    words = [f"q{k}" for k in range(3000)]
    hashes = maxent.buckets_of(next(tokenize(pa.array([" ".join(words)]), TERMS)), shape)
    by = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        if outputs[h] >= shape.own:
            by.setdefault(int(outputs[h]), {})[int(counts[h])] = w
    seen = max(by.values(), key=max)
    assert max(seen) > min(seen)
    # one of the corpus, one that is rarer, of the same output and without context
    extra = spark.createDataFrame([(-1, seen[max(seen)]), (-2, seen[min(seen)])], "doc_id bigint, text string")
    found = {r["doc_id"]: r["log2_probability"] for r in maxent.perplexities(docs.select("doc_id", "text").unionByName(extra)).where("doc_id < 0").collect()}
    assert found[-1] > found[-2] + 0.3


def test_gradients_are_summed_by_row():
    """Segments of every length, up to one of all rows, have the sums of a plain loop, in less time than reduceat takes."""
    rng = np.random.default_rng(3)
    n = 1 << 16
    x = rng.normal(size=(n, maxent.WIDTH)).astype(np.float32)
    for rows in (rng.integers(0, 1 << 14, n), (rng.zipf(1.3, n) - 1) % (1 << 12), np.zeros(n, int), np.arange(n), np.arange(1)):
        order = np.argsort(rows, kind="stable")
        ids, begin, length = np.unique(rows[order], return_index=True, return_counts=True)
        total, of = maxent.segment_sums(x, order, begin, length)
        assert sorted(of.tolist()) == list(range(len(ids)))
        expected = np.zeros((n, maxent.WIDTH))
        np.add.at(expected, rows, x[: len(rows)].astype(np.float64))
        assert np.allclose(total, expected[ids[of]], rtol=0, atol=1e-2 if len(ids) == 1 else 2e-3)
    rows = rng.integers(0, 1 << 14, n)
    order = np.argsort(rows, kind="stable")
    _, begin, length = np.unique(rows[order], return_index=True, return_counts=True)
    halves = [np.ascontiguousarray(h) for h in np.hsplit(x, 2)]

    def seconds(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    old = lambda: np.hstack([np.add.reduceat(np.take(h, order, axis=0), begin, axis=0) for h in halves])
    assert min(seconds(lambda: maxent.segment_sums(x, order, begin, length)) for _ in range(7)) < 0.8 * min(seconds(old) for _ in range(7))


def test_a_step_of_the_language_model():
    """learn() changes the weights, the Adagrad state and the counts of uses as a loop over tokens in 64-bit numbers does."""
    shape = maxent.Shape(depth=3)
    rng = np.random.default_rng(4)
    prior = maxent.prior_of(rng.integers(0, 50, shape.outputs), np.arange(shape.outputs), shape)
    y, features = rng.integers(0, shape.outputs, 5000), maxent.mix64(rng.zipf(1.5, (4, 5000)).astype(np.uint64))
    model = maxent.Model(shape, prior, rng.normal(size=(shape.rows, maxent.WIDTH)).astype(np.float32))
    w, power, seen = model.w.astype(np.float64), np.zeros(shape.rows), np.zeros(shape.rows)
    for some, nodes, rows, target in model.steps(y, features):
        z = prior[nodes] + w[rows].sum(0)
        g = np.exp(z.clip(-30, 30))
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(some)), target] -= 1
        for r in rows:
            total = np.zeros_like(w)
            np.add.at(total, r, g)
            used = np.unique(r)
            power[used] += (total[used] ** 2).mean(1)
            w[used] -= maxent.RATE / np.sqrt(power[used] + 1e-6)[:, None] * total[used]
            np.add.at(seen, r, 1)
    states = np.zeros(shape.rows, np.float32), np.zeros(shape.rows, np.float32)
    model.learn(y, features, *states)
    assert (states[1] == seen).all()
    assert np.allclose(states[0], power, rtol=1e-3)
    assert np.allclose(model.w, w, rtol=0, atol=1e-3)


def test_pipeline_against_its_stages(spark, sf):
    """run() keeps, of each stage's input, what the operators' own results say."""
    docs = table(spark, sf, "documents")
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    toxic = {r["doc_id"] for r in toxicity.toxic_documents(docs, labels).collect()}
    one = docs.where(~docs["doc_id"].isin(list(toxic)) if toxic else "true")
    gone = {r["doc_id"] for r in simhash.near_duplicates(one).where("not is_kept").collect()}
    two = one.where(~one["doc_id"].isin(list(gone)))
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    order = sorted(texts)
    dup = plain_spans([texts[i] for i in order], substrings.LENGTH)
    cut = {i: [w for x, w in enumerate(texts[i].split()) if (k, x) not in dup] for k, i in enumerate(order)}
    three = {i for i in order if cut[i] or not texts[i].split()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} <= three
    assert all(r["text"].split() == cut[r["doc_id"]] for r in got)
    leaks = {r["doc_id"] for r in decontaminate.contaminated(substrings.remove_duplicates(two), bench).collect()}
    assert not leaks & {r["doc_id"] for r in got}
    # what is left is mixed: every source is there, and most of its documents
    assert len({r["doc_id"] for r in got}) > 0.6 * len(three - leaks)
