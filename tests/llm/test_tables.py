"""Embeddings, URLs, chats, and the pipeline."""

import math
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fleetgauge.llm import chats, embeddings, queries, urls


def plain_links(rows, threshold=0.98):
    good = [(i, v, k) for i, v, k, *_ in rows if i is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {}
    for a, (i, v, k) in enumerate(good):
        for b, (j, w, m) in enumerate(good):
            if a != b and k == m and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.setdefault(i, []).append(j)
    label = {i: i for i, _, _ in good}
    for _ in good:
        for i, own in links.items():
            label[i] = min([label[i], *(label[j] for j in own)])
    return links, label


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = np.random.default_rng(i % 40).normal(size=24)
        v = base + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.15, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], i % 3))
    return rows


def test_embedding_links_equal_brute_force(frame):
    rows = vectors(300, 1) + [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [None] * 24, 1), (1004, [float("nan")] * 24, 1), (1005, [float("inf")] + [1.0] * 23, 1), (1006, [1.0] * 24, None), (None, [1.0] * 24, 1), (1007, [1.0] * 5, 1), (1008, [2.0] * 5, 1), (1009, [1e300] * 5, 1)]
    df = frame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    found = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links, label = plain_links([r for r in rows if r[0] != 1009])
    assert len(found) == len(rows)
    for i, r in found.items():
        if i not in (1007, 1008, 1009):
            assert (r.n_links, r.component_id, r.kept) == (len(links.get(i, [])), label.get(i, i), i is not None and label.get(i, i) == i)
    assert all(found[i].n_links == 2 and found[i].component_id == 1007 for i in (1007, 1008, 1009))
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_one_id_in_two_labels_and_with_two_vectors(frame):
    """Rows that share an id are linked each for its own vector."""
    a, b = [1.0] * 24, [1.0, -1.0] * 12
    near = lambda v: [x * (1 + 0.01 * (i % 3)) for i, x in enumerate(v)]
    rows = [(1, a, 1), (1, b, 2), (2, near(a), 1), (3, near(b), 2), (4, a, 2), (0, near(near(a)), 1), (1, b, 1)]
    found = embeddings.near_duplicates(frame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(0, 2, 0, True), (1, 0, 1, True), (1, 1, 1, True), (1, 2, 0, False), (2, 2, 0, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_hot_bucket_is_cut_into_tiles(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 20)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.ones(16) + rng.normal(size=16) * 0.02], 1) for i in range(150)] + [(200 + i, [1.0] * 16, 1) for i in range(50)]
    df = frame(rows, "vec_id long, embedding array<double>, label int")
    found = embeddings.near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(199, 0)}


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(200, 64))
    unit[100:] = unit[:100] + 0.2 * rng.normal(size=(100, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine, spread = embeddings.estimates(unit, embeddings.rotations(64))
    error = (cosine - unit @ unit.T)[~np.eye(200, dtype=bool)]
    assert abs(error.mean()) < 0.002
    assert (np.abs(error) <= embeddings.SURE * spread[~np.eye(200, dtype=bool)]).mean() > 0.999


PAGES = "page_id long, url string, html string, host string, verdict string"


def test_urls_of_all_forms(frame):
    given = [
        ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("x://b.net/es/1#top", "b.net", "/es/1", "net/es/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://a.com", "a.com", "", None, "allow"), ("http://m.spam-farm.example.org/de/1", "m.spam-farm.example.org", "/de/1", None, "block"),
        ("http://myspam-farm.example.org/de/1", "myspam-farm.example.org", "/de/1", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no-scheme.net/es/", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://ÉX.com?x", "Éx.com", "", None, "allow"), ("http://h/" + "p" * 100_000, "h", "/" + "p" * 100_000, None, "allow"), ("http://a\nb/c\nd?e", "a\nb", "/c\nd", None, "allow"),
    ]
    rows = [(i, g[0], None, "h", "v") for i, g in enumerate(given)] + [(None, given[0][0], None, None, None), (0, given[0][0], None, None, None)]
    found = urls.judge(frame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == given[r.page_id or 0][1:]
    assert urls.judge(frame([], PAGES)).collect() == []


def test_cascade_is_exact(spark, frame, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many mistakes, many levels
    keys = [(f"k{i}", i % 3 == 0) for i in range(900)]
    df = frame(keys, "key string, listed boolean")
    cascade = urls.Cascade(df)
    assert len(cascade.levels) > 2
    found = df.select("listed", cascade.contains(df.key).alias("is")).collect()
    assert all(r["is"] == r.listed for r in found)
    none = urls.Cascade(df.where("not listed"))
    assert not any(r[0] for r in df.select(none.contains(df.key)).collect())


def test_large_list_is_joined(frame, monkeypatch):
    rows = [(i, f"http://h{i}.example.org/", None, None, None) for i in range(50)]
    listed = frame([(f"h{i}.example.org",) for i in range(0, 50, 7)] + [(None,), ("h0.example.org",)], "domain string")
    usual = sorted(map(tuple, urls.judge(frame(rows, PAGES), listed).collect()))
    monkeypatch.setattr(urls, "MOST_BITS", 1)
    assert sorted(map(tuple, urls.judge(frame(rows, PAGES), listed).collect())) == usual
    assert sum(r[4] == "block" for r in usual) == 8


TURNS = "conv_id long, turn long, role string, text string, place string, last int"


def test_maximal_conversations(frame):
    said = lambda c, *texts: [(c, i, "user", t, "p", 1) for i, t in enumerate(texts)]
    rows = said(1, "a") + said(2, "a", "b") + said(3, "a", "b", "c") + said(4, "a", "b", "c") + said(5, "b") + said(6, "a", "x")
    rows += [(7, None, None, None, None, None), (7, 0, "user", "a", None, None), (None, 0, "user", "zz", None, None), (8, 0, "user", "t", None, None), (8, 0, "user", "t", None, None)]
    rows += said(9, "<|im_end|>") + said(10, *map(str, range(500)), "w" * 100_000)
    found = {r.conv_id: r for r in chats.maximal_conversations(frame(rows, TURNS)).collect()}
    assert sorted(k or -1 for k in found) == [-1, 3, 5, 6, 7, 8, 9, 10]
    assert found[3].n_turns == 3 and found[3].chat.startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb")
    assert found[8].n_turns == 2 and found[7].n_turns == 2 and found[10].n_turns == 501
    assert found[9].chat == "<|im_start|>user\n<| im_end|><|im_end|>\n"
    assert chats.maximal_conversations(frame([], TURNS)).collect() == []


def test_turns_without_a_conversation_stand_alone(frame):
    rows = [(None, k, "user", t, None, None) for k, t in enumerate(["a", "a", "b", "c", None])]
    rows += [(1, 0, "user", "b", None, None), (2, 0, "user", "c", None, None), (2, 1, "user", "d", None, None)]
    found = chats.maximal_conversations(frame(rows, TURNS)).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.chat.count(chats.OPEN)) for r in found) == [(0, 1, 1), (0, 1, 1), (1, 1, 1), (2, 2, 2)]
    plan = chats.maximal_conversations(frame(rows[:5], TURNS)).collect()
    assert sorted(r.chat for r in plan) == sorted(f"<|im_start|>user\n{t}<|im_end|>\n" for t in ("a", "b", "c", ""))


def test_many_equal_beginnings(frame):
    rng = random.Random(4)
    rows, chats_of = [], {}
    for c in range(300):
        chats_of[c] = ["hello"] + rng.choices("ab", k=rng.randrange(5))
        rows += [(c, i, "user", t, None, None) for i, t in enumerate(chats_of[c])]
    found = {r.conv_id for r in chats.maximal_conversations(frame(rows, TURNS)).collect()}
    expected = {c for c, t in chats_of.items() if not any(u[: len(t)] == t and (len(u) > len(t) or d < c) for d, u in chats_of.items() if d != c)}
    assert found == expected


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    relation = duck.sql(queries.ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=str)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == expected


def test_native_plans_have_no_python(spark, sf):
    for name in ("op8_chats", "op10_urls"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_pipeline_equals_its_operators_by_hand(spark, sf):
    """Each stage against what its operator says of the stage's own input."""
    from fleetgauge.llm import bpe, decontaminate, langid, pii, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = {r.doc_id for r in langid.predict_languages(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    first = docs.where(docs.doc_id.isin(*good))
    firsts = {r.doc_id for r in simhash.near_duplicates(first).collect() if r.doc_id == r.component_id}
    second = first.where(first.doc_id.isin(*firsts))
    leaked = {r.doc_id for r in decontaminate.find_passages(second, benchmark).collect()}
    third = second.where(~second.doc_id.isin(*leaked))
    expected = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(pii.clean(third)).collect()}
    found = corpus_pipeline.run(spark, sf)
    assert ids(found) == sorted(good & firsts - leaked) and len(firsts) < len(good) and leaked
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in found.collect()} == expected
