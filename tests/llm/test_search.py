"""Ranked search, centroid clustering and exact duplicates against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetgauge.llm import centroids, exact, lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, item_id string, rank int, size int, row string"
ITEMS = "item_id long, text string, doc_id string"


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_ranks(docs, items):
    held = [(i, Counter(plain_terms(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    number, total = len(held), sum(c.total() for _, c in held)
    spread = Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in dict.fromkeys(items):
        scores = []
        for doc, counts in held:
            m = 50 + 50 * counts.total() * number // total
            score = 0
            for t in set(plain_terms(text)) & counts.keys():
                score += math.floor(1000 * math.log((2 * number + 2) / (2 * spread[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:50])]
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["The", "a", "É", "naïve", "x1", *(f"w{i}" for i in range(300))]
    texts = [rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, k=rng.choice([1, 3, 20, 60]))) for _ in range(n)]
    texts += [None, "", "...", "w1 " * 50_000, *texts[:60], *texts[:60]]
    return [(i, t, "x", 1, 2, "r") for i, t in enumerate(texts)], texts


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("coordinates", [1024, 8])
def test_ranks_equal_brute_force(frame, monkeypatch, coordinates):
    """Also with sketches of few coordinates, where bounds lie far above the scores."""
    monkeypatch.setattr(lexical, "COORDINATES", coordinates)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 90)
    docs, texts = corpus(400, 1)
    docs += [(None, texts[0], "x", 1, 2, "r"), (3, texts[3], "x", 1, 2, "r")]
    items = [(1, texts[5], "d"), (1, texts[5], "d"), (1, "THE a x1", "d"), (2, None, "d"), (3, "", "d"), (4, "nowhere", "d"), (None, "É w7", "d"), (5, "w1 " * 3000, "d"), (6, texts[0], "d")]
    found = lexical.rank_documents(frame(docs, DOCS), frame(items, ITEMS))
    assert in_order(found.collect()) == in_order(plain_ranks(docs, [i for i in items if i[1] is not None]))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_items_in_several_passes_and_empty_tables(frame, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_ITEMS", 3)
    docs, texts = corpus(120, 2)
    items = [(i, texts[i], "d") for i in range(10)]
    assert in_order(lexical.rank_documents(frame(docs, DOCS), frame(items, ITEMS)).collect()) == in_order(plain_ranks(docs, items))
    assert lexical.rank_documents(frame([], DOCS), frame(items, ITEMS)).collect() == []
    assert lexical.rank_documents(frame(docs, DOCS), frame([], ITEMS)).collect() == []


def test_search_stops_at_the_threshold():
    """Bounds are never below the scores, and few documents are scored exactly."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    texts = [[w.encode() for w in rng.choices(words, k=80)] for _ in range(2000)]
    held = Counter(t for text in texts for t in set(text))
    items = [(i, b" ".join(texts[i][:20]).decode()) for i in range(5)]
    own = lexical.Searcher(items, 2000, 160_000, held)
    block = lexical.Block()
    for i, text in enumerate(texts):
        block.add(i, text)
    best = [lexical.Best() for _ in items]
    scored = lexical._rescore(block, own, best)
    assert scored < 5 * 700 and all(b.rows[0][2] == i and len(b.rows) == 50 for i, b in enumerate(best))


VECTORS = "vec_id long, embedding array<double>, cluster int, distance string"


def plain_clusters(rows, dim, clusters, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centre = [v for _, v in sorted(kept, key=lambda r: (*name(r[0]), r[1]))[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centre))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centre = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(centre)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, k, d in placed:
        inertia[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return [(i, k, d, inertia[k], inertia.total(), names[k]) for i, k, d in placed]


def test_clusters_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=20) + 3 * (i % 5)], 1, "x") for i in range(200)]
    rows += [(500 + i, rows[0][1], 1, "x") for i in range(60)] + [rows[1], rows[1]]
    rows += [(None, rows[2][1], 1, "x"), (900, None, 1, "x"), (901, [], 1, "x"), (902, [None] * 20, 1, "x"), (903, [math.inf] * 20, 1, "x"), (904, [math.nan] * 20, 1, "x"), (905, [1.0] * 19, 1, "x"), (906, [0.0] * 20, 1, "x")]
    found = centroids.cluster_vectors(frame(rows, VECTORS), dim=20, clusters=6, rounds=4)
    assert in_order(found.collect()) == in_order(plain_clusters(rows, 20, 6, 4))


def test_few_equal_and_no_vectors(frame):
    rows = [(i, [0.5, -0.5], 1, "x") for i in range(5)] + [(9, [7.0, 7.0], 1, "x")]
    for some in (rows, rows[:1]):
        found = centroids.cluster_vectors(frame(some, VECTORS), dim=2, clusters=8, rounds=3).collect()
        assert in_order(found) == in_order(plain_clusters(some, 2, 8, 3))
    assert centroids.cluster_vectors(frame([], VECTORS), dim=2).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(frame([(1, [1e9, 0.0], 1, "x")], VECTORS), dim=2)


def test_copies_equal_brute_force(frame):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abc", k=rng.randrange(8))) for _ in range(150)] + ["p" * 100 + t for t in "xxyz"]
    texts += [None, "", " \t\r\n\x0b\x0c", " ", "É é", "Éé", "w" * 200_000, "w " * 200_000]
    rows = [(i, t, "x", 1, 2, "r") for i, t in enumerate(texts)] + [(None, "a b", "x", 1, 2, "r"), (7, "lone", None, None, None, None), (7, "lone", None, None, None, None), (None, "only", "x", 1, 2, "r")]
    found = exact.find_copies(frame(rows, DOCS)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    expected = []
    for own in groups.values():
        best = min(own)
        for r in own:
            expected.append((None if r[1] else r[2], None if best[1] else best[2], len(own)))
    assert in_order((r.row.doc_id, r.keep_id, r.group_size) for r in found) == in_order(expected)
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.row.doc_id == r.keep_id for r in found if r.kept)
    assert set(found[0].row.asDict()) == {"doc_id", "item_id", "rank", "size", "row"}
    assert exact.find_copies(frame([], DOCS)).collect() == []
