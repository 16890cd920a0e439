import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetgauge.llm import lm

SCHEMA = "doc_id long, text string, score string, fold int"


def plain_tokens(text):
    return [*(text or "").encode().lower().split(), None]


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.mark.parametrize("listed", [lm.LISTED, 5])
def test_scores_equal_a_plain_model(spark, sf, monkeypatch, listed):
    """Whatever the number of words that all tasks know, each word is a context of its own."""
    monkeypatch.setattr(lm, "LISTED", listed)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lm.learn_model(lm.rows_of(docs))
    found = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    tokens = {r.doc_id: plain_tokens(r.text) for r in docs.collect()}
    words, pairs, starts = Counter(), Counter(), 0
    for i, ts in tokens.items():
        if not is_held_out(i):
            words.update(ts)
            starts += 1
            pairs.update(zip(["^", *ts], ts))
    n, kinds = sum(words.values()), len(words)
    assert len(model.words) == min(listed, kinds)
    for i, ts in tokens.items():
        base = score = 0.0
        for before, w in zip(["^", *ts], ts):
            base += math.log10((words[w] + 0.1) / (n + 0.1 * (kinds + 1)))
            seen = starts if before == "^" else words[before]
            mix = model.weights[math.frexp(seen)[1]]
            high = pairs[before, w] / max(seen, 1)
            score += math.log10(mix[0] * high + mix[1] * words[w] / n + mix[2] / (kinds + 1))
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(words[w] > 0 for w in ts), n, is_held_out(i))
        assert abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 1e-8
    out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weights_are_a_mixture_of_most_likelihood():
    rng = np.random.default_rng(1)
    cells = np.stack([np.full(300, 5), rng.integers(-50, 200, 300), rng.integers(-20, 100, 300), rng.integers(1, 9, 300)], axis=1).astype(float)
    weights = lm.learn_weights(cells)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0

    def likelihood(mix):
        return (np.log(np.exp(cells[:, 1] * lm.CELL) * mix[0] + np.exp(cells[:, 2] * lm.CELL) * mix[1] + mix[2]) * cells[:, 3]).sum()

    best = max((likelihood(m) for m in rng.dirichlet(np.ones(3), 2000)))
    assert likelihood(weights[5]) >= best - 0.5


def test_frequent_words_and_pairs_change_nothing(frame, monkeypatch):
    rows = [(i, "a b a b c d a b " * 40 + f"w{i} x{i % 7}", None, 1) for i in range(60)]
    df = frame(rows, SCHEMA)
    usual = {r.doc_id: r for r in lm.score_texts(df).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 1.0)
    other = {r.doc_id: r for r in lm.score_texts(df).collect()}
    assert usual.keys() == other.keys()
    for i, r in usual.items():
        assert (r.n_tokens, r.n_known) == (other[i].n_tokens, other[i].n_known)
        assert abs(r.base_score - other[i].base_score) < 1e-9 and abs(r.score - other[i].score) < 1e-9


def test_odd_rows(frame):
    rows = [(1, None, "s", 3), (2, "", None, None), (None, "a b", None, 1), (3, "a b " * 30_000, None, 1), (4, "a b", "x", 1), (4, "a b", "x", 1)]
    found = lm.score_texts(frame(rows, SCHEMA)).collect()
    assert len(found) == 6 and {r.train_tokens for r in found} == {sum(len(plain_tokens(t)) for i, t, *_ in rows if not is_held_out(i))}
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == [(-1, 3), (1, 1), (2, 1), (3, 60_001), (4, 3), (4, 3)]
    assert next(r for r in found if r.doc_id is None).held_out
    assert lm.score_texts(frame([], SCHEMA)).collect() == []
    alone = lm.score_texts(frame([(None, "a b", None, None)], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(3, 0, 0, 0.0, 0.0)]


def test_scored_bytes_do_not_grow_with_the_parts(frame):
    """A part passes on sums of the documents it has tokens of, not of all."""
    rows = lm.rows_of(frame([(i, " ".join(f"w{i * 7 + k}" for k in range(6)), None, 1) for i in range(600)], SCHEMA).repartition(2))
    model = lm.learn_model(rows)
    sent = lm._Sent(rows.sparkSession.sparkContext.broadcast(vars(model)))
    sizes = []
    for parts in (64, 1024):
        placed = lm.place_pairs(rows, sent, parts)
        sums = placed.groupBy("part").applyInArrow(lm._score_part(sent), lm.PLACED)
        sizes.append(sums.selectExpr("sum(length(docs) + length(sums) + length(known))").first()[0])
    assert sizes[1] <= 600 * 7 * 22 and sizes[1] < 1.3 * sizes[0]


def test_unlisted_contexts_of_held_out_rows_and_of_many_parts(frame, monkeypatch):
    """Scores are the same for any list and number of parts, with contexts never learned."""
    rows = [(i, f"a w{i} b x{i % 7} w{i + 1} a w{i}", None, 1) for i in range(80)] + [(None, "never seen w3 a", None, 1)]
    df = frame(rows, SCHEMA)
    usual = sorted((r.doc_id or -1, r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in lm.score_texts(df).collect())
    monkeypatch.setattr(lm, "LISTED", 2)
    monkeypatch.setattr(lm, "PART", 10)  # many parts, and several for a context
    assert usual == sorted((r.doc_id or -1, r.n_known, round(r.base_score, 8), round(r.score, 8)) for r in lm.score_texts(df).collect())
