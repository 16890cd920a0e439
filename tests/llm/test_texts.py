"""Language identification, personal data, decontamination, licences and tokens."""

import hashlib
import os
import random
import re
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetgauge.llm import bpe, decontaminate, langid, licenses, pii, tagger
from fleetgauge.llm.shared import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd_rows():
    return [
        (1, None, "en", None, None, "s", None), (2, "", None, "x", 0, None, "p"), (None, "the of and this", "en", "x", 1, None, None),
        (3, "123 ... ½ ²", "de", None, None, None, None), (4, "the of and\n" * 20_000, "en", "x", 1, None, None),
        (5, "der und die", "de", "x", 1, None, None), (5, "der und die", "de", "x", 1, None, None), (6, "a" * 50_000, "en", None, None, None, None),
    ]


# Language identification


def brute_word(word, names, chance):
    place = {n: i for i, n in enumerate(names)}
    alpha = [np.ones(chance.shape[1])]
    for j in range(1, len(word) + 1):
        ways = [alpha[i] * chance[place[word[i:j]]] for i in range(j) if word[i:j] in place]
        alpha.append(sum(ways) + alpha[j - 1] * langid.LETTER)
    return np.log(alpha[-1])


def test_forward_sums_all_segmentations():
    names = ["a", "b", "ab", "aba", "▁", "▁a", "▁ab", "cab"]
    chance = np.random.default_rng(1).dirichlet(np.ones(len(names)), 2).T
    words = ["▁abab", "▁a", "xyz", "▁cabab", "aab"]
    assert np.allclose(langid.word_scores(words, langid.Pieces(names), chance), [brute_word(w, names, chance) for w in words])


def test_expected_counts_are_the_gradient():
    names = ["a", "b", "ab", "▁", "▁a"]
    chance = np.random.default_rng(2).dirichlet(np.ones(len(names)))[:, None]
    pieces, words, counts = langid.Pieces(names), ["▁abab", "▁ba"], np.array([2, 3])
    found = langid.expected_counts(words, counts, pieces, chance)
    for k in range(len(names)):
        moved = chance.copy()
        moved[k] *= 1 + 1e-6
        change = (langid.word_scores(words, pieces, moved) - langid.word_scores(words, pieces, chance))[:, 0] @ counts
        assert abs(change / 1e-6 - found[k]) < 1e-3


def test_held_out_languages(docs):
    found = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 30 and np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert {r.held_out for r in docs.select((fold(4) == 2).alias("held_out")).collect()} == {True, False}


def test_language_of_odd_rows(frame):
    found = langid.predict_languages(frame(odd_rows(), DOCS)).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found)
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by_id[4].lang_pred == "en"
    assert not by_id[None].held_out
    assert langid.predict_languages(frame([], DOCS)).collect() == []
    unlabelled = frame([(1, "abc", None, None, None, None, None)], DOCS)
    assert [(r.lang_pred, r.score) for r in langid.predict_languages(unlabelled).collect()] == [("und", 0.0)]
    kept = langid.keep_identified(frame(odd_rows(), DOCS))
    assert kept.columns == frame([], DOCS).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "6", "None"]


def test_long_runs_of_letters_are_cut():
    words = langid.words_of("x" * 70 + " y²z")
    assert [len(w) for w in words] == [33, 32, 6, 2, 2] and [w[0] == "▁" for w in words] == [True, False, False, True, True]


# Personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            good = [True, k != 1 or max(map(int, m[0].split("."))) <= 255 if k == 1 else True, k != 2 or (16 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))), k != 3 or 8 <= n <= 15][k]
            if good:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_plain_patterns(docs):
    rng = random.Random(1)
    for _ in range(30_000):
        text = "".join(rng.choice("ab@@..12+- ()%é05") for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain_spans(text)
    for r in docs.collect():
        assert pii.base_spans(r.text) == plain_spans(r.text)
    for text in ("a" * 200_000, "1" * 200_000, "+1 " * 50_000, "a@" * 50_000, "1." * 50_000):
        pii.base_spans(text)


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    model = tagger.Tagger(3, embed=3, hidden=2, kind=np.float64)
    model.p = {k: rng.normal(0, 0.5, v.shape) for k, v in model.p.items()}
    chars, tags = rng.integers(0, 9, (4, 6)), rng.integers(0, 3, (4, 6))
    _, grad = model.loss(chars, tags)
    for k, v in model.p.items():
        at = tuple(rng.integers(0, min(s, 9)) for s in v.shape)
        kept, sides = v[at], []
        for step in (1e-5, -1e-5):
            v[at] = kept + step
            sides.append(model.loss(chars, tags)[0])
        v[at] = kept
        assert abs((sides[0] - sides[1]) / 2e-5 - grad[k][at]) < 1e-6


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    model = tagger.Tagger(3, kind=np.float64)
    model.p["move"], model.p["start"] = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(5, 3))

    def total(path):
        return model.p["start"][path[0]] + sum(scores[t, k] for t, k in enumerate(path)) + sum(model.p["move"][a, b] for a, b in pairwise(path))

    best = max(np.ndindex(*[3] * 5), key=total)
    assert tuple(model.decode(scores)) == best


def test_tagger_finds_what_it_learned(docs):
    model = pii.learn(docs)
    texts = [r.text for r in docs.collect()]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(texts, model, [[] for _ in texts])
    hit, all_base = sum(len({*a} & {*b}) for a, b in zip(alone, base)), sum(map(len, base))
    assert hit >= 0.8 * all_base > 0
    both = pii.added_spans(texts, model, base)
    assert all(e <= s2 or s >= e2 for m, b in zip(both, base) for _, s, e in m for _, s2, e2 in b)


def test_personal_data_of_odd_rows(frame, docs):
    rows = [*odd_rows(), (8, "x" * 100_000 + " joe.doe@mail.example.com " + "1.2.3.4 " * 3, "en", None, 5, None, None), (None, "+1 (555) 555-0199", "en", None, None, None, None)]
    found = pii.find(frame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    long = next(r for r in found if r.doc_id == 8)
    assert (long.n_email, long.n_ip, long.n_card, long.n_phone) == (1, 3, 0, 0)
    assert long.base.startswith("email:100001:100025,ip:100026:100033")
    cleaned = {r.doc_id: r for r in pii.clean(frame(rows, DOCS)).collect() if r.doc_id is not None}
    assert cleaned[8].text == "x" * 100_000 + " <EMAIL> " + "<IP> " * 3 and cleaned[8].n_chars == len(cleaned[8].text)
    assert cleaned[1].text is None and cleaned[2].text == "" and cleaned[5].n_chars == 1
    assert pii.find(frame([], DOCS)).collect() == [] and pii.clean(frame([], DOCS)).collect() == []


def test_cleaned_texts_hold_no_pattern(docs):
    cleaned = pii.clean(docs)
    assert cleaned.columns == docs.columns
    assert all(not pii.base_spans(r.text) for r in cleaned.collect())


# Decontamination


def plain_distance(item, window):
    column = list(range(len(item) + 1))
    best = (len(item), 0)
    for j, w in enumerate(window):
        fresh = [j + 1]
        for i, x in enumerate(item):
            fresh.append(min(column[i] + (x != w), column[i + 1] + 1, fresh[i] + 1))
        column = fresh
        best = min(best, (column[-1], j + 1), key=lambda b: b[0])
    return best


def test_edit_distance_equals_plain_columns():
    rng = random.Random(2)
    for _ in range(2000):
        item, window = [rng.choices(range(4), k=rng.randrange(low, 13)) for low in (1, 0)]
        assert decontaminate.edit_distance(item, window) == plain_distance(item, window)


def test_passages_are_found_with_and_without_edits(spark, frame, docs, sf):
    rng = random.Random(3)
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in benchmark.collect()]
    other = decontaminate.words_of(" ".join(r.text for r in docs.limit(40).collect()))
    rows, wanted = [], set()
    for share in (0.0, 0.1, 0.15):
        for item_id, words in items:
            words = list(words)
            for _ in range(int(share * len(words))):
                words[rng.randrange(len(words))] = rng.choice(other)
            at = rng.randrange(len(other) - 200)
            doc_id = len(rows)
            text = b" ".join(other[at : at + 80] + words + other[at + 80 : at + 160]).decode()
            rows.append((doc_id, text.upper() if share else text.replace(" ", ", \n"), "en", None, None, None, None))
            wanted.add((doc_id, item_id))
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_passages(frame(rows, DOCS), benchmark).collect()}
    assert len(wanted & found.keys()) >= 0.98 * len(wanted)
    # whatever is found is near enough, and no document holds an item it was not given
    assert all(r.distance <= decontaminate.edits_allowed(r.item_words) for r in found.values())
    assert {k for k in found if k not in wanted} == set()


def test_passages_in_odd_rows(frame):
    item = "one two three four five six seven eight nine ten"
    schema = "item_id long, text string, distance string"
    items = frame([(1, item, None), (2, item, None), (3, None, None), (4, "the of", None), (None, "x y z u v w", None)], schema)
    rows = [*odd_rows(), (9, "zero " + item, "en", None, None, None, None), (9, "zero " + item, "en", None, None, None, None), (10, "x y z u v w " * 10_000, None, None, None, None, None)]
    found = sorted((r.doc_id, r.item_id or -1, r.start_word) for r in decontaminate.find_passages(frame(rows, DOCS), items).collect())
    assert found == [(9, 1, 1), (9, 1, 1), (9, 2, 1), (9, 2, 1), (10, -1, 0)]
    kept = decontaminate.keep_clean(frame(rows, DOCS), items)
    assert kept.count() == len(rows) - 3 and kept.columns == frame([], DOCS).columns
    assert decontaminate.find_passages(frame([], DOCS), items).count() == 0
    assert decontaminate.find_passages(frame(rows, DOCS), frame([], schema)).count() == 0


# Licences


def test_licences_match_in_other_spelling(frame):
    mit = next(t for n, t in licenses.TEXTS if n == "MIT" and len(t) > 500)
    other = "Copyright (c) 2020-2024, Some One. All rights reserved.\n\n" + mit.upper().replace('"', "“").replace("SUBLICENSE", "sublicence").replace("\n", " \n ")
    rows = [
        (1, other), (2, "prose\nReleased under the mit license!\nmore"), (3, None), (4, ""), (5, "Copyright 1999 X"), (6, "word " * 50_000),
        (None, "Licensed under CC BY-NC 4.0."), (7, "prose with Released under the MIT License. inside"), (2, "prose\nReleased under the mit license!\nmore"),
    ]
    docs = frame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    found = sorted((r.doc_id or -1, r.line, r.license_id) for r in licenses.scan(docs).collect())
    assert found == [(-1, 0, "CC-BY-NC-4.0"), (1, 0, "MIT"), (2, 2, "MIT"), (2, 2, "MIT")]
    assert licenses.scan(docs.limit(0)).collect() == []
    assert licenses.scan(docs, licenses.known_licenses(docs.sparkSession, [], [])).collect() == []


# Tokens


def test_tokens_equal_the_library(docs, frame):
    path = public_tokenizers.path(bpe.VOCABULARY)
    library, coder = Tokenizer.from_file(path), bpe.Coder(path)

    def check(text):
        ids = library.encode(text, add_special_tokens=False).ids
        packed = coder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert coder.decode(packed) == library.decode(ids, skip_special_tokens=False)

    rng = random.Random(1)
    odd = ["a", "th", "é", "É", "İ", "ẞ", "Σ", "ς", " ", "\n", "\x1c", "\x85", "'s", "'S", "12", "½", "<|startoftext|>", "<|endoftext|>", "中", "😀", "\u0301", "-", "...", "\u00a0", "ǅ", "\x00", "ﬁ", "ª", "µ", "€", "ŉ"]
    for _ in range(5000):
        check("".join(rng.choices(odd, k=rng.randrange(12))))
    for text in ["", "ab" * 3000, "ha" * 400 + " " + "é" * 2000, *(r.text for r in docs.collect())]:
        check(text)
    rows = [*odd_rows(), (None, None, None, None, None, None, None)]
    found = bpe.digests(frame(rows, DOCS)).collect()
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        ids = expected[r.doc_id]
        if r.doc_id is not None:
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(frame([], DOCS)).collect() == []


def test_forced_cuts_lie_in_no_token():
    coder = bpe.Coder(public_tokenizers.path(bpe.VOCABULARY))
    parts = coder.cuts("qzxqéß".encode())
    assert b"".join(parts) == "qzxqéß".encode() and len(parts) > 1
    word = bpe.Coder.word
    assert word(coder, "xq") == word(coder, "xq")


def plain_form(text):
    """The canonical form, character by character."""
    kept = []
    for line in text.lower().splitlines():
        plain = "".join(c if c.isalnum() or c.isspace() else " " for c in line).split()
        owner = plain[:1] in (["copyright"], ["©"]) or line.strip().startswith(("(c) ", "©"))
        dated = any(w.isdigit() and len(w) == 4 for w in plain) or "(c)" in line or "©" in line or "<year>" in line or "[year]" in line or "[yyyy]" in line
        if (owner and dated) or plain == ["all", "rights", "reserved"]:
            continue
        kept += plain
    return " ".join(licenses.SPELLINGS.get(w, w) for w in kept)


def test_licenses_equal_brute_force_on_whole_documents(spark, sf):
    """Every text and every line of the table against every known text, without digests."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {(n, plain_form(t)) for n, t in licenses.TEXTS}
    expected = []
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        pieces = [(0, r.text or ""), *((i + 1, x) for i, x in enumerate(lines) if len(lines) > 1)]
        expected += [(r.doc_id, i, n) for i, piece in pieces for n, form in known if plain_form(piece) == form]
    found = [(r.doc_id, r.line, r.license_id) for r in licenses.scan(docs).collect()]
    assert sorted(found) == sorted(expected) and found


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts installed")
def test_listed_digests_are_those_of_the_installed_texts(frame):
    folder = "/usr/share/common-licenses"
    texts = {n: open(f"{folder}/{n}").read() for n in sorted(os.listdir(folder))}
    listed = dict(map(reversed, licenses.DIGESTS))
    shouted = [(i, t.upper().replace(",", " ;")) for i, t in enumerate(texts.values()) if licenses.digest(licenses.canonical(t)) in listed]
    found = licenses.scan(frame(shouted, "doc_id long, text string")).where("line = 0").collect()
    assert len(shouted) >= 10 and {r.doc_id for r in found} == {i for i, _ in shouted}
    plan = licenses.scan(frame(shouted, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
