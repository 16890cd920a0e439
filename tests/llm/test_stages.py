from fleetgauge.llm import langid, simhash


def test_unlabelled_documents_with_letters_stay(frame):
    schema = "doc_id long, text string, lang string"
    rows = [(i, f"some clean words {i}", None) for i in range(20)] + [(20, "123 ...", None), (21, "", None), (22, None, None)]
    kept = langid.keep_identified(frame(rows, schema))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20)) and kept.columns == ["doc_id", "text", "lang"]


def test_rows_that_share_an_id_stand_for_themselves(frame):
    first, second = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, first), (1, second), (1, second), (0, first.upper()), (2, second + " ")]
    kept = simhash.keep_firsts(frame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, first.upper()), (1, second)]
    kept = simhash.keep_firsts(frame([(1, first), (1, second), (1, second)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, first), (1, second)]
