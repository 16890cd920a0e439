import random

from fleetgauge.llm import decontaminate
from fleetgauge.llm.decontaminate import Items, edit_distance, edits_allowed


def edited(rng, words, kinds):
    """``words`` with as many edits as are allowed."""
    words, n = list(words), edits_allowed(len(words))
    for _ in range(n):
        kind, at = rng.choice(kinds), rng.randrange(len(words))
        words[at : at + (kind != "insert")] = [b"n%d" % rng.randrange(10**6)] * (kind != "delete")
    return words


def found_share(items, own, kinds, rng, copies=60):
    vocabulary, length = [b"w%d" % i for i in range(4000)], len(items[0][1])
    docs = [rng.choices(vocabulary, k=50) + edited(rng, items[k % 5][1], kinds) + rng.choices(vocabulary, k=50) for k in range(copies)]
    found = {(d, m["item_id"]): m for d, m in decontaminate._matches(docs, own)}
    assert all(m["distance"] <= edits_allowed(length) for m in found.values())
    return sum((d, d % 5) in found for d in range(copies)) / copies


def test_recall_at_the_limit_for_items_of_any_length():
    for length in (60, 300, 600):
        rng = random.Random(length)
        items = [(i, rng.choices([b"w%d" % i for i in range(4000)], k=length)) for i in range(5)]
        own = Items(items)
        for kinds in (["replace"], ["insert"], ["delete"], ["replace", "insert", "delete"]):
            assert found_share(items, own, kinds, rng) >= 0.95, (length, kinds)


def test_distances_of_all_starts():
    rng = random.Random(7)
    for _ in range(200):
        item, words = rng.choices(range(6), k=rng.randrange(1, 12)), rng.choices(range(6), k=rng.randrange(30))
        assert decontaminate.start_distances(item, words) == [edit_distance(item, words[k:])[0] for k in range(len(words))]
