import random

import numpy as np
import xxhash

from fleetgauge.llm import simhash
from fleetgauge.llm.components import connected_components


def by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps, limit):
    label = dict.fromkeys(ids)
    for i in ids:
        label[i] = i
    moved = True
    while moved:
        moved = False
        for i in ids:
            for j in ids:
                if bin(fps[i] ^ fps[j]).count("1") <= limit and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    return label


def test_fingerprint_of_any_text():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "a b c", "É è\u00a0x Y", "w " * 30_000, *(" ".join(rng.choices("abcdefg", k=9)) for _ in range(20))]:
        assert simhash.fingerprint(text and text.encode()) % 2**64 == by_hand(text)


def test_components_equal_brute_force(frame):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    texts = base + [t.replace(t.split()[k], "zz", 1) for k, t in enumerate(base) for _ in range(3)] + base[:5] + [None, "", "  "]
    df = frame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    found = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: by_hand(t) for i, t in enumerate(texts)}
    expected = groups(range(len(texts)), fps, 4)
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == expected
    assert len(set(expected.values())) < len(texts) - 50


def test_links_are_whole_for_close_fingerprints(frame):
    rng = random.Random(3)
    fps = {0}
    for _ in range(60):  # clusters that share most bits, so that group values are hot
        centre = rng.getrandbits(20)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(8)}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = {(r.a, r.b) for r in simhash.links(frame([(f,) for f in fps], "fp long")).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) % 2**64).count("1") <= 4}
    assert found == near and near


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(4)
    widths, limit = [22, 21, 21], 4
    meets = np.cumsum(rng.integers(0, 10_000, (50, 3, limit + 1)), axis=2).astype(float)
    given = simhash.allocate(widths, meets, limit)
    assert (given.sum(axis=1) == limit - 3 + 1).all() and given.min() >= -1

    def cost(r, t):
        return sum(simhash.PROBE_COST * simhash.probes(w, x) + meets[r, i, x] for i, (w, x) in enumerate(zip(widths, t)) if x >= 0)

    ways = [(a, b, 2 - a - b) for a in range(-1, 5) for b in range(-1, 5) if -1 <= 2 - a - b <= 4]
    for r in range(50):
        assert cost(r, given[r]) == min(cost(r, t) for t in ways)


def test_empty_null_and_repeated(frame):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(frame([], schema)).collect() == []
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "q r s t"), (None, "only here today ok")]
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(frame(rows, schema)).collect())
    assert found == [(-1, -1), (-1, 7), (3, 3), (7, 7), (7, 7)]
    kept = sorted((r.doc_id or -1) for r in simhash.keep_firsts(frame(rows, schema)).collect())
    assert kept == [-1, 3, 7]  # the first row without an id is a copy of that of 7
    clash = [(1, "a b c d", 5, 6, "x"), (2, "a b c d", 7, 8, "y")]
    kept = simhash.keep_firsts(frame(clash, "doc_id long, text string, fp int, place int, row string"))
    assert [tuple(r) for r in kept.collect()] == [clash[0]]


def test_components_of_a_path_and_a_hub(frame):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, 2000 + i) for i in range(200)]
    noise = [(5, 5), (None, 1), (161, 160), (160, 161)]
    found = {r.node: r.component for r in connected_components(frame(path + hub + noise, "x long, y long")).collect()}
    assert all(found[i] == 100 for i in range(100, 162)) and all(found[2000 + i] == 1000 for i in range(200))
    assert len(found) == 62 + 201 and connected_components(frame([], "x long, y long")).count() == 0
