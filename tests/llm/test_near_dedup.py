import itertools

import numpy as np
import pytest

from evigrid.llm import near_dedup as nd
from evigrid.llm.shared import components


def brute(rows):
    """Classes by comparing all texts, with plain dictionaries of shingles."""
    def profile(text):
        words = (text or "").split()
        out = {}
        for k in range(max(len(words) - 4, min(len(words), 1))):
            s = tuple(words[k:k + 5])
            out[s] = out.get(s, 0) + 1
        return out

    def jaccard(x, y):
        return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())

    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    known = [(d, profile(t)) for d, t in rows]
    for (a, x), (b, y) in itertools.combinations(known, 2):
        if x and y and jaccard(x, y) >= 0.8:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {d: root(d) for d in parent}


def edited(text, places):
    words = text.split(" ")
    for p in places:
        words[p % len(words)] = f"edit{p}"
    return " ".join(words)


def corpus(prose):
    rows = [(k, prose(60 + k, seed=k)) for k in range(20)]
    base = prose(200, seed=99)
    rows += [(100 + k, edited(base, [k * 7])) for k in range(12)]  # one by one from the base
    chain = base
    for k in range(8):  # each near the one before only
        chain = edited(chain, [11 + 23 * k])
        rows.append((200 + k, chain))
    rows += [(300 + k, rows[3][1]) for k in range(4)]
    rows += [(400, ""), (401, None), (402, " \n\t"), (403, "one"), (404, "one"), (405, "a b c d e"), (406, "a b c d e f")]
    rows += [(500, "\n".join(["same line of five words"] * 30)), (501, "\n".join(["same line of five words"] * 31))]
    return rows


def test_classes_equal_all_pairs(spark, docs, prose, table):
    rows = corpus(prose)
    got = table(nd.near_duplicates(docs(rows)), "doc_id")
    want = brute(rows)
    assert {d: r[0]["class_id"] for d, r in got.items()} == want
    assert all(len(r) == 1 and r[0]["class_size"] == list(want.values()).count(r[0]["class_id"]) for r in got.values())


@pytest.mark.parametrize("block", [3])
def test_blocks_of_any_size_give_the_same_classes(spark, docs, prose, table, monkeypatch, block):
    rows = corpus(prose)
    base = prose(80, seed=5)
    rows += [(600 + k, edited(base, [3 * k, 40 + 2 * k])) for k in range(15)]
    monkeypatch.setattr(nd, "BLOCK", block)
    got = table(nd.near_duplicates(docs(rows)), "doc_id")
    assert {d: r[0]["class_id"] for d, r in got.items()} == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark, docs, prose, table):
    one, two, three = (prose(50, seed=k) for k in (1, 2, 3))
    got = table(nd.near_duplicates(docs([(1, one), (1, one), (2, two), (2, three), (3, two), (4, three), (None, one)])), "doc_id")
    assert {d: r[0]["class_id"] for d, r in got.items()} == {1: 1, 2: 2, 3: 2, 4: 2} and all(len(r) == 1 for r in got.values())
    assert nd.near_duplicates(docs([])).count() == 0


def test_registers_estimate_the_probability_jaccard(prose):
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 600, dtype=np.uint64)
    x, y = np.sort(h[:400]), np.sort(h[100:500])
    cx, cy = rng.integers(1, 6, 400), rng.integers(1, 6, 400)
    m = 4096
    a = nd.registers(x, np.zeros(400, int), cx, 1, m)
    b = nd.registers(y, np.zeros(400, int), cy, 1, m)
    want = nd.similarity((x, cx), (y, cy))
    assert abs(np.mean(a == b) - want) < 0.03
    # scaled weights leave the similarity as it is, and one shingle fills all registers
    assert nd.similarity((x, cx), (x, 3 * cx)) == pytest.approx(1)
    assert np.all(nd.registers(h[:1], np.zeros(1, int), np.array([2]), 2, 16)[0] == np.uint32(h[0] >> np.uint64(32)))


def test_similarities_of_blocks_equal_those_of_pairs(prose):
    texts = [prose(40, seed=1), edited(prose(40, seed=1), [5]), "x y z x y z x y z x y z", "", prose(40, seed=2) + " " + prose(20, seed=1)]
    profiles = [nd.profile_of(t) for t in texts]
    want = [[nd.similarity(a, b) for b in profiles] for a in profiles]
    assert nd.similarities(profiles, profiles) == pytest.approx(np.array(want))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(9, 9), (8, 7), (7, 8), (6, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 540)}, 6: 6, 7: 6, 8: 6}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
