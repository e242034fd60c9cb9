"""Source divergence, centroid clusters and fingerprints: by their SQL and by plain versions on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest

from evigrid.llm import centroids, divergence, fingerprints

WORDY = [
    (1, "The cat, the Dog", "en", "a", 1), (2, "the cat the bird\x7fcat", "en", "b", 1), (3, "the cat the bird\x7fcat", "en", "b", 1), (4, "the cat the bird\x7fcat", "en", "c", 1),
    (5, "The dog_dog 12 ÉTÉ été", "en", "c", 1), (6, None, "en", "a", 1), (7, "", None, None, 1), (8, "42 !!", "de", "x", 1), (9, "eins zwei", "de", "x", 1),
    (None, "dog bird", "en", None, 1), (1, "the bird", "en", "a", 1), (11, "été É é", "fr", "a", 1), (12, "été É é", "fr", "b", 1), (13, "été É é", "fr", "b", 1)]


def plain_divergence(rows, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, by = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        held[lang or ""].update(set(words))
        by[lang or "", source or ""].update(words)
    out = []
    for (lang, source), counts in by.items():
        kept = [t for t, n in held[lang].items() if n >= 3]

        totals = {}

        def share(c, t, kept=kept, totals=totals):
            if id(c) not in totals:
                totals[id(c)] = sum(c[x] for x in kept) + len(kept)
            return 1 + 10**9 * (c[t] + 1) // totals[id(c)]

        whole = sum((c for (x, _), c in by.items() if x == lang), Counter())
        pairs = [(-sum((share(counts, t) - share(c, t)) ** 2 // share(c, t) for t in kept), s.encode()) for (x, s), c in by.items() if x == lang and s != source]
        terms = [(-((share(counts, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode()) for t in kept if counts[t] and share(counts, t) > share(whole, t)]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(items)]
    return sorted(out)


def test_divergence(docs):
    df = docs(WORDY).selectExpr("*", "1 AS m", "'q' AS held", "2 AS total")
    got = sorted(tuple(r) for r in divergence.divergence(df).collect())
    assert got == plain_divergence(WORDY)
    assert [r for r in got if r[:3] == ("", "", "pair")] == []
    assert divergence.divergence(df.limit(0)).count() == 0
    assert len([r for r in divergence.divergence(df, top=1).collect() if r.part == "term"]) == len({r[:2] for r in got if r[2] == "term"})


def test_divergence_of_a_text_that_many_sources_repeat(docs, prose, spark):
    same, rows = prose(400), []
    for k in range(120):
        rows.append((k, same if k % 3 else prose(60, k), "en" if k % 2 else "fr", f"s{k % 7}", 1))
    long = "".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " for k in range(700_000))  # over one block
    rows += [(200, long, "en", "s0", 1), (201, long, "en", "s1", 1), (202, long, "en", "s1", 1)]
    assert sorted(tuple(r) for r in divergence.divergence(docs(rows).repartition(3)).collect()) == plain_divergence(rows)
    assert divergence.distinct_texts(docs(rows)).count() == 2 + 40 + 1


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**17 - 1 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if groups[i] else c for i, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, c in found:
        sums[c] += d
    return sorted(((i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c in found), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_clusters_by_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(k % 5, 0.5, 64)], 1) for k in range(90)]
    rows += [(7, rows[3][1], 1), (None, rows[4][1], 2), (100, rows[5][1][:63], 1), (101, None, 1), (102, [*rows[5][1][:63], None], 1), (103, [*rows[5][1][:63], float("nan")], 1),
             (104, [*rows[5][1][:63], float("inf")], 1), (105, [*rows[5][1][:63], 1e30], 1), (106, [], 1), (107, [-1e5] * 64, 0)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'c' AS cluster", "1 AS v", "2 AS n")
    want = plain_clusters([(i, v) for i, v, _ in rows])
    assert sorted((tuple(r) for r in centroids.centroid_clusters(df).collect()), key=str) == want
    assert sorted((tuple(r) for r in centroids.centroid_clusters(df.repartition(7)).collect()), key=str) == want
    few = df.where("vec_id < 3")
    assert sorted((tuple(r) for r in centroids.centroid_clusters(few).collect()), key=str) == plain_clusters([(i, v) for i, v, _ in rows[:3]])
    none = centroids.centroid_clusters(df.limit(0))
    assert none.count() == 0 and none.dtypes == centroids.centroid_clusters(few).dtypes


@pytest.mark.parametrize("k", [1, 2, 3, 9, 200])
def test_tree_search_meets_the_smallest_number_at_the_same_distance(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-3, 4, (k, 5))  # many equal distances and equal centroids
    x = rng.integers(-4, 5, (700, 5))
    number, best = centroids.Tree.over(points).nearest(x)
    gaps = ((x[:, None] - points[None]) ** 2).sum(2)
    assert (best == gaps.min(1)).all() and (number == gaps.argmin(1)).all()
    far = points * (1 << 24)
    number, best = centroids.Tree.over(far).nearest(x * (1 << 24))
    assert (number == gaps.argmin(1)).all() and (best == gaps.min(1) << 48).all()


def test_tree_search_leaves_out_far_centroids(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.normal(0, 1000, (64, 3)).astype(np.int64)
    tree, met = centroids.Tree.over(points), []
    plain = tree._meet
    monkeypatch.setattr(tree, "_meet", lambda x, rows, *rest: met.append(len(rows)) or plain(x, rows, *rest))
    tree.nearest(points[rng.integers(0, 64, 500)])
    assert sum(met) < 500 * 64 / 2


def shingles(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_of_edited_and_next_texts(docs, prose):
    rows = [(k, prose(30 + 40 * (k % 9), k)) for k in range(60)]
    rows += [(60, prose(400)), (61, prose(400)), (62, None), (63, ""), (64, "one"), (65, "é😀 ü"), (66, " \n "), (-5, prose(20, 3)), (None, "lost text here"), (None, None),
             (7, prose(50, 99)), (7, prose(50, 99)), (70, prose(200_000, 8)), (71, prose(200_000, 8) + "x")]
    got = fingerprints.fingerprint_digest(docs(rows).repartition(5)).collect()
    order = sorted(((d is None, -(d or 0)), t or "") for d, t in rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    single = defaultdict(list)
    for place, text in order:
        single[place].append(text)
    places = sorted(single)
    found = {r.doc_id: r for r in got}
    checked = 0
    for at, place in enumerate(places):
        after = single[places[(at + 1) % len(places)]]
        if len(single[place]) > 1 or len(set(after)) > 1:
            continue
        text, r, half = single[place][0], found[None if place[0] else -place[1]], len(single[place][0]) // 2
        edited = text[:len(text) - half] + after[0][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(text), shingles(edited))) < 0.16 and abs(r.near_next - jaccard(shingles(text), shingles(after[0]))) < 0.16
        checked += 1
    assert checked > 60
    assert found[60].fingerprint == found[61].fingerprint and found[61].near_next == 1.0 and found[62].fingerprint == found[63].fingerprint == "f" * 512
    assert found[71].near_next > 0.95
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs(rows)).collect()}
    assert all(plain[d] == r.fingerprint for d, r in found.items() if d not in (None, 7))


def test_fingerprints_don_t_depend_on_partitions(docs, prose, spark, monkeypatch):
    rows = [(k, prose(40, k)) for k in range(50)] + [(None, prose(40, k)) for k in range(30)] + [(9, prose(30, k)) for k in range(30)]
    one = sorted(map(str, fingerprints.fingerprint_digest(docs(rows).repartition(1)).collect()))
    monkeypatch.setattr(fingerprints, "PARTS_PER_TASK", 20)
    monkeypatch.setattr(fingerprints, "CHUNK", 500)
    assert sorted(map(str, fingerprints.fingerprint_digest(docs(rows).repartition(6)).collect())) == one
    r = fingerprints.fingerprint_digest(docs([(3, "a b c d")])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert fingerprints.fingerprint_digest(docs([])).count() == 0
    likely = fingerprints.fingerprint_digest(docs(rows)).select("near_edited", fingerprints.likeness(
        fingerprints.F.col("fingerprint"), fingerprints.F.col("edited_fingerprint")).alias("again")).collect()
    assert all(x.near_edited == x.again for x in likely)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    for size, common in ((50, 40), (3000, 1000), (60_000, 50_000), (60_000, 0)):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a, b = pool[:size], np.concatenate([pool[:common], pool[size:2 * size - common]])
        s = fingerprints.signatures(np.concatenate([a, b]), np.array([0, size, 2 * size]), 512)
        assert abs((s[0] == s[1]).mean() - common / (2 * size - common)) < 0.08


def test_near_copies_by_all_pairs(docs, prose, monkeypatch):
    rows, base = [], prose(120, 1).split()
    for k in range(40):  # a chain and a cloud of near copies of one text
        rows.append((k, " ".join(base[:100 - k] + [f"x{k}{j}" for j in range(k % 8)] + base[100 - k:])))
    rows += [(100 + k, prose(80, k)) for k in range(30)] + [(200, prose(80, 3).replace(" ", "\t")), (201, None), (202, "\n"), (203, "two words"), (204, "two words"), (None, prose(80, 4))]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        return k if root[k] == k else top(root[k])

    links = defaultdict(set)
    for a, b in combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            root[top(b)] = top(a)
            if sets[a] != sets[b]:
                links[a].add(frozenset(sets[b]))
                links[b].add(frozenset(sets[a]))
    ids = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(k)].append(d)
    want = sorted(((d, min(ids[top(k)]), len(links[k])) for k, (d, _) in enumerate(rows)), key=str)
    for block in (256, 7):
        assert sorted((tuple(r) for r in fingerprints.near_copies(docs(rows), block=block).collect()), key=str) == want
    assert fingerprints.near_copies(docs([])).count() == 0


@pytest.mark.parametrize("module, table, rows", [(divergence, "documents", WORDY), (centroids, "embeddings", None)])
def test_sql_on_small_tables(module, table, rows, spark, docs):
    con = duckdb.connect()
    if rows:
        df = docs([r for r in rows if r[0] is not None])
        con.register(table, df.toPandas().astype({"n_chars": "int64"}).where(lambda x: x.notna(), None))
        got = divergence.divergence(df)
    else:
        rng = np.random.default_rng(2)
        df = spark.createDataFrame([(k, [float(x) for x in rng.normal(0, 1, 64 if k % 9 else 12)], 1) for k in range(60)], VECTORS)
        con.register(table, df.toPandas())
        got = centroids.centroid_clusters(df)
    want = con.sql(module.SQL)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
