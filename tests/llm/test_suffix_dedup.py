import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from evigrid.llm import suffix_dedup as sd


def flags(texts, times, size):
    counts = Counter()
    for t, m in zip(texts, times, strict=True):
        for i in range(len(t) - size + 1):
            counts[t[i:i + size]] += m
    return [[counts[t[i:i + size]] > 1 for i in range(len(t) - size + 1)] for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_finds_all_repeats(seed):
    pick = random.Random(seed)
    for _ in range(60):
        letters = pick.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(pick.choice(letters) for _ in range(60))
        texts = []
        for _ in range(pick.randint(1, 6)):
            a = pick.randint(0, 50)
            t = base[a:a + pick.randint(0, 40)] + bytes(pick.choice(letters) for _ in range(pick.randint(0, 10)))
            texts.append(t if pick.random() < 0.8 else t + t)
        times = [pick.choice([1, 1, 2]) for _ in texts]
        size = pick.choice([1, 2, 5, 12])
        got = sd.repeated_windows([np.frombuffer(t, np.uint8) for t in texts], np.array(times), size)
        assert [list(map(bool, g)) for g in got] == flags(texts, times, size)


def test_common_prefixes_are_those_of_the_sorted_suffixes():
    text = b"mississippi$banana$ban"
    symbols = np.array([0 if b == 36 else b + 1 for b in text + b"$"])
    order = sd.suffix_order(symbols)
    got = sd.shared_prefixes(symbols, order, 4)
    ends = [text.find(b"$", i) if b"$" in text[i:] else len(text) for i in range(len(text) + 1)]
    rest = [text[i:ends[i]] for i in order]
    assert rest == sorted(rest)
    for k in range(1, len(order)):
        n = 0
        while n < min(len(rest[k]), len(rest[k - 1])) and rest[k][n] == rest[k - 1][n]:
            n += 1
        assert got[k] == min(n, 4)


def plain(rows, size):
    every = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(b[i:i + size] for _, b in every for i in range(len(b) - size + 1))
    out = []
    for d, b in every:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if counts[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(prose):
    shared = prose(90, seed=7)
    rows = [(k, prose(100 + 3 * k, seed=k)) for k in range(6)]
    rows += [(20 + k, prose(20, seed=30 + k) + " é" + shared + prose(5 + k, seed=60 + k)) for k in range(6)]
    rows += [(40 + k, rows[2][1]) for k in range(3)]
    rows += [(50, "a" * 3000), (51, "xy" * 700), (52, "abcdefgh " * 200 + "tail"), (53, None), (54, ""), (55, "short"), (56, "b" * 400), (57, "c" * 401)]
    rows += [(60, shared), (60, shared), (None, prose(100, seed=3)), (None, None)]
    return rows


def test_digest_equals_a_table_of_all_windows(docs, prose):
    rows = corpus(prose)
    got = sorted((tuple(r) for r in sd.suffix_dedup(docs(rows)).collect()), key=str)
    assert got == plain(rows, 400)


@pytest.mark.parametrize("block", [1500, 1])
def test_keys_too_large_for_a_block_are_cut_again(docs, prose, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK_BYTES", block)
    rows = corpus(prose)
    got = sorted((tuple(r) for r in sd.suffix_dedup(docs(rows)).collect()), key=str)
    assert got == plain(rows, 400)


def test_chunks_and_long_texts_keep_their_keys(prose):
    text = (prose(3000, seed=4) + "zz" * 500).encode()
    whole = np.frombuffer(text, np.uint8)
    alone = sd.pieces(whole, np.array([0, len(whole)]), 32)
    twice = sd.pieces(np.concatenate([whole[:777], whole]), np.array([0, 777, 777, 777 + len(whole)]), 32)
    of = twice[2] == 2
    assert [a.tolist() for a in (alone[0], alone[1], alone[3], alone[4], alone[5])] == [t[of].tolist() for t in (twice[0], twice[1], twice[3], twice[4], twice[5])]


def test_empty_table(docs):
    assert sd.suffix_dedup(docs([])).count() == 0
