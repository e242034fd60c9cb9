import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto", "tir") for b in ("dan", "fel", "gim", "hor", "jus", "kal", "lom", "net")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def prose():
    """prose(n, seed): n words of invented text with some line breaks."""
    def make(n, seed=0):
        pick = random.Random(seed)
        return "".join(pick.choice(WORDS) + ("\n" if k % 17 == 16 else " ") for k in range(n)).strip()
    return make


@pytest.fixture
def docs(spark):
    """docs(rows): documents from (doc_id, text) or full rows, with a column too many."""
    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src1", len(r[1]) if r[1] is not None else None))) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS key", "1 AS n", "'y' AS start")
    return make


@pytest.fixture
def table(spark):
    """table(df, key): rows by key as dictionaries."""
    def read(df, *keys):
        out = {}
        for r in df.collect():
            out.setdefault(tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]], []).append(r.asDict(recursive=True))
        return out
    return read
