"""Documents scored by two classifiers that teach each other: one sees the text, the other what is known about the page.

A document is to be rejected if its label has quality 0 or toxic 1.

1. Sample: at most LABELLED labelled and POOL other documents, those of the smallest md5 of the id. Their features are taken from whole texts.
   Training is one task over this bounded sample; a third of the labelled ones is held out.
2. Text view: the words (lower-cased, without punctuation) and the beginnings of words that separate the classes by WORD_Z standard deviations at least, and the
   text's ratios (symbols, capitals, repeats, ...) in bins. Page view: language, source and length in bins. Both are logistic
   regressions.
3. Co-training: in each of ROUNDS rounds each view names up to GIVEN of the pool of either class of which it is sure, a probability of SURE
   after calibration, and the other view learns them as labels.
4. Each view's logit is calibrated on the held-out documents (Platt), and the calibrated logits are combined by a regression on the same
   ones. A document is rejected over the score that all but LOST of the held-out good documents stay at or under, and over one
   half in any case.
5. All documents are scored where they lie; the model is some thousand numbers.

Defined cases: a null or empty text has no words and zero ratios. Null language, source and length are values of their own. Labels with a null id
are left out; of several labels of a document the worst counts. Rows that repeat a doc_id are scored each. Without labels of
both classes every score is the share of bad labels, and nothing is rejected. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import RATIOS, statistics
from .shared import settled
from .words import SEPARATOR, Words, mixed, text_chunks, word_hashes, words_of

LABELLED, POOL = 8000, 4000
#: Bytes of the beginnings of words that count as features
PREFIXES = (4, 5, 6, 7)
WORD_Z, MOST_WORDS = 5.0, 2000
#: Where the ratios are cut into bins: evenly, and finer at the top
QUANTILES = (*(k / 12 for k in range(1, 12)), 0.94, 0.96, 0.98, 0.99)
BINS = len(QUANTILES)
ROUNDS, SURE, GIVEN = 3, 0.97, 300
LOST = 0.003
SEED = 11
#: Ridge of the regressions
RIDGE = 0.3


def text_features(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """By chunk: first row, distinct hashes of the words of every row and of their first PREFIXES bytes, ratios."""
    for texts in text_chunks(column):
        words = words_of(texts, SEPARATOR)
        kinds = [word_hashes(texts, words, lower=True)]
        for n in PREFIXES:
            end = np.minimum(words.end, words.start + n)
            start = mixed(word_hashes(texts, Words(words.start, end, words.ptr), lower=True) + np.uint64(n))
            kinds.append(np.where(words.end - words.start > n, start, kinds[0]))
        ratios = statistics(texts)
        ratios["words"] = np.log1p(ratios["n_words"])
        grid = np.stack(kinds)
        yield texts.first, [np.unique(grid[:, words.ptr[k]:words.ptr[k + 1]]) for k in range(texts.n)], np.column_stack(
            [ratios[c] for c in (*RATIOS, "words")])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words, ratios in text_features(batch.column("text")):
            part = batch.slice(first, len(words))
            yield pa.RecordBatch.from_arrays([
                part.column("bad"), part.column("lang"), part.column("source"), part.column("n_chars"), part.column("held"),
                pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(list(ratios), pa.list_(pa.float64()))],
                ["bad", "lang", "source", "n_chars", "held", "words", "ratios"])


_FEATURES = "bad int, lang string, source string, n_chars long, held boolean, words array<long>, ratios array<double>"


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse:
    """Rows of small sets of columns, all of value 1."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def dot(self, w):
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g):
        return np.bincount(self.col, g[self.row], self.width)


def regress(x: Sparse, y: np.ndarray, weight: np.ndarray, steps: int = 250) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by gradients with a step for each column."""
    w, speed = np.zeros(x.width + 1), np.full(x.width + 1, 1e-8)
    for _ in range(steps):
        g = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight
        slope = np.append(x.back(g) + RIDGE * w[:-1], g.sum())
        speed += slope**2
        w -= 0.7 * slope / np.sqrt(speed)
    return w


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a logit into one of the observed rate; the slope is never negative."""
    scale = max(float(np.std(logit)), 1e-6)
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(60):
        z = a * logit / scale + b
        p = sigmoid(z)
        v = p * (1 - p) + 1e-6
        u = logit / scale
        hess = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum()]])
        step = np.linalg.solve(hess, [((p - t) * u).sum() + 1e-3 * a, (p - t).sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(a, 0.0) / scale, b


def page_columns(lang, source, n_chars) -> list[list[str]]:
    """Names of the page view's columns for every row."""
    size = [-1 if c is None or c != c else int(2 * np.log2(1 + max(c, 0))) for c in n_chars]
    return [[f"lang={a}", f"source={b}", f"size={c}"] for a, b, c in zip(lang, source, size, strict=True)]


class Views:
    """The columns of both views, learnt from the labelled rows."""

    def __init__(self, words: list[np.ndarray], ratios: np.ndarray, pages: list[list[str]], bad: np.ndarray):
        every = np.concatenate([*words, np.zeros(0, np.uint64)])
        owner = np.repeat(bad, [len(w) for w in words])
        names, at, count = np.unique(every, return_inverse=True, return_counts=True)
        hits, rate, n = np.bincount(at, owner, len(names)), bad.mean(), len(words)
        expected = count * rate
        z = np.abs(hits - expected) / np.sqrt(np.maximum(expected * (1 - rate) * (1 - count / (n + 1)), 1e-9) + 1e-9)
        chosen = np.flatnonzero((z >= WORD_Z) & (count >= 5))
        chosen = chosen[np.argsort(-z[chosen], kind="stable")[:MOST_WORDS]]
        self.words = np.sort(names[chosen])
        self.edges = [np.unique(np.quantile(r, QUANTILES)) for r in ratios.T]
        self.pages = {c: k for k, c in enumerate(sorted({c for p in pages for c in p}))}
        self.text_width = len(self.words) + len(self.edges) * (BINS + 1)
        self.page_width = len(self.pages)

    def text_row(self, words: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, words)
        at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == words)] if len(self.words) else at[:0]
        bins = [len(self.words) + k * (BINS + 1) + int(np.searchsorted(e, r, "right")) for k, (e, r) in enumerate(zip(self.edges, ratios, strict=True))]
        return np.concatenate([at, bins]).astype(np.int64)

    def page_row(self, names: list[str]) -> np.ndarray:
        return np.array([self.pages[c] for c in names if c in self.pages], np.int64)


def cotrain(sample: pd.DataFrame) -> dict:
    """The model; columns as in _FEATURES, bad null in the pool."""
    bad = sample.bad.to_numpy(float, na_value=np.nan)
    words = [np.asarray(w, np.int64).view(np.uint64) for w in sample.words]
    ratios = np.array(sample.ratios.to_list(), float).reshape(len(sample), len(RATIOS) + 1)
    pages = page_columns(sample.lang, sample.source, sample.n_chars.astype(object).where(sample.n_chars.notna(), None))
    known, held = ~np.isnan(bad), sample.held.to_numpy(bool)
    learn, test, pool = np.flatnonzero(known & ~held), np.flatnonzero(known & held), np.flatnonzero(~known)
    rate = float(np.nanmean(bad)) if known.any() else 0.0
    if any(len(np.unique(bad[some])) < 2 for some in (learn, test)):
        return {"rate": rate}
    views = Views([words[k] for k in learn], ratios[learn], [pages[k] for k in learn], bad[learn])
    rows = ([views.text_row(w, r) for w, r in zip(words, ratios, strict=True)], [views.page_row(p) for p in pages])
    widths, given, models = (views.text_width, views.page_width), [{}, {}], [None, None]
    whole = [Sparse(rows[v], widths[v]) for v in (0, 1)]
    for turn in range(ROUNDS + 1):
        sure = []
        for v in (0, 1):
            taught = np.array(sorted(given[v]), int)
            some = np.concatenate([learn, taught]).astype(int)
            y = np.concatenate([bad[learn], [given[v][k] for k in taught]])
            models[v] = regress(Sparse([rows[v][k] for k in some], widths[v]), y, np.ones(len(y)))
            logit = whole[v].dot(models[v][:-1]) + models[v][-1]
            slope, base = platt(logit[test], bad[test])
            p = sigmoid(slope * logit + base)
            order = pool[np.argsort(p[pool], kind="stable")]
            sure.append([(k, 0.0) for k in order[:GIVEN] if p[k] <= 1 - SURE] + [(k, 1.0) for k in order[::-1][:GIVEN] if p[k] >= SURE])
        if turn < ROUNDS:
            for v in (0, 1):
                given[1 - v].update((k, y) for k, y in sure[v])
    logits = [whole[v].dot(models[v][:-1]) + models[v][-1] for v in (0, 1)]
    scales = [platt(logits[v][test], bad[test]) for v in (0, 1)]
    two = np.column_stack([s * lg + b for lg, (s, b) in zip(logits, scales, strict=True)])
    mix = np.array([1.0, 0.0])
    prior = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    best = None
    for share in np.linspace(0, 1, 21):  # of the page view's evidence beyond the prior
        p = sigmoid(two[test, 0] + share * (two[test, 1] - prior))
        loss = -np.mean(bad[test] * np.log(p + 1e-9) + (1 - bad[test]) * np.log(1 - p + 1e-9))
        if best is None or loss < best - 1e-6:
            best, mix = loss, np.array([1.0, share])
    score = sigmoid(two[:, 0] + mix[1] * (two[:, 1] - prior))
    limit = max(0.5, float(np.quantile(score[test][bad[test] == 0], 1 - LOST, method="higher")))
    return {"rate": rate, "views": views, "models": models, "scales": scales, "share": float(mix[1]), "prior": prior, "limit": limit,
            "taught": [len(g) for g in given]}


def score_rows(model: dict, words: list[np.ndarray], ratios: np.ndarray, pages: list[list[str]]) -> np.ndarray:
    """text_score, page_score, score of every row."""
    n = len(words)
    if "views" not in model:
        return np.full((n, 3), model["rate"])
    views = model["views"]
    out = []
    for v, rows in enumerate(([views.text_row(w, r) for w, r in zip(words, ratios, strict=True)], [views.page_row(p) for p in pages])):
        x = Sparse(rows, (views.text_width, views.page_width)[v])
        slope, base = model["scales"][v]
        out.append(slope * (x.dot(model["models"][v][:-1]) + model["models"][v][-1]) + base)
    return np.column_stack([sigmoid(out[0]), sigmoid(out[1]), sigmoid(out[0] + model["share"] * (out[1] - model["prior"]))])


def _scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, ratios in text_features(batch.column("text")):
                part = batch.slice(first, len(words))
                pages = page_columns(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
                scores = score_rows(model, words, ratios, pages)
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(s) for s in scores.T], pa.array(
                    scores[:, 2] <= model.get("limit", 1.0))], ["row", "text_score", "page_score", "score", "kept"])
    return score


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, bad (0, 1): the worst of a document's labels."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    return labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).where(
        "bad IS NOT NULL").groupBy("doc_id").agg(F.max("bad").alias("bad"))


def _clean(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), *more)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    rows = _clean(docs)
    # ids first: the order needs no text
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").join(labelled(labels), "doc_id", "left")
    spot = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = ids.where("bad IS NOT NULL").orderBy(spot).limit(LABELLED).unionByName(ids.where("bad IS NULL").orderBy(spot).limit(POOL))
    picked = settled(picked.dropDuplicates(["doc_id"]))
    held = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(3)) == 0
    # at most LABELLED + POOL ids
    sample = rows.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).withColumn("held", held)
    features = sample.select("bad", "lang", "source", "n_chars", "held", "text").mapInArrow(_features, _FEATURES)
    found = settled(features).coalesce(1).mapInPandas(_train, "model binary").collect()  # one row
    import pickle
    return pickle.loads(found[0].model) if found else {"rate": 0.0}


def _train(frames):
    import pickle
    parts = [f for f in frames if len(f)]
    if parts:
        sample = pd.concat(parts, ignore_index=True)
        # the order of rows must not depend on how they came
        order = sample.assign(k=[hash((tuple(w[:8]), len(w))) for w in sample.words]).sort_values(["n_chars", "k", "source"], kind="stable").index
        yield pd.DataFrame({"model": [pickle.dumps(cotrain(sample.loc[order].reset_index(drop=True)))]})


def classify(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """All columns of docs and text_score, page_score, score (probabilities of being bad), kept; columns of docs with these names
    are replaced."""
    model = model or train(docs, labels)
    given = [c for c in docs.columns if c not in ("text_score", "page_score", "score", "kept")]
    rows = _clean(docs, F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"))
    shape = T.StructType([T.StructField("row", docs.select(*[F.col(f"`{c}`") for c in given]).schema)]
                         + [T.StructField(c, T.DoubleType()) for c in ("text_score", "page_score", "score")] + [T.StructField("kept", T.BooleanType())])
    scored = rows.drop("doc_id").mapInArrow(_scorer(model), shape)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in given], "text_score", "page_score", "score", "kept")
