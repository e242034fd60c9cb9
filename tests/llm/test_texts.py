"""HTML extraction, decontamination, quality rules, classifier, token files and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrid.llm import decontaminate as dc
from evigrid.llm import quality_classifier as qc
from evigrid.llm import quality_rules as qr
from evigrid.llm import token_files as tf
from evigrid.llm.html_text import page_texts, visible_text
from evigrid.llm.words import text_chunks

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b<br>c</div>": "a\nb\nc",
    "one <b>two\n</b> three&nbsp;&lt;": "one two three\xa0<",
    "<ul><li>x<li>y<ol start=3><li>p<li value=9>q</ol><li>z</ul>": "- x\n- y\n  3. p\n  9. q\n- z",
    "<ol reversed><li>x<li>y</ol>": "2. x\n1. y",
    "<table><tr><th>A<th>Long<th>C<tr><td rowspan=2>1<td>2<td>3<tr><td colspan=2>wide cell": "A  Long  C\n1  2     3\n   wide cell",
    "<table><td>l1<br>l2<td>r</table>": "l1  r\nl2",
    "<table><tr><td>o<td><table><tr><td>i<td>j</table></table>": "o  i  j",
    "<script>var t='</p>';</script><style>p{}</style>x<!-- y --><template>z</template>": "x",
    "<p hidden>a</p><p style='display: none'>b</p><div style='visibility:hidden'>c<i style='visibility:visible'>d</i></div>": "d",
    "<pre>  k\n   j</pre>": "  k\n   j",
    "<title>t</title><h1>h</h1>text": "h\n\ntext",
    "a < b <3 </ c> & d": "a < b <3 & d",
    "<a href=\"x>y\" title='>'>in</a>": "in",
    "<a href=\"never closed>in</a>": "in",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<p>a<table><caption>c</caption><tr><td>x</table>b": "a\n\nc\nx\n\nb",
    "": "", "   ": "", "<div></div>": "", "<": "<", "<b": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_layout(page):
    assert visible_text(page) == PAGES[page]


def test_broken_and_deep_pages_never_fail(spark):
    parts = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "x", "y ", "<b", "<!--", "-->", "<script>", "</script>", "&amp", "<a href=\"", "'>",
             ">", "<td colspan=3 rowspan=0>", "<ol reversed>", "</", "<pre>", "\n", "<svg>", "<br/>"]
    pick = random.Random(1)
    for _ in range(3000):
        visible_text("".join(pick.choice(parts) for _ in range(pick.randint(0, 25))))
    assert visible_text("<div>" * 4000 + "x" + "<ul><li>" * 4000 + "y") .replace("- ", "").split() == ["x", "y"]
    rows = spark.createDataFrame([(1, "<p>a", "u"), (1, "<p>a", "u"), (None, None, None), (2, "", "v")], "page_id long, html string, text string")
    assert sorted((tuple(r) for r in page_texts(rows).collect()), key=str) == [(1, "a"), (1, "a"), (2, ""), (None, "")]
    assert page_texts(rows.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [199, 250, 30000])
@pytest.mark.parametrize("opened", ["<div>", "<font>", "<a>"])
def test_depth_changes_nothing(opened, depth):
    inside = {"<script>var x</script><style>p{}</style>b": "b", "<i hidden>c</i><i style='display:none'>d</i>e": "e", "<div hidden><div>f</div>g</div>h": "h",
              "<ul><li>x<li>y</ul>": "- x\n- y", "<pre>  k\n   j</pre>": "  k\n   j", "<table><tr><td>1<td>2<tr><td>33<td>4</table>": "1   2\n33  4"}
    for page, want in inside.items():
        assert visible_text(opened * depth + page) == want
    assert visible_text("<b>" * 10 + "<div hidden>" + opened * depth + "<div>l</div>m</div>n") == ("" if opened == "<div>" else "n")


def plain_tiling(doc, item, least):
    """Greedy string tiling by trying all places again for every tile."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_d[i + n] and not used_i[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        used_d[i:i + n] = used_i[j:j + n] = [True] * n
        out.append(best)


@pytest.mark.parametrize("seed", range(5))
def test_tiling_equals_the_plain_one(seed):
    pick = random.Random(seed)
    for _ in range(25):
        item = [pick.randint(0, 3 if pick.random() < 0.5 else 30) for _ in range(pick.randint(0, 30))]
        cuts = sorted(pick.sample(range(len(item) + 1), min(3, len(item) + 1)))
        parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True)]
        pick.shuffle(parts)
        doc = [x for p in parts for x in p + [pick.randint(0, 30)]]
        got = dc.tiling(np.array(doc, np.uint64), np.array(item, np.uint64))
        assert got == plain_tiling(doc, item, dc.MIN_MATCH)


def test_leaks_moved_and_cut_by_both_joins(spark, docs, prose):
    items = [(k, prose(30, seed=200 + k)) for k in range(8)] + [(50, "too short"), (51, None), (None, prose(30, seed=999)), (0, prose(30, seed=200))]
    words = items[0][1].split()
    moved = " ".join(words[20:] + ["and"] + words[:10] + ["or"] + words[10:20])
    half, third = " ".join(words[:16]), " ".join(words[:9])
    rows = [(1, prose(60, seed=1) + " " + items[3][1].upper().replace("\n", ", ") + " " + prose(60, seed=2)), (2, prose(40, seed=3) + " " + moved), (3, half), (4, third),
            (5, prose(400, seed=5)), (6, None), (7, ""), (None, items[4][1]), (8, items[5][1] + " x " + items[6][1]), (8, items[5][1]), (9, items[8][1]), (10, items[10][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = {(1, 3), (2, 0), (3, 0), (None, 4), (8, 5), (8, 6), (10, None)}
    for limit in (dc.BENCHMARK_CHARS, 0):
        got = dc.leaks(docs(rows), benchmark, limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.coverage == r.covered / r.item_words >= dc.COVERAGE for r in got)
    assert dc.leaks(docs([]), benchmark).count() == 0 and dc.leaks(docs(rows), benchmark.limit(0)).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def quality_rows(prose):
    rows = [(k, prose(80 + k % 40, seed=k)) for k in range(300)]
    rows += [(1000 + k, " ".join(w + "***" for w in prose(90, seed=k).split())) for k in range(30)]
    return rows


def test_rules_statistics_and_verdicts(spark, docs, prose):
    odd = [(2000, None), (2001, ""), (2002, "a b c a b c"), (2003, "x\nx\n \nx"), (2004, "é é é\x0bé é é | #"), (2005, prose(30) + "\n" + prose(30)), (2006, "\n\n"), (None, prose(70))]
    rows = quality_rows(prose) + odd
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)] + [(1000 + k, 0, 0) for k in range(20)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = qr.quality_rules(docs(rows), labels).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = plain_statistics(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & set(range(300))) >= 297 and not kept & set(range(1000, 1030)) and None in kept
    bare = qr.quality_rules(docs(rows), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in bare) and qr.quality_rules(docs([]), labels).count() == 0


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (2000, 3)), [[8, 8, 8]]])
    scores = qr.forest_scores(qr.grow_forest(x[:1000]), x)
    assert scores[-1] > np.quantile(scores[:-1], 0.999) and 0.4 < np.median(scores) < 0.55


def test_odd_in_any_one_statistic_is_an_anomaly(spark, docs, prose):
    def page(k, digits=0, glued=1, twice=0):
        pick = random.Random(k)
        words = [w.capitalize() if pick.random() < 0.1 else w + "," * (pick.random() < 0.15) for w in prose(120 + k % 40, seed=k).split()]
        words = ["".join(words[i:i + glued]) for i in range(0, len(words), glued)]
        words[:digits] = [str(pick.randint(1000, 99999)) for _ in words[:digits]]
        return " ".join(words + words[:twice])
    usual = [(k, page(k, digits=30 // (k * 7 % 1200 + 1), twice=24 // ((k + 600) * 11 % 1200 + 1))) for k in range(1200)]
    low = [(2000 + k, " ".join(w + "***" for w in page(k).split())) for k in range(30)]
    odd = [(first + k, page(5000 + k, **how)) for first, how in ((3000, {"digits": 60}), (3100, {"glued": 2}), (3200, {"twice": 28})) for k in range(10)]
    labels = spark.createDataFrame([(k, int(k < 2000)) for k, _ in usual + low], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in qr.quality_rules(docs(usual + low + odd), labels).collect() if not (r.doc_id >= 3000 and r.base_failed)}
    assert sum(kept[k] for k, _ in usual) >= 1188 and not any(kept[k] for k, _ in low)
    for first in (3000, 3100, 3200):
        of = [v for k, v in kept.items() if first <= k < first + 100]
        assert of and not any(of), first


def test_quantiles_equal_sorted_values(spark):
    pick = np.random.default_rng(3)
    many = pick.random(3001)
    columns = {"a": many, "b": np.round(many, 2), "c": np.full(3001, 0.25), "d": 0.5 + many * 2.0 ** -40, "e": np.where(many < .9, 0.0, many)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns)).repartition(5)
    for at in (0.0, 0.31, 0.998, 1.0):
        got = qr.quantiles(df, list(columns), at)
        assert got == pytest.approx([np.quantile(v, at) for v in columns.values()], rel=1e-14, abs=0)
    assert qr.quantiles(df.limit(0), ["a"], 0.5) is None
    assert qr.quantiles(df.limit(1).select(F.lit(0.3).alias("a")), ["a"], 0.998) == [0.3]


def test_threshold_uses_labels_of_both_qualities(spark):
    def level(low):
        rows = [(1, *[0.3 + k / 10000] * len(qr.GROUPS)) for k in range(1000)] + [(0, *[low] * len(qr.GROUPS))] * 100
        frame = spark.createDataFrame(rows, "quality long, " + ", ".join(f"part{i} double" for i in range(len(qr.GROUPS))))
        levels, threshold = qr._calibrated(frame)
        return threshold, 0.5 + (low - levels[0]) / 2
    threshold, low = level(0.9)
    assert 0.4999 < threshold < 0.5001 < low
    threshold, low = level(0.397)  # under the level of good ones, and more than the good ones over it
    assert threshold < low
    assert level(0.31)[0] > 0.4999  # would cost more good ones than it finds


def labelled_rows(prose):
    rows, labels = [], []
    for k in range(900):
        text, bad = prose(60 + k % 50, seed=k), k % 5 == 0
        if bad:
            words = text.split(" ")
            words[7], words[20] = ("venom" + "abcdefgh"[k % 8] * 2), "scorn,"
            text = " ".join(words)
        rows.append((k, text, "en", "forum" if bad and k % 2 else f"src{k % 4}", len(text)))
        if k < 700:
            labels.append((k, 1, int(bad)))
    return rows, labels


def test_classifier_on_held_out_documents(spark, docs, prose):
    rows, labels = labelled_rows(prose)
    odd = [(2000, None, None, None, None), (2001, "", "en", "src1", 0), (None, prose(60, seed=4), "en", "src1", 400), (3, prose(60, seed=3), "en", "src1", 400)]
    known = spark.createDataFrame(labels + [(None, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = qc.classify(docs(rows + odd), known).collect()
    assert len(got) == len(rows) + len(odd) and {"key", "n", "start", "text", "score", "kept"} <= set(got[0].asDict())
    kept = {r.doc_id: r.kept for r in got}
    unseen = range(700, 900)
    assert sum(not kept[k] for k in unseen if k % 5 == 0) >= 36 and sum(kept[k] for k in unseen if k % 5) >= 157
    assert all(0 <= r.score <= 1 and 0 <= r.text_score <= 1 and 0 <= r.page_score <= 1 for r in got)
    assert all(r.kept for r in qc.classify(docs(rows[:20]), known.limit(0)).collect()) and qc.classify(docs([]), known).count() == 0


def test_views_teach_each_other(prose):
    import pandas as pd
    rows, _ = labelled_rows(prose)
    rows = [(k, t, la, "forum" if k % 5 == 0 else "src1", n) for k, t, la, _, n in rows]
    words, ratios = [], []
    for _, w, r in qc.text_features(pa.array([r[1] for r in rows])):
        words, ratios = words + w, ratios + list(r)
    sample = pd.DataFrame({"bad": [None if k >= 400 else float(k % 5 == 0) for k in range(900)], "lang": "en", "source": [r[3] for r in rows], "n_chars": [r[4] for r in rows],
                           "held": [k % 3 == 0 for k in range(900)], "words": [w.view(np.int64) for w in words], "ratios": ratios})
    model = qc.cotrain(sample)
    assert min(model["taught"]) > 50  # pseudo-labels of the pool went both ways


def read_back(rows, tokenizer):
    want, at = [], 0
    for d, t in sorted(((d is not None, d or 0), t or "") for d, t in rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, tf.END_ID], "<u4")
        want.append((d[1] if d[0] else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return want


def test_token_files_round_trip(spark, docs, prose, monkeypatch):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tf.tokenizer_path())
    monkeypatch.setattr(tf, "REMEMBERED", 50)
    rows = [(k * 3 % 40, prose(20 + k, seed=k)) for k in range(40)] + [(5, None), (6, ""), (7, " \n  two  spaces \t"), (8, "<|endoftext|> in <|endoftext|>"), (9, "😀 don't I'll 123  　x\x85y"),
                                                                    (None, "lost"), (None, None), (100, "again"), (100, "again"), (10**12, "last " * 3000)]
    manifest = tf.write_ids(docs(rows))
    got = sorted(tuple(r) for r in tf.read_digest(manifest).where("doc_id IS NOT NULL").collect())
    nulls = sorted(tuple(r) for r in tf.read_digest(manifest).where("doc_id IS NULL").drop("doc_id").collect())
    want = read_back(rows, tokenizer)
    assert got == sorted(w for w in want if w[0] is not None) and nulls == sorted(w[1:] for w in want if w[0] is None)
    assert tf.read_ids(spark, manifest, 100) == [[*tokenizer.encode("again").ids, 0]] * 2 and tf.read_ids(spark, manifest, 12345) == []
    assert tf.token_digest(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pieces_are_encoded_like_whole_texts(seed):
    encoder = tf.Encoder(tf.tokenizer_path())
    pick = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "’", "é", "ß", "1", "23", "!", "...", " ", "　", "\x1c", "\x85", "日本", "😀", "<|endoftext|>", "don't", " I'll", "\r\n"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(3000)]
    for some in text_chunks(pa.array([*texts, "", None])):
        ids, until = encoder.encode(some)
        got = [ids[a:b].tobytes() for a, b in zip(until[:-1], until[1:], strict=True)]
        assert got == [encoder.plain(t) for t in texts] + [b"", b""]


def test_pipeline_stages_equal_plain_versions(spark, docs, prose, tmp_path):
    import corpus_pipeline as cp
    rows, labels = labelled_rows(prose)
    item = prose(40, seed=5000)
    rows += [(3000, rows[1][1], "en", "src1", 1), (3001, rows[2][1] + " more", "en", "src2", 1), (3002, prose(50, seed=77) + " " + item, "en", "src1", 1), (3003, "", "en", "src1", 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(rows).select(*cp.DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append({r.doc_id for r in frame.collect()})
        assert k == len(cp.STAGES) - 1 or tuple(frame.columns) == cp.DOCUMENT, name
    good, single, clean, mixed, written = seen
    assert len(good & {k for k in range(900) if k % 5}) >= 710 and len(good & set(range(0, 900, 5))) <= 18
    assert good - single == {3000, 3001} & good and {1, 2} <= single
    assert single - clean == {3002} and mixed <= clean and written == mixed and len(mixed) > 100
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "mixing", "token_files"]
    assert cp.run(spark, str(tmp_path)).count() == spark.read.parquet(f"{tmp_path}/4.parquet").count()
