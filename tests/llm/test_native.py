"""Chat formatting, line dedup and mixing: by their SQL and by plain versions on awkward rows."""

import hashlib
import time
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from evigrid.llm import chat_format, line_dedup, mixing

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\</s>b"), (1, 2, "assistant", "[NEXT] and [/INST]\\"), (1, 3, "user", None),
    (2, 0, None, "no role"), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, 5, "system", ""), (3, None, "user", "<\\s> <<SYS>> <|im_end|> x<s>"),
    (4, 1, "assistant", "ü😀\n</s><s>[INST]user[/INST]"), (None, 1, "user", "lost"), (5, 1, "we[/INST]ird", "[INST]"), (6, 1, "assistant", "")]


def plain_chat(rows):
    out = {}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_are_read_back(spark):
    rows = CHATS + chat_format.INTRUDER
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' AS t", "1 AS p")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.chat_digest(df).collect()}
    assert got == plain_chat(rows)


def test_turns_of_one_role_share_a_block_and_texts_are_escaped(spark):
    df = spark.createDataFrame(CHATS[:3], "conv_id long, turn long, role string, text string")
    r = chat_format.format_conversations(df).first()
    assert r.formatted == r"<s>[INST]user[/INST]hi</s><s>[INST]assistant[/INST]a\\<\/s>b[NEXT][\NEXT] and [\/INST]\\</s>"
    assert [r.formatted[s.first:s.first + s.n] for s in r.loss_spans] == [r"a\\<\/s>b", r"[\NEXT] and [\/INST]" + "\\\\"]
    assert chat_format.chat_digest(df.limit(0)).count() == 0


LINES = [
    (1, "A shared line of many words\nown one"), (2, "  a SHARED line of many words \t\nx"), (3, "a shared line of many words\n\na shared line of many words"),
    (4, "another line held by two only"), (5, "another line held by two only"), (6, ""), (7, None), (8, "\n"), (9, "short\nshort"), (10, "short"), (11, "short"),
    (12, "İİİİİİİİİİİİİİİİİİİİ\na shared line of many words\r"), (None, "a shared line of many words\nz"), (13, "\n\n\x0ba shared line of many words"),
    (14, "q" * 19), (15, "q" * 19), (16, "q" * 19), (17, "a shared line of many words")]


def plain_lines(rows):
    held, out = defaultdict(set), []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(lower)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((d is not None, d or 0))
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != (d is not None, d or 0) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(docs):
    got = sorted((tuple(r) for r in line_dedup.line_dedup(docs(LINES)).drop("runs").collect()), key=str)
    assert got == plain_lines(LINES)


def test_line_runs_hot_line_and_empty_table(docs):
    rows = [(k, f"the very same line in every one\nline number {k}\nthe very same line in every one\nthe very same line in every one") for k in range(300)]
    got = line_dedup.line_dedup(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=str) == plain_lines(rows)
    assert all([tuple(x) for x in r.runs] == ([] if r.doc_id == 299 else [(0, 1), (2, 2)]) for r in got)
    assert line_dedup.line_dedup(docs([])).count() == 0


MIX = [(k, " ".join(["w"] * (k % 7)), ["en", "de", None][k % 3], f"src{k % 5}" if k % 11 else None, 1) for k in range(160)] + [
    (7, "w w w", "en", "src1", 1), (7, "w w w", "en", "src1", 1), (None, "w w", "de", "src2", 1), (900, None, "en", "src1", 0)]


def test_mixing_equals_its_sql(docs):
    df = docs(MIX)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in MIX])
    cur = con.execute(mixing.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(((r[names.index("doc_id")], r[names.index("mix_epoch")], r[names.index("mix_start")], r[names.index("mix_take")]) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r) for r in mixing.mixed_documents(df).select("doc_id", "mix_epoch", "mix_start", "mix_take").collect()), key=str)
    assert got == want and got


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s1", 1000), ("b", "en", "s1", 1000), ("b", "en", "s2", 3)]
    targets = [("a", "en", "s1", 3), ("a", "en", "s2", 1), ("a", "de", "s1", 2), ("b", "en", "s1", 1), ("b", "en", "s2", 5), ("c", "en", "s1", 100)]
    budgets = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"),
                                  spark.createDataFrame(targets, "domain string, lang string, source string, weight long"), F.lit(600).cast("long"), 1)
    got = {(r.domain, r.lang, r.source): r.budget for r in budgets.collect()}
    # a and b weigh 6 each; a's en gets 200, of which s1 can take 10
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("a", "de", "s1"): 100, ("b", "en", "s1"): 297, ("b", "en", "s2"): 3}


def test_a_budget_of_all_tokens_reaches_siblings_and_second_epochs(docs, prose):
    # a source of little text weighs as much as the others of its kind, so it runs out and the rest of its share moves on
    rows = [(k, prose(200, k), "en", "src1", 1) for k in range(6)] + [(20 + k, prose(30, k), "en", "src2", 1) for k in range(2)] + [(40 + k, prose(100, k), "fr", "src3", 1) for k in range(5)]
    total = sum(len(r[1].split()) for r in rows)
    taken = mixing.mixed_documents(docs(rows), (1, 1)).collect()
    assert 0 <= total - sum(r.mix_take for r in taken) <= 60
    by_leaf = Counter()
    for r in taken:
        by_leaf[r.lang, r.source] += r.mix_take
    own = Counter()
    for r in rows:
        own[r[2], r[3]] += len(r[1].split())
    assert any(r.mix_epoch == 2 for r in taken) and all(n <= 2 * own[leaf] for leaf, n in by_leaf.items())
    assert any(by_leaf[leaf] > own[leaf] for leaf in own) and any(by_leaf[leaf] < own[leaf] for leaf in own)


def test_takes_fill_the_budgets(docs):
    taken = mixing.mixed_documents(docs(MIX)).collect()
    total = sum(len((r[1] or "").split()) for r in MIX)
    assert 0 <= total // 2 - sum(r.mix_take for r in taken) <= 60  # whole numbers at every node
    times = Counter((r.mix_domain, r.lang, r.source, r.mix_epoch) for r in taken)
    assert all(e == 1 or times[d, la, s, 1] for d, la, s, e in times)
    assert mixing.mixed_documents(docs([])).count() == 0


def test_a_very_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 1 OR id > 15000 THEN 'assistant' ELSE 'user' END AS role",
                                     "concat('é turn [INST] number ', id, repeat(' word', id % 40)) AS text")
    want = plain_chat([tuple(r) for r in rows.collect()])
    start = time.monotonic()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.chat_digest(rows).collect()}
    assert got == want and time.monotonic() - start < 30
    huge = spark.createDataFrame([(1, 1, "assistant", "x" * 3_000_000), (1, 2, "assistant", ""), (1, 3, "assistant", "[INST]" * 1000), (1, 4, "user", "a")], rows.schema)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.chat_digest(huge).collect()}
    assert got == plain_chat([tuple(r) for r in huge.collect()])
