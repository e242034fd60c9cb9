"""Streams against their batch twins, readers and writers on small files."""

import json

from pyspark.sql import functions as F

from evigrid.operators import jobs, limits
from evigrid.sources import files
from evigrid.streaming import jobs as streams


def events(spark, folder, name, df, parts=3):
    # Files in time order, one micro-batch each.
    for i in range(parts):
        df.where(F.col("id").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


PROGRESS = "job_id string, task_id string, id bigint, ts timestamp, node string, is_start boolean, interrupted boolean, has_error boolean, result_status string"


def progress(spark):
    return spark.range(300).select(
        (F.col("id") % 2).cast("string").alias("job_id"), (F.col("id") % 7).cast("string").alias("task_id"), "id", F.timestamp_seconds(F.col("id") * 30 + 1_700_000_000).alias("ts"),
        F.lit("ocr").alias("node"), (F.col("id") % 5 < 3).alias("is_start"), (F.col("id") % 11 == 0).alias("interrupted"), F.lit(False).alias("has_error"),
        F.when(F.col("id") % 4 == 0, "stopped_x").alias("result_status"))


def clock(spark, schema, seconds, **fixed):
    row = {"ts": F.timestamp_seconds(F.lit(seconds)), **{k: F.lit(v) for k, v in fixed.items()}}
    return spark.range(1).select(*[row.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])


def test_stage_timing_of_disordered_events_equals_batch(spark, tmp_path, rows):
    df = progress(spark)
    # an event comes up to eight minutes after younger ones
    come = F.floor((F.col("id") * 30 + F.pmod(F.xxhash64("id"), F.lit(480))) / 3200).cast("int")
    source = streams.feed(df, f"{tmp_path}/in", come, 4, clock(spark, PROGRESS, 1_700_020_000))
    out = streams.run_to_table(streams.stage_timing(source), f"{tmp_path}/out", f"{tmp_path}/state")
    cols = ["job_id", "task_id", "id", "phase", "duration_seconds"]
    assert rows(out, *cols) == rows(jobs.stage_durations(df), *cols)


def test_tasks_of_one_bucket_share_a_state(spark, tmp_path, rows):
    df = progress(spark).withColumn("node", F.when(F.col("id") % 5 > 0, F.col("node")))
    source = streams.feed(df, f"{tmp_path}/in", F.floor(F.col("id") / 100).cast("int"), 3, clock(spark, PROGRESS, 1_700_020_000))
    out = streams.run_to_table(streams.stage_timing(source, buckets=1), f"{tmp_path}/out", f"{tmp_path}/state")
    cols = ["job_id", "task_id", "id", "node", "phase", "duration_seconds"]
    assert rows(out, *cols) == rows(jobs.stage_durations(df), *cols)


def test_stages_go_on_from_a_batch_and_idle_starts_end(spark, tmp_path, rows):
    df = progress(spark)
    head, tail = df.where("id < 150"), df.where("id >= 150")
    assert streams.open_stages(head).count() > 0
    source = streams.feed(tail, f"{tmp_path}/in", F.lit(0), 1, clock(spark, PROGRESS, 1_700_020_000))
    out = streams.run_to_table(streams.stage_timing(source, started=streams.open_stages(head)), f"{tmp_path}/out", f"{tmp_path}/state")
    cols = ["job_id", "task_id", "id", "phase", "duration_seconds"]
    assert sorted(rows(out, *cols) + rows(jobs.stage_durations(head), *cols)) == sorted(rows(jobs.stage_durations(df), *cols))
    source = streams.feed(tail, f"{tmp_path}/in2", F.lit(0), 1, clock(spark, PROGRESS, 1_700_020_000))
    idle = streams.run_to_table(streams.stage_timing(source, idle_seconds=100), f"{tmp_path}/out2", f"{tmp_path}/state2")
    # the same by hand: a start ends as an error unless the next event of its task comes within 100 s
    want, by = [], {}
    for r in tail.orderBy("ts", "id").collect():
        by.setdefault((r.job_id, r.task_id), []).append((r.ts.timestamp(), r.id, r.is_start))
    for key, events in by.items():
        start = None
        for at, k, is_start in [*events, (1e12, None, None)]:
            if start and at >= start[0] + 100:
                want.append((*key, start[1], 100.0))
                start = None
            if is_start:
                start = (at, k)
            elif k is not None:
                want.append((*key, k, round(at - start[0], 1) if start else 0.0))
                start = None
    assert rows(idle, "job_id", "task_id", "id", "duration_seconds") == sorted(want, key=lambda r: tuple((x is not None, str(x)) for x in r))


def plain_limits(attempts, window, maximum):
    held, out = [], {}
    for at, k in sorted(attempts):
        held = [h for h in held if h > at - window]
        out[k] = (len(held) < maximum, 0 if len(held) < maximum else max(1, int(window - (at - held[0])) + 1))
        if out[k][0]:
            held.append(at)
    return out


def attempts(spark, n, every=1.0):
    return spark.range(n).select(F.lit("login").alias("operation"), F.when(F.col("id") % 10 == 0, "calm").otherwise("hot").alias("client"), F.col("id").alias("attempt_id"),
                                 F.timestamp_millis((1_700_000_000_000 + F.col("id") * every * 1000 + F.pmod(F.xxhash64("id"), F.lit(900))).cast("bigint")).alias("ts"))


def by_client(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.client, []).append((r.ts.timestamp(), r.attempt_id))
    return out


def test_limits_of_a_hot_client_equal_a_plain_loop(spark):
    for every, rule in ((0.5, (60, 5)), (0.01, (3, 40)), (45.0, (60, 1))):
        df = attempts(spark, 2000, every)
        want = {k: v for c, a in by_client(df).items() for k, v in plain_limits(a, *rule).items()}
        for windows in (1, 16):
            got = {r.attempt_id: (r.accepted, r.retry_after) for r in limits.limit_attempts(df, {"login": rule}, F.date_trunc("minute", "ts"), windows).collect()}
            assert got == want


def test_limits_stream_equals_batch_and_late_attempts_are_judged(spark, tmp_path, rows):
    df, rule = attempts(spark, 300, 5.0), {"login": (60, 5)}
    late = df.where("attempt_id % 50 = 7 AND attempt_id < 200")
    on_time = df.join(late, "attempt_id", "left_anti").select(df.columns)
    come = F.floor((F.col("attempt_id") * 5 + F.pmod(F.xxhash64("attempt_id"), F.lit(200))) / 600).cast("int")
    closing = clock(spark, "operation string, client string, attempt_id bigint, ts timestamp", 1_700_009_000, operation="login", client="hot").unionByName(
        clock(spark, "operation string, client string, attempt_id bigint, ts timestamp", 1_700_009_000, operation="login", client="calm")).unionByName(late)
    source = streams.feed(on_time, f"{tmp_path}/in", come, 3, closing.repartition(1))
    out = streams.run_to_table(streams.limited_attempts(source, rule, 300), f"{tmp_path}/out", f"{tmp_path}/state")
    decided, missed = out.where("reason IS NULL"), out.where("reason = 'late'")
    assert rows(decided, "attempt_id", "accepted", "retry_after") == rows(limits.limit_attempts(on_time, rule), "attempt_id", "accepted", "retry_after")
    assert rows(missed, "attempt_id") == rows(late, "attempt_id") and missed.where("accepted IS NOT NULL").count() == 0
    timed = [x.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))) for x in (missed, decided)]
    got = {r.attempt_id: (r.accepted, r.retry_after) for r in limits.judge_late(*timed, rule).collect()}
    # by hand: each late attempt against the accepted ones of its window
    want, taken = {}, {}
    for r in decided.where("accepted").collect():
        taken.setdefault(r.client, []).append(r.at)
    for r in missed.orderBy("at").collect():
        held = sorted(t for t in taken[r.client] if r.at - 60 < t <= r.at)
        want[r.attempt_id] = (len(held) < 5, 0 if len(held) < 5 else max(1, int(60 - (r.at - held[0])) + 1))
        if len(held) < 5:
            taken[r.client].append(r.at)
    assert got == want and {v[0] for v in want.values()} == {True, False}


def test_bounded_log_keeps_the_latest(spark, tmp_path, rows):
    df = spark.range(600).select((F.col("id") % 4).cast("string").alias("job_id"), "id", F.col("id").alias("ordinal"), F.lit("m").alias("message"))
    events(spark, tmp_path, "in", df, 6)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.bounded_log(source, f"{tmp_path}/log", f"{tmp_path}/state", keep=10, buckets=3).awaitTermination()
    assert rows(streams.current_log(spark, f"{tmp_path}/log"), "job_id", "ordinal") == rows(jobs.latest_log(df, 10), "job_id", "ordinal")
    assert all(len(list(b.glob("version=*"))) <= 2 for b in (tmp_path / "log").glob("bucket=*"))


def test_late_events_are_counted(spark, tmp_path):
    # the last comes two hours late, when a batch has decided what lies before it
    seconds = F.element_at(F.array(*[F.lit(x) for x in (0, 7200, 7300, 10)]), (F.col("id") + 1).cast("int"))
    df = progress(spark).where("id < 4").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + seconds))
    source = streams.feed(df, f"{tmp_path}/in", F.col("id").cast("int"), 4, clock(spark, PROGRESS, 1_700_020_000))
    counter = streams.LateRows()
    spark.streams.addListener(counter)
    try:
        streams.run_to_table(streams.stage_timing(source), f"{tmp_path}/out", f"{tmp_path}/state")
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        assert sum(counter.rows.values()) == 1
    finally:
        spark.streams.removeListener(counter)


def test_blocks_with_both_caption_forms(spark, tmp_path):
    (tmp_path / "doc1").mkdir()
    blocks = [{"type": "table", "page_idx": 2, "table_caption": ["Table 1", "more"]}, {"type": "image", "page_idx": 0, "image_caption": "Figure 2"}]
    (tmp_path / "doc1" / "content_list.json").write_text(json.dumps(blocks))
    got = files.read_blocks(spark, f"{tmp_path}/*/content_list.json").orderBy("seq").collect()
    assert [(r.doc_id, r.seq, r.page_idx) for r in got] == [("doc1", 0, 2), ("doc1", 1, 0)]
    assert got[0].table_caption == ["Table 1", "more"] and got[1].image_caption == ["Figure 2"]
    (tmp_path / "doc1" / "content_list.json").write_text(json.dumps([{"type": "text", "table_caption": "[1] Pin functions", "image_caption": [], "chart_caption": "[a]"}]))
    bare = files.read_blocks(spark, f"{tmp_path}/*/content_list.json").first()
    assert (bare.table_caption, bare.image_caption, bare.chart_caption) == (["[1] Pin functions"], [], ["[a]"])


def test_snapshots_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"device": "ADS1115", "pins": [{"pin_number": "1", "name": "ADDR"}]}))
    once = files.read_snapshots(spark, f"{tmp_path}/a.json")
    files.write_snapshots(once, f"{tmp_path}/out")
    again = spark.read.schema(once.schema).json(f"{tmp_path}/out")
    assert once.first()["pins"][0]["side"] == "unknown" and once.first()["conflicts"] == []
    assert once.select("device", "pins.name").collect() == again.select("device", "pins.name").collect()


def test_run_logs_keep_jobs_without_files(spark, tmp_path, rows):
    (tmp_path / "j1").mkdir()
    (tmp_path / "j1" / "build.log").write_text("a\nb")
    (tmp_path / "j1" / "wson8.log").write_text("SPMHA1-301")
    lines = files.read_run_logs(spark, str(tmp_path), spark.createDataFrame([("j1",), ("j2",)], "job_id string"))
    assert rows(lines, "job_id", "log_kind", "line_no", "text") == [
        ("j1", "build", 0, "a"), ("j1", "build", 1, "b"), ("j1", "symbol", 0, "SPMHA1-301"), ("j2", None, None, None)]


def test_corpus_takes_markdown_only(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.MARKDOWN.docx").write_text("no")
    for part in ("x", "y z"):
        (tmp_path / part).mkdir()
        (tmp_path / part / "README.MD").write_text(part)
    docs, rejects = files.read_corpus(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [("a", "# A"), ("x/README", "x"), ("y z/README", "y z")]
    assert [r.reason for r in rejects.collect()] == ["unsupported:docx"]


def test_golden_cases_explode(spark, tmp_path, rows):
    case = [{"case_id": "c", "required_dimensions": {"pitch": {"nominal": 0.5, "tolerance": 0.1}, "span": {"nominal": None, "tolerance": None}}}]
    (tmp_path / "g.json").write_text(json.dumps(case))
    assert rows(files.read_golden_cases(spark, f"{tmp_path}/g.json")[1], "field", "nominal") == [("pitch", 0.5), ("span", None)]


def test_chunk_sink_replaces_documents(spark, tmp_path, rows):
    schema = "id string, document_id string, content string, chunk_index int, updated_at bigint"
    first = spark.createDataFrame([("1", "a", "x", 0, 1), ("2", "a", "y", 1, 1), ("3", "b", "z", 0, 1)], schema)
    second = spark.createDataFrame([("4", "a", "new", 0, 2)], schema)
    for df in (first, second, second):
        files.write_chunks(df, f"{tmp_path}/chunks", buckets=4)
    assert rows(spark.read.parquet(f"{tmp_path}/chunks"), "id", "content") == [("3", "z"), ("4", "new")]


def test_reports_by_case(spark, tmp_path):
    files.write_reports(spark.createDataFrame([("c1", "ok"), ("c2", "bad")], "case_id string, status string"), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
