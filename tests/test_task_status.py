"""Task status by keyed state: several batches, messages, the timer, batch equals stream."""

import time

from axiomloom.streaming import status as st
from axiomloom.streaming.progress import read_log, read_results

SCHEMA = "task_id long, run_status string"
OUT = ["task_id", "success_count", "fail_count", "total_count", "task_status"]


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def folders(tmp_path):
    return [str(tmp_path / name) for name in ("in", "out", "state")]


def test_a_task_runs_until_its_total_has_arrived(spark, rows, tmp_path):
    source, out, state = folders(tmp_path)
    tasks = spark.createDataFrame([(1, 3), (2, 2), (2, 1), (3, None), (4, 9), (5, 4), (6, 0)], "task_id long, total_count long")
    schema = spark.createDataFrame([], SCHEMA).schema
    sent = []

    def run(part):
        sent.extend(part)
        arrive(spark, source, part)
        stream = read_results(spark, source, schema, 1)
        return rows(st.run_task_status(stream, tasks, out, state), *OUT)

    first = run([(1, "success"), (2, "success"), (2, "failed"), (3, "success"), (4, "failed"), (5, "success")])
    assert first == [(1, 1, 0, 3, "running"), (2, 1, 1, 2, "completed"), (3, 1, 0, None, "running"),
                     (4, 0, 1, 9, "running"), (5, 1, 0, 4, "running")]
    run([(1, "success"), (4, "load_failed"), (6, None)])
    last = run([(1, "success"), (5, "stopping"), (7, "success"), (2, "success")])
    assert last == [(1, 3, 0, 3, "success"), (2, 2, 1, 2, "completed"), (3, 1, 0, None, "running"), (4, 0, 9, 9, "failed"),
                    (5, 1, 0, 4, "stopped"), (6, 0, 1, 0, "completed"), (7, 1, 0, None, "running")]
    whole = st.task_status(spark.createDataFrame(sent, SCHEMA), tasks)
    assert rows(whole, *OUT) == last
    history = read_log(spark, out, whole.schema)
    assert [s for _, s in rows(history.filter("task_id = 1"), "batch_id", "task_status")] == ["running", "running", "success"]


def test_hot_task_null_task_and_extra_columns(spark, tmp_path):
    source, out, state = folders(tmp_path)
    data = spark.range(30_000).selectExpr(
        "case when id % 3 = 0 then null when id % 3 = 1 then 1L else id end as task_id",
        "case when id % 2 = 0 then 'success' else 'failed' end as run_status", "id as total_count", "'x' as stops")
    data.repartition(4).write.parquet(source)
    tasks = spark.createDataFrame([(1, 10_000), (None, 10_001)], "task_id long, total_count long")
    got = st.run_task_status(read_results(spark, source, data.schema, 2), tasks, out, state)
    want = st.task_status(data, tasks)
    assert got.count() == 10_002 and got.exceptAll(want).count() == 0
    ended = {r["task_id"]: tuple(r)[1:] for r in got.filter("task_id = 1 or task_id is null").collect()}
    assert ended == {1: (5000, 5000, 10_000, "completed"), None: (5000, 5000, 10_001, "running")}
    assert st.task_status(data.limit(0), tasks).count() == 0


def test_timer_stops_a_silent_task_and_a_result_wakes_it(spark, rows, tmp_path):
    source, out, state = folders(tmp_path)
    tasks = spark.createDataFrame([(1, 2), (2, 5)], "task_id long, total_count long")
    schema = spark.createDataFrame([], SCHEMA).schema

    arrive(spark, source, [(1, "success")])
    query, frame = st.watch_task_status(read_results(spark, source, schema, 1), tasks, out, state, 300, "1 second")

    def until(want):
        for _ in range(60):
            time.sleep(1)
            assert query.isActive, query.exception()
            if query.lastProgress and rows(st.newest_status(frame, out), *OUT) == want:
                return True
        return False

    try:
        assert until([(1, 1, 0, 2, "stopped")])
        arrive(spark, source, [(1, "success"), (2, "failed"), (2, "success")])
        assert until([(1, 2, 0, 2, "success"), (2, 1, 1, 5, "stopped")])
    finally:
        query.stop()


def test_without_a_timer_no_python_is_called_per_task(spark, tmp_path):
    source, out, state = folders(tmp_path)
    spark.range(5).selectExpr("id as task_id", "'success' as run_status").write.parquet(source)
    stream = read_results(spark, source, spark.read.parquet(source).schema, 1)
    tasks = spark.createDataFrame([(1, 1)], "task_id long, total_count long")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "WithState" not in plan(st.stream_task_status(stream, tasks))
    assert "WithState" in plan(st.stream_task_status(stream, tasks, 300))
