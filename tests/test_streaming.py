import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsloom.sources.keyed_table import KeyedTable
from opsloom.sources.sinks import batch_appender, latest_state
from opsloom.streaming import jobs
from opsloom.streaming.streaks import error_streaks


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """Four files, arriving in time order."""
    folder = tmp_path_factory.mktemp("landing")
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        start += timedelta(seconds=rng.randint(1, 600))
        rows.append((i, start, rng.choice(["w1", "w1", "w2"]), rng.random() < 0.6))
    for n in range(4):
        part = spark.createDataFrame(rows[n * 100:(n + 1) * 100], "id long, ts timestamp, worker string, failed boolean")
        part.coalesce(1).write.parquet(str(folder / f"part{n}"))
    return str(folder / "*"), rows


def stream(spark, landing):
    session = jobs.stream_session(spark)
    schema = "id long, ts timestamp, worker string, failed boolean"
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing[0])


SCHEMA = "id long, ts timestamp, worker string, failed boolean"


def land(spark, folder, files):
    for name, rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def streaks(rows, until):
    want, streak = [], {}
    for _, ts, worker, failed in sorted(rows, key=lambda r: (r[1], r[3])):
        streak[worker] = streak.get(worker, 0) + 1 if failed else 0
        if streak[worker] == 3 and ts <= until:
            want.append((worker, ts))
    return sorted(want)


def test_streaks_wait_for_late_rows_and_go_on_after_a_restart(spark, landing, tmp_path):
    rows = landing[1]
    late = rows[::7]                         # come one file later
    files = [[r for r in rows[n * 100:(n + 1) * 100] if r not in late] + [r for r in late if n and (n - 1) * 100 <= r[0] < n * 100] for n in range(4)]
    files.append([r for r in late if r[0] >= 300])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        session = jobs.stream_session(spark)
        source = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        path = jobs.drain(error_streaks(source, "worker", "ts", F.col("failed"), delay="2 days"), "append", spark, folder=out)
        return sorted((r["worker"], r["alert_at"]) for r in spark.read.parquet(path).collect())

    land(spark, folder, [(f"a{n}", f) for n, f in enumerate(files[:2])])
    run()
    last = max(r[1] for r in rows)
    end = [[(9000 + n, last + timedelta(days=40 * (n + 1)), "end", False)] for n in range(2)]
    behind = [(9999, rows[0][1], "w1", True)]     # far behind the watermark: dropped
    land(spark, folder, [(f"b{n}", f) for n, f in enumerate([*files[2:], end[0], behind + end[1]])])
    got = run()
    assert got == streaks(rows, last) and got


def test_threads_of_replayed_batches(spark, landing, tmp_path):
    def table(session):
        return KeyedTable(session, str(tmp_path / "t"), f"worker string, {jobs.THREADS}", ["worker"], 4)

    sink = jobs.keyed_sink(table, lambda df: jobs.thread_state(df, "worker", "ts", F.col("failed")), jobs.merged_threads("worker"), "s")
    path = jobs.drain(stream(spark, landing), "append", spark, lambda _: lambda df, n: (sink(df, n), sink(df, n)))
    assert path.endswith("/out")
    got = {r.worker: r for r in table(spark).read().collect()}
    want = jobs.thread_state(spark.createDataFrame(landing[1], SCHEMA), "worker", "ts", F.col("failed")).collect()
    assert [got[r.worker] for r in want] == want and len(got) == 2


def test_leases_are_forgotten(spark):
    old = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 9))], "k string, expires_at timestamp")
    new = spark.createDataFrame([("b", datetime(2024, 1, 5)), ("c", datetime(2024, 1, 3))], "k string, expires_at timestamp")
    kept = jobs.merged_leases("k", F.lit("2024-01-02").cast("timestamp"))(old, new).collect()
    assert sorted((r.k, r.expires_at.day) for r in kept) == [("b", 9), ("c", 3)]


def test_counts_and_dedupe_over_batches(spark, landing):
    out = jobs.drain(jobs.event_counts(stream(spark, landing), "ts", ["worker"], "1 hour", None, "30 days"), "update", spark)
    got = latest_state(spark, out, ["window_start", "worker"]).agg(F.sum("n")).first()[0]
    assert got == 400
    twice = stream(spark, landing).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = jobs.drain(jobs.deduplicated(twice, ["id"], "ts", "1 hour"), "append", spark)
    assert spark.read.parquet(out).count() == 400


def test_retried_batch_replaces_its_rows(spark, tmp_path):
    write = batch_appender(str(tmp_path / "out"))
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for _ in range(2):
        write(df, 0)
    write(spark.createDataFrame([(1, "b")], "k int, v string"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert latest_state(spark, str(tmp_path / "out"), ["k"]).first()["v"] == "b"
