"""Event-time windows and redundancy removal over files that come in turn, late or again."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.sources import read_table
from millrace.streaming import feed, first_arrivals, window_aggregates

SCHEMA = "ts timestamp_ntz, k string, v long"


def at(minutes):
    return None if minutes is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def arrive(spark, path, batches, first=0):
    rows = [(at(m), k, v, first + i) for i, b in enumerate(batches) for m, k, v in b]
    feed(spark.createDataFrame(rows, SCHEMA + ", batch int").coalesce(1), "batch", path)


def windows(spark, sink):
    out = read_table(spark, sink, "window_start timestamp, window_end timestamp, k string, n long, v long")
    start = F.round((F.unix_timestamp("window_start") - 1704067200) / 60).cast("int")
    return sorted((tuple(r) for r in out.select(start.alias("m"), "k", "n", "v").collect()), key=repr)


AGGREGATES = lambda: [F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")]


def run(spark, tmp, **more):
    return window_aggregates(spark, f"{tmp}/in", SCHEMA, "ts", "10 minutes", "10 minutes", ["k"], AGGREGATES(), f"{tmp}/out", f"{tmp}/cp", **more)


def test_windows_out_of_order_and_late(spark, tmp_path):
    # Out of order within ten minutes of the latest; 3 comes two files after the watermark went to 25, so its window is closed.
    arrive(spark, f"{tmp_path}/in", [[(5, "a", 1), (12, "a", 2), (None, "a", 9)], [(8, "a", 4), (14, None, 1), (35, "b", 8)], [(34, "b", 0)], [(3, "a", 16), (26, "a", 32)]])
    assert run(spark, tmp_path) == 1
    # Final: windows that end at 25 or before.
    assert windows(spark, f"{tmp_path}/out") == sorted([(0, "a", 2, 5), (10, "a", 1, 2), (10, None, 1, 1)], key=repr)
    # A restart has nothing to do; later files complete what is open, and nothing is written twice.
    assert run(spark, tmp_path) == 0
    arrive(spark, f"{tmp_path}/in", [[(29, "a", 64)], [(90, "c", 1)]], 4)
    assert run(spark, tmp_path) == 0
    assert windows(spark, f"{tmp_path}/out") == sorted([(0, "a", 2, 5), (10, "a", 1, 2), (10, None, 1, 1), (20, "a", 2, 96), (30, "b", 2, 8)], key=repr)


def test_sessions(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", [[(0, "a", 1), (18, "a", 2)], [(9, "a", 4), (4, "b", 8)], [(60, "z", 0)]])
    assert run(spark, tmp_path, sessions=True) == 0
    # 9 joins 0 and 18 to one session, which ends at 28.
    assert windows(spark, f"{tmp_path}/out") == [(0, "a", 3, 7), (4, "b", 1, 8)]


def test_first_arrivals(spark, tmp_path):
    def go():
        first_arrivals(spark, f"{tmp_path}/in", SCHEMA, "k", "ts", "30 minutes", f"{tmp_path}/out", f"{tmp_path}/cp")
        return sorted(r.v for r in read_table(spark, f"{tmp_path}/out", "ts timestamp, k string, v long").collect())

    arrive(spark, f"{tmp_path}/in", [[(0, "a", 1), (1, None, 2), (1, None, 3), (None, "x", 99)], [(5, "a", 4), (6, "b", 5)]])
    assert go() == [1, 2, 3, 5]
    # The state survives a restart: a and b are known; after the time is over they are new.
    arrive(spark, f"{tmp_path}/in", [[(20, "b", 6), (25, "a", 7)], [(200, "c", 8)], [(201, "c", 11)], [(300, "a", 9), (300, "b", 10)]], 2)
    assert go() == [1, 2, 3, 5, 8, 9, 10]
    assert go() == [1, 2, 3, 5, 8, 9, 10]


def test_what_arrives_together_is_one_batch(spark, tmp_path):
    # The files of an arrival come in any order: one at a time, 100 would close the window of 5.
    rows = [(at(m), "a", 1, b) for b, ms in enumerate([(100, 5, 50, 61), (90, 99, 160), (300,)]) for m in ms]
    df = spark.createDataFrame(rows, SCHEMA + ", batch int").repartition(8, "ts")
    late = []
    feed(df, "batch", f"{tmp_path}/in", lambda: late.append(run(spark, tmp_path, files_per_batch=None)))
    assert late == [0, 0, 0]
    assert windows(spark, f"{tmp_path}/out") == sorted([(m, "a", n, n) for m, n in ((0, 1), (50, 1), (60, 1), (90, 2), (100, 1), (160, 1))], key=repr)
    commits = [f for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit()]
    assert len(commits) <= 6 < len(list((tmp_path / "in").glob("part-*")))
