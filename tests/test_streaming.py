"""Streams over several batches, against what the same rows give at once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftwood.streaming.tables import counts_by_window, current, first_in_window, run_to_end, upsert_stream

T0 = datetime(2024, 1, 1)
ROWS = "k long, at timestamp, n long, note string"


def _stream(spark, folder, batches):
    """A stream that takes one file a batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*")


def _hour(h):
    return T0 + timedelta(hours=h)


def test_upsert_stream_merges_batch_after_batch(spark, tmp_path):
    batches = [[(1, _hour(0), 1, "a"), (1, _hour(1), 2, "b"), (2, _hour(0), 1, "c")], [(1, _hour(2), 3, ""), (3, _hour(2), 1, None)], [(2, _hour(3), 2, "d")]]
    stream = _stream(spark, f"{tmp_path}/in", batches)
    where = (f"{tmp_path}/out", f"{tmp_path}/state")
    upsert_stream(stream, *where, "k", ["at", "n"], ["note"], "n").awaitTermination()
    got = {r["k"]: (r["at"], r["n"], r["note"]) for r in current(spark, where[0]).collect()}
    assert got == {1: (_hour(2), 3, "b"), 2: (_hour(3), 2, "d"), 3: (_hour(2), 1, None)}
    # another run goes on where this one ended
    spark.createDataFrame([(3, _hour(4), 2, "e")], ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/003")
    upsert_stream(stream, *where, "k", ["at", "n"], ["note"], "n").awaitTermination()
    got = {r["k"]: r["note"] for r in current(spark, where[0]).collect()}
    assert got == {1: "b", 2: "d", 3: "e"}


def test_first_in_window_lets_a_key_pass_again_after_its_ttl(spark, tmp_path):
    batches = [[(1, _hour(0), 1, "")], [(1, _hour(2), 2, "")], [(2, _hour(200), 3, "")], [(3, _hour(200), 4, "")], [(1, _hour(200), 5, "")]]
    stream = _stream(spark, f"{tmp_path}/in", batches)
    got = run_to_end(first_in_window(stream, ["k"], "at", "1 day"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert sorted(r["n"] for r in got) == [1, 3, 4, 5]


def test_counts_by_window_are_final_and_equal_a_batch(spark, tmp_path):
    batches = [[(1, _hour(0), 1, ""), (1, _hour(1), 1, "")], [(1, _hour(0.5), 1, ""), (2, _hour(1), 1, "")], [(1, _hour(30), 1, "")]]
    stream = _stream(spark, f"{tmp_path}/in", batches)
    got = run_to_end(counts_by_window(stream, ["k"], "at", "2 hours", "6 hours"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["start"], r["k"], r["n"]) for r in got.collect()) == [(T0, 1, 3), (T0, 2, 1)]  # the last window is still open
