"""Windows of a stream that is stopped and started again, with rows that come too late."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caselens.streaming import incremental

START = datetime(2024, 1, 1)
COLUMNS = "ts timestamp, event_type string, value double"


def rows(minutes, kind="a"):
    return [(START + timedelta(minutes=m), kind, float(m)) for m in minutes]


def test_state_survives_a_restart_and_late_rows_are_counted(spark, tmp_path):
    run = lambda: incremental.append_windows(spark, f"{tmp_path}/in", frame([]).schema, f"{tmp_path}/state", f"{tmp_path}/out", files_per_batch=2)
    frame = lambda r: spark.createDataFrame(r, COLUMNS)
    come = lambda r: frame(r).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    closed = lambda: {(r.start, r.event_type): (r.n, r.value) for r in spark.read.schema("start timestamp, event_type string, n long, value double").parquet(f"{tmp_path}/out").collect()}

    first, second = rows(range(0, 100, 5)) + rows([3, 64], "b"), rows(range(95, 200, 7)) + rows([130], "b")
    come(first)
    told = run()
    assert (told["rows"], told["late"]) == (len(first), 0) and told["open"] == 2  # the second hour of either kind
    assert set(closed()) == {(START, "a"), (START, "b")}
    # Another call, as another session would make it: the second hour was open and gets its later rows.
    come(second)
    told = run()
    assert (told["rows"], told["late"]) == (len(second), 0)
    # Nothing new: nothing is read or written again.
    before = closed()
    assert run()["rows"] == 0 and closed() == before
    # Rows of windows that are closed are late; one of an open window is not.
    late, fine = rows([10, 20, 70]), rows([190])
    come(late + fine)
    assert run()["late"] == 2  # the rows of one task, window and kind meet before the state sees them
    come(rows([600]))
    run()
    want = {}
    for ts, kind, value in first + second + fine:
        hour = START + timedelta(hours=(ts - START) // timedelta(hours=1))
        n, total = want.get((hour, kind), (0, 0.0))
        want[hour, kind] = (n + 1, total + value)
    assert closed() == want
    batch = incremental.event_counts(frame(first + second + fine)).select(F.col("window.start").alias("s"), "event_type", "n", "value").collect()
    assert {(r.s, r.event_type): (r.n, r.value) for r in batch} == closed()
