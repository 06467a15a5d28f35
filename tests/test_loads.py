"""Loads told by a stream equal those of the table: late, repeated and odd events, capacity passed once."""

import random
from datetime import datetime, timedelta

from depotry.streaming.loads import window_loads

SCHEMA = "event_id long, t string, site string, n int"


def replay(spark, folder, parts, **options):
    """Rows told by a stream that reads ``parts`` one after the other, stopped and started again for each."""
    frames = [spark.createDataFrame(p, SCHEMA).selectExpr("event_id", "CAST(t AS timestamp) AS ts", "site", "n") for p in parts]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
        job = window_loads(stream, key="site", orders="n", **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").start()
        job.processAllAvailable()
        job.stop()
    return spark.read.parquet(f"{folder}/out")


def told(df):
    return sorted(str(tuple(r[c] for c in ("window_start", "site", "load", "is_over", "is_final"))) for r in df.collect())


def test_stream_equals_table(spark, tmp_path):
    rng, day = random.Random(8), datetime(2024, 3, 1)
    rows = [(i, str(day + timedelta(minutes=rng.randint(0, 3 * 1440 - 1))), rng.choice("abc"), rng.choice([1, 2, 5, 0, -3, None])) for i in range(150)]
    rows.sort(key=lambda r: r[1])
    late = rows[20:24] + rows[60:64]  # within the watermark: told again and told late, not lost
    first = [r for r in rows if r not in late]
    parts = [first[:60], late[:4] + first[60:80], [*first[80:100], *first[80:85], *late[4:]], first[100:]]
    end = (10_000, "2024-03-20 00:00:00", "end", 1)
    odd = [(None, "2024-03-02 00:00:00", "a", 50), (20_000, None, "a", 50), (20_001, "2024-03-02 00:00:00", None, 50)]
    got = told(replay(spark, tmp_path, [parts[0] + odd, *parts[1:], [end], [(10_001, "2024-03-20 00:01:00", "end", 1)]], capacity=20, late="3 days").where("site <> 'end'"))
    table = spark.createDataFrame([r for p in parts for r in p] + odd, SCHEMA).selectExpr("event_id", "CAST(t AS timestamp) AS ts", "site", "n")
    want = told(window_loads(table, key="site", orders="n", capacity=20))
    assert got == want
    assert any("False)" in w for w in want) and sum("True)" in w for w in want) == 9


def test_capacity_is_told_once_and_before_the_window_closes(spark, tmp_path):
    parts = [[(1, "2024-03-01 08:00:00", "a", 3)], [(2, "2024-03-01 09:00:00", "a", 3)], [(3, "2024-03-01 10:00:00", "a", 3), (2, "2024-03-01 09:00:00", "a", 3)]]
    rows = replay(spark, tmp_path, parts, capacity=5).collect()
    assert [(r["site"], r["load"], r["is_over"], r["is_final"]) for r in rows] == [("a", None, True, False)]


def test_events_later_than_the_watermark_do_not_reopen_a_window(spark, tmp_path):
    parts = [[(1, "2024-03-01 08:00:00", "a", 3)], [(2, "2024-03-05 00:00:00", "b", 1)], [(3, "2024-03-05 01:00:00", "b", 1)], [(4, "2024-03-01 09:00:00", "a", 9)], [(5, "2024-03-05 02:00:00", "b", 1)]]
    rows = [(r["site"], r["load"], r["is_final"]) for r in replay(spark, tmp_path, parts, capacity=5).collect()]
    assert rows == [("a", 3, True)]


def test_empty_table(spark):
    assert window_loads(spark.createDataFrame([], SCHEMA).selectExpr("event_id", "CAST(t AS timestamp) AS ts", "site", "n"), 5, "site").count() == 0
