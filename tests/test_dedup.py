import random

import pytest

from loomline.streaming.dedup import DAY, SeenMessages, drop_repeats, parquet_stream

SCHEMA = "k string, t long, received timestamp_ntz, id long, extra string"


def _rows(seed, n):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.3
        k, t = ("hot", 3 * DAY) if hot else (f"m{r.randrange(n // 3)}", None)
        t = t if hot else (hash(k) % 40) * DAY
        received = r.choice([None, datetime(2024, 1, 1) + timedelta(hours=r.randrange(50))])
        out.append((r.choice([k] * 30 + [None]), r.choice([t] * 30 + [None]), received, i, "x"))
    r.shuffle(out)
    return out


def brute(rows):
    best = {}
    for k, t, received, i, _ in rows:
        if k is not None and t is not None:
            best.setdefault((k, t), []).append((received is None, received, i))
    kept = {min(v, key=lambda x: (x[0], x[1] or 0 if x[0] else x[1], x[2]))[2] for v in best.values()}
    return kept, {x[2] for v in best.values() for x in v} - kept


@pytest.mark.parametrize(("seed", "batches", "delay"), [(1, 1, 7 * DAY), (2, 4, 2 * DAY), (3, 3, 0)])
def test_batches(spark, tmp_path, seed, batches, delay):
    """Whatever the order of arrival, however late: one copy of each stays, the one received first."""
    rows = _rows(seed, 240)
    store = SeenMessages(spark, str(tmp_path / "s"), delay)
    size = -(-len(rows) // batches)
    for b in range(batches):
        df = spark.createDataFrame(rows[b * size : (b + 1) * size], SCHEMA)
        store.add(df, b)
        store.add(df, b)  # run again after a failure: nothing changes
    kept, dropped = brute(rows)
    assert {r.id for r in store.kept().collect()} == kept
    assert sorted(r.id for r in store.dropped().collect()) == sorted(dropped)


def test_stream(spark, tmp_path):
    rows = _rows(9, 120)
    source = str(tmp_path / "in.parquet")
    spark.createDataFrame(rows[:60], SCHEMA).coalesce(1).write.parquet(source)
    store = SeenMessages(spark, str(tmp_path / "s"), DAY)
    drop_repeats(parquet_stream(spark, source, 1), store)
    spark.createDataFrame(rows[60:], SCHEMA).repartition(2).write.mode("append").parquet(source)
    drop_repeats(parquet_stream(spark, source, 1), store)
    drop_repeats(parquet_stream(spark, source, 1), store)
    kept, dropped = brute(rows)
    assert {r.id for r in store.kept().collect()} == kept and sorted(r.id for r in store.dropped().collect()) == sorted(dropped)


def test_empty(spark, tmp_path):
    store = SeenMessages(spark, str(tmp_path / "s"))
    assert store.dropped().count() == 0 and store.kept().count() == 0
    store.add(spark.createDataFrame([], SCHEMA), 0)
    store.add(spark.createDataFrame([(None, None, None, 1, "")], SCHEMA), 1)
    assert store.dropped().count() == 0 and store.kept().count() == 0


def test_event_times_in_the_future(spark, tmp_path):
    """One event time far ahead leaves the watermark with the others."""
    from datetime import datetime

    at = datetime(2024, 1, 10)
    t = 19732 * DAY
    store = SeenMessages(spark, str(tmp_path / "s"), DAY)
    store.add(spark.createDataFrame([("a", t, at, 1, ""), ("b", t - 3 * DAY, at, 2, ""), ("far", 9999 * 366 * DAY, at, 3, "")], SCHEMA), 0)
    assert t - DAY <= store.pointer()["watermark"] <= t + DAY
    store.add(spark.createDataFrame([("a", t, at, 4, ""), ("b", t - 3 * DAY, at, 5, ""), ("far", 9999 * 366 * DAY, None, 6, "")], SCHEMA), 1)
    assert {r.id for r in store.dropped().collect()} == {4, 5, 6} and store.pointer()["late"] == 1


def test_segments(spark, tmp_path):
    """Small batches add segments to the hot part; they are merged, and what is old leaves, at the eighth."""
    rows = [(f"m{i}", i // 20 * DAY, None if i % 7 else __import__("datetime").datetime(1970, 1, 1 + i // 20), i, "") for i in range(200)]
    store = SeenMessages(spark, str(tmp_path / "s"), 2 * DAY)
    store.add(spark.createDataFrame(rows, SCHEMA), 0)
    most = 0
    for b in range(1, 10):
        store.add(spark.createDataFrame([(rows[b][0], rows[b][1], None, 1000 + b, ""), (f"n{b}", 9 * DAY, None, 2000 + b, "")], SCHEMA), b)
        most = max(most, len(store.pointer()["hot"]))
    assert most == 7 and sorted(r.id for r in store.dropped().collect()) == [1000 + b for b in range(1, 10)]
    assert {r.id for r in store.kept().collect()} == set(range(200)) | {2000 + b for b in range(1, 10)}
    assert any(n.name.startswith("span=") for n in (tmp_path / "s/merged").glob("*/*"))
