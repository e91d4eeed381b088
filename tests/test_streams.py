"""Streams: equality with the batch form, resume, replay after a failure, late rows."""

import datetime as dt
import decimal
import json
import pathlib
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.operators import edges
from tickloom.streaming import keyed, state, streams
from tickloom.streaming.state import read_output

T0 = dt.datetime(2024, 1, 1)
TICK = "token_id long, metric_id long, metric_time timestamp, pump_probability double, price double"
HIGH = 0.85


class Landing:
    """Folder that files are added to, read as a stream one file per micro-batch."""

    def __init__(self, spark, root, ddl):
        self.spark, self.root, self.ddl = spark, root, ddl

    def add(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(f"{self.root}/landing")

    def stream(self):
        return self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/landing")

    def path(self, name):
        return f"{self.root}/{name}"


@pytest.fixture
def landing(spark, tmp_path):
    return lambda ddl=TICK: Landing(spark, str(tmp_path), ddl)


def tick(token, i, p, minutes=None, price=1.0):
    return (token, i, T0 + dt.timedelta(minutes=i if minutes is None else minutes), p, price)


def run_edges(land, ttl=1800):
    q = streams.start_rising_edges(land.stream(), land.path("out"), land.path("check"), F.col("pump_probability") >= HIGH, ttl)
    q.awaitTermination()
    return q


def fired(spark, land):
    out = read_output(spark, land.path("out"), land.stream().schema)
    return sorted(r["metric_id"] for r in out.collect())


BATCHES = [
    [tick(1, 1, 0.9), tick(2, 2, 0.1), tick(1, 3, 0.95)],  # first row already high
    [tick(1, 4, 0.9), tick(2, 5, 0.85), tick(2, 6, 0.2), tick(2, 7, 0.99)],  # two rows of a key in one batch
    [tick(3, 8, 0.1)],  # other keys only
    [tick(1, 60, 0.9), tick(2, 61, 0.9)],  # state older than 30 minutes
]


def test_edges_equal_batch_and_resume(spark, landing):
    land = landing()
    for rows in BATCHES[:2]:
        land.add(rows)
    run_edges(land)
    assert fired(spark, land) == [1, 5, 7]
    for rows in BATCHES[2:]:
        land.add(rows)
    run_edges(land)  # a restarted query goes on from its checkpoint
    everything = spark.createDataFrame([r for b in BATCHES for r in b], TICK)
    want = edges.rising_edges(everything, "token_id", "metric_time", "metric_id", F.col("pump_probability") >= HIGH, 1800)
    assert fired(spark, land) == sorted(r["metric_id"] for r in want.collect()) == [1, 5, 7, 60, 61]


def test_replay_after_failure(spark, landing):
    """A micro-batch fails once its state is written: the repeated one starts from the state before it."""
    land = landing()
    for rows in BATCHES:
        land.add(rows)
    mark = land.path("failed")

    def run():
        edges_of = keyed.rising_edge_rows(land.stream(), F.col("pump_probability") >= HIGH, 1800)

        def save(batch, batch_id):
            state.save_batch(batch, land.path("out"), batch_id)
            if batch_id == 1 and not pathlib.Path(mark).exists():
                pathlib.Path(mark).touch()
                raise RuntimeError("executor lost")

        writer = edges_of.writeStream.foreachBatch(save).option("checkpointLocation", land.path("check"))
        streams.start_keyed(writer, spark, None).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert fired(spark, land) == [1, 5, 7, 60, 61]


def state_rows(spark, land):
    """Keys whose state is in Spark's store after the last micro-batch."""
    return sorted(r["key"]["_key"] for r in spark.read.format("statestore").load(land.path("check")).collect())


def seen(query, n, batches=1, seconds=60):
    """Wait until the query has read `n` rows and has run `batches` micro-batches since."""
    end = time.monotonic() + seconds
    progress = []
    while time.monotonic() < end:
        progress = query.recentProgress
        read = 0
        for i, p in enumerate(progress):
            read += p["numInputRows"]
            if read >= n:
                if len(progress) - i > batches:
                    return
                break
        time.sleep(0.2)
    raise AssertionError(f"read {[p['numInputRows'] for p in progress]} of {n}: {query.exception()}")


def test_state_of_an_idle_key_ends(spark, landing):
    land = landing()
    land.add([tick(1, 1, 0.9), tick(2, 2, 0.1, minutes=1)])
    query = streams.start_rising_edges(land.stream(), land.path("out"), land.path("check"), F.col("pump_probability") >= HIGH,
                                       ttl_seconds=2, trigger="200 milliseconds")
    try:
        # Idle by the machine's clock, but the stream's own time stands still: the keys stay.
        seen(query, 2)
        time.sleep(4)
        assert state_rows(spark, land) == [1, 2]
        # Once the stream has moved on as well, they go; a key that comes back starts anew.
        land.add([tick(3, 4, 0.1, minutes=40)])
        seen(query, 3)
        for minute in range(41, 60):
            if state_rows(spark, land) == [3]:
                break
            land.add([tick(3, minute, 0.1, minutes=minute)])
            seen(query, 4 + minute - 41)
            time.sleep(0.5)
        assert state_rows(spark, land) == [3]
        read = sum(p["numInputRows"] for p in query.recentProgress)
        land.add([tick(1, 100, 0.9, minutes=60)])
        seen(query, read + 1)
    finally:
        query.stop()
    assert fired(spark, land) == [1, 100]


def test_changes_forget_an_idle_key(spark, landing):
    land = landing()
    land.add([tick(1, 1, 0.9), tick(2, 2, 0.1)])
    query = streams.start_changes(land.stream(), land.path("out"), land.path("check"), ["token_id", "price"], ttl_seconds=2,
                                  trigger="200 milliseconds")
    try:
        seen(query, 2)
        time.sleep(4)
        assert state_rows(spark, land) == []
        land.add([tick(1, 4, 0.9)])
        seen(query, 3)
    finally:
        query.stop()
    assert fired(spark, land) == [1, 2, 4]


ALL_TYPES = "token_id long, metric_id long, metric_time timestamp, a int, b decimal(20,6), c double, d string, e binary, f date, g boolean, h long"


def test_columns_come_back_as_they_were(spark, landing):
    land = landing(ALL_TYPES)
    big = 2**62 + 1
    rows = [(1, big, T0, None, decimal.Decimal("1.000001"), 0.1 + 0.2, "x'\n", b"\x00\xff", dt.date(2024, 1, 1), True, None),
            (2, big + 1, T0 + dt.timedelta(microseconds=1), 7, None, float("inf"), None, None, None, None, big),
            (None, 3, T0, 1, decimal.Decimal("-5"), None, "", b"", dt.date(1, 1, 1), False, -big)]
    land.add(rows)
    changed = keyed.changed_rows(land.stream(), ["h"])
    changed.writeStream.format("parquet").option("path", land.path("out")).option("checkpointLocation", land.path("check")).trigger(
        availableNow=True).start().awaitTermination()
    got = spark.read.schema(changed.schema).parquet(land.path("out"))
    assert got.schema == land.stream().schema
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r) for r in land.spark.createDataFrame(rows, ALL_TYPES).collect()),
                                                                          key=repr)
    with pytest.raises(ValueError, match="plain columns"):
        keyed.changed_rows(land.stream().withColumn("s", F.struct("a")), ["h"])


def test_rows_without_a_time_have_no_place(spark, landing):
    land = landing()
    land.add([(1, 1, None, 0.9, 1.0), tick(1, 2, 0.1)])
    land.add([(1, 3, None, 0.9, 1.0), tick(1, 4, 0.9)])
    run_edges(land)
    assert fired(spark, land) == [4]


YEAR = 366 * 24 * 60
ODD_TIMES = {
    "a future row of another key": ([[tick(1, 1, 0.9), tick(2, 2, 0.1)], [tick(9, 3, 0.1, minutes=YEAR)], [tick(1, 4, 0.9), tick(2, 5, 0.9)]],
                                    [1, 5]),
    "a future row of the key": ([[tick(1, 1, 0.9)], [tick(1, 2, 0.9, minutes=YEAR)], [tick(1, 3, 0.9)], [tick(1, 4, 0.1)], [tick(1, 5, 0.9)]],
                                [1, 2, 5]),
    "late high rows": ([[tick(1, 10, 0.9), tick(2, 11, 0.1)], [tick(1, 5, 0.9), tick(2, 6, 0.9), tick(2, 12, 0.9)]], [10, 12]),
    "a late low row": ([[tick(1, 10, 0.9)], [tick(1, 5, 0.1)], [tick(1, 39, 0.9)]], [10]),
    "a late row and a newer one": ([[tick(1, 10, 0.9)], [tick(1, 5, 0.1), tick(1, 11, 0.9)]], [10]),
    "a key that comes back": ([[tick(1, 1, 0.9)], [tick(2, 2, 0.9)], [tick(2, 30, 0.1)], [tick(1, 31, 0.9)], [tick(1, 62, 0.9)]], [1, 2, 62]),
    "a row that comes twice": ([[tick(1, 1, 0.9)], [tick(1, 1, 0.9)]], [1]),
}


@pytest.mark.parametrize("case", ODD_TIMES)
def test_edges_of_late_future_and_returning_rows(spark, landing, case):
    land = landing()
    batches, want = ODD_TIMES[case]
    for rows in batches:
        land.add(rows)
    run_edges(land)
    assert fired(spark, land) == want


def test_snapshot_edges_forget_absent_keys(spark, landing):
    land = landing()
    for rows in ([tick(1, 1, 0.9)], [tick(1, 2, 0.9), tick(2, 3, 0.5)], [tick(2, 4, 0.9)], [tick(1, 5, 0.9), tick(2, 6, 0.9)]):
        land.add(rows)
    streams.start_snapshot_edges(land.stream(), land.path("out"), land.path("check"),
                                 F.col("pump_probability") >= HIGH).awaitTermination()
    assert fired(spark, land) == [1, 4, 5]


def test_changes_ignore_update_time(spark, landing):
    land = landing()
    for rows in ([tick(1, 1, 0.9)], [tick(1, 2, 0.9)], [tick(1, 3, 0.9, price=2.0), tick(2, 4, 0.1)], [tick(1, 5, None, price=2.0)],
                 [tick(1, 6, None, price=2.0)]):
        land.add(rows)
    streams.start_changes(land.stream(), land.path("out"), land.path("check"),
                          ["token_id", "price", "pump_probability"]).awaitTermination()
    assert fired(spark, land) == [1, 3, 4, 5]


def test_keyed_changes_equal_table_changes(spark, landing):
    land = landing()
    hot = [tick(1, i, 0.5, price=float(i % 3)) for i in range(10, 400)]
    for rows in ([tick(1, 1, 0.9)], [tick(1, 2, 0.9), tick(3, 3, None)], hot, [tick(1, 500, 0.5, price=0.0), tick(2, 501, 0.1)],
                 [tick(1, 502, None, price=2.0)]):
        land.add(rows)
    fields = ["token_id", "price", "pump_probability"]
    streams.start_changes(land.stream(), land.path("out"), land.path("check"), fields).awaitTermination()
    changed = keyed.changed_rows(land.stream(), fields)
    changed.writeStream.format("parquet").option("path", land.path("keyed")).option("checkpointLocation", land.path("check2")) \
        .trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(changed.schema).parquet(land.path("keyed"))
    assert sorted(r["metric_id"] for r in got.collect()) == fired(spark, land) == [1, 3, 399, 501, 502]
    assert got.where("metric_id = 3 and pump_probability is null").count() == 1


def test_live_snapshot_replays_for_late_readers(spark, landing):
    land = landing()
    for rows in BATCHES:
        land.add(rows)
    q = streams.start_live_snapshot(land.stream(), land.path("state"), land.path("check"), trigger=None)
    q.awaitTermination()
    live = streams.latest_snapshot(spark, land.path("state"), land.stream().schema, q)
    assert sorted((r["token_id"], r["metric_id"]) for r in live.collect()) == [(1, 60), (2, 61), (3, 8)]


def test_live_snapshot_is_merged_now_and_then(spark, landing):
    land = landing()
    for i in range(1, 8):
        land.add([tick(i % 3, i, 0.1), tick(9, i, 0.2), tick(9, 0, 0.3, minutes=-i)])
    q = streams.start_live_snapshot(land.stream(), land.path("state"), land.path("check"), merge_every=2, trigger=None)
    q.awaitTermination()
    live = streams.latest_snapshot(spark, land.path("state"), land.stream().schema, q)
    assert sorted((r["token_id"], r["metric_id"]) for r in live.collect()) == [(0, 6), (1, 7), (2, 5), (9, 7)]
    # A reader that began one merge ago still finds its folders, older ones are gone; keys without news are not written.
    left = sorted(int(f.name.split("=")[1]) for f in pathlib.Path(land.path("state")).glob("batch_id=*"))
    assert left == [4, 5, 6] and spark.read.parquet(land.path("state") + "/batch_id=5").count() == 2
    earlier = state.newest_of_batches(spark, land.path("state"), land.stream().schema, "token_id", 5)
    assert sorted((r["token_id"], r["metric_id"]) for r in earlier.collect()) == [(0, 6), (1, 4), (2, 5), (9, 6)]


def candle(i, close, minute, arrival):
    k = {"s": "a", "i": "1h", "t": 1704067200000 + i * 3600000, "T": 1704070799999 + i * 3600000, "o": "1", "h": "2", "l": "1",
         "c": str(close), "v": "1", "q": "1", "n": 1, "V": "1", "Q": "1", "x": True}
    return json.dumps({"data": {"e": "kline", "k": k}}), T0 + dt.timedelta(minutes=minute), arrival


def test_candle_upsert_and_late_update(spark, landing):
    land = landing("payload string, arrived_at timestamp, arrival_id long")
    land.add([candle(0, 1.0, 1, 1), candle(0, 1.5, 2, 2), candle(30, 9.0, 2, 3)])
    land.add([candle(0, 2.0, 9, 5), candle(1, 7.0, 9, 6)])
    land.add([candle(0, 3.0, 4, 4)])  # an older update that comes late
    for _ in range(2):
        streams.start_candle_upsert(land.stream(), land.path("out"), land.path("check")).awaitTermination()
    got = spark.read.parquet(land.path("out")).orderBy("open_time").collect()
    assert [r["close"] for r in got] == [2.0, 7.0, 9.0]


def test_hourly_flow_holds_back_open_hours(spark, landing):
    land = landing("symbol string, side string, trade_time timestamp, notional_usd double")
    land.add([("A", "BUY", T0, 1.0), ("A", "BUY", T0 + dt.timedelta(minutes=30), 2.0), ("A", "SELL", T0 + dt.timedelta(minutes=90), 4.0)])
    land.add([("A", "BUY", T0 + dt.timedelta(hours=5), 8.0)])
    streams.start_hourly_flow(land.stream(), land.path("out"), land.path("check")).awaitTermination()
    got = spark.read.parquet(land.path("out")).collect()
    assert sorted((r["ts_hour"], r["side"], r["notional"]) for r in got) == [(T0, "BUY", 3.0), (T0 + dt.timedelta(hours=1), "SELL", 4.0)]


@pytest.mark.parametrize("kind", ["edges", "changes"])
def test_a_key_costs_few_columns_whatever_its_rows_hold(spark, landing, kind):
    land = landing()
    land.add([tick(1, 1, 0.9)])
    wide = land.stream().select("*", *[F.lit(i).alias(f"more{i}") for i in range(20)])
    found = keyed.rising_edge_rows(wide, F.col("pump_probability") >= HIGH) if kind == "edges" else keyed.changed_rows(wide, ["price"])
    plan = found._jdf.queryExecution().analyzed().toString()
    line = next(x for x in plan.splitlines() if "FlatMapGroupsInPandasWithState" in x)
    taken = line.split(f"{kind}(", 1)[1].split(")", 1)[0].split(", ")
    assert len(taken) <= 3
    assert found.schema.names == wide.schema.names
