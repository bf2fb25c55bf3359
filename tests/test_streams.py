"""Stream forms against their batch forms: repeats in later micro-batches, restarts, replayed and empty batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
RECORD = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def record(offset, seconds, value=None, partition=0):
    text = value if value is not None else (
        '{"sourceId": "r%d", "sourceType": "RADAR", "observedAt": "2026-01-02T03:04:05Z", "receivedAt": 1767323045.5, '
        '"latDeg": 1.5, "lonDeg": 2.5, "positionSigmaMeters": 9.0}' % offset)
    return (b"k", None if value == "null" else text.encode(), "in", partition, offset, at(seconds))


def feed(spark, folder, rows, schema, name):
    """One more file of the stream's folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def drain(stream, base, writer, mode="append"):
    q = stream.writeStream.outputMode(mode).foreachBatch(writer).option(
        "checkpointLocation", base + "/ck").trigger(availableNow=True).start()
    q.awaitTermination()


def test_kafka_records_keep_their_delivery(spark):
    from sensortracks.sources.formats import from_kafka

    rows = [record(0, 0), record(1, 1, "{broken"), record(2, 2, "null"), record(3, 3), record(3, 4)]
    good, rejected = from_kafka(spark.createDataFrame(rows, RECORD))
    got = {(r["partition"], r["offset"], r["source_id"], r["sigma_m"]) for r in good.collect()}
    assert got == {(0, 0, "r0", 9.0), (0, 3, "r3", 9.0)} and good.count() + rejected.count() == len(rows)
    bad = {r["offset"]: (r["value"], r["reason"], r["topic"], bytes(r["key"])) for r in rejected.collect()}
    assert bad == {1: ("{broken", "json_broken", "in", b"k"), 2: (None, "json_broken", "in", b"k")}
    assert {"topic", "partition", "offset", "arrived_at", "key"} <= set(good.columns)


def test_redelivery_counts_once_across_batches_and_restart(spark, tmp_path):
    from sensortracks.operators.ticks import dedup_deliveries, dedup_stream
    from sensortracks.sources.formats import from_kafka
    from sensortracks.streaming.ledger import LedgerTable

    base = str(tmp_path)
    table = LedgerTable(spark, base + "/out", ["topic", "partition", "offset"])
    batches = [[record(0, 0), record(1, 1), record(1, 2)], [record(1, 5), record(2, 6), record(0, 7, partition=1)],
               [record(0, 9), record(2, 9), record(3, 10)], [record(4, 30), record(3, 31), record(9, 31, "{")]]
    schema = spark.createDataFrame([], RECORD).schema
    for k, rows in enumerate(batches):
        feed(spark, base + "/in", rows, RECORD, f"f{k}")
        stream = spark.readStream.schema(schema).parquet(base + "/in/*")
        drain(dedup_stream(from_kafka(stream)[0], "1 minute"), base, table.writer())  # a new query on the old checkpoint
        so_far = spark.createDataFrame([r for b in batches[:k + 1] for r in b], RECORD)
        want = {(r["partition"], r["offset"]) for r in dedup_deliveries(from_kafka(so_far)[0])[0].collect()}
        got = [(r["partition"], r["offset"]) for r in table.read().collect()]
        assert sorted(got) == sorted(want)


def test_ledger_counts_each_batch_once(spark, tmp_path):
    from sensortracks.streaming.ledger import LedgerTable

    table = LedgerTable(spark, str(tmp_path) + "/t", ["track_id"])
    assert table.read() is None and table.entries() == {}
    rows = lambda n, first=0: spark.range(first, first + n).select(F.col("id").alias("track_id"))
    assert table.append(rows(10), 0)
    assert not table.append(rows(3), 0)  # replayed, smaller
    assert table.append(rows(0), 1)  # empty
    assert table.append(rows(5, 100), 2)
    rows(7, 500).write.parquet(f"{table.path}/batch-3-broken")  # an attempt that broke off before its entry
    assert table.append(rows(2, 500), 3)
    got = sorted((r["batch_id"], r["track_id"]) for r in table.read().collect())
    assert got == [(0, i) for i in range(10)] + [(2, i) for i in range(100, 105)] + [(3, 500), (3, 501)]


def test_history_is_clustered_by_track(spark, tmp_path):
    from sensortracks.operators import tables

    rows = spark.range(4000).select(
        F.lit("s").alias("session_id"), (F.col("id") % 200).alias("track_id"), F.lit("CONFIRMED").alias("status"),
        F.timestamp_seconds(F.col("id")).alias("state_at"))
    table = tables.history_table(spark, str(tmp_path) + "/h")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.append(rows, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = tables.read_history(spark, str(tmp_path) + "/h")
    files = back.select(F.input_file_name().alias("f"), "track_id")
    n = files.select("f").distinct().count()
    assert n >= 4 and files.filter("track_id = 17").select("f").distinct().count() == 1
    assert tables.track_history(back, 17).count() == 20 and back.count() == 4000


@pytest.mark.parametrize("replay", [False, True])
def test_current_tracks_after_every_batch(spark, tmp_path, replay):
    from sensortracks.operators import tables

    base, schema = str(tmp_path), "session_id string, track_id long, status string, state_at timestamp, hit_count int"
    batches = [[("s", 1, "TENTATIVE", at(0), 1), ("s", 2, "TENTATIVE", at(0), 1), ("t", 1, "CONFIRMED", at(1), 5)],
               [("s", 1, "CONFIRMED", at(2), 2), ("s", 2, "DROPPED", at(2), 1)], [("s", 1, "CONFIRMED", at(1), 9)],
               [("s", 3, "TENTATIVE", at(3), 1), ("t", 1, "COASTING", at(4), 5), ("s", 1, "DROPPED", at(5), 2)]]
    spec = spark.createDataFrame([], schema).schema
    assert tables.read_current(spark, base + "/out") is None
    for k, rows in enumerate(batches):
        feed(spark, base + "/in", rows, schema, f"f{k}")
        stream = spark.readStream.schema(spec).parquet(base + "/in/*")
        write = tables.current_table(spark, base + "/out").writer()

        def twice(batch, batch_id, write=write):
            write(batch, batch_id)
            write(batch.limit(0), batch_id)

        drain(tables.latest_rows(stream), base, twice if replay else write, "update")
        want = tables.current_tracks(spark.createDataFrame([r for b in batches[:k + 1] for r in b], schema))
        assert sorted(tables.read_current(spark, base + "/out").collect()) == sorted(want.select(*spec.names).collect())


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class _Map(dict):
    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class _Handle:
    """State in memory; the list state of earlier versions is empty."""

    def getValueState(self, *_):
        return _Value()

    def getListState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()


@pytest.mark.parametrize("track", [False, True])
def test_long_micro_batch_waits_in_the_state(track):
    """A batch of many chunks: at most ``held_rows`` rows (and a chunk) are in memory while it is read; same rows as whole."""
    import pandas as pd

    from sensortracks.streaming.stateful import TickProcessor

    us, base = 1_000_000, 1_700_000_000_000_000

    def second(i):
        return i * 37 % 1000 + 300 * ((i >= 700) + (i >= 800))

    def rows(ids, final=False):
        return pd.DataFrame([{
            "region": 0, "tick_us": base + second(i) * us, "arrival_us": base + second(i) * us + 5, "final": final,
            "identity": str(i % 3), "e": float(i % 3) * 1e6 + i % 5, "n": 0.0, "ve0": 0.0, "vn0": 0.0, "attr_key": "", "source_id": "a",
            "source_type": "A", "observed_us": base + i, "received_us": base + i, "lat_deg": 1.0, "lon_deg": 2.0, "alt_m": None,
            "speed_mps": None, "heading_deg": None, "sigma_m": 9.0, "attributes": {"k": str(i)}} for i in ids])

    def run(held_rows):
        p, waiting, out = TickProcessor(2 * us, track=track, held_rows=held_rows), [], []
        p.init(_Handle())

        def batch(ids, final=False):
            for a in range(0, len(ids), 50):
                yield rows(ids[a:a + 50], final)
                waiting.append(len(p.chunks))
        for chunks in (batch(range(0, 700)), batch(range(700, 800)), batch(range(800, 1000), True)):
            out.append(pd.concat([pd.DataFrame(), *p.handleInputRows((0,), chunks, None)], ignore_index=True))
        assert not p.chunks  # everything is closed in the end
        return out, waiting

    whole, _ = run(1 << 20)
    parts, waiting = run(100)
    assert waiting[2] > 0 and waiting[12] > waiting[2]
    key = ["tick_us", "local_id"] if track else ["tick_us", "outcome", "observed_us"]
    for a, b in zip(whole, parts, strict=True):
        assert a.sort_values(key)[key].values.tolist() == b.sort_values(key)[key].values.tolist()
    if not track:
        assert sum(map(len, parts)) == 1000 and "LATE" in set(parts[1]["outcome"])
    for part in parts:
        fused = part if track else part[part["outcome"] == "FUSED"]
        assert fused["tick_us"].is_monotonic_increasing


def test_a_micro_batch_has_files_for_all_cores(spark):
    """The derived feeds are written and read by all cores, still in about four micro-batches."""
    import glob

    from sensortracks.plans.streams import _stream_of

    base, stream = _stream_of(spark, spark.range(10_000), "id", "cores")
    cores = spark.sparkContext.defaultParallelism
    files = glob.glob(base.removeprefix("file:") + "/in/*.parquet")
    assert len(files) == 4 * cores
    sizes = []
    drain(stream, base, lambda batch, _: sizes.append(batch.count()))
    assert sum(sizes) == 10_000 and len(sizes) == 4
