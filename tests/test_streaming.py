"""Frames over streams, run to the end of a folder."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tagloom import TagFrame, streaming
from tagloom.queries import ORACLES, QUERIES


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, "A" if i % 2 else "B", "" if i % 3 else f"v{i}", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, org string, note string, n double").withColumn("t", F.timestamp_seconds(F.col("id") * 600))
    df.coalesce(1).sortWithinPartitions("id").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return streaming.stream_frame(source, {"id": "#meta+id", "org": "#org", "note": "#x", "n": "#value", "t": "#date"})


def run(df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table("out").collect()


def test_rows_columns_and_cells(spark, stream):
    other = TagFrame.from_rows(spark, [["#org", "#org+code"], ["a", "1"], ["b", "2"]])
    f = stream.with_rows("#value>=6").clean_data(lower="#org").add_columns("#y={{#value * 2}}").merge_data(other, "#org-code", "#org+code").with_columns("#meta,#org,#y")
    got = sorted(tuple(r) for r in run(f.to_df("id", "org", "y", "code")))
    assert got == [(i, "a" if i % 2 else "b", str(2 * i), "1" if i % 2 else "2") for i in range(6, 12)]


def test_count(stream):
    assert sorted(tuple(r) for r in run(stream.count("#org", "sum(#value) as s#s").to_df("org", "s"), "complete")) == [("A", 36.0), ("B", 30.0)]


def test_windows(stream):
    timed = streaming.with_watermark(stream, "#date", "1 minute")
    got = run(streaming.windowed_count(timed, "#date", "1 hour", "#org"), "complete")
    assert sorted((r.start.hour, r.org, r.rows) for r in got)[0][2] == 3 and len(got) == 4


def test_dedup(stream):
    assert sorted(r.org for r in run(streaming.dedup(stream.with_columns("#org"), "#org").to_df("org"))) == ["A", "B"]


def test_fill_down(stream):
    got = {r.id: r.note for r in run(streaming.fill_down(stream.with_columns("#meta,#org,#x"), "#org", "#x").to_df("id", "org", "note"))}
    assert got[0] == got[2] == got[4] == "v0" and got[1] == "" and got[3] == got[5] == got[7] == "v3" and got[8] == "v6"


def test_static_frames_are_refused(spark):
    with pytest.raises(ValueError):
        streaming.stream_frame(spark.range(1), {"id": "#x"})


@pytest.fixture
def events(spark, tmp_path, monkeypatch):
    """Folder of a small table of events in two files; files of the queries go there too, if no folder is shared."""
    kinds = ["purchase", "view", "", "signup"]
    rows = [(None if i == 9 else i, kinds[i % 4], float(i * 10)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double")
    df = df.selectExpr("event_id", "timestamp_seconds(value) AS ts", "1L AS user_id", "event_type", "value", "'{}' AS props")
    df.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    df.createOrReplaceTempView("events")
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    yield str(tmp_path)
    spark.catalog.dropTempView("events")


@pytest.mark.parametrize("name", ["stream_rows_columns_cells", "stream_dedup", "stream_merge_append"])
def test_rows_of_a_stream_stay_with_the_executors(spark, events, name):
    """Rows of append mode are files of the executors, read again at will, and no table of the driver."""
    got = QUERIES[name](spark, events)
    want = sorted(map(repr, spark.sql(ORACLES[name]).collect()))
    assert [sorted(map(repr, got.collect())) for _ in range(2)] == [want, want]
    assert got.inputFiles() and all("/tagloom-stream-" in f for f in got.inputFiles())


def test_groups_of_a_stream(spark, events):
    assert sorted(map(repr, QUERIES["stream_count"](spark, events).collect())) == sorted(map(repr, spark.sql(ORACLES["stream_count"]).collect()))


def test_merge_does_not_shuffle_a_stream(spark, events, monkeypatch):
    """The one row to merge goes to the stream's rows; only its own aggregate is dealt out by key."""
    plans, start = [], DataStreamWriter.start

    def ended(self, *args):
        run = start(self, *args)
        run.awaitTermination(120)
        plans.append(run._jsq.explainInternal(False).split("Initial Plan")[-1])
        return run

    monkeypatch.setattr(DataStreamWriter, "start", ended)
    QUERIES["stream_merge_append"](spark, events)
    (plan,) = plans
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
