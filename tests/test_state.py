"""Limits and feeds as state of a stream, against plain Python and the same over a table."""

from cairn.streaming import state

REQUESTS = "host string, at long, event_id long, outcome string"


def stream_of(spark, folder, frames, schema):
    """A stream with a micro-batch for each of ``frames``, in order."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def drained(stream, folder, mode):
    """Rows of every micro-batch, with its number."""
    out = f"{folder}/out"

    def write(batch, number):
        batch.selectExpr("*", f"{number} AS batch").write.mode("overwrite").parquet(f"{out}/n={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.read.parquet(out).drop("n")


def test_next_limit():
    now = (4, 0, 0)
    for _ in range(25):
        now = state.next_limit(now, "success", 1)
    assert now == (5, 0, 0)
    assert state.next_limit((5, 7, 0), "error", 1) == (5, 0, 0)
    assert state.next_limit((5, 7, 0), "limited", 10) == (2, 0, 30_000_010)
    assert state.next_limit((1, 7, 10**9), "limited", 10) == (1, 0, 10**9)
    assert state.next_limit((16, 24, 0), "success", 1) == (16, 25, 0)


def outcomes(n, base=0):
    return [("a" if i % 3 else "b", base + i, base + i, "limited" if i % 61 == 60 else "error" if i % 47 == 46 else "success") for i in range(n)]


def test_limits_stream_and_table_agree(spark, tmp_path):
    frames = [outcomes(150), outcomes(150, 1000)]
    table = state.replay_limits(spark.createDataFrame(frames[0] + frames[1] + [(None, 1, 1, "success"), ("c", None, 2, "success")], REQUESTS))
    want = sorted(map(tuple, table.collect()))
    assert len(want) == 300
    now = {}
    for host, at, event_id, outcome in frames[0] + frames[1]:
        now[host] = state.next_limit(now.get(host, (4, 0, 0)), outcome, at)
        assert (host, at, event_id, *now[host]) in want
    got = drained(state.stream_limits(stream_of(spark, tmp_path, frames, REQUESTS)), tmp_path, "append")
    assert sorted(map(tuple, got.drop("batch").collect())) == want


def test_feeds_stream(spark, tmp_path):
    schema = "job string, at long, note string"
    frames = [[("j", i, f"n{i}") for i in range(40)] + [("k", 1, None), (None, 1, "x")], [("j", 100 + i, f"m{i}") for i in range(30)]]
    rows = drained(state.stream_feeds(stream_of(spark, tmp_path, frames, schema)), tmp_path, "update").collect()
    last = max((r for r in rows if r["job"] == "j"), key=lambda r: r["batch"])
    assert last["at"] == [100 + i for i in range(29, -1, -1)] + list(range(39, 19, -1))
    assert [r["notes"] for r in rows if r["job"] == "k"] == [[None]]
    assert {r["job"] for r in rows} == {"j", "k"}


def test_empty(spark):
    assert state.replay_limits(spark.createDataFrame([], REQUESTS)).count() == 0
