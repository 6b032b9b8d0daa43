"""Frames with state by parts: packets cut anywhere, restarts, dead letters, expiry."""

import random
import time

import pytest

from contrail.streaming import frames

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def feed(spark, tmp_path, batches, idle=60.0, name="a", wait=False):
    """Each batch is a file and a micro-batch; every run goes on from the last one's checkpoint."""
    (tmp_path / f"{name}-in").mkdir(exist_ok=True)
    for rows in batches:
        i = len(list((tmp_path / f"{name}-in").iterdir()))
        spark.createDataFrame(rows, "conn string, packet long, data string").coalesce(1).write.json(str(tmp_path / f"{name}-in" / f"b{i}"))
        stream = spark.readStream.schema("conn string, packet long, data string").json(str(tmp_path / f"{name}-in" / "*"))
        writer = frames.frames(stream, idle_seconds=idle).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-check"))
        if wait:
            query = writer.trigger(processingTime="200 milliseconds").start()
            until = time.monotonic() + 30
            done = lambda: spark.read.schema(frames.ROWS).parquet(f"{tmp_path}/{name}-ou*").where("kind = 'expired'").count()
            while time.monotonic() < until and not done():
                time.sleep(0.5)
            query.stop()
        else:
            # timers ask for batches without data for ever, so that a run of what is available would not end
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
            assert writer.trigger(availableNow=True).start().awaitTermination(60)
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()


def test_packets_cut_anywhere_over_restarts(spark, tmp_path):
    """A restart in the middle of a token or a frame loses and repeats nothing."""
    r = random.Random(9)
    want, text = [], {}
    for conn in ("a", "b"):
        said = ""
        for i in range(12):
            vals = [round(r.uniform(-9, 9), 2) for _ in range(r.choice([0, 1, 5, 40]))]
            want.append((conn, float(i), [float(v) for v in vals]))
            said += f"{i}.0 {len(vals)} " + "".join(f"{v}\n" for v in vals)
        text[conn] = said
    batches, at = [[] for _ in range(3)], 0
    for conn, said in text.items():
        cuts = sorted({0, len(said), *[r.randint(0, len(said)) for _ in range(14)]})
        parts = [said[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, part in enumerate(parts):
            at += 1
            batches[i * 3 // len(parts)].append((conn, at, part))
    for b in batches:
        r.shuffle(b)
    rows = feed(spark, tmp_path, batches)
    got = sorted((x["key"], x["sim_time"], [round(v, 2) for v in x["vals"]]) for x in rows)
    assert all(x["kind"] == "frame" for x in rows) and got == sorted(want)


def test_a_bad_token_ends_its_connection_only(spark, tmp_path):
    rows = feed(spark, tmp_path, [[("a", 1, "1.0 1 5 "), ("a", 2, "2.0 many 1 "), ("a", 3, "3.0 0 "), ("b", 1, "1.0 2 7 "), ("c", 1, None), ("c", 2, "4.0 nan ")], [("a", 4, "4.0 0 "), ("b", 2, "8 ")]])
    got = sorted((x["key"], x["kind"], x["sim_time"], x["vals"]) for x in rows if x["kind"] == "frame")
    assert got == [("a", "frame", 1.0, [5.0]), ("b", "frame", 1.0, [7.0, 8.0])]
    assert sorted((x["key"], x["kind"]) for x in rows if x["kind"] != "frame") == [("a", "bad"), ("a", "dead"), ("a", "dead"), ("c", "bad")]
    assert any(x["kind"] == "dead" and x["detail"] == "4.0 0 " for x in rows)


def test_idle_connections_expire(spark, tmp_path):
    rows = feed(spark, tmp_path, [[("a", 1, "1.0 3 5 ")]], idle=0.5, wait=True)
    assert [(x["key"], x["kind"], x["sim_time"], x["detail"]) for x in rows] == [("a", "expired", 1.0, "an open frame lacks 2 values")]
