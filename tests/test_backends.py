"""Services with strikes and cooldowns: single steps, and a stream against the batch form."""

from pyspark.sql import functions as F

from gleaner.streaming import backends as B

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "run long, id long, at long, text string, tried array<struct<name: string, outcome: string>>"


def steps(*requests):
    run, out = B.Run(), []
    for at, text, tried in requests:
        out.append(B.decide(run, at, text, tried)[:2])
    return out


def test_three_strikes_cooldown_and_one_more_failure():
    bad, good = [("g", "fail"), ("m", "ok")], [("g", "ok"), ("m", "ok")]
    n = B.COOLDOWN
    assert steps((0, "a", bad), (1, "b", bad), (2, "c", bad), (3, "d", good), (2 + n, "e", good)) == [("ok", "m")] * 4 + [("ok", "g")]
    # after the cooldown a single failure leaves it out again
    assert steps((0, "a", bad), (1, "b", bad), (2, "c", bad), (2 + n, "e", bad), (3 + n, "f", good), (2 + 2 * n, "h", good)) == [("ok", "m")] * 5 + [("ok", "g")]
    # an answer takes the strikes away
    assert steps((0, "a", bad), (1, "b", bad), (2, "c", good), (3, "d", bad), (4, "e", bad), (5, "f", good))[-1] == ("ok", "g")


def test_outcomes_about_the_text_and_fatal_ones():
    assert steps((0, "a", [("g", "same"), ("m", "same")])) == [("untranslatable", None)]
    assert steps((0, "a", [("g", "same"), ("m", "fail")]), (1, "b", [("g", "unable")])) == [("error", None)] * 2
    assert steps((0, "a", [("g", "fatal")]), (10**12, "b", [("g", "ok")])) == [("error", None), ("none", None)]
    assert steps((0, "a", [])) == [("none", None)]
    ok = [("g", "ok")]
    assert steps((0, "a", ok), (B.MEMORY - 1, "a", ok), (B.MEMORY, "a", ok), (B.MEMORY, None, ok)) == [("ok", "g"), ("cached", "g"), ("ok", "g"), ("ok", "g")]


def requests(n):
    kinds = ["ok", "fail", "fail", "same", "unable", "fail", "fatal"]
    return [(i % 3, i, 10**9 + i * 45_000, f"t{i * i % 11}", [(s, kinds[(i * a + b) % (7 if (i * a) % 29 == 0 else 6)]) for s, a, b in (("g", 5, 1), ("m", 3, 2), ("d", 11, 0))]) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    rows = requests(90)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((str(r.run), r.id, r.status, r.served, tuple(r.asked)) for r in B.batch_requests(df, "run").collect())
    assert {w[2] for w in want} >= {"ok", "cached", "error"}
    for part in range(3):
        df.where(f"id between {part * 30} and {part * 30 + 29}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("at"))
        out = B.stream_requests(stream, "run", "ts", "1 minute")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.unset(PROVIDER)
    got = sorted((r.run, r.id, r.status, r.served, tuple(r.asked)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want
