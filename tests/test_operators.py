"""Operators on small inputs: nulls, ties, empty tables, and what SQL does not cover."""

from pyspark.sql import functions as F

from gleaner.operators import classify, cluster, layers, ledger, match, plan, scan, survive, tree
from gleaner.streaming import sessions

c = F.col


def test_gap_clusters_chain_and_drop_nulls(spark):
    df = spark.createDataFrame([("k", x) for x in (0.0, 3.0, 6.0, 9.0, 100.0)] + [("k", None), (None, 1.0)], "k string, v double")
    got = cluster.gap_clusters(df, ["k"], "v", 3.0, []).collect()
    assert sorted(r.v for r in got) == [0.0, 3.0, 6.0, 9.0] and {r.cluster for r in got} == {0} and {r.cluster_size for r in got} == {4}
    assert cluster.gap_clusters(df.limit(0), ["k"], "v", 3.0, []).count() == 0


def test_plans(spark):
    rows = [("g", "a", 2, "x"), ("g", "b", 3, "x"), ("h", "c", 1, "x"), ("h", "d", 1, "y")]
    df = spark.createDataFrame(rows, "g string, path string, q int, v string")
    got = {r.path: r["mark"] for r in survive.plan_copies(df, ["g"], [F.desc("q"), c("path")], "v").collect()}
    assert got == {"a": "remove", "b": "keep", "c": "", "d": ""}
    strays = spark.createDataFrame([("g", "a", True, False), ("g", "b", False, True), ("g", "n", None, True), ("h", "c", False, False)], "g string, p string, placed boolean, lossless boolean")
    assert {r.p: r.plan for r in survive.plan_strays(strays, ["g"], "placed", "lossless").collect()} == {"a": "keep", "b": "held", "n": None, "c": None}
    assert [r.x for r in spark.createDataFrame([("/m/a/b/c.mp3",), ("/m/c.mp3",), ("/x",)], "p string").select(survive.in_collection(c("p"), "/m").alias("x")).collect()] == [True, False, None]
    picks = spark.createDataFrame([("a",), ("c",), ("d",)], "path string")
    assert {r.path for r in survive.picked_deletions(df, picks, ["g"], "path").collect()} == {"a"}


def test_best_hit(spark):
    hits = [(1, 1.0, 1.0, True, False, None), (2, 1.0, 1.0, False, False, 0.0), (3, 0.5, 1.0, True, False, 0.0), (4, 1.0, 0.0, True, False, 2.0), (5, 1.0, 1.0, True, False, 13.0), (6, 0.0, None, False, True, 40.0)]
    h = spark.createDataFrame([("k", *x) for x in hits], "b string, pos int, t double, a double, synced boolean, exact boolean, gap double")
    q = spark.createDataFrame([("k", 7)], "b string, q int")
    ok = match.accept_hit(c("t"), c("a"), c("exact"), c("gap"))
    score = match.hit_score(c("t"), c("a"), c("synced"), c("exact"), c("gap"))
    got = match.top_matches(q, h, ["b"], score, [c("pos")], "q", ok, k=9).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r["rank"])] == [1, 4, 2]
    d = spark.createDataFrame([(10.0, 12.0), (0.0, 3.0), (None, 1.0)], "a double, b double").select(match.duration_gap(c("a"), c("b")).alias("g"))
    assert [r.g for r in d.collect()] == [2.0, None, None]


LRC = "[ti:x]\n[00:01.00][00:05.50]hello\n[00:01.00]konnichiwa\nno stamp\n[00:03.00]\n"


def test_timed_lines(spark):
    df = spark.createDataFrame([(1, LRC), (2, None), (3, "")], "id int, text string")
    got = sorted((r.time, r.pos, r.text) for r in layers.timed_lines(df, ["id"], "text").collect())
    assert got == [(1.0, 1, "hello"), (1.0, 2, "konnichiwa"), (3.0, 4, ""), (5.5, 1, "hello")]


def test_local_lines(spark):
    text = "[offset:500]\n[00:01.50]<00:01.50>one  <00:02.00>two\n[1:02:5] three\n[ar:me]\n"
    df = spark.createDataFrame([(1, text), (2, "\na\n\n\nb\n\n")], "id int, text string")
    got = layers.local_lines(df, ["id"], "text").collect()
    assert sorted((r.time, r.text) for r in got if r.id == 1) == [(1.0, "one two"), (62.0, "three")]
    assert [(r.pos, r.text) for r in sorted((r for r in got if r.id == 2), key=lambda r: r.pos)] == [(1, "a"), (2, ""), (4, "b")]
    assert {r.synced for r in got if r.id == 2} == {False}


def test_fold_layers_and_render(spark):
    lines = [(1, i, t, x) for i, (t, x) in enumerate([(1.0, "君が好き"), (1.0, "I love you and me"), (2.0, "夢を見る"), (2.0, "this is what you are"), (3.0, ""), (None, "tail")])]
    df = spark.createDataFrame(lines, "id int, pos int, time double, text string")
    got = layers.fold_layers(df, ["id"], ["pos"]).collect()
    assert sorted((r.run, r.text, r.english) for r in got) == [(1, "君が好き", "I love you and me"), (2, "夢を見る", "this is what you are"), (3, "", ""), (4, "tail", "")]
    rows = layers.fold_layers(df, ["id"], ["pos"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("time", "text", "romaji", "english"))).alias("rows"))
    out = rows.select(layers.render_timed(c("rows"), title=F.lit("T")).alias("x"), layers.render_html(F.lit("a<b"), c("rows")).alias("h")).first()
    assert "[00:01.00]君が好き\n[00:01.00]I love you and me\n" in out.x and out.x.startswith("[ti:T]\n[by:gleaner]\n")
    assert "a&lt;b" in out.h
    back = rows.select(layers.parse_data_block(layers.render_html(F.lit("t"), c("rows")), "array<struct<time: double, text: string>>").alias("b")).first().b
    assert {x.text for x in back} == {"君が好き", "夢を見る", "", "tail"}


def test_strip_credits(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["作词 : X", "", "Song - Me", "real", "Lyrics: no"])] + [(2, 0, "作曲：Y")], "id int, pos int, text string")
    got = layers.strip_credits(df, ["id"], "pos", "text", F.array(F.lit("songme"))).collect()
    assert sorted((r.id, r.text) for r in got) == [(1, "Lyrics: no"), (1, "real"), (2, "作曲：Y")]


def test_tree(spark):
    files = spark.createDataFrame([("A/X/1.mp3",), ("A/X/2.mp3",), ("A/y.txt",), ("z.mp3",)], "path string")
    got = {r.folder: (r.audio, r.files, r.depth) for r in tree.depth_counts(files, "path", c("path").endswith(".mp3")).collect()}
    assert got == {"A": (2, 3, 1), "A/X": (2, 2, 2)}
    folders = spark.createDataFrame([("A",), ("E",), ("E/D",)], "folder string")
    assert [r.folder for r in tree.empty_folders(folders, "folder", files, "path").collect()] == ["E/D", "E"]
    more = spark.createDataFrame([("d/a.mp3",), ("d/a.lrc",), ("d/a.lrc.bak",), ("d/b.mp3",), ("d/B.flac",), ("d/b.lrc",), ("d/cover.jpg",)], "path string")
    got = tree.sidecars(more, "path", c("path").rlike(r"\.(mp3|flac)$"), (".lrc", ".lrc.bak", ".jpg"), ("cover.jpg",)).collect()
    assert sorted(r.sidecar for r in got) == ["d/a.lrc", "d/a.lrc.bak"]


def test_ledger(spark):
    led = spark.createDataFrame([("a", "notfound", "2024-01-01"), ("b", "notfound", "2024-01-30"), ("c", "english", "2020-01-01")], "key string, status string, at string").withColumn("at", c("at").cast("timestamp"))
    holds = ledger.settled(led, F.lit("2024-02-01").cast("timestamp"), 14, ("notfound",))
    assert {r.key for r in holds.collect()} == {"b", "c"}
    items = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    assert {r.key for r in ledger.pending(items, holds, "key").collect()} == {"a", "x"}


def test_batches_and_free_names(spark):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate([5, 5, 11, 1, 9, 1])], "p string, i int, s long")
    assert [r.batch for r in scan.size_batches(df, ["p"], ["i"], "s", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3]
    want = spark.createDataFrame([(1, "x"), (2, "x"), (3, "X")], "id int, stem string")
    taken = spark.createDataFrame([("x",), ("x (3)",)], "n string")
    assert [r.final for r in plan.free_names(want, "stem", taken, "n", [c("id")]).orderBy("id").collect()] == ["x (2)", "x (4)", "X (5)"]


def test_stream_sessions_equal_batch(spark, tmp_path):
    from gleaner.session import table

    events = table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", c("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    far = spark.createDataFrame([(0, -1, "x", 0.0, "{}")], "event_id long, user_id long, event_type string, value double, props string").select("event_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.stream_sessions(stream, "user_id", "ts", "30 minutes", "1 day").writeStream.outputMode("append").format("memory").queryName("sess").start()
    q.processAllAvailable()
    far.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    want = sessions.batch_sessions(events, "user_id", "ts", "30 minutes").collect()
    got = spark.sql("select * from sess where user_id >= 0").collect()
    assert sorted((r.user_id, r.n, r.started) for r in got) == sorted((r.user_id, r.n, r.started) for r in want)


def test_bounds_of_whole_lengths_are_exact(spark):
    df = spark.createDataFrame([(33.6, 84), (33.59, 84), (126.0, 84), (126.01, 84)], "l double, c long")
    got = [r[0] for r in df.select(classify.duration_status(F.col("l"), F.col("c"))).collect()]
    assert got == [None, "REJECT_SNIPPET", None, "REJECT_MIX"]


def test_nearest_matches_are_the_best_ones(spark):
    import random

    rng = random.Random(5)
    values = [None, 0.0, float("inf"), float("nan"), 1e15, 0.3, 0.1 + 0.2, *(rng.randrange(-3000, 3000) / 4 for _ in range(60))]
    q = spark.createDataFrame([(i, rng.choice([1, 2, None]), rng.choice(values)) for i in range(200)], "q long, b int, v double")
    h = spark.createDataFrame([(i, rng.choice([1, 2, None]), rng.choice(values)) for i in range(80)], "h long, b int, w double")
    gap = F.abs(c("v") - c("w"))
    want = match.top_matches(q, h, ["b"], 3.0 - gap / 50, [c("h")], "q", gap <= 100).select("q", "v", "h", "w", "score")
    got = match.nearest_matches(q, h, ["b"], "v", "w", lambda g: 3.0 - g / 50, ["h"], "q", 100).select("q", "v", "h", "w", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 80


def test_pairs_of_groups_are_dealt_in_blocks(spark):
    rows = [(i, f"g{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "x long, g string")
    scored = spark.createDataFrame([("g0", "g0", 1.0), ("g0", "g1", 0.5)], "ga string, gb string, score double")
    got = sorted(map(tuple, match._expanded(df.select("g", "x"), scored, 4).collect()))
    of = {g: [i for i, k in rows if k == g] for g in ("g0", "g1")}
    want = [(x, y, 1.0) for x in of["g0"] for y in of["g0"] if x < y] + [(min(x, y), max(x, y), 0.5) for x in of["g0"] for y in of["g1"]]
    assert got == sorted(want)
