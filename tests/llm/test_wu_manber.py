import hashlib
import random
import re

from gleaner.llm import wu_manber as wm


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        p = words(t)
        m = min(width, len(p))
        for a in range(len(p) - m + 1) if p else ():
            for s in range(len(w) - m + 1):
                if w[s : s + m] == p[a : a + m]:
                    hit |= set(range(s, s + m))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def data():
    r = random.Random(5)
    v = ["the", "of", "É", "xä", "夢", "a1", "Zed", "in", "on"]
    items = [(i, " ".join(r.choices(v, k=r.choice([1, 2, 3, 9, 10, 11, 25]))) + "?!") for i in range(40)] + [(100, None), (101, "..."), (2, "The of.")]
    items = [x for x in items if len(words(x[1])) != 1] + [(77, "unique")]
    docs = []
    for i in range(150):
        t = " ".join(r.choices(v, k=r.randint(0, 60)))
        if i % 3 == 0:
            t += (f"\n{r.choice(items)[1]}".upper() if i % 2 else f"; {r.choice(items)[1]}")
        docs.append((i, t))
    return docs + [(900, None), (901, ""), (902, "the " * 5000 + "UNIQUE"), (900, None)], items


def test_equals_brute_force(spark):
    docs, items = data()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 30):
        got = wm.digests(wm.occurrences(df, bench, block_patterns=block)).collect()
        assert len(got) == len(docs)
        by = {i: brute(t, items) for i, t in docs}
        for r in got:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == by[r.doc_id], r


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = wm.digests(wm.occurrences(docs, none)).collect()
    assert len(r) == 1 and r[0].n_hit == 0 and r[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert wm.digests(wm.occurrences(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string"))).count() == 0


def test_blocks_are_bounded_and_streamed(spark, monkeypatch):
    """Of 30 blocks at most two are held by the driver, and one of the broadcasts is live."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)] + [(99, " ".join(f"long{j}" for j in range(400)))]
    df = spark.createDataFrame([(1, items[3][1] + " . " + items[29][1]), (2, items[-1][1]), (3, "w1x1 clean")], "doc_id long, text string")
    seen, live, most = [], [0], [0]
    build = wm.build

    def counted(found):
        seen.append(len(found))
        return build(found)

    broadcast = type(spark.sparkContext).broadcast

    def sent(self, value):
        out = broadcast(self, value)
        live[0] += 1
        most[0] = max(most[0], live[0])
        drop = out.unpersist
        out.unpersist = lambda *a: (live.__setitem__(0, live[0] - 1), drop(*a))
        return out

    monkeypatch.setattr(wm, "build", counted)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sent)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in wm.occurrences(df, bench, block_patterns=45).collect()}
    assert max(seen) <= 45 and len(seen) >= 30 and most[0] == 1
    assert got[1].items == ["29", "3"] and [tuple(s) for s in got[1].spans] == [(0, 80)] and got[2].items == ["99"] and not got[3].spans


def test_null_items_and_clashing_columns(spark):
    bench = spark.createDataFrame([(None, "alpha beta"), (None, "gamma"), ("", "delta"), ("b", "alpha beta")], "item_id string, text string")
    df = spark.createDataFrame([(1, "Alpha beta gamma delta", "s"), (1, "Alpha beta gamma delta", "s"), (2, "beta", "t")], "doc_id long, text string, spans string")
    for block in (1, 100):
        found = wm.occurrences(df, bench, block_patterns=block)
        assert found.columns == ["doc_id", "text", "n_words", "spans", "items"]
        assert sorted((r.doc_id, r.items) for r in found.collect()) == [(1, ["", "b", None]), (1, ["", "b", None]), (2, [])]
        assert {r.n_items for r in wm.digests(found).where("contaminated").collect()} == {3}
