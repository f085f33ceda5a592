import random
import re

import numpy as np
import pytest

from gleaner.llm import pivot_join as pj


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, num, den):
    s = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 10**9), rows[i][0])
    return sorted((rows[i][0], len(s[i]), low[find(i)]) for i in range(len(rows)))


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=40)
    base = [r.choices(words, k=r.choice([1, 2, 3, 4, 8, 12, 30, 60, 150])) for _ in range(n // 6)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1])] = [r.choice(words)]
        if r.random() < 0.2:
            w += passage
        t = " ".join(w)
        out.append((i, t.upper() if r.random() < 0.1 else t))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (5, out[5][1]), (6, "another text of id six")]


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 1024), (5, 80, 1024), (3, 80, 7)])
def test_equals_brute_force(spark, k, num, block):
    rows = corpus(500, num + k)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")
    got = sorted(tuple(r) for r in pj.join(df, pj.Law(k, num, 100), block=block).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, k, num, 100)


def test_recursion_equals_pairs(monkeypatch):
    monkeypatch.setattr(pj.Region, "LEAF", 6)
    r = np.random.default_rng(1)
    law = pj.Law(3, 80, 100)
    centers = [np.unique(r.integers(0, 2**62, 60, dtype=np.uint64)) for _ in range(12)]
    sets = []
    for _ in range(400):
        c = centers[r.integers(12)].copy()
        c[: r.integers(0, 14)] = r.integers(0, 2**62, 1, dtype=np.uint64)
        sets.append(np.unique(c))
    region = pj.Region([s.tobytes() for s in sets], law)
    region.join(np.arange(len(sets)))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(sets))] == [region.root(i) for i in range(len(sets))]


def test_sketches_never_leave_out_a_link():
    r = np.random.default_rng(2)
    law = pj.Law(3, 80, 100)
    base = np.unique(r.integers(0, 2**62, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[: int(r.integers(150, 400))], r.integers(0, 2**62, int(r.integers(0, 60)), dtype=np.uint64)))) for _ in range(80)]
    sketch = np.array([np.bincount((pj.W.mix(s) >> np.uint64(55)).astype(int), minlength=512) for s in sets], np.uint8)
    part = r.integers(0, 2, 80)
    for blocks in (None, part):
        comp = list(range(80))
        for a, b in pj.sketch_links(sketch, law, blocks):
            comp = [comp[a] if x == comp[b] else x for x in comp]
        for i in range(80):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c) and (blocks is None or blocks[i] != blocks[j]):
                    assert comp[i] == comp[j]


def test_keep_one_and_empty(spark):
    rows = corpus(120, 3)
    df = spark.createDataFrame([(i, t, "src") for i, t in rows] + [(None, "null id here", "x")], "doc_id long, text string, component_id string")
    kept = pj.keep_one(df, pj.Law(5, 80, 100))
    assert kept.columns == df.columns
    want = {d for d, _, c in brute(rows, 5, 80, 100) if d == c}
    assert {r.doc_id for r in kept.collect()} - {None} == want
    assert pj.join(df.limit(0)).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    t, u = (" ".join(f"{x}{i}" for i in range(60)) for x in "tu")
    rows = [(3, t), (5, u), (5, t + " tail"), (7, u + " x"), (None, t + " end"), (None, "alone " * 9), (8, t + " tail"), (9, u + " y"), (9, u + " y"), (None, None), (4, ""), (4, "")]
    df = spark.createDataFrame([(i, x, "src") for i, x in rows], "doc_id long, text string, component_id string").repartition(5)
    kept = sorted(((r.doc_id, r.text) for r in pj.keep_one(df, pj.Law(5, 80, 100)).collect()), key=str)
    assert kept == sorted([(3, t), (5, u), (None, "alone " * 9), (None, None), (4, ""), (4, "")], key=str)
    # two texts of a group with its smallest id: one stays; equal rows: one stays
    same = [(2, t), (2, t + " a"), (2, u), (2, u)]
    kept = pj.keep_one(spark.createDataFrame(same, "doc_id long, text string"), pj.Law(5, 80, 100)).collect()
    assert sorted(r.text[0] for r in kept) == ["t", "u"]


@pytest.mark.parametrize(("k", "num", "block"), [(3, 80, 1024), (3, 80, 7)])
def test_links_per_document_equal_brute_force(spark, k, num, block):
    rows = corpus(240, 11)
    s = [shingles(t, k) for _, t in rows]
    want = []
    for i, x in enumerate(s):
        n = sum(i != j and bool(x) and bool(y) and 100 * len(x & y) >= num * len(x | y) for j, y in enumerate(s))
        want.append((rows[i][0], len(x), n))
    assert max(n for *_, n in want) > 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pj.join(df, pj.Law(k, num, 100), block=block).select("doc_id", "n_shingles", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_linked_sets_share_a_signature_at_the_lowest_similarity():
    r = np.random.default_rng(5)
    law = pj.Law(3, 70, 100)
    for n in range(20, 400, 3):
        y = np.unique(r.integers(0, 2**62, n, dtype=np.uint64))
        x = np.sort(r.permutation(y)[: -(-len(y) * 7 // 10)])
        sig, who = pj.signatures(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), law)
        assert set(sig[who == 0]) & set(sig[who == 1]), n


def test_classes_of_registered_laws_are_as_before():
    for num in (80, 90):
        low = pj.classes(pj.Law(3, num, 100))[0]
        assert all(b == max(a + 1, pj.math.ceil(a * 1.25)) for a, b in zip(low, low[1:]))


@pytest.mark.parametrize(("num", "block"), [(70, 9), (75, 1024), (80, 6), (90, 5)])
def test_split_regions_equal_brute_force(spark, num, block):
    """Families of near copies larger than a task, at several similarities: every link, and components."""
    r = random.Random(num)
    rows = []
    for f in range(4):
        # in a family, changes drift: neighbours are near, the ends are far apart
        words = [f"f{f}w{i}" for i in range(40)]
        for _ in range(25):
            words[r.randrange(40)] = f"x{r.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[3][1]), (len(rows) + 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in pj.join(df, pj.Law(1, num, 100), block=block).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, 1, num, 100)
    s = [shingles(t, 1) for _, t in rows]
    want = {i: sum(i != j and bool(x) and bool(y) and 100 * len(x & y) >= num * len(x | y) for j, y in enumerate(s)) for i, x in enumerate(s)}
    assert {x.doc_id: x.n_links for x in pj.join(df, pj.Law(1, num, 100), block=block).collect()} == want


def drifting(n=60):
    r = random.Random(2)
    words, out = [f"w{i}" for i in range(60)], []
    for i in range(n):
        words[r.randrange(60)] = f"x{i}"
        out.append(np.unique(np.array([hash(w) & (1 << 62) - 1 for w in words], np.uint64)))
    return out


def test_cells_replicate_what_links_need(monkeypatch):
    """With windows of 2t both ends of every link meet in a cell; without replication some don't."""
    sets, law = drifting(), pj.Law(1, 80, 100)
    homes = {}

    def met(share):
        rows = [(0, 0, k, 1000 + k, False, sets[x].tobytes()) for k, x in enumerate((0, 20, 40, 59))] + [(0, 0, -1, i, True, s.tobytes()) for i, s in enumerate(sets)]
        batch = pj.pa.RecordBatch.from_arrays([pj.pa.array(c) for c in zip(*rows)], ["p", "salt", "k", "node", "home", "hashes"])
        of = {}
        for out in pj._cells(iter([batch]), pj.Law(1, share, 100), "sets"):
            for _, k, node, home in zip(*(out.column(i).to_pylist() for i in range(4))):
                of.setdefault(node, set()).add(k)
                if home:
                    assert homes.setdefault((share, node), k) == k
        return of

    linked = [(i, j) for i in range(60) for j in range(i) if law.den * len(np.intersect1d(sets[i], sets[j])) >= law.num * len(np.union1d(sets[i], sets[j]))]
    whole, narrow = met(80), met(99.9999)
    assert all(whole[i] & whole[j] for i, j in linked) and sum(map(len, whole.values())) < 4 * 60
    assert not all(narrow[i] & narrow[j] for i, j in linked)
    # the home of either end holds both, so each link counts in one cell
    assert all(homes[80, i] in whole[j] and homes[80, j] in whole[i] for i, j in linked)


def test_filter_passes_all_that_are_wanted(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    words = pj.wanted(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert pj.passes(words, keys).all() and pj.passes(words, ~keys).mean() < 0.01


def test_very_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in pj.join(df, pj.Law(3, 90, 100)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3)]
    assert pj.keep_one(df).count() == 2


def family(n, changes, seed=7):
    """n near copies of one text, each with some words of its own, and a few texts that are like none."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(80), changes):
            w[at] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"z{i}y{j}" for j in range(50))) for i in range(3)]


def test_a_family_is_not_dealt_into_pairs_of_blocks(spark, monkeypatch):
    """Members of a team meet no other; rows of tasks were as the square of a family."""
    made = {}
    dealt = pj.tasks

    def counted(cells, block):
        out = dealt(cells, block)
        made.setdefault(cells.count(), []).append(out.count())
        return out

    monkeypatch.setattr(pj, "tasks", counted)
    rows = family(300, 3)
    sizes = [(t, pj.links) for t in (150, 300)]
    for n, links in sizes:
        df = spark.createDataFrame([(i, t) for i, t in rows if i < n or i >= 300], "doc_id long, text string")
        law = pj.Law(1, 80, 100)
        found = pj._placed(s := pj._sizes(df, law, "doc_id", "text"), links(df, s, law, "doc_id", "text", 10, every=False))
        assert sorted(x.component_id for x in found.collect()) == [0] * n + [300, 301, 302]
    # a set would go to 15 blocks of 150 and to 30 of 300
    assert max(made) >= 300 and all(sum(x) <= 2 * n for n, x in made.items())


@pytest.mark.parametrize("changes", [8])
def test_teams_lose_no_link(spark, changes):
    """Pairs lie on both sides of the threshold, so some members link to no pivot, or to pivots of one team only by others."""
    rows = family(90, changes, changes)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    law = pj.Law(1, 80, 100)
    sizes = pj._sizes(df, law, "doc_id", "text")
    for every in (False, True):
        found = pj._placed(sizes, pj.links(df, sizes, law, "doc_id", "text", 8, every))
        assert sorted((x.doc_id, x.n, x.component_id) for x in found.collect()) == brute(rows, 1, 80, 100)


def test_lists_with_a_common_pivot_are_one_team():
    batch = pj.pa.RecordBatch.from_arrays([pj.pa.array([1, 2]), pj.pa.array([[[5, 3], [9], [3], [7, 9], [4, 5]], [[-2]]])], ["p", "lists"])
    got = [x for out in pj._merged(iter([batch])) for x in zip(*(out.column(i).to_pylist() for i in range(4)))]
    assert got == [(1, 3, 0, 3), (1, 4, 0, 3), (1, 5, 0, 3), (1, 7, 1, 7), (1, 9, 1, 7), (2, -2, 0, -2)]
