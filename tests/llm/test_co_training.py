import numpy as np

from gleaner.llm import co_training as co
from gleaner.session import table

SF = "/root/testdata/sf0.01"


def test_accuracy_on_rows_not_fitted(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = co.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert sum(model.history[0]) > 0
    y = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in co.score(docs, model).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i].kept == bool(q) for i, q in y.items()]) > 0.93
    assert np.mean([got[i].kept for i, q in y.items() if q]) > 0.96
    kept = co.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())


def newton(x, y, w, l2, mean, scale):
    z = np.hstack((np.clip((x - mean) * scale, -8, 8), np.ones((len(x), 1))))
    pull = np.append(np.full(x.shape[1], l2), 1e-3)
    v = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ v))
        v -= np.clip(np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(pull), z.T @ (w * (p - y)) + pull * v), -2, 2)
    return lambda q: np.hstack((np.clip((q - mean) * scale, -8, 8), np.ones((len(q), 1)))) @ v


def views(n, seed=0):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.4).astype(float)
    return y, (y[:, None] * 2 + r.normal(size=(n, 3))).astype(np.float32), (y[:, None] * 1.5 + r.normal(size=(n, 4))).astype(np.float32)


def test_fit_equals_a_plain_one(spark):
    y, a, b = views(1200)
    known, aside = np.arange(1200) < 200, np.arange(1200) % 4 == 3
    rows = [(int(y[i]) if known[i] else None, bool(aside[i]), a[i].tobytes(), b[i].tobytes()) for i in range(1200)]
    df = spark.createDataFrame(rows, "y int, aside boolean, a binary, b binary").repartition(5).checkpoint()
    plan = co.Plan(steps=30)
    model = co.co_train(df, plan, (3, 4))
    # the same in memory
    own = known & ~aside
    x = [a.astype(float), b.astype(float)]
    moments = [(v[known].mean(0), 1 / v[known].std(0)) for v in x]
    fits = [newton(v[own], y[own], np.ones(own.sum()), plan.l2, *m) for v, m in zip(x, moments)]
    for _ in range(plan.rounds):
        z = [f(v) for f, v in zip(fits, x)]
        new = []
        for v, m, other in zip(x, moments, z[::-1]):
            sure = ~known & (np.abs(other) >= np.log(plan.sure / (1 - plan.sure)))
            label = (other > 0).astype(float)
            w = np.zeros(1200)
            for k in (0, 1):
                at = sure & (label == k)
                w[at] = min(1, (own & (y == k)).sum() / max(at.sum(), 1))
            w[own] = 1
            new.append(newton(v[w > 0], np.where(known, y, label)[w > 0], w[w > 0], plan.l2, *m))
        fits = new
    cal = known & aside
    z = [f(v)[:, None] for f, v in zip(fits, x)]
    flat = [newton(q[cal], y[cal], np.ones(cal.sum()), 0.1, 0, 0.4)(q) for q in z]
    both = np.stack(flat, 1)
    want = 1 / (1 + np.exp(-newton(both[cal], y[cal], np.ones(cal.sum()), 0.1, 0, 0.4)(both)))
    assert np.allclose(model.score(*x), want, atol=2e-3)
    assert ((want > 0.5) == y)[~known].mean() > 0.9


def test_pseudo_labels_help_a_view(spark):
    y, a, b = views(4000, 3)
    rows = [(int(y[i]) if i < 30 else None, i % 4 == 3, a[i].tobytes(), b[i].tobytes()) for i in range(2000)]
    df = spark.createDataFrame(rows, "y int, aside boolean, a binary, b binary").checkpoint()
    right = []
    for rounds in (0, 3):
        m = co.co_train(df, co.Plan(rounds=rounds), (3, 4))
        assert len(m.history) == rounds and all(sum(h) > 300 for h in m.history)
        right.append(np.mean([((v.logit(x[2000:].astype(float)) > 0) == y[2000:]).mean() for v, x in zip(m.views, (a, b))]))
    assert right[1] > right[0]


def test_metadata_sees_no_text(spark):
    rows = [(i, "word " * i, "en", "s", 100) for i in range(5)]
    assert len({tuple(m) for m in co.metadata(*(list(x) for x in zip(*((r[2], r[3], r[4]) for r in rows))))}) == 1


def test_ties_long_texts_and_repeated_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(400)
    more = spark.createDataFrame([(10**6, "w x. " * 60_000, "en", "a", 10**9), (1, "again", None, None, -5), (1, "again", None, None, -5)], docs.schema)
    labels = table(spark, SF, "labels").unionByName(spark.createDataFrame([(10**6, 1, 0), (10**6, 0, 0), (1, None, 0)], table(spark, SF, "labels").schema))
    both = docs.unionByName(more)
    model = co.fit(both, labels)
    got = co.score(both, model).collect()
    assert len(got) == both.count() and len({r.score for r in got if r.doc_id == 1 and r.score == got[-1].score}) == 1
    edge = got[0].score
    assert next(r for r in co.score(both, model, threshold=edge).collect() if r.doc_id == got[0].doc_id).kept


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (1, "", "en", "y"), (None, "a b", "en", "z")], "doc_id long, text string, lang string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = co.fit(docs, none)
    assert [r.score for r in co.score(docs, model).collect()] == [1.0] * 3
    assert co.keep(docs, model).count() == 3 and co.keep(docs, model).columns == docs.columns
    sf = co.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert co.score(docs, sf).count() == 3 and co.score(docs.limit(0), sf).count() == 0
