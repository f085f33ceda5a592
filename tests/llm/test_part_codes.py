"""Integer product codes against a plain version without bounds."""

import math

import numpy as np
import pytest

from gleaner.llm import part_codes as P


def plain(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, vector) -> codebooks, codes and errors by id order, every distance computed."""
    x = np.array([[math.floor(1024 * float(np.float32(y))) for y in v] for _, v in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
    cuts = [i * x.shape[1] // parts for i in range(parts + 1)]
    books, codes, error = [], [], np.zeros(len(x), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[:, a:b]
        book = part[order[:entries]].copy()
        for step in range(rounds + 1):
            d = ((part[:, None, :] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if step == rounds:
                break
            for e in set(near.tolist()):
                own = part[near == e]
                book[e] = [math.floor(int(s) / len(own)) if abs(int(s)) < 2**40 else None for s in own.sum(0)]
        books.append(book)
        codes.append(near)
        error += d.min(1)
    return books, ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], error


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(y)) for y in centres[i % 12] + 0.2 * rng.normal(size=16)], int(i % 3)) for i in range(400)]
    return rows + [(400 + i, rows[7][1], 1) for i in range(100)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_equals_the_plain_version(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(7)
    for entries in (256, 20):
        books = P.fit(df, entries=entries)
        expect, codes, error = plain([(i, v) for i, v, _ in vectors], entries=entries)
        assert all((a == b).all() for a, b in zip(books.entries, expect, strict=True))
        got = {r.vec_id: (r.code, r.error) for r in P.encode(df, books).collect()}
        assert got == {i: (c, int(e)) for (i, _, _), c, e in zip(vectors, codes, error, strict=True)}
    assert len(P.decode(codes, books)) == len(vectors)


def test_bounds_leave_out_most_entries_and_no_nearest_one():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 16):
        book = rng.integers(-900, 900, (200, width))
        x = np.concatenate((book[rng.integers(0, 200, 500)] + rng.integers(-40, 40, (500, width)), rng.integers(-900, 900, (100, width))))
        index, far, exact = P.nearest(x, book)
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (far == d.min(1)).all()
        assert exact < 0.5 * d.size


def test_ties_go_to_the_lower_index():
    book = np.array([[4, 0], [0, 4], [0, 4], [0, -4]])
    index, far, _ = P.nearest(np.array([[0, 0], [0, 4], [1, -4]]), book)
    assert index.tolist() == [0, 1, 3] and far.tolist() == [16, 0, 1]


def test_odd_rows(spark):
    good = [0.5, -0.25, 0.125, 1.0]
    rows = [(1, good, None, "x"), (1, good, 2, "x"), (None, [-0.001] * 4, None, "x"), (2, None, 1, "x"), (3, [0.1, None, 0.2, 0.3], 1, "x"), (4, [float("nan")] * 4, 1, "x")]
    rows += [(5, [float("inf"), 0.0, 0.0, 0.0], 1, "x"), (6, [], 1, "x"), (7, [1.0] * 8, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", code string")  # a column that the result has too
    got = sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in P.digests(df).collect())
    assert got == [(-1, "02020202", 0, 0), (1, "00000000", 0, 0), (1, "00000000", 0, 0)]
    books = P.fit(df)
    assert [b[2].tolist() for b in books.entries] == [[-2]] * 4  # floors, not truncated


def test_empty_table_and_too_large_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.digests(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and P.digests(none).count() == 0
    with pytest.raises(OverflowError):
        P.scaled(__import__("pyarrow").array([[1e30] * 4]), 4)


def test_labels_are_summed_over_all_their_rows(spark, vectors):
    rows = P.digests(spark.createDataFrame(vectors, SCHEMA)).collect()
    label = {i: g for i, _, g in vectors}
    total = {}
    for r in rows:
        total[label[r.vec_id]] = total.get(label[r.vec_id], 0) + r.error
    assert all(r.label_error == total[label[r.vec_id]] for r in rows) and len(rows) == len(vectors)
