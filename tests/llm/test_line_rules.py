import random
import re

import pyarrow as pa
import pytest

from gleaner.llm import line_rules as lr


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


CASES = [None, "", " \n\t ", "a", "a\na\na", "é ñ é ñ é ñ 夢\n\n夢", "x | y | z\nHome About", "#*$%&|<> <a>\r\nb\x0bc\x0cd", "word " * 500]
_r = random.Random(3)
CASES += ["".join(_r.choice(["a", "b", "é", " ", "\n", "|", "!!", "  ", "cd."]) for _ in range(_r.randint(1, 300))) for _ in range(200)]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(CASES)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in lr.judge(df).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), (i, t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


def test_verdicts_and_cleaning(spark):
    good = prose(60) + "\n" + prose(60, 1)
    rows = [
        (1, good, 0, "a"),
        (2, good + "\nAll rights reserved.", 0, "a"),
        (3, " | ".join(prose(100, 2).split()), 0, "a"),
        (4, " ".join(x + "!!" for x in prose(100, 3).split()), 0, "a"),
        (5, " ".join(x for x in prose(30, 4).split() for _ in range(4)), 0, "a"),
        (6, None, 0, None),
        (7, "Home About\n" + good + "\nShare", 0, "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __0 string")
    assert {r.doc_id for r in lr.judge(df).collect() if r.kept} == {1, 2, 7}
    out = {r.doc_id: r for r in lr.clean(df).collect()}
    assert {i: r.text for i, r in out.items()} == {1: good, 2: good, 7: good}
    assert all(r.n_chars == len(good) for r in out.values()) and out[7]["__0"] == "b"
    assert lr.clean(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lr.judge(df).count() == 0 and lr.clean(df).count() == 0


def test_long_word_and_text():
    text = "x" * 3_000_000 + " " + "ab " * 100_000
    got, _, _ = lr.examine(*next(lr.W.groups(pa.array([text])))[2:], lr.Rules())
    assert got["n_words"][0] == 100_001 and got["word_chars"][0] == 3_200_000


@pytest.mark.parametrize("line", ["We use cookies here, truly.", "Read more"])
def test_boilerplate_lines_go(spark, line):
    good = prose(80, 9)
    df = spark.createDataFrame([(1, line + "\n" + good)], "doc_id long, text string")
    assert lr.clean(df).collect()[0].text == good


def test_lines_are_judged_apart_from_neighbouring_documents():
    good = prose(60, 5)
    texts = ["Home About\n" + good, good, "", "Home About\n" + good + "\nShare", good + "\nRead", "more of this. " + good, None, "Search"]

    def bad(column):
        return [int(x) for _, _, bounds, data in lr.W.groups(column) for x in lr.examine(bounds, data, lr.Rules())[0]["n_bad_lines"]]

    alone = [bad(pa.array([t], pa.string()))[0] for t in texts]
    assert alone == [1, 0, 0, 2, 0, 0, 0, 1]
    assert bad(pa.array(texts)) == alone and bad(pa.array(texts[::-1])) == alone[::-1]


def test_cleaning_keeps_other_breaks_whatever_the_batch(spark):
    a, b = prose(60, 6), prose(60, 7)
    texts = {
        1: (a + "\n\n" + b + "\n", a + "\n\n" + b + "\n"),
        2: ("Home\n" + a + "\n\n" + b + "\n", a + "\n\n" + b + "\n"),
        3: (a + "\n\n" + b + "\nShare", a + "\n\n" + b),
        4: (a + "\n\nHome\n\n" + b + "\nShare\nLogin", a + "\n\n\n" + b),
        5: ("\n" + a + "\n\nRead more", "\n" + a + "\n"),
        6: ("Share\n" + a, a),
        7: (a, a),
    }
    rows = [(i, t) for i, (t, _) in texts.items()]
    want = {i: t for i, (_, t) in texts.items()}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        assert {r.doc_id: r.text for r in lr.clean(df).collect()} == want
