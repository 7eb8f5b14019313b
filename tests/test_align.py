"""Aligned diff against a brute-force longest common subsequence."""
import random

import pytest
from pyspark.sql import functions as F

from assetflow.operators import align


def table(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_myers_equals_brute_force():
    r = random.Random(2)
    for _ in range(3000):
        k = r.choice([1, 2, 3, 5, 20])
        a, b = ([r.randrange(k) for _ in range(r.randrange(14))] for _ in range(2))
        got = align.common_lines(a, b)
        assert len(got) == table(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_longest_increasing():
    r = random.Random(3)
    for _ in range(500):
        v = r.sample(range(30), r.randrange(12))
        got = [v[i] for i in align.longest_increasing(v)]
        assert got == sorted(got) and len(got) == table(v, sorted(v))


def versions():
    r = random.Random(5)
    files = {}
    for n in range(60):
        size, kinds = r.choice([0, 3, 20, 60]), r.choice([2, 5, 1000])
        a = [f"l{r.randrange(kinds)}" for _ in range(size)]
        b = list(a)
        for _ in range(r.randrange(8)):
            at = r.randrange(len(b) + 1)
            kind = r.randrange(4)
            if kind == 0:
                b[at:at + r.randrange(6)] = []
            elif kind == 1:
                b[at:at] = [f"n{r.randrange(9)}"] * r.randrange(1, 4)
            elif kind == 2 and b:
                move = b[at:at + 10]
                b[at:at + 10] = []
                to = r.randrange(len(b) + 1)
                b[to:to] = move
            else:
                b[at:at] = [""]
        files[f"f{n}"] = (a, b)
    files["gone"], files["new"], files["blank"], files["same"] = (["x", "y"], []), ([], ["x"]), ([""] * 40, [""] * 45), (["p"] * 30, ["p"] * 30)
    files["swapped"] = ([f"s{i}" for i in range(50)], [f"s{i}" for i in range(25, 50)] + [f"s{i}" for i in range(25)])
    return files


@pytest.mark.parametrize("minimal", [True, False])
@pytest.mark.parametrize("block", [1 << 16, 7])
def test_script_turns_left_into_right(spark, monkeypatch, minimal, block):
    monkeypatch.setattr(align, "BLOCK", block)
    files = versions()
    rows = [[(f, i + 1, v if v else None) for f, pair in files.items() for i, v in enumerate(pair[s])] for s in (0, 1)]
    left, right = (spark.createDataFrame(x, "file string, line_no int, value string").withColumn("pos", F.lit("clash")) for x in rows)
    script = align.aligned_diff(left, right, minimal=minimal).collect()
    edits = {}
    for r in script:
        edits.setdefault(r["file"], []).append(r)
    for f, (a, b) in files.items():
        gone = {r["line_no"] for r in edits.get(f, []) if r["op"] == "-"}
        new = {r["line_no"]: r for r in edits.get(f, []) if r["op"] == "+"}
        stay = [(i + 1, v) for i, v in enumerate(a) if i + 1 not in gone]
        kept = [v for j, v in enumerate(b) if j + 1 not in new]
        assert [v for _, v in stay] == kept                                   # the lines that stay are the same on both sides
        assert all((r["value"] or "") == b[j - 1] for j, r in new.items())
        if minimal:
            assert len(stay) == table(a, b), f
        pairs = list(zip([i for i, _ in stay], [j + 1 for j in range(len(b)) if j + 1 not in new]))
        for j, r in new.items():
            assert r["other_no"] == max((i for i, k in pairs if k < j), default=None)
    if minimal:
        again = align.apply_script(left, align.aligned_diff(left, right)).collect()
        for f, (_, b) in files.items():
            assert [r["value"] or "" for r in sorted((r for r in again if r["file"] == f), key=lambda r: r["line_no"])] == b


def test_patience_cuts_at_the_longest_chain_of_unique_lines(spark):
    a = ["{", "a1", "}", "{", "a2", "}", "{", "a3", "}"]
    b = ["{", "a2", "}", "{", "a3", "}", "{", "new", "}", "{", "a1", "}"]
    rows = lambda x: spark.createDataFrame([("f", i, v) for i, v in enumerate(x)], "file string, line_no int, value string")      # noqa: E731
    kept = {r["line_no"] for r in align.aligned_diff(rows(a), rows(b), minimal=False).filter("op = '-'").collect()}
    assert 4 not in kept and 7 not in kept and 1 in kept


def test_empty_and_null_files(spark):
    schema = "file string, line_no int, value string"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([("f", 1, "x"), (None, 1, "y")], schema)
    assert align.aligned_diff(none, none).count() == 0
    assert {tuple(r) for r in align.aligned_diff(some, none).collect()} == {("f", "-", 1, None, "x"), (None, "-", 1, None, "y")}


@pytest.mark.parametrize("minimal", [True, False])
def test_short_files_are_not_joined_with_carried_values(spark, monkeypatch, minimal):
    files = {f: p for f, p in versions().items()}
    rows = [[(f if f != "f3" else None, i + 1, v) for f, pair in files.items() for i, v in enumerate(pair[s])] for s in (0, 1)]
    left, right = (spark.createDataFrame(x, "file string, line_no int, value string") for x in rows)
    used, plain = [], align.running
    monkeypatch.setattr(align, "running", lambda *a, **k: used.append(k["spread"]) or plain(*a, **k))
    short = sorted(map(tuple, align.aligned_diff(left, right, minimal=minimal).collect()), key=str)
    assert used and not any(used)
    used.clear()
    monkeypatch.setattr(align, "BLOCK", 9)
    assert sorted(map(tuple, align.aligned_diff(left, right, minimal=minimal).collect()), key=str) == short
    assert used and all(used)
    few = spark.createDataFrame([(None, 1, 5), (None, 4, 2), ("a", 2, 7)], "k string, pos long, v long")
    values = {"m": ("max", F.col("v"), False), "n": ("min", F.col("v"), True), "s": ("sum", F.col("v"), False)}
    one, many = (plain(few, ["k"], "pos", values, spread=x) for x in (False, True))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
