"""Delta cache against a plain dictionary, commits and vacuum."""
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assetflow.plans.delta_cache import Conflict, DeltaCache

SCHEMA = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("v", StringType())])


def test_refreshes_equal_a_dictionary_and_write_the_change_only(spark, tmpdir_path):
    r = random.Random(6)
    cache, have = DeltaCache(spark, tmpdir_path, SCHEMA), {}
    assert cache.read().count() == 0 and cache.versions() == []
    for step in range(7):
        files = {(f"f{i}", r.choice([1, 2])) for i in r.sample(range(30), r.randrange(25))}
        df = spark.createDataFrame([(p, s, f"content {p}") for p, s in files], "path string, size long, content string")
        seen = []

        def compute(misses):
            seen.extend((x["path"], x["size"]) for x in misses.collect())
            return misses.select("path", "size", F.concat(F.col("content"), F.lit(f" of {step}")).alias("v"))
        before = cache.parts()
        version = cache.refresh(df, compute, max_parts=9)
        want = {k: have.get(k, f"content {k[0]} of {step}") for k in files}
        assert set(seen) == set(want) - set(have) and len(seen) == len(set(seen))
        got = [((x["path"], x["size"]), x["v"]) for x in cache.read().collect()]
        assert dict(got) == want and len(got) == len(want)
        new = [p for p in cache.parts(step + 1 if step < 3 else None) if p not in before]
        if version == len(before) + 1 or step < 3:
            assert sum(p["rows"] for p in new if p["kind"] == "rows") <= max(len(seen), len(want))
        have = want
    assert len(cache.parts()) <= 10


def test_incomplete_rows_are_replaced(spark, tmpdir_path):
    cache = DeltaCache(spark, tmpdir_path, SCHEMA)
    df = spark.createDataFrame([("a", 1), ("b", 1)], "path string, size long")
    cache.refresh(df, lambda d: d.withColumn("v", F.when(F.col("path") == "a", "old")))
    cache.refresh(df, lambda d: d.withColumn("v", F.lit("new")), complete=lambda d: d.filter("v is not null"))
    assert {(x["path"], x["v"]) for x in cache.read().collect()} == {("a", "old"), ("b", "new")}
    assert [(p["kind"], p["rows"]) for p in cache.parts()] == [("rows", 2), ("rows", 1), ("gone", 1)]
    assert {(x["path"], x["v"]) for x in cache.read(1).collect()} == {("a", "old"), ("b", None)}      # versions stay readable


def test_a_version_is_committed_once(spark, tmpdir_path):
    cache = DeltaCache(spark, tmpdir_path, SCHEMA)
    cache.refresh(spark.createDataFrame([("a", 1)], "path string, size long"), lambda d: d.withColumn("v", F.lit("x")))
    with pytest.raises(Conflict):
        cache._commit(1, [])
    assert len(cache.parts()) == 1 and not [n for n in os.listdir(f"{tmpdir_path}/_manifest") if n.startswith(".") and not n.endswith(".crc")]
    # a refresh that fails half-way leaves the version before
    with pytest.raises(Exception):
        cache.refresh(spark.createDataFrame([("b", 1)], "path string, size long"), lambda d: d.select("path"))
    assert [x["path"] for x in cache.read().collect()] == ["a"] and cache.versions() == [1]


def test_vacuum_deletes_what_no_version_names(spark, tmpdir_path):
    cache = DeltaCache(spark, tmpdir_path, SCHEMA)
    for names in ("ab", "bc", "cd"):
        cache.refresh(spark.createDataFrame([(n, 1) for n in names], "path string, size long"), lambda d: d.withColumn("v", F.col("path")))
    cache.compact()
    assert len(cache.vacuum(keep=1)) == 5 and cache.versions() == [4]
    assert sorted(x["path"] for x in cache.read().collect()) == ["c", "d"] and cache.vacuum(keep=1) == []
