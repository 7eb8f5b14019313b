"""Properties: skew-safe ranking, caps, folds, plans, caches."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetflow.operators import dedup, gloss
from assetflow.operators.ranking import rank_within_groups


def rank_within_groups_plain(df, group_cols, order_cols, rank_col):
    """The definition: one window per group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long"))


def test_rank_of_a_large_frame_with_a_hot_group(spark):
    # more rows than the range sampling looks at, columns beyond the sort keys, half the rows in one group
    df = spark.range(0, 400_000, 1, 7).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 1001).cast("string"))).alias("g"),
        (F.xxhash64("id") % 50).alias("s"), F.format_string("p%07d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))
    got = rank_within_groups(df, ["g"], ["s", "path"], "r", num_partitions=24).select("path", "r")
    want = rank_within_groups_plain(df, ["g"], ["s", "path"], "w").select(F.col("path").alias("p"), "w")
    met = got.join(want, F.col("path") == F.col("p"))
    assert met.count() == 400_000 and met.filter("r <> w").count() == 0
from assetflow.plans import cache


def test_rank_helper_equals_plain_window_with_hot_group(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"
        rows.append((g, rnd.random(), rnd.randrange(5), f"p{i:05d}"))
    rows.append((None, 0.5, 1, "pnull"))
    df = spark.createDataFrame(rows, "label string, score double, size int, path string")
    order = ["score", F.col("size").desc(), "path"]
    a = rank_within_groups(df, ["label"], order, "r", num_partitions=8).select("path", "r")
    b = rank_within_groups_plain(df, ["label"], order, "r").select("path", "r")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    glob = rank_within_groups(df, [], ["path"], "r", num_partitions=8)
    assert glob.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first() == (1, 3001, 3001)


def test_caps_keep_the_first_per_line_and_overall(spark):
    # five a in line 1 of document 1, two more a and one b in line 2, four a in document 2
    rows = [(1, 1, p, "a") for p in (9, 2, 4, 7, 5)] + [(1, 2, 0, "a"), (1, 2, 1, "b"), (1, 2, 2, "a")] + [(2, 1, p, "a") for p in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, pos long, ch string")
    got = sorted((r.doc_id, r.line_no, r.pos, r.ch) for r in gloss.capped_annotations(df, 3, 7).collect())
    assert got == [(1, 1, 2, "a"), (1, 1, 4, "a"), (1, 1, 5, "a"), (1, 2, 0, "a"), (1, 2, 1, "b"), (1, 2, 2, "a"), (2, 1, 0, "a"), (2, 1, 1, "a")]


def test_native_fold_equals_udf(spark):
    from native_fold import interlinear
    g = {"é": "e1", "中": "zhong", "文": "wen"}
    lines = ["héllo wörld " * 9, "中 文 中文 abc", "", "short", "x" * 70 + " y", "中文中文 中 文 " * 6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    v = F.concat(F.col("value"), F.lit("\n"))
    toks = F.transform(gloss.word_tokens(v), lambda w: F.struct(w.alias("text"), gloss.translate_with(w, g).alias("gloss")))
    out = df.select("i", interlinear(toks, 20, "\\p{IsHan}").alias("n"),
                    gloss.interlinear_udf(g, 20, "\\p{Han}")(v).alias("u"))
    for r in out.collect():
        assert [tuple(x) for x in r.n] == [tuple(x) for x in r.u], r.i
        assert all(len(x.p) > 20 or x is r.n[-1] for x in r.n)


def test_dedup_plan_one_keeper_per_group(spark):
    from assetflow.plans.catalog import QUERIES
    plan = QUERIES["dedup_plan"](spark, "/root/testdata/sf0.001")
    per = plan.groupBy("hash_type", "hash").agg(F.count(F.when(F.col("action") == "keep", 1)).alias("k"))
    assert per.filter("k <> 1").count() == 0
    assert plan.select("dst").distinct().count() == plan.count()


def test_cache_refresh_idempotent(spark, tmpdir_path):
    cur = spark.createDataFrame([(f"f{i}", i, f"c{i}") for i in range(50)], "path string, size long, content string")
    schema = "path string, size long, md5 string"
    calls = []

    def compute(m):
        calls.append(m.count())
        return m.select("path", "size", F.md5("content").alias("md5"))

    empty = spark.createDataFrame([], schema)
    v1 = cache.refresh(cur, empty, compute)
    out1 = cache.write_version(v1, tmpdir_path, 1)
    v2 = cache.refresh(cur, spark.read.parquet(out1), compute)
    assert calls == [50, 0]
    assert v2.exceptAll(v1).count() == 0 and v1.exceptAll(v2).count() == 0
    changed = cur.withColumn("size", F.when(F.col("path") == "f3", F.lit(999)).otherwise(F.col("size")))
    cache.refresh(changed, spark.read.parquet(out1), compute)
    assert calls[-1] == 1


def test_time_queries_do_not_depend_on_session_zone(spark):
    from assetflow.plans.catalog import QUERIES
    names = ["epoch_from_ts", "ts_from_epoch", "history_unique"]
    old = spark.conf.get("spark.sql.session.timeZone")
    got = {}
    try:
        for tz in ["UTC", "America/Los_Angeles"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            for n in names:
                got[(tz, n)] = sorted(map(tuple, QUERIES[n](spark, "/root/testdata/sf0.001").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for n in names:
        assert got[("UTC", n)] == got[("America/Los_Angeles", n)], n


def test_report_pages_equal_plain_positions(spark):
    from assetflow.operators import paging, scoring
    from assetflow.plans import catalog
    from assetflow.sources import views
    sf = "/root/testdata/sf0.01"
    s = scoring.score_assets(views.detection_assets(spark, sf), views.detections(spark, sf), catalog.DRIVER_CLASSES)
    lab = scoring.label_assets(s.withColumn("score", F.round("score", 6)), catalog.DRIVER_CLASSES).checkpoint()
    got = paging.report_rows(lab, "label", imgs_per_row=7, num_partitions=16).select("asset_id", "pos")
    want = rank_within_groups_plain(lab, ["label"], ["score", "size", "path"], "pos").select("asset_id", "pos")
    assert got.count() == 1500 and got.exceptAll(want).count() == 0
    assert lab.select("label").distinct().count() >= 6


def test_rank_helper_shapes_and_partition_counts(spark):
    rnd = random.Random(21)
    shapes = {
        "one_group": [("g", rnd.random(), f"p{i:04d}") for i in range(400)],
        "all_distinct": [(f"g{i}", rnd.random(), f"p{i:04d}") for i in range(400)],
        "with_nulls": [(None if i % 5 == 0 else f"g{i % 7}", rnd.random(), f"p{i:04d}") for i in range(400)],
    }
    for name, rows in shapes.items():
        df = spark.createDataFrame(rows, "g string, s double, path string")
        want = rank_within_groups_plain(df, ["g"], ["s", "path"], "r").select("path", "r")
        for n in (1, 3, 16):
            got = rank_within_groups(df, ["g"], ["s", "path"], "r", num_partitions=n).select("path", "r")
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, (name, n)


def test_group_report_follows_the_family_order(spark):
    from assetflow.operators import dedup
    from assetflow.plans import reports
    rows = [("t", "h", "a.jpg", 10, 50, 40), ("t", "h", "b.jpg", 10, 80, 40), ("t", "h", "c.jpg", 99, 50, 40), ("t", "h", "d.jpg", 10, 50, 60)]
    long = spark.createDataFrame(rows, "hash_type string, hash string, path string, size long, w long, h long")
    family = dedup.HashFamily(name="f", hash_types=("t",), build=lambda: None,
                              order=lambda: [-F.col("w"), -F.col("h"), -F.col("size"), F.col("path")])
    lines = reports.group_report_lines(dedup.dedup_plan(long, family), family=family).filter("line like '<img%'").orderBy("seq").collect()
    assert [r.line.split('"')[1] for r in lines] == ["b.jpg", "d.jpg", "c.jpg", "a.jpg"]


def test_hot_group_members_are_dealt_over_tasks(spark):
    from assetflow.operators.salting import salted_join
    many = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("path"))
    few = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = salted_join(many, few, ["k"], ["path"]).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_hex_diff_of_bytes_equals_that_of_text(spark):
    """Repeated and missing ids included; only bytes are shuffled."""
    from assetflow.operators import search
    rows = [(0, "a" * 40), (1, "a" * 16 + "b" * 20), (2, "é\x00" * 9), (3, None), (4, "same" * 8), (5, "same" * 8), (6, "x"), (6, "xy"), (6, "é"), (7, "xy"), (None, "z")]
    df = spark.createDataFrame(rows, "id long, content string")

    def diff(chunk):
        hx = search.hex_rows(df, key="id", chunk=chunk)
        return search.hex_diff(hx.select("offset", "chunk" if chunk else "hex", F.floor(F.col("id") / 2).cast("long").alias("pair"), (F.col("id") % 2 == 1).alias("is_right")))
    got = diff(True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, diff(False).collect()), key=str)
    assert got.columns == ["pair", "offset", "left_hex", "right_hex"] and got.count() == 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "hex(" not in plan[plan.index("Aggregate"):]
