"""Hand-derived goldens (FIXTURES.md section 3)."""
from pyspark.sql import functions as F

from assetflow.functions import hashing as H
from assetflow.functions import paths as P
from assetflow.functions import text as T
from assetflow.operators import combos, dedup, filters, history, paging, scoring, toggle
from assetflow.plans import moves


def _levels_hex(spark, px, bits):
    df = spark.createDataFrame([(px,)], "px array<int>")
    lv = H.gray_levels(F.col("px"), bits)
    r = df.select(lv.alias("lv"), H.levels_to_bits(lv, bits).alias("b"),
                  H.bits_to_hex(H.levels_to_bits(lv, bits)).alias("h")).first()
    return list(r.lv), r.b, r.h


def test_phash_quantisation(spark):
    cases = [([0, 85, 170, 255], 2, [0, 1, 2, 4], "000110100", "0x34"),
             ([0, 85, 170, 255], 1, [0, 0, 1, 2], "00110", "0x6"),
             ([0, 1, 2, 3], 2, [0, 0, 0, 0], "00000000", "0x0"),
             ([0, 1, 2, 3], 1, [0, 1, 2, 3], "011011", "0x1b"),
             ([7, 7, 7, 7], 2, [0, 0, 0, 0], "00000000", "0x0"),
             ([0, 2, 2, 2], 1, [0, 2, 2, 2], "0101010", "0x2a")]
    for px, bits, lv, b, h in cases:
        assert _levels_hex(spark, px, bits) == (lv, b, h)


def test_bits_to_hex_beyond_64_bits(spark):
    bits = "1" + "0" * 130 + "1011"
    df = spark.createDataFrame([(bits,)], "b string")
    assert df.select(H.bits_to_hex(F.col("b"))).first()[0] == hex(int(bits, 2))


def test_resize_static_equals_dynamic(spark):
    import random
    rnd = random.Random(1)
    rows = [([rnd.randrange(256) for _ in range(48)],) for _ in range(20)]
    df = spark.createDataFrame(rows, "px array<int>").withColumn("h", F.lit(6)).withColumn("w", F.lit(8))
    for oh, ow in [(4, 4), (5, 5), (3, 8), (7, 7)]:
        a = df.select(H.resize_box(F.col("px"), F.col("h"), F.col("w"), oh, ow).alias("a"),
                      H.resize_box(F.col("px"), 6, 8, oh, ow).alias("b"))
        assert a.filter(F.col("a") != F.col("b")).count() == 0


def test_combinations(spark):
    ops = spark.createDataFrame([(0, 73, 27, 27, 73)], "set_id long, a long, b long, c long, d long")
    p = combos.problems(ops)
    assert p.count() == 560
    counts = {r.value: r.n_problems for r in combos.value_counts(p).collect()}
    assert counts == {-200: 35, -146: 70, -92: 35, -54: 70, 0: 140, 54: 70, 92: 35, 146: 70, 200: 35}
    assert combos.select_values(p).count() == 210
    # rendered problems evaluate (as Python expressions) to their value
    for r in p.limit(60).collect():
        assert eval(r.problem, {}, {}) == r.value  # noqa: S307 - test oracle on generated arithmetic


def test_duplicate_ranking(spark):
    rows = [("b", 10, 10, 5), ("a", 10, 10, 5), ("c", 20, 5, 1)]
    df = spark.createDataFrame(rows, "path string, w long, h long, size long") \
        .withColumn("hash_type", F.lit("md5")).withColumn("hash", F.lit("x"))
    plan = dedup.dedup_plan(df, dedup.md5_family(), "/t")
    assert {r.path: r.action for r in plan.collect()} == {"a": "keep", "b": "move", "c": "move"}
    fam = dedup.phash_family()
    df2 = df.withColumn("hash_type", F.lit(fam.hash_types[0]))
    plan2 = dedup.dedup_plan(df2, fam)
    assert {r.path: r.action for r in plan2.collect()} == {"c": "keep", "a": "move", "b": "move"}
    assert dict((r.path, r.dst) for r in plan.collect())["b"] == "/t/b"


def test_cleanup_classification(spark):
    rows = [("d/x.php", 10, True), ("d/y.php", 30000, True), ("d/x.jpg", 30000, False), ("d/x.html", 5, True),
            ("d/z.jpg", 30000, True)]
    df = spark.createDataFrame(rows, "path string, size long, valid boolean")
    out = {r.path: r.action for r in filters.cleanup_classify(df, valid="valid", size_threshold=20480,
                                                               patterns=[".*\\.php$"]).collect()}
    assert out == {"d/x.php": "small", "d/y.php": "pattern", "d/x.jpg": "invalid", "d/z.jpg": "keep"}


DIM = scoring.ClassDimension(rows=(("A", 1024, "99"), ("F", 4, "19"), ("X", 1, "09-x"), ("Y", 1, "09-y")), face_bit=4)


def test_scoring(spark):
    det = spark.createDataFrame([(1, "F", 0.5), (2, "Y", 0.0), (3, "A", 0.0), (3, "F", 0.0)],
                                "asset_id long, class string, score double")
    assets = spark.createDataFrame([(i,) for i in range(1, 5)], "asset_id long")
    s = scoring.label_assets(scoring.score_assets(assets, det, DIM), DIM)
    got = {r.asset_id: (r.score, r.label) for r in s.collect()}
    assert got == {1: (6.0, "face-19"), 2: (1.0, "09-x"), 3: (1028.0, "face-99"), 4: (0.0, "00-neutral")}


def test_unknown_class_is_an_error(spark):
    import pytest
    det = spark.createDataFrame([(1, "Q", 0.5)], "asset_id long, class string, score double")
    with pytest.raises(Exception):
        scoring.weighted_detections(det, DIM).collect()


def test_paging(spark):
    rows = [("a", float(i), 1, f"p{i:05d}") for i in range(1001)] + [("b", 0.0, 1, "q")]
    df = spark.createDataFrame(rows, "label string, score double, size long, path string")
    r = paging.report_rows(df, "label", ("score", "size", "path"), imgs_per_row=10)
    pages = paging.report_pages(r, "label", imgs_per_row=10)
    a = pages.filter("label = 'a'")
    assert a.agg(F.max("row_idx")).first()[0] == 100
    assert sorted(x[0] for x in a.select("page").distinct().collect()) == [0, 1]
    b = pages.filter("label = 'b'").first()
    assert (b.page, b.page_name) == (2, "b-002")


def test_align_and_width(spark):
    df = spark.createDataFrame([("ab", "abcde"), ("中文", "zw")], "a string, b string")
    r = df.select(T.align_pair(F.col("a"), F.col("b")).alias("p"), T.display_width(F.col("a")).alias("w")).collect()
    assert (r[0].p.a, r[0].p.b) == (" ab  ", "abcde")
    assert r[1].w == 4 and (r[1].p.a, r[1].p.b) == ("中文", " zw ")


def test_flat_rename(spark):
    df = spark.createDataFrame([("a.b.jpg",), ("js",)], "p string")
    out = [r[0] for r in df.select(P.flat_name(F.col("p"))).collect()]
    assert out[0].startswith("a.b.") and out[0].endswith(".jpg") and len(out[0]) == len("a.b..jpg") + 16
    assert out[1].startswith(".") and out[1].endswith(".js") and len(out[1]) == 1 + 16 + 3


def test_history_pairing(spark):
    vals = ["#1", "#2", "ls", "pwd", "#5", "ls"]
    df = spark.createDataFrame([("h", i + 1, v) for i, v in enumerate(vals)], "file string, line_no long, value string")
    got = {(r.ts, r.cmd) for r in history.unique_history(df).collect()}
    assert got == {(0, "pwd"), (5, "ls")}


def test_toggle(spark):
    log = spark.createDataFrame([(1, "toggle", "x"), (2, "toggle", "y"), (3, "toggle", "x")],
                                "seq long, kind string, item string")
    st = toggle.toggle_state(log)
    assert {r.item for r in st.filter("moved").collect()} == {"y"}
    assert toggle.moved_count(st).first().counter == 1
    log2 = log.unionByName(spark.createDataFrame([(4, "reset", None)], "seq long, kind string, item string"))
    st2 = toggle.toggle_state(log2)
    c = toggle.moved_count(st2).first()
    assert (c.counter, c.n_moved) == (0, 1)


def test_move_plan_and_conflicts(spark):
    df = spark.createDataFrame([("/s/a/x.jpg",), ("/s/b/x.jpg",), ("/s/.DS_Store",)], "path string")
    plan = moves.move_plan(df, "/d", "/s")
    assert {(r.src, r.dst, r.dst_dir) for r in plan.collect()} == {
        ("/s/a/x.jpg", "/d/a/x.jpg", "/d/a"), ("/s/b/x.jpg", "/d/b/x.jpg", "/d/b")}
    flat = moves.move_plan(df, "/d", "/s", keep_structure=False)
    assert flat.select("dst").distinct().count() == 2
    existing = spark.createDataFrame([("/d/a/x.jpg",)], "path string")
    c = moves.move_conflicts(plan, existing)
    assert [(r.src, r.reason) for r in c.collect()] == [("/s/a/x.jpg", "exists")]


def test_quote_path(spark):
    from urllib.parse import quote
    samples = ["a b/c~*+é.php?x=1", "中文/目录 1/(x)!'.png", "plain/path.jpg"]
    df = spark.createDataFrame([(s,) for s in samples], "p string")
    assert [r[0] for r in df.select(P.quote_path(F.col("p"))).collect()] == [quote(s) for s in samples]


def test_han_predicate(spark):
    df = spark.createDataFrame([("中",), ("中文",), ("a",), ("中a",), ("",)], "s string")
    assert [r[0] for r in df.select(T.is_han(F.col("s"))).collect()] == [True, True, False, False, False]


def test_recent_unique_keeps_latest(spark):
    cmds = ["ls", "pwd ", "ls", "#12", "git st", "pwd"]
    df = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cmds)], "line_no long, cmd string")
    got = [(r.cmd, r.line_no) for r in history.recent_unique(df, n=2).collect()]
    assert got == [("git st", 5), ("pwd", 6)]


def test_report_keeper_must_be_relative(spark):
    import pytest

    from assetflow.plans import reports
    rows = [("/abs/a.jpg", 1, 1, 1, "md5", "h"), ("/abs/b.jpg", 1, 1, 1, "md5", "h")]
    long = spark.createDataFrame(rows, "path string, w long, h long, size long, hash_type string, hash string")
    plan = dedup.dedup_plan(long, dedup.md5_family())
    with pytest.raises(Exception):
        reports.group_report_lines(plan, checkpoint=False).collect()


def test_hash_type_registered_twice_is_an_error():
    import pytest
    with pytest.raises(ValueError):
        dedup.register_families(dedup.md5_family(), dedup.md5_family())


def test_magic_types(spark):
    samples = [bytes.fromhex("89504e470d0a1a0a"), b"GIF89a..", bytes.fromhex("ffd8ffe000104a46"),
               b"RIFF\x00\x00\x00\x00WEBPVP8 ", b"RIFF\x00\x00\x00\x00WAVEfmt ", b"BM\x00\x00", b"\x0a\x0b\x0c\x0d",
               b"B"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, b binary")
    got = [(r.a, r.b) for r in df.orderBy("i").select(filters.magic_type(F.col("b")).alias("a"),
                                                       filters.magic_type(F.col("b"), check_webp=True).alias("b")).collect()]
    assert got == [("PNG", "PNG"), ("GIF", "GIF"), ("JPEG", "JPEG"), ("RIFF/WEBP", "WEBP"), ("RIFF/WEBP", "RIFF"),
                   ("BMP", "BMP"), ("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "UNKNOWN")]


def test_scale_conf():
    from assetflow.session import scale_conf
    c = scale_conf(100 * 10 ** 12)
    assert int(c["spark.sql.shuffle.partitions"]) == -(-100 * 10 ** 12 // (256 * 2 ** 20))
    assert scale_conf(10)["spark.sql.shuffle.partitions"] == "200"


def test_history_timestamps_numeric_and_strict(spark):
    vals = ["#9", "make", "#10", "make", "#note", "ls"]
    df = spark.createDataFrame([("h", i + 1, v) for i, v in enumerate(vals)], "file string, line_no long, value string")
    got = {(r.cmd, r.ts) for r in history.unique_history(df).collect()}
    # "#10" > "#9" numerically (string order would pick 9); "#note" is a command, not a timestamp
    assert got == {("make", 10), ("#note", 0), ("ls", 0)}
