"""File sources on small generated files (PNG written with zlib)."""
import os
import struct
import zlib

from pyspark.sql import functions as F

from assetflow.functions import hashing as H
from assetflow.operators import filters
from assetflow.sources import files


def _png(path, w, h, gray_rows):
    def chunk(t, data):
        c = struct.pack(">I", len(data)) + t + data
        return c + struct.pack(">I", zlib.crc32(t + data) & 0xFFFFFFFF)
    raw = b"".join(b"\x00" + bytes(r) for r in gray_rows)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _tree(root):
    os.makedirs(f"{root}/a b", exist_ok=True)
    os.makedirs(f"{root}/c", exist_ok=True)
    _png(f"{root}/a b/img 1.png", 4, 4, [[0, 85, 170, 255]] * 4)
    _png(f"{root}/c/flat.png", 4, 4, [[7, 7, 7, 7]] * 4)
    with open(f"{root}/c/bad.jpg", "wb") as f:
        f.write(b"not an image at all")
    with open(f"{root}/c/notes.txt", "w") as f:
        f.write("one\ntwo\nthree\n")


def test_listing_and_filters(spark, tmpdir_path):
    _tree(tmpdir_path)
    ls = files.list_files(spark, tmpdir_path)
    assert {r.relpath for r in ls.collect()} == {"a b/img 1.png", "c/flat.png", "c/bad.jpg", "c/notes.txt"}
    kept = filters.skip_filter(ls)
    assert {r.relpath for r in kept.collect()} == {"a b/img 1.png", "c/flat.png", "c/bad.jpg"}
    content = files.read_files(spark, tmpdir_path).withColumn("magic", filters.magic_type(F.col("content")))
    got = {r.relpath: r.magic for r in content.collect()}
    assert got["a b/img 1.png"] == "PNG" and got["c/bad.jpg"] == "UNKNOWN"


def test_read_lines_both_modes(spark, tmpdir_path):
    _tree(tmpdir_path)
    p = f"{tmpdir_path}/c/notes.txt"
    a = [(r.line_no, r.value) for r in files.read_lines(spark, p).orderBy("line_no").collect()]
    b = [(r.line_no, r.value) for r in files.read_lines(spark, p).orderBy("line_no").collect()]
    assert a == b == [(1, "one"), (2, "two"), (3, "three")]


def test_image_source_and_phash(spark, tmpdir_path):
    _tree(tmpdir_path)
    img = files.read_images(spark, tmpdir_path + "/*/*.*")
    rows = {os.path.basename(r.path): r for r in img.collect()}
    assert rows["bad.jpg"].height == -1 and not rows["bad.jpg"].valid
    good = rows["img 1.png"]
    assert (good.height, good.width, good.nChannels) == (4, 4, 1)
    gray = img.filter("valid").select("path", H.grayscale_bgr(F.col("data"), F.col("nChannels")).alias("px"),
                                     "height", "width")
    hashed = gray.select("path", H.phash(F.col("px"), F.col("height"), F.col("width"), 4, 2).alias("h")).collect()
    by = {os.path.basename(r.path): r.h for r in hashed}
    assert by["flat.png"] == "0x0"
    assert by["img 1.png"] == hex(int("000110100" * 4, 2))


def test_numpy_thumbnails_equal_native(spark):
    import random
    from assetflow.functions import thumbnails
    rnd = random.Random(5)
    rows = []
    for i in range(12):
        h, w, n = rnd.randrange(1, 23), rnd.randrange(1, 19), rnd.choice([1, 3, 4])
        rows.append((i, bytes(rnd.randrange(256) for _ in range(h * w * n)), h, w, n))
    df = spark.createDataFrame(rows, "i int, data binary, height int, width int, nChannels int")
    t = thumbnails.with_thumbnails(df)
    gray = H.grayscale_bgr(F.col("data"), F.col("nChannels"))
    for s in (4, 5, 6, 7, 8):
        native = H.resize_box(gray, F.col("height"), F.col("width"), s, s)
        bad = t.filter(F.col(f"thumbs.s{s}") != native)
        assert bad.count() == 0, s
    hashed = t.select(thumbnails.phash_map_from_thumbs(F.col("thumbs")).alias("m"),
                      H.phash_map(gray, F.col("height"), F.col("width")).alias("n"))
    assert hashed.filter(F.to_json("m") != F.to_json("n")).count() == 0


def test_read_lines_split_parallel_numbering(spark, tmpdir_path):
    p = f"{tmpdir_path}/big.txt"
    with open(p, "w") as f:
        for i in range(20000):
            f.write(f"line {i} " + "x" * (i % 37) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        df = files.read_lines(spark, p)
        assert df.rdd.getNumPartitions() > 1  # the file really is read in several splits
        got = df.select("line_no", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 20000
    assert all(int(r.value.split()[1]) + 1 == r.line_no for r in got)


def test_cleanup_on_real_files(spark, tmpdir_path):
    from assetflow.plans import moves
    _tree(tmpdir_path)
    with open(f"{tmpdir_path}/c/bad.jpg", "wb") as f:
        f.write(b"\x00" * 300)
    listing = files.list_files(spark, tmpdir_path)
    info = files.with_image_info(listing, files.read_images(spark, tmpdir_path))
    plan = moves.cleanup_plan(info, "/trash", src_root=tmpdir_path, valid="valid", size_threshold=50,
                              patterns=["flat"])
    got = {os.path.basename(r.src): (r.action, r.dst) for r in plan.collect()}
    assert got == {"flat.png": ("pattern", "/trash/c/flat.png"), "bad.jpg": ("invalid", "/trash/c/bad.jpg")}


def test_report_lines_written_in_order(spark, tmpdir_path):
    from assetflow.operators import dedup
    from assetflow.plans import reports
    rows = [(f"d/p{i:03d}.jpg", 10 + i % 3, 5, 100, "md5", f"h{i % 4}") for i in range(40)]
    long = spark.createDataFrame(rows, "path string, w long, h long, size long, hash_type string, hash string")
    plan = dedup.dedup_plan(long, dedup.md5_family(), "/t")
    lines = reports.group_report_lines(plan, 100, True)
    out = f"{tmpdir_path}/report"
    reports.write_lines(lines, out, ["hash_type"], ["hash", "seq"], num_partitions=3)
    folder = f"{out}/hash_type=md5"
    text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    got = text.splitlines()
    assert got[0] == "<tr><td>h0</td><td>" and got[1].startswith('<img src="d/p000.jpg"')
    assert got[11] == "</td></tr>" and len(got) == 4 * 12


def test_read_lines_has_one_rule_at_any_size(spark, tmpdir_path):
    texts = {"crlf": "a\r\nb\rc\n", "none": "", "open": "x\ny", "blank": "\n\nz\n", "large": "0123456789\r\n" * 30_000}
    for name, text in texts.items():
        with open(f"{tmpdir_path}/{name}.txt", "w", newline="") as f:
            f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "16k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in files.read_lines(spark, tmpdir_path).orderBy("file", "line_no").collect():
                got.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append((r.line_no, r.value))
            want = {n: list(enumerate(t[:-1].split("\n") if t.endswith("\n") else t.split("\n"), 1)) for n, t in texts.items() if t}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_image_dedup_on_real_files(spark, tmpdir_path):
    from assetflow.plans import image_dedup
    _tree(tmpdir_path)
    os.makedirs(f"{tmpdir_path}/d", exist_ok=True)
    _png(f"{tmpdir_path}/d/copy.png", 4, 4, [[0, 85, 170, 255]] * 4)            # same bytes as "a b/img 1.png"
    _png(f"{tmpdir_path}/d/big.png", 8, 8, [[0, 0, 85, 85, 170, 170, 255, 255]] * 8)  # same picture, larger
    md5 = image_dedup.image_dedup_plan(spark, tmpdir_path, "md5", "/trash")
    got = {r.path: r.action for r in md5.collect()}
    assert got == {"a b/img 1.png": "keep", "d/copy.png": "move"}
    ph = image_dedup.image_dedup_plan(spark, tmpdir_path, "simhash16x4")
    groups = {}
    for r in ph.collect():
        groups.setdefault(r.hash, {})[r.path] = r.action
    # the 8x8 picture keeps (largest w, h); its 4x4 copies hash the same and move
    assert {"d/big.png": "keep", "a b/img 1.png": "move", "d/copy.png": "move"} in groups.values()
    hashed = image_dedup.hashed_images(spark, tmpdir_path)
    assert {r.path for r in hashed.collect()} == {"a b/img 1.png", "c/flat.png", "d/copy.png", "d/big.png"}


def test_image_hashes_reuse_the_cache_per_type(spark, tmpdir_path):
    from assetflow.plans import image_dedup
    root = f"{tmpdir_path}/in"
    _tree(root)
    with open(f"{root}/c/large.png", "wb") as f:
        f.write(b"x" * 5000)
    first = image_dedup.refresh_hashes(spark, root, None, f"{tmpdir_path}/v1", max_size=4000)
    want = {r.path: r for r in first.collect()}
    assert set(want) == {"a b/img 1.png", "c/flat.png"}
    assert all(set(r.hashes) == set(image_dedup.hash_types()) and (r.w, r.h) == (4, 4) for r in want.values())
    # hashes in the cache are trusted; those it lacks are computed, files of another size are new
    one, gap = image_dedup.hash_types()[1], image_dedup.hash_types()[2]
    fake = [("a b/img 1.png", want["a b/img 1.png"].size, 4, 4, {t: "old" for t in image_dedup.hash_types() if t != gap}),
            ("c/flat.png", want["c/flat.png"].size + 1, 9, 9, {one: "stale"}), ("gone.png", 3, 1, 1, {one: "stale"})]
    spark.createDataFrame(fake, image_dedup.CACHE_SCHEMA).write.parquet(f"{tmpdir_path}/fake")
    got = {r.path: r for r in image_dedup.refresh_hashes(spark, root, f"{tmpdir_path}/fake", f"{tmpdir_path}/v2", max_size=4000).collect()}
    assert got["c/flat.png"] == want["c/flat.png"] and set(got) == set(want)
    mixed = got["a b/img 1.png"].hashes
    assert mixed.pop(gap) == want["a b/img 1.png"].hashes[gap] and set(mixed.values()) == {"old"}
    no_md5 = [(*r[:4], {t: "old" for t in r[4] if t != "md5"}) for r in want.values()]
    again = image_dedup.hashed_images(spark, root, 4000, spark.createDataFrame(no_md5, image_dedup.CACHE_SCHEMA))
    assert {r.path: r.hashes["md5"] for r in again.collect()} == {k: r.hashes["md5"] for k, r in want.items()}


def test_image_scans_are_pruned_and_thumbnails_run_once(spark, tmpdir_path):
    from assetflow.plans import image_dedup
    _tree(tmpdir_path)
    plan = image_dedup.hashed_images(spark, tmpdir_path, max_size=4000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("Scan image") > 0
    assert all("file_size" in x or "length" in x for x in plan.splitlines() if "FileScan" in x)
    assert not [x for x in plan.splitlines() if "Exchange" in x and ("content" in x or "data" in x)]


def test_score_report_on_real_files(spark, tmpdir_path):
    import pandas as pd

    from assetflow.operators import scoring
    from assetflow.plans import score_report
    for d in ("x", "y"):
        os.makedirs(f"{tmpdir_path}/imgs/{d}", exist_ok=True)
        for i in range(6):
            kind = "face" if i % 3 == 0 else "plain"
            _png(f"{tmpdir_path}/imgs/{d}/{kind}{i}.png", 2, 2, [[i, i], [i, i]])
    calls = spark.sparkContext.accumulator(0)

    def detector(pdf):
        calls.add(len(pdf))
        dets = [[{"class": "FACE", "score": 0.5, "box": [0, 0, 1, 1]}] if "face" in p else [] for p in pdf["path"]]
        return pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "detections": dets})

    dim = scoring.ClassDimension(rows=(("FACE", 4, "19-face"),), face_bit=4)
    v1 = score_report.refresh_predictions(spark, f"{tmpdir_path}/imgs", detector, None, f"{tmpdir_path}/cache/v1")
    lines = score_report.score_report(v1, dim, imgs_per_row=3).collect()
    assert calls.value == 12
    labels = sorted({(r.label, r.page_name) for r in lines})
    assert labels == [("00-neutral", "00-neutral-000"), ("face-19-face", "face-19-face-001")]
    assert sum(r.line.count("<img") for r in lines) == 12
    v2 = score_report.refresh_predictions(spark, f"{tmpdir_path}/imgs", detector, f"{tmpdir_path}/cache/v1",
                                          f"{tmpdir_path}/cache/v2")
    assert v2.count() == 12 and calls.value == 12   # second run: every image was a cache hit


def test_image_info_in_rounds(spark, tmpdir_path):
    """Folders inside folders, odd names and several rounds give what one read of all gives."""
    from assetflow.functions import png
    from assetflow.sources import named_files
    names = ["top.png", "a/1.png", "a/b=1/2.png", "a/b=1/c/3.png", "d [x]*/4 {5}.png", "e%20+f/6.png", "g/7.png", "g/8.png", "g/9.png"]
    rows = spark.createDataFrame([(n, [k] * 6) for k, n in enumerate(names)], "file string, px array<int>")
    content = F.when(F.col("file") == "g/8.png", F.lit("broken").cast("binary")).otherwise(png.encode(F.col("px"), F.lit(2), F.lit(3)))
    named_files.write_files(rows.select("file", content.alias("content")), tmpdir_path)
    want = sorted(tuple(r) for r in files.read_images(spark, tmpdir_path).select("path", "height", "width", "valid").collect())
    assert len(want) == len(names) and sum(not r[3] for r in want) == 1
    for root in (tmpdir_path, "file://" + tmpdir_path):
        listing = files.list_files_parallel(spark, root)
        for most in (1, 2, 100):
            assert sorted(tuple(r) for r in files.image_info(spark, root, listing, most).collect()) == want
    none = files.list_files_parallel(spark, tmpdir_path + "/none")
    assert files.image_info(spark, tmpdir_path, none).count() == 0


def test_commit_messages_do_not_grow_with_the_files(tmpdir_path):
    import pickle
    import pyarrow as pa
    from assetflow.sources import named_files

    def message(n):
        batch = pa.RecordBatch.from_arrays([pa.array([f"f{k}" for k in range(n)]), pa.array([b"x"] * n)], names=["file", "content"])
        writer = named_files._Writer({"path": f"{tmpdir_path}/out{n}"})
        got = writer.write(iter([batch]))
        writer.commit([got])
        assert len([f for f in os.listdir(f"{tmpdir_path}/out{n}") if f.startswith("f")]) == n
        return len(pickle.dumps(got))
    assert message(2500) == message(1)


def test_empty_files_are_no_assets(spark, tmpdir_path):
    from assetflow.plans import catalog
    rows = [(n, None if n in (3, 5) else [float(n + k) for k in range(64)]) for n in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmpdir_path}/embeddings.parquet")
    assert sorted(map(tuple, catalog.invalid_assets(spark, tmpdir_path).collect())) == [(10, 20)]
    assert sorted(r["image_id"] for r in catalog.image_dims(spark, tmpdir_path).collect()) == [0, 1, 2, 4, 6, 7, 8, 9, 11]
