"""File sink, byte-range source, PNG files, report documents, partial hash caches."""
import os
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetflow.functions import png
from assetflow.operators import dedup, history, search
from assetflow.plans import reports
from assetflow.sources import files, named_files


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_rows_of_a_file_are_joined_over_tasks(spark, tmpdir_path):
    rows = spark.range(1000).select(F.concat(F.lit("d/f"), (F.col("id") % 3).cast("string"), F.lit(".txt")).alias("file"), "id",
                                    F.concat(F.col("id").cast("string"), F.lit("\n")).alias("content"))
    placed = rows.repartitionByRange(7, "file", "id").sortWithinPartitions("file", "id")
    assert placed.rdd.getNumPartitions() == 7
    named_files.write_files(placed, f"{tmpdir_path}/out")
    assert tree(f"{tmpdir_path}/out") == {f"d/f{k}.txt": "".join(f"{i}\n" for i in range(k, 1000, 3)).encode() for k in range(3)}
    named_files.write_files(rows.filter("id = 4"), f"{tmpdir_path}/out")                      # replaces that file only
    assert tree(f"{tmpdir_path}/out")["d/f1.txt"] == b"4\n" and len(tree(f"{tmpdir_path}/out")) == 3
    named_files.write_files(rows.filter("false"), f"{tmpdir_path}/none")
    assert tree(f"{tmpdir_path}/none") == {}


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["file", "content"])


def test_a_task_that_runs_twice_adds_nothing(tmpdir_path):
    w = named_files._Writer({"path": tmpdir_path})
    w.write(iter([batch(("a", b"1"), ("a", b"2"))]))                                          # an attempt that is lost
    good = w.write(iter([batch(("a", b"1"), ("a", b"2"), ("b", None))]))
    w.commit([good, None])
    assert tree(tmpdir_path) == {"a": b"12", "b": b""}
    lost = named_files._Writer({"path": tmpdir_path})
    lost.write(iter([batch(("a", b"x"))]))
    lost.abort([])
    assert tree(tmpdir_path) == {"a": b"12", "b": b""}


@pytest.mark.parametrize("name", ["/abs", "a/../b", "..", "", None])
def test_names_stay_below_the_folder(name):
    with pytest.raises(ValueError):
        named_files.checked(name)


def test_hex_dump_over_many_splits_equals_one(spark, tmpdir_path):
    data = bytes(range(256)) * 900 + b"tail"
    os.makedirs(f"{tmpdir_path}/in/sub")
    for name, content in (("big", data), ("sub/small", b"x"), ("empty", b""), ("sub/_hidden", b"no"), ("exact", b"y" * 4096)):
        with open(f"{tmpdir_path}/in/{name}", "wb") as f:
            f.write(content)
    whole = named_files.read_ranges(spark, f"{tmpdir_path}/in")
    cut = named_files.read_ranges(spark, f"{tmpdir_path}/in", range_bytes=4096, partition_bytes=10_000)
    assert cut.rdd.getNumPartitions() > 20 and whole.rdd.getNumPartitions() == 1
    assert whole.count() == 3 and cut.filter("length > 4096").count() == 0
    dumps = [sorted(map(tuple, search.hex_rows(x, base="offset").collect())) for x in (whole, cut)]
    assert dumps[0] == dumps[1] and len(dumps[0]) == (len(data) + 15) // 16 + 1 + 256
    assert dumps[0] == sorted(map(tuple, search.hex_rows(files.read_files(spark, f"{tmpdir_path}/in").filter("size > 0 and path not like '%hidden'")).collect()))
    assert named_files.read_ranges(spark, f"{tmpdir_path}/in/big").count() == 1
    assert named_files.read_ranges(spark, f"{tmpdir_path}/nothing").count() == 0


def test_spans_cover_every_byte_once():
    sizes = [("a", 0), ("b", 1), ("c", 1000), ("d", 16), ("e", 333)]
    parts = named_files.spans_of(sizes, 16, 100)
    spans = [s for p in parts for s in p]
    for path, size in sizes:
        mine = sorted(s[1:] for s in spans if s[0] == path)
        assert [b for b, _ in mine] == [0, *[e for _, e in mine[:-1]]][:len(mine)] and (mine[-1][1] if mine else 0) == size
    assert all(sum(e - b for _, b, e in p) <= 96 for p in parts) and all(b % 16 == 0 for _, b, _ in spans)


def decoded(data):
    assert data[:8] == bytes.fromhex(png.SIGNATURE)
    at, idat, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + n:at + 12 + n])[0]
        head = struct.unpack(">IIBB", body[:10]) if kind == b"IHDR" else head
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    return head, zlib.decompress(idat)


def test_png_files_decode(spark, tmpdir_path):
    rows = [(i, h, w, [(x * 37 + i) % 256 for x in range(h * w * 3)]) for i, (h, w) in enumerate([(1, 1), (3, 5), (150, 160)])] + [(9, 0, 4, [])]
    df = spark.createDataFrame(rows, "id int, h int, w int, px array<int>")
    made = df.select("id", png.encode(F.col("px"), F.col("h"), F.col("w"), rgb=True).alias("rgb"), png.encode(F.slice("px", 1, F.col("h") * F.col("w")), F.col("h"), F.col("w")).alias("gray"))
    got = {r["id"]: r for r in made.collect()}
    assert got[9]["rgb"] is None
    for i, h, w, px in rows[:3]:
        for name, per, kind in (("rgb", 3, 2), ("gray", 1, 0)):
            head, raw = decoded(bytes(got[i][name]))
            line = w * per + 1
            assert head == (w, h, 8, kind) and [v for y in range(h) for v in raw[y * line + 1:(y + 1) * line]] == px[:h * w * per]
    named_files.write_files(made.filter("id < 3").select(F.concat("id", F.lit(".png")).alias("file"), F.col("rgb").alias("content")), f"{tmpdir_path}/png")
    read = {r["path"].rsplit("/", 1)[1]: r for r in files.read_images(spark, f"{tmpdir_path}/png").collect()}
    for i, h, w, px in rows[:3]:
        bgr = list(bytes(read[f"{i}.png"]["data"]))
        assert [bgr[k + j] for k in range(0, len(bgr), 3) for j in (2, 1, 0)] == px


GOLDEN = """<!DOCTYPE html>
<html>
<head>
<meta charset="utf-8">
<title>File Group Mappings</title>
</head>
<body>
<h1>File Group Mappings</h1>
<table>
<thead>
<tr><th>Group Name</th><th>Files</th></tr>
</thead>
<tbody>
<tr><td>h1</td><td>
<img src="b.png" width="100px" data-meta="{}" />\x20
<img src="/t/a%20x.png" width="50px" data-meta="{}" />\x20
<img src="/t/c.png" width="50px" data-meta="{}" />\x20
</td></tr>
<tr><td>h2</td><td>
<img src="d.png" width="100px" data-meta="{}" />\x20
<img src="/t/e.png" width="100px" data-meta="{}" />\x20
</td></tr>
</tbody>
</table>
</body>
</html>
"""


def test_group_document_is_golden_and_follows_the_family(spark, tmpdir_path):
    rows = [("simhash4x1", "h1", "a x.png", 10, 20, 20), ("simhash4x1", "h1", "b.png", 10, 40, 20), ("simhash4x1", "h1", "c.png", 9, 20, 20),
            ("simhash4x1", "h2", "d.png", 5, 8, 8), ("simhash4x1", "h2", "e.png", 4, 8, 8), ("simhash4x1", "h3", "alone.png", 1, 1, 1)]
    long = spark.createDataFrame(rows, "hash_type string, hash string, path string, size long, w long, h long")
    family = dedup.HashFamily("simhash", ("simhash4x1",), lambda: None, lambda: [-F.col("w"), -F.col("h"), -F.col("size"), F.col("path")])
    lines = reports.group_report_lines(dedup.dedup_plan(long, family, "/t"))
    for tasks in (1, 5):
        reports.write_group_documents(lines, f"{tmpdir_path}/r{tasks}", num_partitions=tasks)
        assert {k: v.decode() for k, v in tree(f"{tmpdir_path}/r{tasks}").items()} == {"simhash4x1.html": GOLDEN}


def test_paged_documents_one_file_per_page(spark, tmpdir_path):
    rows = [(p, f"en-00{p}", "en", r, f"<tr>{p}.{r}</tr>") for p in range(3) for r in range(40)]
    df = spark.createDataFrame(rows, "page long, page_name string, label string, row_idx long, line string")
    reports.write_paged_documents(df, tmpdir_path, "model", title="T", num_partitions=4)
    got = tree(tmpdir_path)
    assert set(got) == {f"score_html-model/en-00{p}.html" for p in range(3)}
    for p in range(3):
        text = got[f"score_html-model/en-00{p}.html"].decode()
        assert text == "\n".join([reports.document_head("T"), *[f"<tr>{p}.{r}</tr>" for r in range(40)], reports.DOCUMENT_FOOT, ""])


def test_content_hash_of_an_undecodable_file_is_cached(spark, tmpdir_path):
    from assetflow.plans import image_dedup
    df = spark.createDataFrame([("a.png", [1, 2, 3, 4])], "file string, px array<int>")
    named_files.write_files(df.select("file", png.encode(F.col("px"), F.lit(2), F.lit(2)).alias("content")), f"{tmpdir_path}/in")
    with open(f"{tmpdir_path}/in/broken.png", "wb") as f:
        f.write(b"not an image")
    image_dedup.refresh_hashes(spark, f"{tmpdir_path}/in", None, f"{tmpdir_path}/v1")
    got = {r["path"]: r for r in spark.read.parquet(f"{tmpdir_path}/v1").collect()}
    assert set(got["broken.png"]["hashes"]) == {"md5"} and len(got["a.png"]["hashes"]) == len(image_dedup.hash_types())
    faked = [(r["path"], r["size"], r["w"], r["h"], {**r["hashes"], "md5": "cached"}) for r in got.values()]
    spark.createDataFrame(faked, image_dedup.CACHE_SCHEMA).write.parquet(f"{tmpdir_path}/v2")
    image_dedup.refresh_hashes(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/v2", f"{tmpdir_path}/v3")
    again = {r["path"]: r["hashes"]["md5"] for r in spark.read.parquet(f"{tmpdir_path}/v3").collect()}
    assert again == {"a.png": "cached", "broken.png": "cached"}
    assert [r["path"] for r in image_dedup.hashed_images(spark, f"{tmpdir_path}/in").collect()] == ["a.png"]


def test_rewritten_history_is_in_order(spark):
    lines = ["#20", "b", "#3", "a", "#100", "a", "c", "#3", "d"]
    df = spark.createDataFrame([("h", i + 1, v) for i, v in enumerate(lines)], "file string, line_no long, value string")
    got = [r["line"] for r in history.unique_history_lines(df).orderBy("line_no").collect()]
    assert got == ["#0", "c", "#3", "d", "#20", "b", "#100", "a"]


def test_parallel_listing_equals_the_driver_listing(spark, tmpdir_path):
    for name in ("a.txt", "x/b.txt", "x/y/z/c.txt", "x/y/d e.txt", "k=1/_e.txt", "_no/f.txt", "_p=1/g.txt", ".h/i.txt", "x/.hidden", "x/_tmp", "é/中.txt"):
        os.makedirs(os.path.dirname(f"{tmpdir_path}/in/{name}"), exist_ok=True)
        with open(f"{tmpdir_path}/in/{name}", "w") as f:
            f.write(name)
    os.makedirs(f"{tmpdir_path}/in/empty/deeper")
    want = {tuple(r) for r in files.list_files(spark, f"{tmpdir_path}/in").select("path", "relpath", "size").collect()}
    got = [tuple(r) for r in files.list_files_parallel(spark, f"{tmpdir_path}/in", tasks=3).select("path", "relpath", "size").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 6
    assert {tuple(r) for r in files.list_files_parallel(spark, f"file://{tmpdir_path}/in").select("path", "relpath", "size").collect()} == want
    two = files.list_files_parallel(spark, [f"{tmpdir_path}/in/x", f"{tmpdir_path}/in/k=1", f"{tmpdir_path}/none"])
    assert {r["relpath"] for r in two.collect()} == {"b.txt", "y/z/c.txt", "y/d e.txt"}
