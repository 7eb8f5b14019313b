"""Deterministic bindings of the operators' inputs onto the provided tables.

The test tables hold no image files, so each operator family reads a view
derived from a table whose size grows with the data:

* ``assets``     documents -> one file per document (path, size, w, h, content)
* ``lines``      documents -> one row per text line
* ``chars``      lines     -> one row per character
* ``detections`` events    -> detector output per asset
* ``pixels``     embeddings-> an 8x8 gray image per vector
* ``history``    events    -> timestamped command history lines
* ``paths``      pages     -> files under a directory tree

The same definitions are repeated as SQL CTEs by the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.functions.arrays import let
from assetflow.functions import png
from assetflow.functions.timefmt import epoch_from_timestamp
from assetflow.session import scratch_folder
from assetflow.sources.tables import read_table

# Extension assigned by doc_id % 8 (exercises the suffix rules).
ASSET_EXTENSIONS = ("jpg", "JPG", "jpeg", "png", "gif", "webp", "txt", "mp4")

PIXEL_SIDE = 8  # embeddings have 64 components -> 8x8 image


def _ext_for(doc_id: Column) -> Column:
    exts = F.array(*[F.lit(e) for e in ASSET_EXTENSIONS])
    return F.element_at(exts, (doc_id % len(ASSET_EXTENSIONS)).cast("int") + 1)


def asset_path(source: Column, lang: Column, doc_id: Column) -> Column:
    name = F.concat(F.lpad(doc_id.cast("string"), 8, "0"), F.lit("."), _ext_for(doc_id))
    return F.concat_ws("/", source, lang, name)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset per document: path, size in bytes, w = longest line, h = lines."""
    return assets_of(read_table(spark, sf_dir, "documents"))


def assets_of(d: DataFrame) -> DataFrame:
    """The asset view of a documents table or stream."""
    parts = F.split(F.col("text"), "\n", -1)
    return d.select(
        "doc_id", "lang", "source",
        asset_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.array_max(F.transform(parts, lambda x: F.length(x))).cast("long").alias("w"),
        F.size(parts).cast("long").alias("h"),
        F.col("text").alias("content"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of every document; ``line_no`` is 1-based like sed/grep."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    # _outer generators: a plain one makes Catalyst evaluate the split again
    # in an inferred size(...) > 0 filter; text is non-null, so rows are equal
    return d.select(
        "doc_id",
        asset_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("file"),
        F.posexplode_outer(F.split(F.col("text"), "\n", -1)).alias("pos", "value"),
    ).select("doc_id", "file", (F.col("pos") + 1).cast("long").alias("line_no"), "value")


HAN_SPAN = 40        # code points of the Han lines


def han_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of Han characters and words per document; neighbouring code points make phrases."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    code = lambda k: F.lit(0x4E00) + (F.col("doc_id") * 31 + k + F.floor(k / 4) * 5) % HAN_SPAN      # noqa: E731
    piece = lambda k: F.when(k % 9 == 8, F.concat(F.lit(" "), "lang", F.lit(" "))).otherwise(F.decode(F.unhex(F.hex(code(k))), "UTF-16BE"))      # noqa: E731
    value = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 20 + F.col("doc_id") % 60), piece), "")
    return d.select("doc_id", F.lit(1).cast("long").alias("line_no"), value.alias("value"))


FILE_DOCS = 1000     # documents in a text file


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the documents' texts as files ``bucket=<n>/...``, by id, a line end after each."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    out = scratch_folder(spark, "text-files")
    (d.select(F.floor(F.col("doc_id") / FILE_DOCS).alias("bucket"), "doc_id", "text").repartition("bucket")
     .sortWithinPartitions("bucket", "doc_id").select("bucket", "text").write.partitionBy("bucket").text(out))
    return out


def bucket_of(path: Column) -> Column:
    return F.regexp_extract(path, "bucket=([0-9]+)/", 1).cast("long")


def color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RGB image per embedding, 4 to 8 pixels wide, as a PNG file; every seventh file is cut off."""
    p = pixels(spark, sf_dir)
    w = (4 + F.col("image_id") % 5).cast("int")
    h = F.floor(F.lit(PIXEL_SIDE * PIXEL_SIDE) / w).cast("int")
    rgb = F.flatten(F.transform(F.slice("px", 1, h * w), lambda v: F.array(v, 255 - v, (v * 7) % 256)))
    file = png.encode(rgb, h, w, rgb=True)
    return p.select("image_id", h.alias("height"), w.alias("width"), rgb.alias("rgb"),
                    F.format_string("%03d/%08d.png", F.floor(F.col("image_id") / 1000), "image_id").alias("file"),
                    F.when(F.col("image_id") % 7 == 3, F.substring(file, 1, 20)).otherwise(file).alias("content"))


def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later version of every text file: some lines are gone, some have a new line behind them,
    and in every fourth file the first line has moved to the end."""
    d = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    at = lambda i: F.col("doc_id") + i + 1      # noqa: E731
    new = F.flatten(F.transform(F.split(F.col("text"), "\n", -1), lambda x, i: F.when(at(i) % 9 == 0, F.array().cast("array<string>"))
                                .when((at(i) + i + 1) % 11 == 0, F.array(x, F.concat(F.lit("> "), x))).otherwise(F.array(x))))
    turned = let(new, lambda e: F.when((F.col("doc_id") % 4 == 0) & (F.size(e) > 0), F.concat(F.slice(e, 2, F.size(e)), F.slice(e, 1, 1))).otherwise(e))
    return d.select(
        "doc_id", asset_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("file"), F.posexplode(turned).alias("pos", "value"),
    ).select("doc_id", "file", (F.col("pos") + 1).cast("long").alias("line_no"), "value")


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per character of every line; ``pos`` is 0-based in the line."""
    return lines(spark, sf_dir).select(
        "doc_id", "line_no",
        F.posexplode_outer(F.split(F.col("value"), "", -1)).alias("pos", "ch"),
    ).filter(F.col("ch").isNotNull() & (F.col("ch") != "")).select(
        "doc_id", "line_no", F.col("pos").cast("long").alias("pos"), "ch")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output: asset = user, score = value; the class is the event type's
    rank, but at most the user's grade, so that users differ in their highest class."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("asset_id"),
        F.col("event_id").alias("det_id"),
        F.expr("element_at(array('trace', 'glance', 'tap', 'fault', 'join', 'order'), 1 + cast(least(user_id % 6, CASE event_type "
               "WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS int))").alias("class"),
        F.col("value").alias("score"),
    )


def detection_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored population: every user that appears in events or orders.

    Customers who never produced a detection still get a row (score 0,
    label ``00-neutral``), like images the detector found nothing in.
    """
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"))
    ids = e.unionByName(c).distinct()
    return ids.select(
        "asset_id",
        F.format_string("img/%06d.jpg", F.col("asset_id")).alias("path"),
        ((F.col("asset_id") * 7919) % 100000 + 1).cast("long").alias("size"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray image per embedding, scaled per row to 0..255 by min/max."""
    e = read_table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    stats = F.struct(v.alias("v"), F.array_min(v).alias("mn"), F.array_max(v).alias("mx"))
    px = let(stats, lambda s: F.transform(
        s["v"],
        lambda x: F.when(s["mx"] > s["mn"], F.floor((x - s["mn"]) / (s["mx"] - s["mn"]) * 255))
        .otherwise(F.lit(0)).cast("int")))
    return e.select(
        F.col("vec_id").alias("image_id"),
        F.lit(PIXEL_SIDE).alias("height"),
        F.lit(PIXEL_SIDE).alias("width"),
        px.alias("px"),
    )


def history_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command history: one command per event, in event order."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("line_no"),
        epoch_from_timestamp(F.col("ts"), "s", ntz=True).alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("cmd"),
    )


def _count_below(e: Column, m: int, r: int) -> Column:
    """How many j in [0, e) have j % m == r (e >= 0)."""
    return F.floor((e + (m - 1 - r)) / m)


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history *file*: ``#<epoch>`` line, then the command line.

    Every 7th event has no timestamp line and every 11th has its timestamp
    written twice, which exercises the pairing rules.  Line numbers are dense
    (1..n) and computed arithmetically from the event id, so no global
    numbering pass is needed.
    """
    h = history_commands(spark, sf_dir)
    e = F.col("line_no")
    dup = (e % 11 == 5).cast("long")
    has_ts = (e % 7 != 3).cast("long")
    first = 1 + e + (e - _count_below(e, 7, 3)) + _count_below(e, 11, 5)
    ts_line = F.concat(F.lit("#"), F.col("ts").cast("string"))
    entries = F.array(
        F.struct(F.lit(0).cast("long").alias("k"), F.when(dup == 1, ts_line).alias("v")),
        F.struct(dup.alias("k"), F.when(has_ts == 1, ts_line).alias("v")),
        F.struct((dup + has_ts).alias("k"), F.col("cmd").alias("v")),
    )
    return (h.select(first.cast("long").alias("first"), F.inline(entries))
            .filter(F.col("v").isNotNull())
            .select(F.lit("history").alias("file"),
                    (F.col("first") + F.col("k")).cast("long").alias("line_no"),
                    F.col("v").alias("value")))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directory tree: url minus scheme, query and fragment."""
    p = read_table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), "[?#].*$", "")
    path = F.regexp_replace(path, "/$", "/index.html")
    return p.select(
        "page_id",
        path.alias("path"),
        F.octet_length("html").cast("long").alias("size"),
    )
