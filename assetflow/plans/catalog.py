"""Registered driver queries: each operator bound to the provided tables.

Every entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assetflow.functions import hashing as H
from assetflow.functions import numbers as N
from assetflow.functions import paths as P
from assetflow.functions import text as T
from assetflow.functions import timefmt as TF
from assetflow.operators import align, combos, dedup, filters, gloss, history, paging, scoring, search, sizes, toggle
from assetflow.operators.ranking import rank_within_groups
from assetflow.plans import cache, delta_cache, moves, progress, reports
from assetflow.session import scratch_folder
from assetflow.sources import files, named_files, views
from assetflow.sources.tables import read_table, stream_table
from assetflow.streaming import incremental, toggle_shards, toggles

QUERIES = {}

TRASH_ROOT = "/trash"
GROUP_COLUMNS = ("hash_type", "hash", "n_members", "keep_path")
PLAN_COLUMNS = ("hash_type", "hash", "path", "size", "w", "h", "n_members", "action", "dst")
DRIVER_MAX_BYTES = 16 * 1024  # the documents never reach 10 MiB; exercise the size rule


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _hashed_assets(spark, sf_dir, max_size=filters.MAX_ASSET_BYTES) -> DataFrame:
    a = filters.skip_filter(views.assets(spark, sf_dir), max_size=max_size)
    return dedup.with_hashes(a, dedup.md5_family())


@query("asset_listing")
def asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.assets(spark, sf_dir).select("path", "size", "w", "h")


@query("content_md5")
def content_md5(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return a.select("path", dedup.hashing.content_md5(F.col("content")).alias("md5"))


@query("skip_filter")
def skip_filter(spark, sf_dir):
    return filters.skip_filter(views.assets(spark, sf_dir), max_size=DRIVER_MAX_BYTES).select("path", "size")


@query("allow_filter")
def allow_filter(spark, sf_dir):
    return filters.allow_filter(views.assets(spark, sf_dir)).select("path", "size")


@query("hash_long")
def hash_long(spark, sf_dir):
    return dedup.hash_long(_hashed_assets(spark, sf_dir))


@query("dup_groups_md5")
def dup_groups_md5(spark, sf_dir):
    return dedup.duplicate_groups(hash_long(spark, sf_dir), dedup.md5_family()).select(*GROUP_COLUMNS)


@query("dedup_plan")
def dedup_plan(spark, sf_dir):
    return dedup.dedup_plan(hash_long(spark, sf_dir), dedup.md5_family(), TRASH_ROOT).select(*PLAN_COLUMNS)


@query("scaled_width")
def scaled_width(spark, sf_dir):
    plan = dedup.dedup_plan(hash_long(spark, sf_dir), dedup.md5_family())
    return dedup.scaled_width(plan, 100).select("hash", "path", "action", "width")


# --- filters, paths and move plans ------------------------------------------


# Driver patterns, anchored at the start of the bare file name.
DRIVER_PATTERNS = (".*7\\.(jpg|JPG)$", "0000000[0-4].*", ".*\\.gif$")
CLEANUP_THRESHOLD = 2048


def _relpath(c):
    return F.regexp_replace(c, "^[^/]+/", "")


def _mime(path_col):
    ext = F.lower(F.substring_index(path_col, ".", -1))
    return (F.when(ext.isin("jpg", "jpeg"), F.lit("image/jpeg"))
            .when(ext == "png", F.lit("image/png")).when(ext == "gif", F.lit("image/gif"))
            .when(ext == "webp", F.lit("image/webp")).when(ext == "txt", F.lit("text/plain"))
            .when(ext == "mp4", F.lit("video/mp4")).otherwise(F.lit("")))


@query("regex_any")
def regex_any(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return a.filter(filters.regex_any(P.basename(F.col("path")), DRIVER_PATTERNS)).select("path")


@query("cleanup_classify")
def cleanup_classify(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumn("valid", F.col("h") > 1)
    return filters.cleanup_classify(a, valid="valid", size_threshold=CLEANUP_THRESHOLD,
                                    patterns=DRIVER_PATTERNS).select("path", "size", "action")


@query("cleanup_plan")
def cleanup_plan(spark, sf_dir):
    a = views.assets(spark, sf_dir).withColumn("valid", F.col("h") > 1)
    return moves.cleanup_plan(a, "/trash", valid="valid", size_threshold=CLEANUP_THRESHOLD,
                              patterns=DRIVER_PATTERNS)


@query("path_rebase")
def path_rebase(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return a.select("path", P.rebase(_relpath(F.col("path")), "/restore").alias("dst"))


@query("flat_rename")
def flat_rename(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    return a.select("path", F.concat(F.lit("/flat/"), P.flat_name(_relpath(F.col("path")))).alias("dst"))


@query("move_plan")
def move_plan(spark, sf_dir):
    return moves.move_plan(views.assets(spark, sf_dir), "/archive")


def _md5_plan(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    ext = F.lower(F.substring_index(F.col("path"), ".", -1))
    return a.select(F.col("path").alias("src"),
                    F.concat(F.lit("/by_md5/"), F.md5("content"), F.lit("."), ext).alias("dst"))


@query("move_conflicts")
def move_conflicts(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    existing = a.filter(F.col("doc_id") % 5 == 0).select(
        F.concat(F.lit("/by_md5/"), F.md5("content"), F.lit(".jpg")).alias("path"))
    return moves.move_conflicts(_md5_plan(spark, sf_dir), existing)


@query("needed_dirs")
def needed_dirs(spark, sf_dir):
    return moves.needed_dirs(move_plan(spark, sf_dir))


@query("move_preview")
def move_preview(spark, sf_dir):
    return moves.preview(move_plan(spark, sf_dir))


# first bytes by doc_id % 11: every known signature, two near misses and none
DRIVER_HEADERS = (*(sig for sig, _ in filters.MAGIC_SIGNATURES), "424d1a00", "424e1a00", "ffd8ffe2", "")


def _signed(spark, sf_dir):
    """Assets whose ``bytes`` are the text behind a header that follows from the id."""
    head = F.element_at(F.array(*[F.lit(h) for h in DRIVER_HEADERS]), (F.col("doc_id") % len(DRIVER_HEADERS)).cast("int") + 1)
    return views.assets(spark, sf_dir).withColumn("bytes", F.concat(F.unhex(head), F.col("content").cast("binary")))


@query("magic_type")
def magic_type(spark, sf_dir):
    return _signed(spark, sf_dir).select("path", filters.magic_type(F.col("bytes")).alias("magic"))


@query("image_only")
def image_only(spark, sf_dir):
    a = _signed(spark, sf_dir).withColumn("mime", _mime(F.col("path")))
    return filters.image_only(a, "mime", "bytes").select("path", "mime")


# --- scoring, report rows and pages -----------------------------------------


# The caller's class dimension for the registered queries, in priority order.
DRIVER_CLASSES = scoring.ClassDimension(rows=(
    ("order", 4096, "f-order"),
    ("join", 512, "e-join"),
    ("fault", 128, "d-fault"),
    ("tap", 32, "c-tap"),
    ("glance", 2, "b-glance"),
    ("trace", 1, "a-trace"),
), face_bit=32)


@query("weighted_detections")
def weighted_detections(spark, sf_dir):
    return scoring.weighted_detections(views.detections(spark, sf_dir), DRIVER_CLASSES) \
        .select("det_id", "asset_id", "class", "weight")


def _scored(spark, sf_dir):
    s = scoring.score_assets(views.detection_assets(spark, sf_dir), views.detections(spark, sf_dir),
                             DRIVER_CLASSES)
    return s.withColumn("score", F.round("score", 6))


@query("detection_score")
def detection_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("asset_id", "score")


@query("detection_mask")
def detection_mask(spark, sf_dir):
    return _scored(spark, sf_dir).select("asset_id", "mask")


@query("detection_label")
def detection_label(spark, sf_dir):
    return scoring.label_assets(_scored(spark, sf_dir), DRIVER_CLASSES).select("asset_id", "score", "mask", "label")


def _rows(spark, sf_dir):
    lab = scoring.label_assets(_scored(spark, sf_dir), DRIVER_CLASSES)
    return paging.report_rows(lab, "label", ("score", "size", "path"), imgs_per_row=7)


@query("report_row_index")
def report_row_index(spark, sf_dir):
    return _rows(spark, sf_dir).select("asset_id", "label", "pos", "row_idx", "col_idx")


@query("report_pages")
def report_pages(spark, sf_dir):
    return paging.report_pages(_rows(spark, sf_dir), "label", imgs_per_row=7) \
        .select("asset_id", "label", "row_idx", "page", "page_name")


@query("grid_layout")
def grid_layout(spark, sf_dir):
    return paging.grid_layout(views.assets(spark, sf_dir).select("path"), ("path",), cols=5)


# --- pixels: perceptual hashes and character art ----------------------------



def _pixel_assets(spark, sf_dir):
    p = views.pixels(spark, sf_dir)
    return p.select("image_id", F.format_string("img/%06d.png", "image_id").alias("path"),
                    F.lit(64).cast("long").alias("size"), F.col("width").cast("long").alias("w"),
                    F.col("height").cast("long").alias("h"), "px", "height", "width")


# every pixel image is PIXEL_SIDE x PIXEL_SIDE: use the compiled static resize
_PIXEL_FAMILY = dedup.phash_family(height=views.PIXEL_SIDE, width=views.PIXEL_SIDE)


@query("phash")
def phash(spark, sf_dir):
    p = dedup.with_hashes(_pixel_assets(spark, sf_dir), _PIXEL_FAMILY)
    return dedup.hash_long(p, keep=("image_id",))


@query("dup_groups_phash")
def dup_groups_phash(spark, sf_dir):
    fam = _PIXEL_FAMILY
    long = dedup.hash_long(dedup.with_hashes(_pixel_assets(spark, sf_dir), fam))
    return dedup.duplicate_groups(long, fam).select(*GROUP_COLUMNS)


@query("resize")
def resize(spark, sf_dir):
    p = views.pixels(spark, sf_dir)
    # rendered as text so the comparison does not depend on how engines materialise arrays
    small = H.resize_box(F.col("px"), views.PIXEL_SIDE, views.PIXEL_SIDE, 4, 4)
    return p.select("image_id", F.array_join(small, ",").alias("small"))


@query("ascii_ramp")
def ascii_ramp(spark, sf_dir):
    p = views.pixels(spark, sf_dir)
    return p.select("image_id", H.ascii_art(F.col("px"), views.PIXEL_SIDE, views.PIXEL_SIDE, 8, 4).alias("art"))


# --- search, slices, diffs, hex dumps ---------------------------------------


NAME_PATTERN = "src1[0-3]/(de|fr)/"
CONTENT_PATTERN = "ou[ei]"


@query("text_lines")
def text_lines(spark, sf_dir):
    return views.lines(spark, sf_dir).select("file", "line_no", "value")


@query("name_grep")
def name_grep(spark, sf_dir):
    return search.name_grep(views.assets(spark, sf_dir).select("path"), NAME_PATTERN)


@query("name_grep_first")
def name_grep_first(spark, sf_dir):
    return search.name_grep(views.assets(spark, sf_dir).select("path"), NAME_PATTERN, search.SHORT_MATCH_CAP)


@query("name_grep_meta")
def name_grep_meta(spark, sf_dir):
    return search.name_grep(views.assets(spark, sf_dir).select("path", "size", "w", "h"), NAME_PATTERN)


@query("content_grep")
def content_grep(spark, sf_dir):
    return search.content_grep(views.lines(spark, sf_dir), CONTENT_PATTERN, 3).select("file", "line_no", "value")


@query("name_content_grep")
def name_content_grep(spark, sf_dir):
    return search.name_content_grep(views.lines(spark, sf_dir), ["/fr/", "\\.(jpg|png)$"], "[éè]") \
        .select("file", "line_no", "value")


@query("multi_source_grep")
def multi_source_grep(spark, sf_dir):
    docs = views.lines(spark, sf_dir).select("file", "line_no", "value")
    conv = read_table(spark, sf_dir, "conversations").select(
        F.format_string("conversations/%06d.txt", "conv_id").alias("file"),
        F.col("turn").cast("long").alias("line_no"), F.col("text").alias("value"))
    return search.multi_source_grep([docs, conv], "\\b[Tt]he\\b", 5)


@query("line_slice")
def line_slice(spark, sf_dir):
    return search.line_slice(views.lines(spark, sf_dir), 2, 4).select("file", "line_no", "value")


@query("line_range_diff")
def line_range_diff(spark, sf_dir):
    ln = views.lines(spark, sf_dir)
    a = search.line_slice(ln, 1, 5).withColumn("range_start", F.lit(1))
    b = search.line_slice(ln, 3, 7).withColumn("range_start", F.lit(3))
    return search.line_range_diff(a, b)


def _edits(script: DataFrame) -> DataFrame:
    return script.groupBy("file").agg(F.count_if(F.col("op") == "-").alias("deleted"), F.count_if(F.col("op") == "+").alias("inserted"))


@query("line_range_align")
def line_range_align(spark, sf_dir):
    ln = views.lines(spark, sf_dir)
    return _edits(align.aligned_diff(search.line_slice(ln, 1, 5), search.line_slice(ln, 3, 7)))


@query("file_align")
def file_align(spark, sf_dir):
    return align.aligned_diff(views.lines(spark, sf_dir), views.edited_lines(spark, sf_dir))


@query("file_align_edits")
def file_align_edits(spark, sf_dir):
    return _edits(file_align(spark, sf_dir))


@query("file_align_unique")
def file_align_unique(spark, sf_dir):
    return align.aligned_diff(views.lines(spark, sf_dir), views.edited_lines(spark, sf_dir), minimal=False)


def _hex(spark, sf_dir, chunk=False):
    return search.hex_rows(views.assets(spark, sf_dir).select("doc_id", "path", "content"), key="doc_id", chunk=chunk)


@query("hex_rows")
def hex_rows(spark, sf_dir):
    return _hex(spark, sf_dir)


@query("hex_ranges")
def hex_ranges(spark, sf_dir):
    """Hex dump of files that several tasks read in ranges."""
    ranges = named_files.read_ranges(spark, views.text_files(spark, sf_dir), range_bytes=16 * 1024, partition_bytes=256 * 1024)
    return search.hex_rows(ranges.withColumn("bucket", views.bucket_of(F.col("path"))), key="bucket", base="offset")


@query("read_lines")
def read_lines(spark, sf_dir):
    return files.read_lines(spark, views.text_files(spark, sf_dir)).select(views.bucket_of(F.col("file")).alias("bucket"), "line_no", "value")


def _images(spark, sf_dir):
    """A folder with PNG files, some of them broken."""
    out = scratch_folder(spark, "images")
    named_files.write_files(views.color_images(spark, sf_dir), out)
    return out


def _image_id(path):
    return F.regexp_extract(path, "([0-9]+)[.]png$", 1).cast("long").alias("image_id")


@query("parallel_listing")
def parallel_listing(spark, sf_dir):
    """A nested tree listed by the tasks, a level a round."""
    return files.list_files_parallel(spark, _images(spark, sf_dir)).select("relpath", "size")


def _image_info(spark, sf_dir):
    root = _images(spark, sf_dir)
    listing = files.list_files_parallel(spark, root).filter("size > 0")      # like Spark's own scans, which pass over empty files
    return files.with_image_info(listing, files.image_info(spark, root, listing))


@query("image_dims")
def image_dims(spark, sf_dir):
    return _image_info(spark, sf_dir).filter("valid").select(_image_id(F.col("path")), "height", "width", "size")


@query("invalid_assets")
def invalid_assets(spark, sf_dir):
    return _image_info(spark, sf_dir).filter("not valid").select(_image_id(F.col("path")), "size")


@query("grayscale")
def grayscale(spark, sf_dir):
    images = files.read_images(spark, _images(spark, sf_dir)).filter("valid")
    return images.select(_image_id(F.col("path")), F.array_join(H.grayscale_bgr(F.col("data"), F.col("nChannels")), ",").alias("gray"))


@query("hex_diff")
def hex_diff(spark, sf_dir):
    hx = _hex(spark, sf_dir, chunk=True).select("offset", "chunk", F.floor(F.col("doc_id") / 2).cast("long").alias("pair"),
                                    (F.col("doc_id") % 2 == 1).alias("is_right"))
    return search.hex_diff(hx)


# --- text annotation ---------------------------------------------------------


ACCENTED = "[à-ÿ]"  # the driver texts hold no Han characters; accented letters stand in
# The driver dictionary is built from a rule: every letter U+00E0..U+00FF
# (except the division sign) glossed by its code point in hex.
DRIVER_GLOSS = {chr(c): format(c, "x") for c in range(0xE0, 0x100) if c != 0xF7}
DRIVER_DENY = ("é",)


def _eligible(spark, sf_dir):
    return gloss.eligible(views.chars(spark, sf_dir), DRIVER_GLOSS, DRIVER_DENY, ACCENTED)


def _accepted(spark, sf_dir):
    return gloss.capped_annotations(_eligible(spark, sf_dir))


@query("char_gloss")
def char_gloss(spark, sf_dir):
    return _eligible(spark, sf_dir).select("doc_id", "line_no", "pos", "ch", "gloss")


@query("gloss_caps")
def gloss_caps(spark, sf_dir):
    return _accepted(spark, sf_dir).select("doc_id", "line_no", "pos", "ch", "gloss")


@query("annotate_text")
def annotate_text(spark, sf_dir):
    return gloss.annotate_lines(views.lines(spark, sf_dir), _accepted(spark, sf_dir)) \
        .select("doc_id", "line_no", "value")


@query("display_width")
def display_width(spark, sf_dir):
    return views.lines(spark, sf_dir).select("doc_id", "line_no", T.display_width(F.col("value")).alias("width"))


@query("han_tokens")
def han_tokens(spark, sf_dir):
    """Widths and alignment of Han, mixed and other tokens derived from the ids."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    han = F.decode(F.unhex(F.hex(0x4E00 + F.col("doc_id") % 20000)), "UTF-16BE")
    token = F.when(F.col("doc_id") % 3 == 0, F.repeat(han, F.lit(2))).when(F.col("doc_id") % 3 == 1, F.concat(han, F.col("lang"))).otherwise(F.col("lang"))
    t = d.select("doc_id", token.alias("token"), F.concat("lang", (F.col("doc_id") % 1000).cast("string")).alias("under"))
    pair = T.align_pair(F.col("token"), F.col("under"))
    return t.select("doc_id", "token", T.is_han(F.col("token")).alias("is_han"), T.display_width(F.col("token")).alias("width"),
                    pair["a"].alias("text"), pair["b"].alias("gloss"))


@query("align_pair")
def align_pair(spark, sf_dir):
    a = _accepted(spark, sf_dir)
    pair = T.align_pair(F.col("ch"), F.col("gloss"))
    return a.select("doc_id", "line_no", "pos", pair["a"].alias("text"), pair["b"].alias("gloss"))


def _wrapped(spark, sf_dir):
    ln = views.lines(spark, sf_dir)
    segs = gloss.interlinear_udf(DRIVER_GLOSS)(F.concat(F.col("value"), F.lit("\n")))
    # the _outer generator keeps Catalyst from re-evaluating the fold in an inferred filter
    return ln.select("doc_id", "line_no", F.posexplode_outer(segs).alias("seg", "s")).filter(F.col("s").isNotNull()) \
        .select("doc_id", "line_no", F.col("seg").cast("long").alias("seg"),
                F.col("s.h").alias("text"), F.col("s.p").alias("gloss"))


@query("interlinear_wrap")
def interlinear_wrap(spark, sf_dir):
    return _wrapped(spark, sf_dir)


@query("interlinear_lines")
def interlinear_lines(spark, sf_dir):
    w = _wrapped(spark, sf_dir)
    return w.select("doc_id", "line_no", "seg", F.posexplode(F.array("gloss", "text")).alias("k", "line")) \
        .select("doc_id", "line_no", "seg", F.col("k").cast("long").alias("k"), "line")


# Fixed by a rule: characters of the Han lines, pairs and triples of neighbouring ones, and their readings.
_HAN_CHARS = [chr(0x4E00 + c) for c in range(views.HAN_SPAN)]
HAN_GLOSS = {ch: f"z{c}" for c, ch in enumerate(_HAN_CHARS)}
HAN_PHRASES = {"".join(_HAN_CHARS[c:c + n]): [f"y{c}.{n}.{k}" for k in range(n)]
               for n, keep in ((2, lambda c: c % 3 == 0), (3, lambda c: c % 5 == 1)) for c in range(views.HAN_SPAN - n + 1) if keep(c)}


@query("phrase_readings")
def phrase_readings(spark, sf_dir):
    return gloss.phrase_readings(views.han_lines(spark, sf_dir), HAN_PHRASES, HAN_GLOSS)


@query("interlinear_han")
def interlinear_han(spark, sf_dir):
    segs = gloss.interlinear_udf(HAN_GLOSS, phrases=HAN_PHRASES)(F.concat(F.col("value"), F.lit("\n")))
    return views.han_lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(segs).alias("seg", "s")).select(
        "doc_id", "line_no", F.col("seg").cast("long").alias("seg"), F.col("s.h").alias("text"), F.col("s.p").alias("gloss"))


# --- history and time --------------------------------------------------------


LOCAL_TZ = "America/Los_Angeles"


@query("history_recent")
def history_recent(spark, sf_dir):
    return history.recent_unique(views.history_commands(spark, sf_dir), "click").select("cmd", "line_no", "position")


@query("history_unique")
def history_unique(spark, sf_dir):
    return history.unique_history(views.history_lines(spark, sf_dir)).select("cmd", "ts")


@query("history_rewritten")
def history_rewritten(spark, sf_dir):
    return history.unique_history_lines(views.history_lines(spark, sf_dir))


@query("history_tail")
def history_tail(spark, sf_dir):
    return history.tail(views.history_commands(spark, sf_dir), "error").select("line_no", "cmd", "position")


@query("epoch_from_ts")
def epoch_from_ts(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id",
                    *[TF.epoch_from_timestamp(F.col("ts"), u, ntz=True).alias(f"epoch_{u}") for u in TF.UNIT_FACTOR],
                    TF.epoch_from_string(text, "yyyy-MM-dd HH:mm:ss", "s", tz="UTC").alias("epoch_s_text"))


@query("ts_from_epoch")
def ts_from_epoch(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id",
                                                   TF.epoch_from_timestamp(F.col("ts"), "ms", ntz=True).alias("ms"))
    return e.select("event_id", "ms", TF.format_epoch(F.col("ms"), "ms").alias("utc"),
                    TF.format_epoch(F.col("ms"), "ms", LOCAL_TZ).alias("local"))


@query("time_label")
def time_label(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", TF.time_label(ts).alias("label"), TF.time_label(ts, pretty=True).alias("pretty"))


@query("numeric_parse")
def numeric_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", N.parse_count(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))


@query("base_convert")
def base_convert(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    v = F.col("event_id") * 7919 + F.col("user_id")
    return e.select("event_id", N.from_base10(v, 2).alias("b2"), N.from_base10(v, 8).alias("b8"),
                    N.from_base10(v, 16).alias("b16"), N.from_base10(v, 36).alias("b36"),
                    N.to_base10(N.from_base10(v, 16), 16).alias("back10"),
                    N.from_base10(100 - F.col("event_id"), 16).alias("signed16"))


# --- sizes and top-k ---------------------------------------------------------



@query("largest_assets")
def largest_assets(spark, sf_dir):
    return sizes.largest(views.assets(spark, sf_dir).select("path", "size"), 20000, 20)


@query("dir_sizes")
def dir_sizes(spark, sf_dir):
    return sizes.dir_sizes(views.paths(spark, sf_dir))


@query("dir_total")
def dir_total(spark, sf_dir):
    return sizes.dir_total(views.paths(spark, sf_dir))


@query("dir_top")
def dir_top(spark, sf_dir):
    return sizes.size_top(views.paths(spark, sf_dir), 30)


@query("first_n")
def first_n(spark, sf_dir):
    return filters.allow_filter(views.assets(spark, sf_dir)).select("path", "size").orderBy("path").limit(100)


@query("group_best")
def group_best(spark, sf_dir):
    a = views.assets(spark, sf_dir).select("source", "lang", "path", "size")
    return scoring.best_per_group(a, ["source", "lang"], [-F.col("size"), F.col("path")])


# --- combinations ------------------------------------------------------------



def _operands(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    a = F.col("s_suppkey") % 90 + 10
    return s.select(F.col("s_suppkey").alias("set_id"), a.alias("a"), (F.col("s_nationkey") + 10).alias("b"),
                    ((F.col("s_suppkey") * 7) % 90 + 10).alias("c"), (100 - a).alias("d"))


@query("quiz_problems")
def quiz_problems(spark, sf_dir):
    return combos.problems(_operands(spark, sf_dir))


@query("quiz_value_counts")
def quiz_value_counts(spark, sf_dir):
    return combos.value_counts(combos.problems(_operands(spark, sf_dir)))


@query("quiz_selected")
def quiz_selected(spark, sf_dir):
    return combos.select_values(combos.problems(_operands(spark, sf_dir))).orderBy("shuffle_key")


@query("quiz_counts")
def quiz_counts(spark, sf_dir):
    p = combos.problems(_operands(spark, sf_dir))
    return p.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count(F.when(F.col("value").isin(*combos.SELECTED_VALUES), 1)).alias("n_selected"))


@query("progress_totals")
def progress_totals(spark, sf_dir):
    """Totals of a hashing job, observed in the pass that writes its result."""
    seen = progress.Progress()
    listed = seen.watch(views.assets(spark, sf_dir), "listed", n_bytes=F.sum("size"))
    kept = seen.watch(filters.skip_filter(listed, max_size=DRIVER_MAX_BYTES), "kept", n_bytes=F.sum("size"))
    dedup.with_hashes(kept, dedup.md5_family()).select("path", "hashes").write.parquet(scratch_folder(spark, "progress"))
    rows = [(name, t["rows"], t["n_bytes"]) for name in ("listed", "kept") for t in (seen.totals(name),)]
    return spark.createDataFrame(rows, "step string, n_rows long, n_bytes long")


_DELTA_ROWS = "path string, size long, md5 string"


def _delta(spark, sf_dir):
    """A cache after three refreshes: files come and go, some are incomplete at first."""
    files_ = views.assets(spark, sf_dir).select("doc_id", "path", "size", "content")
    found = delta_cache.DeltaCache(spark, scratch_folder(spark, "delta-cache"), StructType.fromDDL(_DELTA_ROWS))
    hashed = lambda d: d.select("path", "size", H.content_md5(F.col("content")).alias("md5"))      # noqa: E731
    found.refresh(files_.filter("doc_id % 3 <> 0"), lambda d: hashed(d).withColumn("md5", F.when(F.col("size") % 4 > 0, F.col("md5"))))
    found.refresh(files_.filter("doc_id % 5 <> 0"), hashed, complete=lambda d: d.filter("md5 is not null"))
    found.refresh(files_.filter("doc_id % 7 <> 0"), hashed)
    return found


@query("delta_cache")
def delta_cache_rows(spark, sf_dir):
    return _delta(spark, sf_dir).read()


@query("delta_cache_parts")
def delta_cache_parts(spark, sf_dir):
    """What each refresh wrote: rows and keys of the change, not the whole cache."""
    parts = [(p["version"], p["kind"], p["rows"]) for p in _delta(spark, sf_dir).parts()]
    return spark.createDataFrame(parts, "version long, kind string, n_rows long")


@query("delta_cache_compacted")
def delta_cache_compacted(spark, sf_dir):
    found = _delta(spark, sf_dir)
    found.compact()
    return found.read()


# --- toggles -----------------------------------------------------------------



def _toggle_log(spark, sf_dir):
    return _toggle_log_of(read_table(spark, sf_dir, "events"))


def _toggle_log_of(e):
    kind = F.when(F.col("event_type") == "signup", F.lit("reset")).when(F.col("event_type") == "click", F.lit("toggle"))
    return e.select(F.col("event_id").alias("seq"), kind.alias("kind"),
                    F.format_string("img/%03d.jpg", "user_id").alias("item")).filter(F.col("kind").isNotNull())


@query("toggle_state")
def toggle_state(spark, sf_dir):
    return toggle.toggle_state(_toggle_log(spark, sf_dir))


@query("toggle_counter")
def toggle_counter(spark, sf_dir):
    return toggle.moved_count(toggle.toggle_state(_toggle_log(spark, sf_dir)))


@query("toggle_stream")
def toggle_stream(spark, sf_dir):
    """The counter of a toggle log that arrives as a file stream."""
    root = scratch_folder(spark, "toggle-stream")
    log = _toggle_log_of(stream_table(spark, sf_dir, "events"))
    toggles.start_toggle_counter(spark, log, f"{root}/state", f"{root}/progress").awaitTermination()
    return toggles.read_toggle_counter(spark, f"{root}/state")


@query("toggle_shards")
def toggle_shards_stream(spark, sf_dir):
    """The same counter, kept as keyed state."""
    root = scratch_folder(spark, "toggle-shards")
    log = _toggle_log_of(stream_table(spark, sf_dir, "events"))
    toggle_shards.start_shard_counter(spark, log, f"{root}/rows", f"{root}/progress", shards=8).awaitTermination()
    return toggle_shards.read_shard_counter(spark, f"{root}/rows")


# --- cache reuse -------------------------------------------------------------


HASH_CACHE = StructType([StructField("path", StringType()), StructField("size", LongType()), StructField("md5", StringType())])



def _current(spark, sf_dir):
    return views.assets(spark, sf_dir).select("doc_id", "path", "size", "content")


def _old_cache(spark, sf_dir):
    """A previous run's cache: most files, some with a changed size, some gone."""
    a = _current(spark, sf_dir)
    kept = a.filter(F.col("doc_id") % 3 != 0).select(
        "path", F.when(F.col("doc_id") % 6 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.md5("content").alias("md5"))
    gone = a.filter(F.col("doc_id") % 10 == 0).select(
        F.concat(F.lit("gone/"), F.col("path")).alias("path"), "size", F.md5("content").alias("md5"))
    return kept.unionByName(gone)


@query("cache_split")
def cache_split(spark, sf_dir):
    return cache.cache_status(_current(spark, sf_dir).select("path", "size"), _old_cache(spark, sf_dir))


@query("cache_refresh")
def cache_refresh(spark, sf_dir):
    cur = _current(spark, sf_dir)
    new = cache.refresh(cur.select("path", "size", "content"), _old_cache(spark, sf_dir),
                        lambda m: m.select("path", "size", F.md5("content").alias("md5")))
    return new


@query("cache_versions")
def cache_versions(spark, sf_dir):
    """A refresh from one written cache version to the next, read back."""
    root = scratch_folder(spark, "cache-versions")
    cur = _current(spark, sf_dir).select("path", "size", "content")
    old = cache.load_or_empty(spark, cache.write_version(_old_cache(spark, sf_dir), root, 1), HASH_CACHE)
    new = cache.refresh(cur, old, incremental.md5_of())
    return cache.load_or_empty(spark, cache.write_version(new, root, 2), HASH_CACHE)


@query("hash_stream")
def hash_stream(spark, sf_dir):
    """Two deliveries as file streams into one hash cache; the second finds the first's rows in it."""
    root = scratch_folder(spark, "hash-stream")
    files = views.assets_of(stream_table(spark, sf_dir, "documents"))
    for run, part in (("first", files.filter(F.col("doc_id") % 3 != 0)), ("second", files)):
        incremental.start_incremental_hashing(
            spark, part.select("path", "size", "content"), f"{root}/cache", HASH_CACHE,
            incremental.md5_of(), f"{root}/{run}").awaitTermination()
    return cache.load_or_empty(spark, f"{root}/cache", HASH_CACHE).select(*HASH_CACHE.fieldNames())


@query("predict_missing")
def predict_missing(spark, sf_dir):
    """A batch detector over the assets that the prediction cache lacks."""
    def detector(pdf):
        return pdf.assign(score=(pdf["size"] % 97) / 8.0)[["asset_id", "path", "score"]]
    return scoring.predict_missing(predict_pending(spark, sf_dir), detector, "asset_id long, path string, score double")


@query("predict_pending")
def predict_pending(spark, sf_dir):
    da = views.detection_assets(spark, sf_dir)
    pred_cache = da.filter(F.col("asset_id") % 4 != 0).select("path", "size")
    _hits, misses = cache.split_by_cache(da.select("asset_id", "path", "size"), pred_cache)
    return misses


@query("complete_hashes")
def complete_hashes(spark, sf_dir):
    a = views.assets(spark, sf_dir)
    m = F.map_filter(F.create_map(F.lit("md5"), F.md5("content"),
                                  F.lit("sha1"), F.when(F.col("h") > 1, F.sha1("content"))),
                     lambda k, v: v.isNotNull())
    return dedup.complete_hashes(a.withColumn("hashes", m), 2).select("path", F.col("hashes")["sha1"].alias("sha1"))


# --- quoting and reports -----------------------------------------------------



@query("quote_path")
def quote_path(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", P.quote_path(F.col("text")).alias("quoted"))


@query("report_rows")
def report_rows(spark, sf_dir):
    plan = dedup.dedup_plan(hash_long(spark, sf_dir), dedup.md5_family(), TRASH_ROOT)
    return reports.group_report_lines(plan, 100, True)


@query("report_files")
def report_files(spark, sf_dir):
    """The duplicate report as text files, one folder per hash type, read back."""
    out = scratch_folder(spark, "report-files")
    reports.write_lines(report_rows(spark, sf_dir), out, ["hash_type"], ["hash", "seq"])
    return spark.read.schema("value string, hash_type string").text(out).select("hash_type", F.col("value").alias("line"))


def _document_lines(spark, folder):
    name = F.substring_index(F.col("file"), "/", -1)
    return files.read_lines(spark, folder).select(name.alias("file"), "line_no", "value")


@query("report_documents")
def report_documents(spark, sf_dir):
    """The duplicate report as HTML documents, one per hash type, read back."""
    out = scratch_folder(spark, "report-documents")
    reports.write_group_documents(report_rows(spark, sf_dir), out)
    return _document_lines(spark, out)


@query("paged_documents")
def paged_documents(spark, sf_dir):
    """The score report as HTML documents, one per page, read back."""
    out = scratch_folder(spark, "paged-documents")
    reports.write_paged_documents(paged_report(spark, sf_dir), out, "events")
    return _document_lines(spark, f"{out}/{reports.PAGED_FOLDER}events")


@query("paged_report")
def paged_report(spark, sf_dir):
    pages = paging.report_pages(_rows(spark, sf_dir), "label", imgs_per_row=7)
    return reports.paged_report_rows(pages, 200) \
        .select("page", "page_name", "label", "row_idx", "n_cells", "line")


@query("box_corners")
def box_corners(spark, sf_dir):
    d = views.detections(spark, sf_dir)
    x, y = F.col("asset_id") % 100, F.col("det_id") % 100
    w, h = F.floor(F.col("score")).cast("long") + 1, F.lit(10).cast("long")
    text_w = (F.length("class") * 10).cast("long")
    return d.select("det_id", x.alias("x"), y.alias("y"), (x + w).alias("x2"), (y + h).alias("y2"),
                    F.floor(x + (w - text_w) / 2).cast("long").alias("text_x"), (y + h + 10 + 5).alias("text_y"))


@query("locale_sort")
def locale_sort(spark, sf_dir):
    """Viewer order: asset paths in locale order."""
    p = views.assets(spark, sf_dir).select("path")
    return rank_within_groups(p, [], [F.collate(F.col("path"), "UNICODE"), F.col("path")], "position")
