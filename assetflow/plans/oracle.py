"""DuckDB SQL restating each registered query (the correctness oracle)."""

from __future__ import annotations

from assetflow.plans.sqlviews import (ASSET_PATH, ASSETS, CHARS, DETECTION_ASSETS, DETECTIONS, HISTORY_COMMANDS, HISTORY_LINES,
                                      LINES, PATHS, PIXELS, skip_pred, with_views)


ORACLE = {}


def sql(name, text):
    ORACLE[name] = text


_KEPT = f"kept AS (SELECT * FROM assets WHERE NOT ({skip_pred()}) AND size <= 10485760)"
_LONG = "long AS (SELECT path, size, w, h, 'md5' AS hash_type, md5(content) AS hash FROM kept)"
_RANKED = """ranked AS (
  SELECT *, count(*) OVER (PARTITION BY hash_type, hash) AS n_members,
         row_number() OVER (PARTITION BY hash_type, hash ORDER BY path) AS rn
  FROM long)"""

sql("asset_listing", f"{with_views(ASSETS)} SELECT path, size, w, h FROM assets")
sql("content_md5", f"{with_views(ASSETS)} SELECT path, md5(content) AS md5 FROM assets")
sql("skip_filter", f"{with_views(ASSETS)} SELECT path, size FROM assets WHERE NOT ({skip_pred()}) AND size <= 16384")
sql("allow_filter", f"""{with_views(ASSETS)} SELECT path, size FROM assets
  WHERE ends_with(lower(path), '.jpeg') OR ends_with(lower(path), '.jpg') OR ends_with(lower(path), '.png')""")
sql("hash_long", f"{with_views(ASSETS, _KEPT, _LONG)} SELECT path, size, w, h, hash_type, hash FROM long")
sql("dup_groups_md5", f"""{with_views(ASSETS, _KEPT, _LONG, _RANKED)}
  SELECT hash_type, hash, n_members, path AS keep_path FROM ranked WHERE rn = 1 AND n_members >= 2""")
sql("dedup_plan", f"""{with_views(ASSETS, _KEPT, _LONG, _RANKED)}
  SELECT hash_type, hash, path, size, w, h, n_members,
         CASE WHEN rn = 1 THEN 'keep' ELSE 'move' END AS action,
         CASE WHEN rn = 1 THEN path ELSE '/trash/' || path END AS dst
  FROM ranked WHERE n_members >= 2""")
sql("scaled_width", f"""{with_views(ASSETS, _KEPT, _LONG, _RANKED)}
  SELECT hash, path, CASE WHEN rn = 1 THEN 'keep' ELSE 'move' END AS action,
         CAST(floor(100 * w / first_value(w) OVER (PARTITION BY hash_type, hash ORDER BY rn)) AS BIGINT) AS width
  FROM ranked WHERE n_members >= 2""")

# --- filters, paths and move plans ------------------------------------------


_BASENAME = "regexp_extract(path, '[^/]*$', 0)"
_PATTERNS = ["'^(?:.*7\\.(jpg|JPG)$)'", "'^(?:0000000[0-4].*)'", "'^(?:.*\\.gif$)'"]
_RX_ANY = " OR ".join(f"regexp_matches({_BASENAME}, {p})" for p in _PATTERNS)
_CLEAN = f"""classified AS (
  SELECT path, size, CASE WHEN size < 2048 THEN 'small' WHEN {_RX_ANY} THEN 'pattern'
                          WHEN NOT (h > 1) THEN 'invalid' ELSE 'keep' END AS action
  FROM assets WHERE NOT ({skip_pred()}))"""
_REL = "regexp_replace(path, '^[^/]+/', '')"

sql("regex_any", f"{with_views(ASSETS)} SELECT path FROM assets WHERE {_RX_ANY}")
sql("cleanup_classify", f"{with_views(ASSETS, _CLEAN)} SELECT path, size, action FROM classified")
sql("cleanup_plan", f"""{with_views(ASSETS, _CLEAN)}
  SELECT path AS src, '/trash/' || path AS dst, regexp_extract('/trash/' || path, '^(.*)/[^/]*$', 1) AS dst_dir, action
  FROM classified WHERE action <> 'keep'""")
sql("path_rebase", f"{with_views(ASSETS)} SELECT path, '/restore/' || {_REL} AS dst FROM assets")
_FLAT_NAME = f"""CASE WHEN contains(regexp_extract({_REL}, '[^/]*$', 0), '.')
      THEN regexp_extract(regexp_extract({_REL}, '[^/]*$', 0), '^(.*)\\.[^.]*$', 1) ELSE '' END
    || '.' || substr(sha256({_REL}), 1, 16) || '.' || regexp_extract({_REL}, '[^.]*$', 0)"""
sql("flat_rename", f"{with_views(ASSETS)} SELECT path, '/flat/' || {_FLAT_NAME} AS dst FROM assets")
_MOVE = f"""plan AS (SELECT path AS src, '/archive/' || path AS dst,
  regexp_extract('/archive/' || path, '^(.*)/[^/]*$', 1) AS dst_dir FROM assets
  WHERE NOT ends_with(lower(path), '.ds_store'))"""
sql("move_plan", f"{with_views(ASSETS, _MOVE)} SELECT * FROM plan")
sql("needed_dirs", f"{with_views(ASSETS, _MOVE)} SELECT DISTINCT dst_dir FROM plan")
sql("move_preview", f"{with_views(ASSETS, _MOVE)} SELECT * FROM plan ORDER BY src LIMIT 30")
sql("move_conflicts", f"""{with_views(ASSETS)},
  plan AS (SELECT path AS src, '/by_md5/' || md5(content) || '.' || lower(regexp_extract(path, '[^.]*$', 0)) AS dst FROM assets),
  existing AS (SELECT DISTINCT '/by_md5/' || md5(content) || '.jpg' AS dst FROM assets WHERE doc_id % 5 = 0),
  claims AS (SELECT dst, count(*) AS n_claims FROM plan GROUP BY dst)
  SELECT p.src, p.dst, c.n_claims,
         CASE WHEN p.dst IN (SELECT dst FROM existing) THEN 'exists' ELSE 'duplicate' END AS reason
  FROM plan p JOIN claims c USING (dst)
  WHERE p.dst IN (SELECT dst FROM existing) OR c.n_claims > 1""")
_HEAD = """lower(substr(['89504e47', '47494638', 'ffd8ffe0', 'ffd8ffe1', 'ffd8ffee', 'ffd8ffdb', '52494646', '424d1a00', '424e1a00', 'ffd8ffe2', '']
  [doc_id % 11 + 1] || hex(encode(content)), 1, 8))"""
_MAGIC = f"""CASE WHEN {_HEAD} = '89504e47' THEN 'PNG' WHEN {_HEAD} = '47494638' THEN 'GIF'
  WHEN {_HEAD} IN ('ffd8ffe0','ffd8ffe1','ffd8ffee','ffd8ffdb') THEN 'JPEG'
  WHEN {_HEAD} = '52494646' THEN 'RIFF/WEBP' WHEN starts_with({_HEAD}, '424d') THEN 'BMP' ELSE 'UNKNOWN' END"""
sql("magic_type", f"{with_views(ASSETS)} SELECT path, {_MAGIC} AS magic FROM assets")
_MIME = """CASE lower(regexp_extract(path, '[^.]*$', 0)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg'
  WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp'
  WHEN 'txt' THEN 'text/plain' WHEN 'mp4' THEN 'video/mp4' ELSE '' END"""
sql("image_only", f"""{with_views(ASSETS)} SELECT path, mime FROM (SELECT path, {_MIME} AS mime, {_MAGIC} AS magic FROM assets)
  WHERE contains(mime, 'image') OR magic <> 'UNKNOWN'""")

# --- scoring, report rows and pages -----------------------------------------

_DIM = """dim AS (SELECT * FROM (VALUES (1, 'order', 4096, 'f-order'), (2, 'join', 512, 'e-join'), (3, 'fault', 128, 'd-fault'),
  (4, 'tap', 32, 'c-tap'), (5, 'glance', 2, 'b-glance'), (6, 'trace', 1, 'a-trace'))
  AS t(ordinal, class, weight, group_key))"""
_SCORED = """scored AS (
  SELECT a.asset_id, a.path, a.size, round(coalesce(p.score, 0), 6) AS score, CAST(coalesce(p.mask, 0) AS BIGINT) AS mask
  FROM detection_assets a LEFT JOIN (
    SELECT asset_id, sum((1 + score) * weight) AS score, bit_or(weight) AS mask
    FROM detections JOIN dim USING (class) GROUP BY asset_id) p USING (asset_id))"""
_LABELED = """labeled AS (
  SELECT *, coalesce(nullif((CASE WHEN mask & 32 <> 0 THEN 'face-' ELSE '' END) ||
     coalesce((SELECT min_by(group_key, ordinal) FROM dim WHERE (mask & weight) <> 0), ''), ''), '00-neutral') AS label
  FROM scored)"""
_ROWS = """rows AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score, size, path) AS BIGINT) AS pos FROM labeled),
  rows2 AS (SELECT *, CAST((pos - 1) // 7 AS BIGINT) AS row_idx, CAST((pos - 1) % 7 AS BIGINT) AS col_idx FROM rows)"""
_SCORE_VIEWS = (DETECTION_ASSETS, DETECTIONS, _DIM, _SCORED)

sql("weighted_detections", f"""{with_views(DETECTIONS, _DIM)}
  SELECT det_id, asset_id, class, CAST(weight AS BIGINT) AS weight FROM detections JOIN dim USING (class)""")
sql("detection_score", f"{with_views(*_SCORE_VIEWS)} SELECT asset_id, score FROM scored")
sql("detection_mask", f"{with_views(*_SCORE_VIEWS)} SELECT asset_id, mask FROM scored")
sql("detection_label", f"{with_views(*_SCORE_VIEWS, _LABELED)} SELECT asset_id, score, mask, label FROM labeled")
sql("report_row_index", f"""{with_views(*_SCORE_VIEWS, _LABELED, _ROWS)}
  SELECT asset_id, label, pos, row_idx, col_idx FROM rows2""")
sql("report_pages", f"""{with_views(*_SCORE_VIEWS, _LABELED, _ROWS)},
  lp AS (SELECT label, CAST(ceil(ceil(count(*) / 7) / 100) AS BIGINT) AS pages FROM labeled GROUP BY label),
  off AS (SELECT label, coalesce(sum(pages) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_page FROM lp)
  SELECT asset_id, label, row_idx, CAST(first_page + row_idx // 100 AS BIGINT) AS page,
         printf('%s-%03d', label, CAST(first_page + row_idx // 100 AS BIGINT)) AS page_name
  FROM rows2 JOIN off USING (label)""")
sql("grid_layout", f"""{with_views(ASSETS)}
  SELECT path, CAST((rn - 1) // 5 AS BIGINT) AS grid_row, CAST((rn - 1) % 5 AS BIGINT) AS grid_col
  FROM (SELECT path, row_number() OVER (ORDER BY path) AS rn FROM assets)""")

# --- pixels ------------------------------------------------------------------



def _resize_sql(px: str, hh: int, ww: int, oh: str, ow: str) -> str:
    lo_r = f"((k // {ow}) * {hh}) // {oh}"
    hi_r = f"greatest({lo_r} + 1, ((k // {ow} + 1) * {hh}) // {oh})"
    lo_c = f"((k % {ow}) * {ww}) // {ow}"
    hi_c = f"greatest({lo_c} + 1, ((k % {ow} + 1) * {ww}) // {ow})"
    inner = (f"list_sum(list_transform(range({lo_r}, {hi_r}), lambda r: "
             f"list_sum(list_transform(range({lo_c}, {hi_c}), lambda c: {px}[r * {ww} + c + 1]))))")
    return (f"list_transform(range({oh} * {ow}), lambda k: CAST(floor({inner} / "
            f"(({hi_r} - {lo_r}) * ({hi_c} - {lo_c}))) AS BIGINT))")


_HEX_OF_BITS = """CASE WHEN ltrim(array_to_string(list_transform(range(length(pb) // 4), lambda i:
      substr('0123456789abcdef', 1 + 8 * CAST(substr(pb, i * 4 + 1, 1) AS INT) + 4 * CAST(substr(pb, i * 4 + 2, 1) AS INT)
             + 2 * CAST(substr(pb, i * 4 + 3, 1) AS INT) + CAST(substr(pb, i * 4 + 4, 1) AS INT), 1)), ''), '0') = ''
    THEN '0x0' ELSE '0x' || ltrim(array_to_string(list_transform(range(length(pb) // 4), lambda i:
      substr('0123456789abcdef', 1 + 8 * CAST(substr(pb, i * 4 + 1, 1) AS INT) + 4 * CAST(substr(pb, i * 4 + 2, 1) AS INT)
             + 2 * CAST(substr(pb, i * 4 + 3, 1) AS INT) + CAST(substr(pb, i * 4 + 4, 1) AS INT), 1)), ''), '0') END"""

_PHASH = f"""{with_views(PIXELS)},
  cfg AS (SELECT * FROM (VALUES (4, 2), (5, 2), (6, 2), (7, 2), (8, 2), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1)) t(s, b)),
  rs AS (SELECT image_id, s, b, {_resize_sql('px', 8, 8, 's', 's')} AS sm FROM pixels, cfg),
  lv AS (SELECT image_id, s, b, list_transform(sm, lambda v: CASE WHEN (list_max(sm) - list_min(sm)) // CAST(pow(2, b) AS BIGINT) = 0
           THEN 0 ELSE (v - list_min(sm)) // ((list_max(sm) - list_min(sm)) // CAST(pow(2, b) AS BIGINT)) END) AS lev FROM rs),
  bs AS (SELECT image_id, s, b, array_to_string(list_transform(lev, lambda l: CASE WHEN length(bin(l)) < b
           THEN lpad(bin(l), CAST(b AS INTEGER), '0') ELSE bin(l) END), '') AS bits FROM lv),
  pb AS (SELECT image_id, s, b, lpad(bits, CAST(ceil(length(bits) / 4) * 4 AS INTEGER), '0') AS pb FROM bs),
  hashes AS (SELECT image_id, 'simhash' || CAST(s * s AS VARCHAR) || 'x' || CAST(CAST(pow(2, b) AS BIGINT) AS VARCHAR) AS hash_type,
           {_HEX_OF_BITS} AS hash FROM pb)"""

sql("phash", f"{_PHASH} SELECT image_id, hash_type, hash FROM hashes")
sql("dup_groups_phash", f"""{_PHASH},
  ranked AS (SELECT hash_type, hash, image_id, count(*) OVER (PARTITION BY hash_type, hash) AS n_members,
             row_number() OVER (PARTITION BY hash_type, hash ORDER BY printf('img/%06d.png', image_id)) AS rn FROM hashes)
  SELECT hash_type, hash, n_members, printf('img/%06d.png', image_id) AS keep_path FROM ranked WHERE rn = 1 AND n_members >= 2""")
sql("resize", f"{with_views(PIXELS)} SELECT image_id, array_to_string({_resize_sql('px', 8, 8, '4', '4')}, ',') AS small FROM pixels")
sql("ascii_ramp", f"""{with_views(PIXELS)},
  sm AS (SELECT image_id, {_resize_sql('px', 8, 8, '4', '8')} AS sm FROM pixels),
  ch AS (SELECT image_id, array_to_string(list_transform(sm, lambda v: (['@','#','S','%','?','*','+',';',':',',','.'])[v // 25 + 1]), '') AS s FROM sm)
  SELECT image_id, array_to_string(list_transform(range(length(s) // 8), lambda i: substr(s, i * 8 + 1, 8)), chr(10)) AS art FROM ch""")

# --- search ------------------------------------------------------------------

_NAME_RX = "'src1[0-3]/(de|fr)/'"
sql("text_lines", f"{with_views(LINES)} SELECT file, line_no, value FROM lines")
sql("name_grep", f"{with_views(ASSETS)} SELECT path FROM assets WHERE regexp_matches(path, {_NAME_RX}) ORDER BY path LIMIT 10000")
sql("name_grep_first", f"{with_views(ASSETS)} SELECT path FROM assets WHERE regexp_matches(path, {_NAME_RX}) ORDER BY path LIMIT 1")
sql("name_grep_meta", f"{with_views(ASSETS)} SELECT path, size, w, h FROM assets WHERE regexp_matches(path, {_NAME_RX}) ORDER BY path LIMIT 10000")
sql("content_grep", f"""{with_views(LINES)} SELECT file, line_no, value FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM lines WHERE regexp_matches(value, 'ou[ei]'))
  WHERE rn <= 3""")
sql("name_content_grep", f"""{with_views(LINES)} SELECT file, line_no, value FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM lines
  WHERE regexp_matches(file, '/fr/') AND regexp_matches(file, '\\.(jpg|png)$') AND regexp_matches(value, '[éè]'))
  WHERE rn <= 10000""")
sql("multi_source_grep", f"""{with_views(LINES)},
  src AS (SELECT file, line_no, value FROM lines
          UNION ALL SELECT printf('conversations/%06d.txt', conv_id), CAST(turn AS BIGINT), text FROM conversations)
  SELECT file, line_no, value FROM (
    SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM src WHERE regexp_matches(value, '\\b[Tt]he\\b'))
  WHERE rn <= 5""")
sql("line_slice", f"{with_views(LINES)} SELECT file, line_no, value FROM lines WHERE line_no BETWEEN 2 AND 4")
sql("line_range_diff", f"""{with_views(LINES)},
  a AS (SELECT file, line_no - 1 AS rel, value AS left_value FROM lines WHERE line_no BETWEEN 1 AND 5),
  b AS (SELECT file, line_no - 3 AS rel, value AS right_value FROM lines WHERE line_no BETWEEN 3 AND 7)
  SELECT coalesce(a.file, b.file) AS file, CAST(coalesce(a.rel, b.rel) AS BIGINT) AS rel, left_value, right_value
  FROM a FULL OUTER JOIN b ON a.file = b.file AND a.rel = b.rel
  WHERE left_value IS DISTINCT FROM right_value""")
# the longest common subsequence by its table, a row per line of the left version
_LCS = """,
  dp AS (
    SELECT file, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM pairs
    UNION ALL
    SELECT file, a, b, i + 1, list_prepend(0, list_transform(range(1, len(b) + 1), lambda j: list_max(c[1:j])))
    FROM (SELECT *, list_transform(range(1, len(b) + 1),
            lambda j: greatest(r[j + 1], CASE WHEN b[j] = a[i + 1] THEN r[j] + 1 ELSE 0 END)) AS c FROM dp WHERE i < len(a)))
  SELECT file, len(a) - r[len(b) + 1] AS deleted, len(b) - r[len(b) + 1] AS inserted
  FROM dp WHERE i = len(a) AND (len(a) > r[len(b) + 1] OR len(b) > r[len(b) + 1])"""
sql("line_range_align", f"""WITH RECURSIVE pairs AS (
    SELECT file, t[1:5] AS a, t[3:7] AS b FROM (SELECT {ASSET_PATH} AS file, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)){_LCS}""")
sql("file_align_edits", f"""WITH RECURSIVE cut AS (
    SELECT doc_id, {ASSET_PATH} AS file, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
  edited AS (
    SELECT doc_id, file, a, flatten(list_transform(range(1, len(a) + 1), lambda i: CASE
      WHEN (doc_id + i) % 9 = 0 THEN [] WHEN (doc_id + 2 * i) % 11 = 0 THEN [a[i], '> ' || a[i]] ELSE [a[i]] END)) AS e FROM cut),
  pairs AS (SELECT file, a, CASE WHEN doc_id % 4 = 0 AND len(e) > 0 THEN list_concat(e[2:], e[1:1]) ELSE e END AS b FROM edited){_LCS}""")
_HEXROWS = f"""{with_views(ASSETS)},
  hx AS (SELECT doc_id, lower(hex(encode(content))) AS hx FROM assets WHERE strlen(content) > 0),
  hexrows AS (SELECT doc_id, CAST(off AS BIGINT) AS "offset",
      rtrim(regexp_replace(substr(hx, off * 2 + 1, 32), '(....)', '\\1 ', 'g')) AS hex,
      array_to_string(list_transform(range(0, least(16, length(hx) // 2 - off)), lambda j:
        CASE WHEN CAST(('0x' || substr(hx, (off + j) * 2 + 1, 2)) AS INTEGER) BETWEEN 32 AND 126
             THEN chr(CAST(('0x' || substr(hx, (off + j) * 2 + 1, 2)) AS INTEGER)) ELSE '.' END), '') AS text
    FROM (SELECT doc_id, hx, unnest(range(0, length(hx) // 2, 16)) AS off FROM hx))"""
sql("hex_rows", f'{_HEXROWS} SELECT doc_id, "offset", hex, text FROM hexrows')
_BUCKETS = """buckets AS (
    SELECT doc_id // 1000 AS bucket, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1)"""
sql("hex_ranges", f"""WITH {_BUCKETS},
  cut AS (SELECT bucket, regexp_extract_all(lower(hex(encode(t))), '.{{1,32}}') AS rs FROM buckets),
  hexrows AS (SELECT bucket, unnest(range(0, len(rs))) * 16 AS "offset", unnest(rs) AS r FROM cut)
  SELECT bucket, "offset", rtrim(regexp_replace(r, '(....)', '\\1 ', 'g')) AS hex,
    array_to_string(list_transform(range(0, length(r) // 2), lambda j:
      CASE WHEN CAST(('0x' || substr(r, j * 2 + 1, 2)) AS INTEGER) BETWEEN 32 AND 126
           THEN chr(CAST(('0x' || substr(r, j * 2 + 1, 2)) AS INTEGER)) ELSE '.' END), '') AS text
  FROM hexrows""")
sql("read_lines", f"""WITH {_BUCKETS}
  SELECT bucket, unnest(generate_series(1, len(v) - 1)) AS line_no, unnest(v[1:len(v) - 1]) AS value
  FROM (SELECT bucket, string_split(t, chr(10)) AS v FROM buckets)""")
_IMAGES = f"""{with_views(PIXELS)},
  images AS (SELECT *, 64 // w AS h FROM (SELECT image_id, px, 4 + image_id % 5 AS w FROM pixels))"""
sql("image_dims", f"""{_IMAGES}
  SELECT image_id, CAST(h AS INTEGER) AS height, CAST(w AS INTEGER) AS width, 8 + 25 + 12 + 2 + 5 + h * (3 * w + 1) + 4 + 12 AS size
  FROM images WHERE image_id % 7 <> 3""")
sql("parallel_listing", f"""{_IMAGES}
  SELECT printf('%03d/%08d.png', CAST(image_id // 1000 AS BIGINT), image_id) AS relpath,
    CASE WHEN image_id % 7 = 3 THEN 20 ELSE 8 + 25 + 12 + 2 + 5 + h * (3 * w + 1) + 4 + 12 END AS size FROM images""")
sql("invalid_assets", "SELECT vec_id AS image_id, CAST(20 AS BIGINT) AS size FROM embeddings WHERE vec_id % 7 = 3")
sql("grayscale", f"""{_IMAGES}
  SELECT image_id, array_to_string(list_transform(px[1:h * w], lambda v: CAST(floor(
    CAST(v AS DECIMAL(9, 3)) * 0.299 + (255 - v) * 0.587 + ((v * 7) % 256) * 0.114 + 0.5) AS INTEGER)), ',') AS gray
  FROM images WHERE image_id % 7 <> 3""")
sql("hex_diff", f"""{_HEXROWS},
  a AS (SELECT doc_id // 2 AS pair, "offset", hex AS left_hex FROM hexrows WHERE doc_id % 2 = 0),
  b AS (SELECT doc_id // 2 AS pair, "offset", hex AS right_hex FROM hexrows WHERE doc_id % 2 = 1)
  SELECT CAST(coalesce(a.pair, b.pair) AS BIGINT) AS pair, coalesce(a."offset", b."offset") AS "offset", left_hex, right_hex
  FROM a FULL OUTER JOIN b ON a.pair = b.pair AND a."offset" = b."offset"
  WHERE left_hex IS DISTINCT FROM right_hex""")

# --- text annotation ---------------------------------------------------------


_DICT_ROWS = ", ".join(f"('{chr(c)}', '{format(c, 'x')}')" for c in range(0xE0, 0x100) if c != 0xF7)
_DICT = f"dict AS (SELECT * FROM (VALUES {_DICT_ROWS}) t(ch, gloss))"
_ELIG = """elig AS (SELECT c.doc_id, c.line_no, c.pos, c.ch, d.gloss FROM chars c JOIN dict d USING (ch)
  WHERE regexp_full_match(c.ch, '[à-ÿ]') AND c.ch NOT IN ('é'))"""
_ACC = """r6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, ch ORDER BY pos) AS rn6 FROM elig),
  r7 AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY doc_id, line_no, pos) AS rn7 FROM r6 WHERE rn6 <= 3),
  acc AS (SELECT doc_id, line_no, pos, ch, gloss FROM r7 WHERE rn7 <= 20)"""
_TXT = (LINES, CHARS, _DICT, _ELIG)

sql("char_gloss", f"{with_views(*_TXT)} SELECT doc_id, line_no, pos, ch, gloss FROM elig")
sql("gloss_caps", f"{with_views(*_TXT, _ACC)} SELECT * FROM acc")
sql("annotate_text", f"""{with_views(*_TXT, _ACC)},
  ann AS (SELECT c.doc_id, c.line_no, string_agg(c.ch || coalesce('[' || a.gloss || ']', ''), '' ORDER BY c.pos) AS v
          FROM chars c LEFT JOIN acc a USING (doc_id, line_no, pos) GROUP BY c.doc_id, c.line_no)
  SELECT l.doc_id, l.line_no, coalesce(ann.v, l.value) AS value FROM lines l LEFT JOIN ann USING (doc_id, line_no)""")
sql("display_width", f"""{with_views(LINES)} SELECT doc_id, line_no,
  CAST(length(value) * CASE WHEN regexp_full_match(value, '\\p{{Han}}+') THEN 2 ELSE 1 END AS BIGINT) AS width FROM lines""")
sql("han_tokens", """WITH t AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN repeat(chr(CAST(19968 + doc_id % 20000 AS INTEGER)), 2)
                                 WHEN 1 THEN chr(CAST(19968 + doc_id % 20000 AS INTEGER)) || coalesce(lang, '') ELSE coalesce(lang, '') END AS token,
         coalesce(lang, '') || CAST(doc_id % 1000 AS VARCHAR) AS under FROM documents),
  w AS (SELECT *, regexp_full_match(token, '\\p{Han}+') AS is_han, length(under) AS wu FROM t),
  v AS (SELECT *, length(token) * CASE WHEN is_han THEN 2 ELSE 1 END AS width FROM w),
  p AS (SELECT *, greatest(width, wu) - width AS da, greatest(width, wu) - wu AS db FROM v)
  SELECT doc_id, token, is_han, CAST(width AS BIGINT) AS width, repeat(' ', da // 2) || token || repeat(' ', da - da // 2) AS text,
         repeat(' ', db // 2) || under || repeat(' ', db - db // 2) AS gloss FROM p""")
sql("align_pair", f"""{with_views(*_TXT, _ACC)} SELECT doc_id, line_no, pos,
  repeat(' ', (greatest(length(ch), length(gloss)) - length(ch)) // 2) || ch ||
    repeat(' ', (greatest(length(ch), length(gloss)) - length(ch)) - (greatest(length(ch), length(gloss)) - length(ch)) // 2) AS text,
  repeat(' ', (greatest(length(ch), length(gloss)) - length(gloss)) // 2) || gloss ||
    repeat(' ', (greatest(length(ch), length(gloss)) - length(gloss)) - (greatest(length(ch), length(gloss)) - length(gloss)) // 2) AS gloss
  FROM acc""")

# --- history and time --------------------------------------------------------

_TS_RX = "'#[0-9]+'"
sql("history_recent", f"""{with_views(HISTORY_COMMANDS)}
  SELECT *, row_number() OVER (ORDER BY line_no) AS position FROM (
  SELECT rtrim(cmd) AS cmd, max(line_no) AS line_no FROM history_commands
  WHERE regexp_matches(cmd, 'click') AND NOT regexp_full_match(cmd, {_TS_RX})
  GROUP BY rtrim(cmd) ORDER BY line_no DESC LIMIT 20)""")
sql("history_unique", f"""{with_views(HISTORY_COMMANDS, HISTORY_LINES)},
  p AS (SELECT line_no, value, lag(value) OVER (ORDER BY line_no) AS prev FROM history_lines)
  SELECT value AS cmd, max(CASE WHEN regexp_full_match(prev, {_TS_RX}) THEN CAST(substr(prev, 2) AS BIGINT) ELSE 0 END) AS ts
  FROM p WHERE NOT regexp_full_match(value, {_TS_RX}) AND value <> '' GROUP BY value""")
sql("history_rewritten", f"""WITH u AS (SELECT cmd, ts, row_number() OVER (ORDER BY ts, cmd) AS nth FROM ({ORACLE['history_unique']}))
  SELECT 2 * nth - 1 AS line_no, '#' || ts AS line FROM u UNION ALL SELECT 2 * nth, cmd FROM u""")
sql("history_tail", f"""{with_views(HISTORY_COMMANDS)}
  SELECT *, row_number() OVER (ORDER BY line_no) AS position FROM (
  SELECT line_no, cmd FROM history_commands WHERE regexp_matches(cmd, 'error') ORDER BY line_no DESC LIMIT 10)""")
sql("epoch_from_ts", """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, epoch_us(ts) // 1000 AS epoch_ms,
  epoch_us(ts) AS epoch_us, epoch_us(ts) * 1000 AS epoch_ns,
  CAST(epoch(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS epoch_s_text FROM events""")
sql("ts_from_epoch", """SELECT event_id, epoch_us(ts) // 1000 AS ms,
  strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d-%H:%M:%S') || '.000000000' AS utc,
  strftime(timezone('America/Los_Angeles', timezone('UTC', make_timestamp((epoch_us(ts) // 1000000) * 1000000))),
           '%Y-%m-%d-%H:%M:%S') || '.000000000' AS local
  FROM events""")
sql("time_label", """SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M-%S') AS label,
  strftime(ts, '%Y-%m-%d-%H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) % 1000000) * 1000 AS VARCHAR), 9, '0') AS pretty
  FROM events""")
sql("numeric_parse", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
sql("base_convert", """SELECT event_id, to_base(event_id * 7919 + user_id, 2) AS b2, to_base(event_id * 7919 + user_id, 8) AS b8,
  to_base(event_id * 7919 + user_id, 16) AS b16, to_base(event_id * 7919 + user_id, 36) AS b36,
  CAST('0x' || to_base(event_id * 7919 + user_id, 16) AS BIGINT) AS back10,
  CASE WHEN event_id > 100 THEN '-' ELSE '' END || to_base(abs(100 - event_id), 16) AS signed16 FROM events""")

# --- sizes and top-k ---------------------------------------------------------

_DIRS = """dirs AS (
  SELECT dir, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS n_files, CAST(len(string_split(dir, '/')) AS BIGINT) AS depth
  FROM (SELECT size, unnest(list_transform(range(1, len(string_split(path, '/'))),
          lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS dir FROM paths)
  GROUP BY dir)"""
sql("largest_assets", f"{with_views(ASSETS)} SELECT path, size FROM assets WHERE size > 20000 ORDER BY size DESC, path LIMIT 20")
sql("dir_sizes", f"{with_views(PATHS, _DIRS)} SELECT * FROM dirs")
sql("dir_total", f"{with_views(PATHS)} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, count(*) AS n_files FROM paths")
sql("dir_top", f"""{with_views(PATHS, _DIRS)}
  SELECT entry, total_size, kind FROM (SELECT dir AS entry, total_size, 'dir' AS kind FROM dirs
    UNION ALL SELECT path, size, 'file' FROM paths) ORDER BY total_size DESC, entry LIMIT 30""")
sql("first_n", f"""{with_views(ASSETS)} SELECT path, size FROM assets
  WHERE ends_with(lower(path), '.jpeg') OR ends_with(lower(path), '.jpg') OR ends_with(lower(path), '.png')
  ORDER BY path LIMIT 100""")
sql("group_best", f"""{with_views(ASSETS)} SELECT source, lang, path, size FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY size DESC, path) AS rn FROM assets) WHERE rn = 1""")

# --- combinations ------------------------------------------------------------

_OPERANDS = """ops AS (SELECT s_suppkey AS set_id, s_suppkey % 90 + 10 AS a, s_nationkey + 10 AS b,
  (s_suppkey * 7) % 90 + 10 AS c, 100 - (s_suppkey % 90 + 10) AS d FROM supplier)"""
_SIGNS = "sg AS (SELECT * FROM (VALUES (1), (-1)) t(s))"
_OPS = "op AS (SELECT * FROM (VALUES ('+'), ('-')) t(o))"
_PROBS = f"""{with_views(_OPERANDS, _SIGNS, _OPS)},
  gen AS (SELECT set_id, a * s1.s AS na, b * s2.s AS nb, c * s3.s AS nc, d * s4.s AS nd, p1.o AS o1, p2.o AS o2, p3.o AS o3, t.t
    FROM ops, sg s1, sg s2, sg s3, sg s4, op p1, op p2, op p3, (SELECT unnest(range(5)) AS t) t
    WHERE p1.o = '-' OR p2.o = '-' OR p3.o = '-'),
  f AS (SELECT *, CASE t
      WHEN 0 THEN printf('%d %s %d %s %d %s %d', na, o1, nb, o2, nc, o3, nd)
      WHEN 1 THEN printf('%d %s (%d %s %d) %s %d', na, o1, nb, o2, nc, o3, nd)
      WHEN 2 THEN printf('(%d %s %d) %s (%d %s %d)', na, o1, nb, o2, nc, o3, nd)
      WHEN 3 THEN printf('%d %s (%d %s %d %s %d)', na, o1, nb, o2, nc, o3, nd)
      ELSE printf('%d %s (%d %s (%d %s %d))', na, o1, nb, o2, nc, o3, nd) END AS problem FROM gen),
  ev AS (SELECT set_id, CAST(t AS INTEGER) AS template_id, problem,
    CASE t WHEN 0 THEN ((na + (CASE o1 WHEN '+' THEN 1 ELSE -1 END) * nb) + (CASE o2 WHEN '+' THEN 1 ELSE -1 END) * nc)
                       + (CASE o3 WHEN '+' THEN 1 ELSE -1 END) * nd
           WHEN 1 THEN (na + (CASE o1 WHEN '+' THEN 1 ELSE -1 END) * (nb + (CASE o2 WHEN '+' THEN 1 ELSE -1 END) * nc))
                       + (CASE o3 WHEN '+' THEN 1 ELSE -1 END) * nd
           WHEN 2 THEN (na + (CASE o1 WHEN '+' THEN 1 ELSE -1 END) * nb)
                       + (CASE o2 WHEN '+' THEN 1 ELSE -1 END) * (nc + (CASE o3 WHEN '+' THEN 1 ELSE -1 END) * nd)
           WHEN 3 THEN na + (CASE o1 WHEN '+' THEN 1 ELSE -1 END) * ((nb + (CASE o2 WHEN '+' THEN 1 ELSE -1 END) * nc)
                       + (CASE o3 WHEN '+' THEN 1 ELSE -1 END) * nd)
           ELSE na + (CASE o1 WHEN '+' THEN 1 ELSE -1 END) * (nb + (CASE o2 WHEN '+' THEN 1 ELSE -1 END)
                       * (nc + (CASE o3 WHEN '+' THEN 1 ELSE -1 END) * nd)) END AS value FROM f)"""
sql("quiz_problems", f"{_PROBS} SELECT set_id, template_id, problem, CAST(value AS BIGINT) AS value FROM ev")
sql("quiz_value_counts", f"{_PROBS} SELECT CAST(value AS BIGINT) AS value, count(*) AS n_problems FROM ev GROUP BY value")
sql("quiz_selected", f"""{_PROBS} SELECT set_id, template_id, problem, CAST(value AS BIGINT) AS value,
  md5(concat_ws('|', set_id, template_id, problem, 0)) AS shuffle_key FROM ev
  WHERE value IN (0, 200, -200)""")
sql("quiz_counts", f"""{_PROBS} SELECT count(*) AS n_total, count(*) FILTER (WHERE value IN (0, 200, -200)) AS n_selected FROM ev""")

# --- toggles -----------------------------------------------------------------

_TOGGLE = """log AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'reset' ELSE 'toggle' END AS kind,
    printf('img/%03d.jpg', user_id) AS item FROM events WHERE event_type IN ('signup', 'click')),
  t AS (SELECT item, seq, row_number() OVER (PARTITION BY item ORDER BY seq) AS k FROM log WHERE kind = 'toggle'),
  st AS (SELECT item, count(*) AS n_toggles, count(*) % 2 = 1 AS moved,
    coalesce(sum(CASE WHEN seq > (SELECT coalesce(max(seq), -1) FROM log WHERE kind = 'reset')
                      THEN CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END END), 0) AS delta
    FROM t GROUP BY item)"""
sql("toggle_state", f"{with_views(_TOGGLE)} SELECT item, n_toggles, moved, CAST(delta AS BIGINT) AS delta FROM st")
sql("toggle_counter", f"""{with_views(_TOGGLE)} SELECT CAST(coalesce(sum(delta), 0) AS BIGINT) AS counter,
  count(*) FILTER (WHERE moved) AS n_moved FROM st""")

sql("toggle_stream", ORACLE["toggle_counter"])

# --- cache reuse -------------------------------------------------------------

_OLD_CACHE = """old AS (
  SELECT path, CASE WHEN doc_id % 6 = 1 THEN size + 1 ELSE size END AS size, md5(content) AS md5 FROM assets WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'gone/' || path, size, md5(content) FROM assets WHERE doc_id % 10 = 0)"""
sql("cache_split", f"""{with_views(ASSETS, _OLD_CACHE)} SELECT path, size,
  CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.path = a.path AND o.size = a.size) THEN 'hit' ELSE 'miss' END AS status
  FROM assets a""")
sql("cache_refresh", f"{with_views(ASSETS)} SELECT path, size, md5(content) AS md5 FROM assets")
sql("cache_versions", ORACLE["cache_refresh"])
sql("hash_stream", ORACLE["cache_refresh"])
sql("predict_missing", f"{with_views(DETECTION_ASSETS)} SELECT asset_id, path, (size % 97) / 8.0::DOUBLE AS score FROM detection_assets WHERE asset_id % 4 = 0")
sql("predict_pending", f"{with_views(DETECTION_ASSETS)} SELECT asset_id, path, size FROM detection_assets WHERE asset_id % 4 = 0")
sql("complete_hashes", f"{with_views(ASSETS)} SELECT path, sha1(content) AS sha1 FROM assets WHERE h > 1")

# --- quoting and reports -----------------------------------------------------

sql("quote_path", "SELECT doc_id, replace(url_encode(text), '%2F', '/') AS quoted FROM documents")
sql("report_rows", f"""{with_views(ASSETS, _KEPT, _LONG, _RANKED)},
  g AS (SELECT *, first_value(w) OVER (PARTITION BY hash_type, hash ORDER BY rn) AS keep_w FROM ranked WHERE n_members >= 2)
  SELECT hash_type, hash, CAST(0 AS BIGINT) AS seq, '<tr><td>' || hash || '</td><td>' AS line FROM g WHERE rn = 1
  UNION ALL
  SELECT hash_type, hash, CAST(rn AS BIGINT), '<img src="' || replace(url_encode(CASE WHEN rn = 1 THEN path ELSE '/trash/' || path END), '%2F', '/')
    || '" width="' || CAST(CAST(floor(100 * w / keep_w) AS BIGINT) AS VARCHAR) || 'px" data-meta="{{}}" /> ' FROM g
  UNION ALL
  SELECT hash_type, hash, CAST(n_members + 1 AS BIGINT), '</td></tr>' FROM g WHERE rn = 1""")
sql("report_files", f"SELECT hash_type, line FROM ({ORACLE['report_rows']})")
sql("paged_report", f"""{with_views(*_SCORE_VIEWS, _LABELED, _ROWS)},
  lp AS (SELECT label, CAST(ceil(ceil(count(*) / 7) / 100) AS BIGINT) AS pages FROM labeled GROUP BY label),
  off AS (SELECT label, coalesce(sum(pages) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_page FROM lp)
  SELECT CAST(first_page + row_idx // 100 AS BIGINT) AS page,
         printf('%s-%03d', label, CAST(first_page + row_idx // 100 AS BIGINT)) AS page_name, label, row_idx, count(*) AS n_cells,
         '<tr><td>' || printf('%s-%d', label, row_idx) || '</td><td>' || string_agg('<img src="' || replace(url_encode(path), '%2F', '/')
           || '" width="200px" data-meta="' || printf('%.6f', score) || '" /> ', '' ORDER BY col_idx) || '</td></tr>' AS line
  FROM rows2 JOIN off USING (label) GROUP BY page, page_name, label, row_idx""")
sql("box_corners", f"""{with_views(DETECTIONS)} SELECT det_id, asset_id % 100 AS x, det_id % 100 AS y,
  asset_id % 100 + CAST(floor(score) AS BIGINT) + 1 AS x2, det_id % 100 + 10 AS y2,
  CAST(floor(asset_id % 100 + (CAST(floor(score) AS BIGINT) + 1 - length(class) * 10) / 2) AS BIGINT) AS text_x,
  det_id % 100 + 10 + 10 + 5 AS text_y FROM detections""")

sql("locale_sort", f"""{with_views(ASSETS)}
  SELECT path, CAST(row_number() OVER (ORDER BY path COLLATE en, path) AS BIGINT) AS position FROM assets""")

# --- interlinear wrap: the per-line fold restated with list_reduce ----------

_GLOSS_CHAIN = "t"
for _c in sorted(chr(c) for c in range(0xE0, 0x100) if c != 0xF7):
    _GLOSS_CHAIN = f"replace({_GLOSS_CHAIN}, '{_c}', '{format(ord(_c), 'x')}')"
_HAN = "'\\p{Han}+'"
_FOLD = f"""  ms AS (SELECT doc_id, line_no, list_transform(tg, lambda x: {{'t': x.t, 'g': x.g, 'han': regexp_full_match(x.t, {_HAN}),
           'wa': length(x.t) * CASE WHEN regexp_full_match(x.t, {_HAN}) THEN 2 ELSE 1 END,
           'wb': length(x.g) * CASE WHEN regexp_full_match(x.g, {_HAN}) THEN 2 ELSE 1 END}}) AS m FROM gl),
  al AS (SELECT doc_id, line_no, list_transform(m, lambda x: {{
           'h': repeat(' ', (greatest(x.wa, x.wb) - x.wa) // 2) || x.t
                || repeat(' ', (greatest(x.wa, x.wb) - x.wa) - (greatest(x.wa, x.wb) - x.wa) // 2),
           'p': repeat(' ', (greatest(x.wa, x.wb) - x.wb) // 2) || x.g
                || repeat(' ', (greatest(x.wa, x.wb) - x.wb) - (greatest(x.wa, x.wb) - x.wb) // 2),
           'han': x.han}}) AS a FROM ms),
  it AS (SELECT doc_id, line_no, list_transform(range(len(a)), lambda i: {{'h': a[i + 1].h, 'p': a[i + 1].p, 'han': a[i + 1].han,
           'next_han': coalesce(a[i + 2].han, false), 'next_sp': coalesce(starts_with(a[i + 2].p, ' '), false)}}) AS items FROM al),
  fo AS (SELECT doc_id, line_no, list_reduce(items, lambda s, x: CASE WHEN length(s.p || x.p) > 60 THEN
           {{'h': '', 'p': '', 'out': list_append(s.out, {{
              'h': s.h || x.h || CASE WHEN ends_with(s.p || x.p, chr(10)) THEN '' ELSE chr(10) END,
              'p': s.p || x.p || CASE WHEN ends_with(s.p || x.p, chr(10)) THEN '' ELSE chr(10) END}})}}
         ELSE {{'h': s.h || x.h || CASE WHEN x.han AND x.next_han AND NOT ends_with(x.p, ' ') AND NOT x.next_sp THEN ' ' ELSE '' END,
                'p': s.p || x.p || CASE WHEN x.han AND x.next_han AND NOT ends_with(x.p, ' ') AND NOT x.next_sp THEN ' ' ELSE '' END,
                'out': s.out}} END,
         {{'h': '', 'p': '', 'out': []::STRUCT(h VARCHAR, p VARCHAR)[]}}) AS r FROM it),
  segs AS (SELECT doc_id, line_no, CASE WHEN length(r.p) > 0 THEN list_append(r.out, {{'h': r.h, 'p': r.p}}) ELSE r.out END AS s FROM fo),
  wrapped AS (SELECT doc_id, line_no, CAST(unnest(generate_series(0, len(s) - 1)) AS BIGINT) AS seg, unnest(s) AS x FROM segs)"""
_WRAP = f"""{with_views(LINES)},
  tk AS (SELECT doc_id, line_no, regexp_extract_all(value || chr(10), '\\p{{Han}}|[^\\p{{Han}} ]+ *| +') AS toks FROM lines),
  gl AS (SELECT doc_id, line_no, list_transform(toks, lambda t: {{'t': t, 'g': {_GLOSS_CHAIN}}}) AS tg FROM tk),
{_FOLD}"""
sql("interlinear_wrap", f"{_WRAP} SELECT doc_id, line_no, seg, x.h AS text, x.p AS gloss FROM wrapped")
sql("interlinear_lines", f"""{_WRAP} SELECT doc_id, line_no, seg, CAST(0 AS BIGINT) AS k, x.p AS line FROM wrapped
  UNION ALL SELECT doc_id, line_no, seg, CAST(1 AS BIGINT) AS k, x.h AS line FROM wrapped""")


# the cheapest cut of each Han line from its end, then the words from its start
_PHRASES = """WITH han AS (
    SELECT doc_id, CAST(1 AS BIGINT) AS line_no, list_transform(range(0, 21 + doc_id % 60), lambda k: CASE WHEN k % 9 = 8 THEN ' ' || coalesce(lang, '') || ' '
      ELSE chr(CAST(19968 + (doc_id * 31 + k + k // 4 * 5) % 40 AS INTEGER)) END) AS pieces FROM documents),
  hl AS (SELECT doc_id, line_no, array_to_string(pieces, '') AS value FROM han),
  cs AS (SELECT *, list_transform(string_split(value, ''), lambda x: CASE WHEN unicode(x) BETWEEN 19968 AND 20007 THEN unicode(x) - 19968 ELSE -9 END) AS c FROM hl),
  best AS (SELECT *, list_reduce(list_reverse(range(1, len(c) + 1)), lambda acc, i: list_prepend(CASE
      WHEN c[i] % 5 = 1 AND c[i] >= 0 AND c[i + 1] = c[i] + 1 AND c[i + 2] = c[i] + 2 AND coalesce(acc[3].c, 0) <= least(coalesce(acc[1].c, 0),
           CASE WHEN c[i] % 3 = 0 AND c[i] >= 0 AND c[i + 1] = c[i] + 1 THEN coalesce(acc[2].c, 0) ELSE 999999 END) THEN {'c': coalesce(acc[3].c, 0) + 1, 'l': 3}
      WHEN c[i] % 3 = 0 AND c[i] >= 0 AND c[i + 1] = c[i] + 1 AND coalesce(acc[2].c, 0) <= coalesce(acc[1].c, 0) THEN {'c': coalesce(acc[2].c, 0) + 1, 'l': 2}
      ELSE {'c': coalesce(acc[1].c, 0) + 1, 'l': 1} END, acc), []::STRUCT(c BIGINT, l BIGINT)[]) AS b FROM cs),
  walk AS (SELECT *, list_reduce(range(1, len(c) + 1), lambda s, i: CASE WHEN i = s.next
      THEN {'next': i + b[i].l, 'starts': list_append(s.starts, i)} ELSE s END, {'next': CAST(1 AS BIGINT), 'starts': []::BIGINT[]}).starts AS starts FROM best),
  chars AS (SELECT doc_id, line_no, value, c, b, starts, unnest(range(1, len(c) + 1)) AS i FROM walk),
  placed AS (SELECT doc_id, line_no, value, c, b, i, list_max(list_filter(starts, lambda x: x <= i)) AS st FROM chars WHERE c[i] >= 0),
  said AS (SELECT doc_id, line_no, value, i - 1 AS pos, substr(value, i, 1) AS ch, st - 1 AS word_start, b[st].l AS word_length,
      CASE WHEN b[st].l = 1 THEN 'z' || c[i] ELSE 'y' || c[st] || '.' || b[st].l || '.' || (i - st) END AS reading FROM placed)"""
sql("phrase_readings", f"{_PHRASES} SELECT doc_id, line_no, pos, ch, reading, word_start, word_length FROM said")
sql("interlinear_han", f"""{_PHRASES},
  rd AS (SELECT doc_id, line_no, list(reading ORDER BY pos) AS r FROM said GROUP BY 1, 2),
  tk AS (SELECT h.doc_id, h.line_no, r, regexp_extract_all(value || chr(10), '\\p{{Han}}|[^\\p{{Han}} ]+ *| +') AS toks FROM hl h JOIN rd USING (doc_id, line_no)),
  gl AS (SELECT doc_id, line_no, list_transform(range(1, len(toks) + 1), lambda i: {{'t': toks[i], 'g': CASE WHEN regexp_full_match(toks[i], {_HAN})
      THEN r[len(list_filter(toks[1:i], lambda x: regexp_full_match(x, {_HAN})))] ELSE toks[i] END}}) AS tg FROM tk),
{_FOLD} SELECT doc_id, line_no, seg, x.h AS text, x.p AS gloss FROM wrapped""")


sql("progress_totals", f"""{with_views(ASSETS)}
  SELECT 'listed' AS step, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS n_bytes FROM assets
  UNION ALL SELECT 'kept', count(*), CAST(sum(size) AS BIGINT) FROM assets WHERE NOT ({skip_pred()}) AND size <= 16384""")


# --- delta cache ---------------------------------------------------------------------

sql("delta_cache", f"{with_views(ASSETS)} SELECT path, size, md5(content) AS md5 FROM assets WHERE doc_id % 7 <> 0")
sql("delta_cache_compacted", ORACLE["delta_cache"])
sql("delta_cache_parts", f"""{with_views(ASSETS)},
  c AS (SELECT doc_id % 3 <> 0 AS a, doc_id % 5 <> 0 AS b, doc_id % 7 <> 0 AS c, size % 4 = 0 AS bad FROM assets)
  SELECT * FROM (
    SELECT 1 AS version, 'rows' AS kind, count(*) FILTER (a) AS n_rows FROM c
    UNION ALL SELECT 2, 'rows', count(*) FILTER (b AND (NOT a OR bad)) FROM c
    UNION ALL SELECT 2, 'gone', count(*) FILTER (a AND (NOT b OR bad)) FROM c
    UNION ALL SELECT 3, 'rows', count(*) FILTER (c AND NOT b) FROM c
    UNION ALL SELECT 3, 'gone', count(*) FILTER (b AND NOT c) FROM c) WHERE n_rows > 0""")


sql("toggle_shards", ORACLE["toggle_stream"])


# --- documents: the lines of a report between head and foot --------------------------


def _documents(file, rows, order):
    head = ["<!DOCTYPE html>", "<html>", "<head>", '<meta charset="utf-8">', "<title>File Group Mappings</title>", "</head>", "<body>",
            "<h1>File Group Mappings</h1>", "<table>", "<thead>", "<tr><th>Group Name</th><th>Files</th></tr>", "</thead>", "<tbody>"]
    foot = ["</tbody>", "</table>", "</body>", "</html>"]
    listed = lambda part, lines: ", ".join(f"({part}, {i}, '{x}')" for i, x in enumerate(lines))      # noqa: E731
    return f"""WITH body AS (SELECT {file} AS file, 1 AS part, row_number() OVER (PARTITION BY {file} ORDER BY {order}) AS nth, line FROM ({rows})),
      ends AS (SELECT file, part, nth, line FROM (SELECT DISTINCT file FROM body), (VALUES {listed(0, head)}, {listed(2, foot)}) e(part, nth, line)),
      every AS (SELECT file, part, nth, line FROM body UNION ALL SELECT file, part, nth, line FROM ends)
      SELECT file, row_number() OVER (PARTITION BY file ORDER BY part, nth) AS line_no, line AS value FROM every"""


sql("report_documents", _documents("hash_type || '.html'", ORACLE["report_rows"], "hash, seq"))
sql("paged_documents", _documents("page_name || '.html'", ORACLE["paged_report"], "label, row_idx"))
