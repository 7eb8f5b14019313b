"""The driver-table views of ``assetflow.sources.views`` as DuckDB CTEs.

Used only by the correctness oracle: each SQL text here restates a view
independently of the Spark code so that both sides can be compared.
"""

EXT_LIST = "['jpg','JPG','jpeg','png','gif','webp','txt','mp4']"
ASSET_PATH = (f"source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.' || "
              f"({EXT_LIST})[doc_id % 8 + 1]")

ASSETS = f"""assets AS (
  SELECT doc_id, lang, source,
         {ASSET_PATH} AS path,
         CAST(strlen(text) AS BIGINT) AS size,
         CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS BIGINT) AS w,
         CAST(len(string_split(text, chr(10))) AS BIGINT) AS h,
         text AS content
  FROM documents)"""

LINES = f"""lines AS (
  SELECT doc_id, file, CAST(line_no AS BIGINT) AS line_no, value FROM (
    SELECT doc_id, {ASSET_PATH} AS file,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no,
           unnest(string_split(text, chr(10))) AS value
    FROM documents))"""

CHARS = """chars AS (
  SELECT doc_id, line_no, CAST(pos AS BIGINT) AS pos, ch FROM (
    SELECT doc_id, line_no,
           unnest(generate_series(0, len(string_split(value, '')) - 1)) AS pos,
           unnest(string_split(value, '')) AS ch
    FROM lines) WHERE ch <> '')"""

DETECTIONS = """detections AS (
  SELECT user_id AS asset_id, event_id AS det_id, (['trace', 'glance', 'tap', 'fault', 'join', 'order'])[1 + least(user_id % 6,
    CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)] AS class,
    value AS score FROM events)"""

DETECTION_ASSETS = """detection_assets AS (
  SELECT asset_id, printf('img/%06d.jpg', asset_id) AS path,
         CAST((asset_id * 7919) % 100000 + 1 AS BIGINT) AS size
  FROM (SELECT user_id AS asset_id FROM events UNION SELECT c_custkey FROM customer))"""

PIXELS = """pixels AS (
  SELECT image_id, 8 AS height, 8 AS width,
         list_transform(v, lambda x: CASE WHEN mx > mn THEN CAST(floor((x - mn) / (mx - mn) * 255) AS INTEGER) ELSE 0 END) AS px
  FROM (SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS v,
               list_min(CAST(embedding AS DOUBLE[])) AS mn, list_max(CAST(embedding AS DOUBLE[])) AS mx
        FROM embeddings))"""

HISTORY_COMMANDS = """history_commands AS (
  SELECT event_id AS line_no, epoch_us(ts) // 1000000 AS ts, event_type || ' ' || props AS cmd FROM events)"""

HISTORY_LINES = """history_lines AS (
  SELECT 'history' AS file, CAST(row_number() OVER (ORDER BY line_no, k) AS BIGINT) AS line_no, v AS value
  FROM (
    SELECT line_no, 0 AS k, '#' || ts AS v FROM history_commands WHERE line_no % 11 = 5
    UNION ALL SELECT line_no, 1, '#' || ts FROM history_commands WHERE line_no % 7 <> 3
    UNION ALL SELECT line_no, 2, cmd FROM history_commands))"""

PATHS = """paths AS (
  SELECT page_id,
         regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '/index.html') AS path,
         CAST(strlen(html) AS BIGINT) AS size
  FROM pages)"""

SKIP_SUFFIXES_SQL = ("'.ds_store', '.html', '.json', '.py', '.avi', '.mov', '.mp4', '.txt', '.webp'")


def skip_pred(path: str = "path") -> str:
    """SQL: path has a denylisted suffix."""
    return f"list_bool_or(list_transform([{SKIP_SUFFIXES_SQL}], lambda s: ends_with(lower({path}), s)))"


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views)
