"""SQL text for the oracle (DuckDB dialect): fixtures and path helpers.

The oracle re-states each query as a plain, brute-force SQL statement over
the same driver tables, independent of the Spark operator code.
"""

from __future__ import annotations

ROOT = "/data/Processing"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def basename(x: str) -> str:
    return f"regexp_extract({x}, '([^/]*)$', 1)"


def parent(x: str) -> str:
    return f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"


def suffix(x: str) -> str:
    return f"regexp_extract({x}, '(?s)^.+(\\.[^.]+)$', 1)"


def lower_suffix(x: str) -> str:
    return f"lower({suffix(x)})"


def stem(x: str) -> str:
    return f"CASE WHEN {suffix(x)} <> '' THEN regexp_extract({x}, '(?s)^(.+)\\.[^.]+$', 1) ELSE {x} END"


def year_folder(x: str) -> str:
    return f"regexp_extract({x}, '(?:^|/)(Photos from [0-9]{{4}}[^/]*)', 1)"


def archive(x: str) -> str:
    strict = f"regexp_extract({x}, '(?:^|/)([Zz][0-9]{{3}})(?:/|$)', 1)"
    loose = f"regexp_extract({x}, '(?:^|/)([Zz][^/]*)', 1)"
    return f"CASE WHEN {strict} <> '' THEN {strict} ELSE {loose} END"


def blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) = '')"


def flag_is(x: str, v: str) -> str:
    return f"(lower(trim(coalesce({x}, ''))) = {q(v)})"


SIDECAR_RE = "(?i)^(.+)\\.([^.]+)\\.[^.]*?(?:\\((\\d+)\\))?\\.json$"


def expected_media(n: str) -> str:
    b = f"regexp_extract({n}, {q(SIDECAR_RE)}, 1)"
    e = f"regexp_extract({n}, {q(SIDECAR_RE)}, 2)"
    d = f"regexp_extract({n}, {q(SIDECAR_RE)}, 3)"
    return (f"CASE WHEN regexp_matches({n}, {q(SIDECAR_RE)}) THEN "
            f"CASE WHEN {d} <> '' THEN {b} || '(' || {d} || ').' || {e} ELSE {b} || '.' || {e} END END")


def json_ts(c: str) -> str:
    raw = f"json_extract_string({c}, '$.photoTakenTime.timestamp')"
    return (f"coalesce(CASE WHEN {c} IS NOT NULL AND json_valid({c}) THEN "
            f"CASE WHEN regexp_matches({raw}, '^\\s*[+-]?[0-9]+\\s*$') THEN TRY_CAST(trim({raw}) AS BIGINT) END END, 0)")


def fmt_time(ts: str) -> str:
    return (f"CASE WHEN {ts} IS NULL OR {ts} = 0 THEN '' ELSE "
            f"strftime(epoch_ms(CAST({ts} AS BIGINT) * 1000), '%Y:%m:%d %H:%M:%S') END")


def unclean(nm: str) -> str:
    return ("(" + " OR ".join(f"instr({nm}, {q(m)}) > 0" for m in ["(1)", "_1", "copy", "edited"]) + ")")


# ------------------------------------------------------------------ fixtures

def _dir(i: str = "doc_id") -> str:
    return (f"'{ROOT}/Z' || printf('%03d', {i} % 3 + 1) || '/Takeout/Google Photos/Photos from ' "
            f"|| CAST(2010 + ({i} // 3) % 5 AS VARCHAR)")


MEDIA_EXT = ("CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' "
             "WHEN 3 THEN '.heic' WHEN 4 THEN '.mp4' ELSE '.avi' END")
SIDECAR_EXT = ("CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' "
               "WHEN 3 THEN '.heic' WHEN 4 THEN '.mp4' ELSE '.avi' END")

MEDIA_NAME = ("'IMG_' || printf('%05d', doc_id // 3) || CASE WHEN doc_id % 11 = 3 THEN '(1)' ELSE '' END || "
              + MEDIA_EXT)
SIDECAR_NAME = ("'IMG_' || printf('%05d', doc_id // 3) || " + SIDECAR_EXT +
                " || CASE WHEN doc_id % 13 = 5 THEN '.json' ELSE '.supplemental-metadata' || "
                "CASE WHEN doc_id % 11 = 3 THEN '(1)' ELSE '' END || '.json' END")

FIXTURE_CTES = f"""
media_files AS (
  SELECT doc_id AS file_id, 'media' AS origin,
         {_dir()} || '/' || {MEDIA_NAME} AS path,
         n_chars AS size, CAST(1600000000 + doc_id * 60 AS BIGINT) AS mtime,
         CAST(NULL AS VARCHAR) AS content,
         CASE WHEN doc_id % 7 = 2 THEN 'FFD8FFE000104A4649460001'
              WHEN doc_id % 7 = 5 THEN '000000146674797071742020'
              WHEN lower({MEDIA_EXT}) = '.jpg' THEN 'FFD8FFE000104A4649460001'
              WHEN lower({MEDIA_EXT}) = '.png' THEN '89504E470D0A1A0A0000000D'
              WHEN lower({MEDIA_EXT}) = '.heic' THEN '000000186674797068656963'
              WHEN lower({MEDIA_EXT}) = '.mp4' THEN '000000206674797069736F6D'
              ELSE '524946460000000041564920' END AS header_hex,
         sha1(text) AS content_sha1,
         CASE WHEN lower({MEDIA_EXT}) IN ('.jpg', '.jpeg', '.png', '.heic')
              THEN substr(sha1(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')), 1, 16)
              ELSE '' END AS phash64
  FROM documents),
sidecar_files AS (
  SELECT doc_id AS file_id, 'sidecar' AS origin,
         {_dir()} || '/' || {SIDECAR_NAME} AS path,
         CAST(length(content) AS BIGINT) AS size,
         CAST(1600000000 + doc_id * 60 + 1 AS BIGINT) AS mtime,
         content, CAST(NULL AS VARCHAR) AS header_hex,
         CAST(NULL AS VARCHAR) AS content_sha1, CAST(NULL AS VARCHAR) AS phash64
  FROM (SELECT doc_id,
          CASE WHEN doc_id % 17 = 4 THEN '{{"photoTakenTime": {{"timestamp": '
               WHEN doc_id % 19 = 7 THEN '{{"title": "' || {SIDECAR_NAME} || '"}}'
               WHEN doc_id % 2 = 0 THEN '{{"photoTakenTime": {{"timestamp": ' || CAST(1262304000 + doc_id * 86400 AS VARCHAR) || '}}}}'
               ELSE '{{"photoTakenTime": {{"timestamp": "' || CAST(1262304000 + doc_id * 86400 AS VARCHAR) || '"}}}}' END AS content
        FROM documents WHERE doc_id % 10 < 8) s),
inventory AS (SELECT * FROM media_files UNION ALL SELECT * FROM sidecar_files),
inventory_now AS (
  SELECT * REPLACE (CASE WHEN origin = 'media' AND file_id % 9 = 4 THEN mtime + 3600 ELSE mtime END AS mtime)
  FROM inventory
  WHERE NOT ((origin = 'media' AND file_id % 23 = 0) OR (origin = 'sidecar' AND file_id % 29 = 0))),
fingerprints AS (
  SELECT path,
         CASE WHEN lower(regexp_extract(path, '(?s)^.+(\\.[^.]+)$', 1)) = '.heic' AND file_id % 4 = 1 THEN '' ELSE content_sha1 END AS content_sha1,
         CASE WHEN lower(regexp_extract(path, '(?s)^.+(\\.[^.]+)$', 1)) = '.heic' AND file_id % 4 = 1 THEN '' ELSE phash64 END AS phash64,
         mtime
  FROM media_files)"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def append_hist(c: str, t: str) -> str:
    p = f"trim(coalesce({c}, ''))"
    return f"CASE WHEN {p} = '' THEN {t} ELSE {p} || '; ' || {t} END"


def quarantine(p: str, root: str) -> str:
    strict = f"regexp_extract({p}, '(?:^|/)([Zz][0-9]{{3}})(?:/|$)', 1)"
    after = f"regexp_extract({p}, '(?:^|/)(?:[Zz][0-9]{{3}})(/.*)?$', 1)"
    after_loose = f"regexp_extract({p}, '(?:^|/)(?:[Zz][^/]*)(/.*)?$', 1)"
    tail = f"(CASE WHEN {strict} <> '' THEN {after} ELSE {after_loose} END)"
    parts = f"list_filter(string_split({tail}, '/'), lambda x: x <> '' AND lower(x) NOT IN ('takeout', 'google photos'))"
    rel = f"(CASE WHEN len({parts}) > 0 THEN '/' || array_to_string({parts}, '/') ELSE '' END)"
    return f"(CASE WHEN {archive(p)} = '' THEN NULL ELSE {q(root)} || '/' || {archive(p)} || {rel} END)"


def to_wsl(x: str) -> str:
    s = f"replace({strip(x)}, '\\', '/')"
    return (f"(CASE WHEN {x} = '' THEN {x} WHEN regexp_matches({s}, '^([a-zA-Z]):/(.+)') THEN "
            f"'/mnt/' || lower(regexp_extract({s}, '^([a-zA-Z]):/(.+)', 1)) || '/' || "
            f"regexp_extract({s}, '(?s)^([a-zA-Z]):/(.+)', 2) ELSE {s} END)")


ARCHIVE_MEMBERS = f"""
archive_members AS (
  SELECT '/data/Zipped/' || regexp_extract(path, '^/data/Processing/(Z[0-9]{{3}})/(.*)$', 1) || '.zip' AS zip_path,
         regexp_extract(path, '^/data/Processing/(Z[0-9]{{3}})/(.*)$', 2) AS member
  FROM inventory)"""

DOWNLOADS = """
downloads AS (
  SELECT '/data/Zipped/' || CASE
      WHEN page_id % 9 = 0 THEN 'Z' || printf('%03d', page_id % 1000) || '.zip'
      WHEN page_id % 11 = 1 THEN 'takeout-2025' || printf('%04d', page_id % 1200 + 101) || 'T000000Z-' || printf('%03d', page_id % 1000) || '.ZIP'
      WHEN page_id % 13 = 2 THEN 'takeout-2025' || printf('%04d', page_id % 1200 + 101) || 'T000000Z-' || printf('%03d', page_id % 1000) || '.7z'
      WHEN page_id % 17 = 3 THEN 'takeout-2025' || printf('%04d', page_id % 1200 + 101) || 'T000000Z-extra.zip'
      ELSE 'takeout-2025' || printf('%04d', page_id % 1200 + 101) || 'T000000Z-' || printf('%03d', page_id % 1000) || '.zip' END AS path
  FROM pages)"""
