"""Oracle SQL (DuckDB) for every registered query with an SQL form."""

from __future__ import annotations

from .sqlparts import (ARCHIVE_MEMBERS, DOWNLOADS, FIXTURE_CTES, ROOT, append_hist, archive,
                       basename, blank, expected_media, flag_is, fmt_time, json_ts, lower_suffix,
                       parent, q, quarantine, stem, strip, suffix, to_wsl, unclean, year_folder)

# ---------------------------------------------------------------- manifest

FILES = f"""
files AS (
  SELECT file_id, path, content, {basename('path')} AS name, {archive('path')} AS archive,
         {year_folder('path')} AS year_folder,
         lower({basename('path')}) LIKE '%.json' AS is_json
  FROM inventory WHERE {year_folder('path')} <> ''),
js AS (SELECT *, lower({expected_media('name')}) AS k FROM files WHERE is_json),
md AS (SELECT *, lower(name) AS k FROM files WHERE NOT is_json),
jr AS (SELECT *, row_number() OVER (PARTITION BY year_folder, k ORDER BY archive, name, file_id) AS rk
       FROM js WHERE k IS NOT NULL),
mr AS (SELECT *, row_number() OVER (PARTITION BY year_folder, k ORDER BY archive, name, file_id) AS rk
       FROM md),
pairs AS (SELECT jr.path AS json_path, jr.name AS json_name, mr.path AS media_path,
                 mr.name AS media_name, jr.year_folder, jr.content
          FROM jr JOIN mr ON jr.year_folder = mr.year_folder AND jr.k = mr.k AND jr.rk = mr.rk)"""

MANIFEST = FILES + f""",
mrows AS (
  SELECT 0 AS section, j.year_folder AS yf, j.archive AS o0, j.name AS o1, j.file_id AS o2,
         CASE WHEN p.media_path IS NOT NULL THEN 'matched' ELSE 'unmatched_json' END AS row_type,
         j.name AS json_filename, j.path AS json_path,
         coalesce(p.media_name, '') AS original_media,
         coalesce(p.media_path, '') AS media_path,
         coalesce(p.media_path, '') AS corrected_path,
         CASE WHEN p.media_path IS NOT NULL THEN {json_ts('j.content')} END AS timestamp_unix,
         CASE WHEN p.media_path IS NOT NULL THEN {fmt_time(json_ts('j.content'))} ELSE '' END AS formatted_time,
         CASE WHEN p.media_path IS NOT NULL THEN {lower_suffix(basename('p.media_path'))} ELSE '' END AS new_ext,
         '' AS action_taken,
         CASE WHEN p.media_path IS NOT NULL THEN '' ELSE 'No media match found in ' || j.year_folder END AS notes
  FROM files j LEFT JOIN pairs p ON j.path = p.json_path
  WHERE j.is_json
  UNION ALL
  SELECT 1, m.year_folder, m.archive, m.name, m.file_id, 'unmatched_media', '', '', m.name, m.path, m.path,
         CAST(NULL AS BIGINT), '', {lower_suffix('m.name')}, '', 'No JSON match found in ' || m.year_folder
  FROM files m WHERE NOT m.is_json AND m.path NOT IN (SELECT media_path FROM pairs)),
manifest AS (
  SELECT row_number() OVER (ORDER BY section, yf, o0, o1, o2) AS row_id,
         row_type, json_filename, json_path, original_media, media_path, corrected_path,
         timestamp_unix, formatted_time, new_ext, action_taken, notes
  FROM mrows)"""

BASE = "WITH " + FIXTURE_CTES + "," + MANIFEST

# manifest with fingerprints attached (what the hashing stage produces)
FP_MANIFEST = """,
fpm AS (
  SELECT m.*, coalesce(f.content_sha1, '') AS content_sha1, coalesce(f.phash64, '') AS phash64,
         f.mtime AS hash_mtime
  FROM manifest m LEFT JOIN fingerprints f ON m.media_path = f.path)"""


def dedup_sql(src: str, key: str, name: str, existing: str | None = None) -> str:
    """CTEs ``{name}_v`` (verdict per path) for manifest-shaped ``src``."""
    img = "phash64" if key == "phash" else "content_sha1"
    ext = lower_suffix(basename("trim(media_path)"))
    ex = f" AND media_path IN (SELECT path FROM {existing})" if existing else ""
    return f""",
{name}_c AS (
  SELECT *, CASE WHEN {ext} IN ('.jpg', '.jpeg', '.png', '.heic') THEN 0
                 WHEN {ext} IN ('.mp4', '.mov', '.avi', '.mkv') THEN 1 END AS kind,
            CASE WHEN {ext} IN ('.jpg', '.jpeg', '.png', '.heic') THEN trim({img})
                 WHEN {ext} IN ('.mp4', '.mov', '.avi', '.mkv') THEN trim(content_sha1) END AS fp
  FROM {src}),
{name}_c2 AS (SELECT * FROM {name}_c WHERE kind IS NOT NULL AND fp IS NOT NULL AND fp <> ''{ex}),
{name}_pp AS (
  SELECT kind, fp, media_path, min(row_id) AS first_row_id,
         arg_max(original_media, row_id) AS original_media,
         arg_max(json_filename, row_id) AS json_filename
  FROM {name}_c2 GROUP BY kind, fp, media_path),
{name}_sc AS (
  SELECT *, row_number() OVER (PARTITION BY kind, fp ORDER BY
              {blank('json_filename')}, {unclean('lower(original_media)')},
              length(lower(original_media)), first_row_id) AS pref,
            count(*) OVER (PARTITION BY kind, fp) AS n_members,
            min(first_row_id) OVER (PARTITION BY kind, fp) AS group_first
  FROM {name}_pp),
{name}_g AS (
  SELECT kind, fp, media_path AS keeper_path, original_media AS keeper_media,
         printf('group_%04d', row_number() OVER (ORDER BY kind, group_first) - 1) AS dedup_group_id
  FROM {name}_sc WHERE pref = 1 AND n_members >= 2),
{name}_v AS (
  SELECT s.media_path, g.dedup_group_id,
         CASE WHEN s.media_path = g.keeper_path THEN 'false' ELSE 'true' END AS delete_flag,
         CASE WHEN s.media_path = g.keeper_path THEN '' ELSE g.keeper_media END AS duplicate_of,
         CASE WHEN s.media_path = g.keeper_path THEN 'best_candidate' ELSE 'phash' END AS dedup_reason,
         '{ROOT}/__DUPLICATE_GROUPS__/' || g.dedup_group_id || '/' || {basename('s.media_path')} AS visual_review_path
  FROM {name}_sc s JOIN {name}_g g ON s.kind = g.kind AND s.fp = g.fp)"""


def apply_sql(src: str, verdicts: str, name: str) -> str:
    cols = ["dedup_group_id", "delete_flag", "duplicate_of", "dedup_reason", "visual_review_path"]
    sets = ", ".join(f"CASE WHEN v.media_path IS NOT NULL THEN v.{c} ELSE m.{c} END AS {c}" for c in cols)
    return f""",
{name} AS (
  SELECT m.* EXCLUDE ({', '.join(cols)}), {sets}
  FROM {src} m LEFT JOIN {verdicts} v ON m.media_path = v.media_path)"""


DEDUPED = (FP_MANIFEST + """,
fpm0 AS (SELECT *, '' AS dedup_group_id, '' AS delete_flag, '' AS duplicate_of, '' AS dedup_reason,
                '' AS visual_review_path FROM fpm)""" + dedup_sql("fpm0", "phash", "d1")
           + apply_sql("fpm0", "d1_v", "deduped"))


STALE = DEDUPED + f""",
del1 AS (
  SELECT *, CASE WHEN {flag_is('delete_flag', 'true')} THEN
              CASE WHEN media_path <> '' AND media_path IN (SELECT path FROM inventory_now)
                   THEN 'deleted' ELSE 'not_deleted' END ELSE '' END AS deletion_status
  FROM deduped),
live1 AS (SELECT * FROM del1 WHERE NOT {flag_is('deletion_status', 'deleted')})""" + \
    dedup_sql("live1", "phash", "d2") + apply_sql("del1", "d2_v", "stale")


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["pair_sidecars"] = BASE + """
SELECT json_path, json_name, media_path, media_name, year_folder FROM pairs"""
    out["manifest_build"] = BASE + "\nSELECT * FROM manifest"
    out["dedup_verdicts"] = BASE + DEDUPED + """
SELECT row_id, media_path, dedup_group_id, delete_flag, duplicate_of, dedup_reason, visual_review_path
FROM deduped WHERE dedup_group_id <> ''"""
    out["dedup_groups"] = BASE + FP_MANIFEST + """,
fpm0 AS (SELECT * FROM fpm)""" + dedup_sql("fpm0", "phash", "d1") + """
SELECT g.dedup_group_id, s.n_members, s.group_first AS first_row_id, g.keeper_path, g.keeper_media
FROM d1_g g JOIN d1_sc s ON g.kind = s.kind AND g.fp = s.fp AND s.pref = 1"""
    out["dedup_last_row_per_path"] = BASE + FP_MANIFEST + """,
rescanned AS (SELECT * FROM fpm UNION ALL
         SELECT * REPLACE (row_id + (SELECT max(row_id) FROM fpm) AS row_id, '' AS json_filename) FROM fpm WHERE row_type = 'matched')""" + \
        dedup_sql("rescanned", "phash", "d1") + """
SELECT p.media_path, p.first_row_id, c.row_id AS last_row_id, p.original_media, p.json_filename
FROM d1_pp p JOIN (SELECT kind, fp, media_path, max(row_id) AS row_id FROM d1_c2 GROUP BY ALL) c
  ON p.kind = c.kind AND p.fp = c.fp AND p.media_path = c.media_path"""
    gid = "trim(coalesce(dedup_group_id, ''))"
    out["dedup_multi_keeper"] = BASE + STALE + f"""
SELECT {gid} AS dedup_group_id, count(*) FILTER (WHERE trim(dedup_reason) = 'best_candidate') AS n_best,
       count(*) AS n_rows
FROM stale WHERE {gid} <> '' GROUP BY 1 HAVING n_best > 1"""
    out["dedup_fix_groups"] = BASE + STALE + f""",
grp AS (SELECT *, {gid} AS gid FROM stale WHERE {gid} <> ''),
multi AS (SELECT gid FROM grp GROUP BY gid HAVING count(*) FILTER (WHERE trim(dedup_reason) = 'best_candidate') > 1),
ranked AS (
  SELECT grp.*, row_number() OVER (PARTITION BY grp.gid ORDER BY {blank('json_filename')},
           {unclean("lower(coalesce(original_media, ''))")}, length(lower(coalesce(original_media, ''))), row_id) AS pref
  FROM grp JOIN multi ON grp.gid = multi.gid),
best AS (SELECT gid, row_id AS best_row, trim(coalesce(original_media, '')) AS best_media FROM ranked WHERE pref = 1)
SELECT r.row_id, r.dedup_group_id,
       CASE WHEN r.row_id = b.best_row THEN 'FALSE' ELSE 'TRUE' END AS delete_flag,
       CASE WHEN r.row_id = b.best_row THEN 'best_candidate' ELSE 'phash' END AS dedup_reason,
       CASE WHEN r.row_id = b.best_row THEN '' ELSE b.best_media END AS duplicate_of
FROM ranked r JOIN best b ON r.gid = b.gid"""
    out["dedup_verify_issues"] = BASE + STALE + f""",
g AS (
  SELECT {gid} AS dedup_group_id,
         count(*) FILTER (WHERE {flag_is('delete_flag', 'false')}) AS n_keepers,
         count(*) FILTER (WHERE {flag_is('delete_flag', 'true')}) AS n_duplicates,
         count(*) AS n_members
  FROM stale WHERE NOT {flag_is('deletion_status', 'deleted')} AND {gid} <> '' GROUP BY 1)
SELECT *, CAST(n_keepers <> 1 AS BIGINT) + CAST(n_members < 2 AS BIGINT) AS issues
FROM g WHERE n_keepers <> 1 OR n_members < 2"""
    out["dedup_deletion_plan"] = BASE + DEDUPED + f""",
fl AS (
  SELECT row_id, trim(media_path) AS ml, trim(json_path) AS jl, media_path, json_path,
         media_path <> '' AND trim(media_path) IN (SELECT path FROM inventory_now) AS dm,
         json_path <> '' AND trim(json_path) IN (SELECT path FROM inventory_now) AS dj
  FROM deduped WHERE {flag_is('delete_flag', 'true')})
SELECT row_id, 'delete' AS op, ml AS src, 'duplicate media' AS reason,
       CASE WHEN dm THEN 'deleted' ELSE 'not_deleted' END AS deletion_status FROM fl WHERE dm
UNION ALL
SELECT row_id, 'delete', jl, 'duplicate sidecar', CASE WHEN dm THEN 'deleted' ELSE 'not_deleted' END
FROM fl WHERE dj"""
    out["dedup_review_paths"] = BASE + DEDUPED + """
SELECT dedup_group_id, 'copy' AS op, media_path AS src, visual_review_path AS dst
FROM deduped WHERE dedup_group_id <> ''"""
    out["fingerprint_cache_misses"] = BASE + FP_MANIFEST + f"""
SELECT m.row_id, m.media_path,
       CASE WHEN {blank('m.content_sha1')} THEN 'no_hash'
            WHEN coalesce(m.hash_mtime, -1) <> f.mtime THEN 'mtime_changed' END AS reason
FROM fpm m JOIN inventory_now f ON trim(m.media_path) = f.path
WHERE {lower_suffix(basename('trim(m.media_path)'))} IN ('.jpg', '.jpeg', '.png', '.heic', '.mp4', '.mov', '.avi', '.mkv')
  AND ({blank('m.content_sha1')} OR coalesce(m.hash_mtime, -1) <> f.mtime)"""
    out.update(batch2())
    out.update(similarity_sql())
    rec = recovery_sql()
    out["fuzzy_recover"] = "WITH RECURSIVE" + rec[len("WITH"):] + "\nSELECT * FROM won"
    rj = lambda c: f"CASE WHEN starts_with({c}, '{ROOT}/__UNMATCHED_JSON__/') THEN '{ROOT}/' || regexp_extract(substr({c}, {len(ROOT + '/__UNMATCHED_JSON__/') + 1}), '^([^/]+)/(.+)$', 1) || '/Takeout/Google Photos/' || regexp_extract(substr({c}, {len(ROOT + '/__UNMATCHED_JSON__/') + 1}), '^([^/]+)/(.+)$', 2) END"
    rm = lambda c: f"CASE WHEN starts_with({c}, '{ROOT}/__UNMATCHED_MEDIA__/') THEN '{ROOT}/' || regexp_extract(substr({c}, {len(ROOT + '/__UNMATCHED_MEDIA__/') + 1}), '^([^/]+)/(.+)$', 1) || '/Takeout/Google Photos/' || regexp_extract(substr({c}, {len(ROOT + '/__UNMATCHED_MEDIA__/') + 1}), '^([^/]+)/(.+)$', 2) END"
    out["fuzzy_recover_rows"] = "WITH RECURSIVE" + rec[len("WITH"):] + f"""
SELECT q.row_id, 'matched' AS row_type, {basename('w.json_path')} AS json_filename, {rj('w.json_path')} AS json_path,
       {basename(rm('w.media_path'))} AS original_media, {rm('w.media_path')} AS media_path, 'Recovered match' AS notes
FROM quar q JOIN won w ON lower(q.row_type) = 'unmatched_media' AND q.media_path = w.media_path"""
    out.update(file_sql())
    out["intake_stream"] = out["archive_intake_plan"]
    out.update(plan_sql())
    out.update(option_sql())
    out.update(picture_sql())
    out["tag_csv_file"] = out["tag_csv"]
    out["pair_sidecars_same_archive"] = same_archive_sql()
    out["fingerprint_refresh"] = BASE + FP_MANIFEST + f""",
misses AS (SELECT DISTINCT media_path AS p FROM ({out["fingerprint_cache_misses"]}))
SELECT m.row_id, m.media_path, CASE WHEN p IS NULL THEN m.content_sha1 ELSE f.content_sha1 END AS content_sha1,
       CASE WHEN p IS NULL THEN m.phash64 ELSE f.phash64 END AS phash64,
       CASE WHEN p IS NULL THEN m.hash_mtime ELSE f.mtime END AS hash_mtime, 1 AS version
FROM fpm m LEFT JOIN misses ON m.media_path = p LEFT JOIN inventory_now f ON f.path = p"""
    out["audit_events"] = f"""
WITH ev AS (
  SELECT 'verify' AS stage, 'missing path' AS event, row_id, column_name, path, '' AS detail FROM ({out["invalid_paths"]})
  UNION ALL
  SELECT 'prune', 'row removed', row_id, '', media_path, json_path FROM ({out["prune_missing"]})
  UNION ALL
  SELECT 'clear', 'cell cleared', row_id, column_name, '', old_value FROM ({out["clear_column"]})
  UNION ALL
  SELECT 'quarantine', 'path updated', row_id, '', media_path, notes FROM ({out["quarantine_paths"]}))
SELECT 'r1' AS run, * FROM ev UNION ALL SELECT 'r2', * FROM ev"""
    out["quarantine_move_plan"] = quarantine_move_sql()
    out["type_from_magic"] = type_from_magic_sql()
    out["unmatched_sidecars"] = BASE + """
SELECT row_id, json_filename, json_path, notes FROM manifest WHERE row_type = 'unmatched_json'"""
    out["unmatched_media"] = BASE + """
SELECT row_id, original_media, media_path, new_ext, notes FROM manifest WHERE row_type = 'unmatched_media'"""
    out["dedup_groups_exact"] = BASE + FP_MANIFEST + """,
fpm0 AS (SELECT * FROM fpm)""" + dedup_sql("fpm0", "sha1", "d1") + """
SELECT g.dedup_group_id, s.n_members, s.group_first AS first_row_id, g.keeper_path, g.keeper_media
FROM d1_g g JOIN d1_sc s ON g.kind = s.kind AND g.fp = s.fp AND s.pref = 1"""
    out["format_times"] = f"""
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp_unix,
       {fmt_time("CAST(floor(epoch(ts)) AS BIGINT)")} AS formatted_time
FROM events"""
    out["zip_search"] = "WITH " + FIXTURE_CTES + "," + ARCHIVE_MEMBERS + f"""
SELECT path AS found, 'file' AS kind FROM media_files WHERE instr(lower({basename('path')}), 'img_0001') > 0
UNION ALL
SELECT zip_path || ' ▶ ' || member, 'archive_member' FROM archive_members WHERE instr(lower(member), 'img_0001') > 0"""
    gid = "trim(coalesce(dedup_group_id, ''))"
    out["dedup_guardrail_pairs"] = BASE + STALE + f""",
g AS (SELECT *, {gid} AS gid FROM stale WHERE {gid} <> ''),
k AS (SELECT gid, min(media_path) AS keeper_path FROM g WHERE {flag_is('delete_flag', 'false')}
      GROUP BY gid HAVING count(*) = 1)
SELECT g.gid AS dedup_group_id, k.keeper_path, g.media_path AS copy_path, g.row_id AS copy_row_id
FROM g JOIN k ON g.gid = k.gid WHERE {flag_is('g.delete_flag', 'true')}"""
    return out


DEDUPED_COLUMNS = ["row_id", "row_type", "json_filename", "json_path", "original_media", "media_path",
                   "corrected_path", "timestamp_unix", "formatted_time", "new_ext", "action_taken", "notes",
                   "content_sha1", "phash64", "hash_mtime", "dedup_group_id", "delete_flag",
                   "duplicate_of", "dedup_reason", "visual_review_path"]


def _renamed(jpath: str, jname: str, media: str) -> tuple[str, str]:
    sfx = f"regexp_extract({jname}, '^(.+?\\.[^.]+)(\\..+?\\.json)$', 2)"
    new_fn = f"(CASE WHEN {sfx} <> '' THEN {media} || {sfx} ELSE {jname} END)"
    changed = f"({new_fn} <> {jname} AND {jname} <> '')"
    return (f"(CASE WHEN {changed} THEN {new_fn} ELSE {jname} END)",
            f"(CASE WHEN {changed} THEN concat_ws('/', {parent(jpath)}, {new_fn}) ELSE {jpath} END)")


CONVERSION = f""",
cv0 AS (
  SELECT d.*, h.header_hex AS hdr FROM deduped d
  LEFT JOIN (SELECT path, header_hex FROM inventory_now WHERE origin = 'media') h ON d.media_path = h.path),
cv1 AS (
  SELECT *, coalesce(media_path, '') AS media0, {basename("coalesce(media_path, '')")} AS name0,
         upper(hdr) AS h
  FROM cv0),
cv2 AS (
  SELECT *, {lower_suffix('name0')} AS old_ext,
         starts_with(h, 'FFD8FF') AS is_jpeg,
         substr(h, 9, 8) = '66747970' AND len(list_filter(range(0, 11), lambda i: substr(h, i * 2 + 1, 4) = '7174')) > 0 AS is_mov
  FROM cv1),
cv3 AS (
  SELECT *, CASE WHEN is_jpeg AND old_ext <> '.jpg' THEN '.jpg' WHEN is_mov AND old_ext <> '.mov' THEN '.mov' END AS fixed_ext
  FROM cv2),
cv4 AS (
  SELECT *, coalesce(media0 <> '' AND fixed_ext IS NOT NULL, false) AS fix FROM cv3),
cv5 AS (
  SELECT *, CASE WHEN fix THEN {stem('name0')} || '_' || regexp_replace(old_ext, '^\\.', '') || '_conv' || fixed_ext ELSE name0 END AS name1
  FROM cv4),
cv6 AS (
  SELECT *, CASE WHEN fix THEN {append_hist('action_taken', "'Renamed ' || name0 || ' → ' || name1")} ELSE action_taken END AS act1,
         CASE WHEN fix THEN fixed_ext ELSE new_ext END AS ext1,
         {lower_suffix('name1')} AS e1
  FROM cv5),
cv7 AS (
  SELECT *, media0 <> '' AND e1 IN ('.png', '.heic', '.dng', '.tif', '.tiff', '.gif') AS conv,
         CASE WHEN e1 IN ('.png', '.heic', '.dng') THEN regexp_replace(e1, '^\\.', '')
              ELSE regexp_replace({suffix('name1')}, '^\\.', '') END AS tag
  FROM cv6),
cv8 AS (
  SELECT *, CASE WHEN conv THEN {stem('name1')} || '_' || tag || '_conv.jpg' ELSE name1 END AS name2 FROM cv7),
cv9 AS (
  SELECT *, CASE WHEN conv THEN {append_hist('act1', "'Converted → ' || name2")} ELSE act1 END AS act2,
         CASE WHEN conv THEN '.jpg' ELSE ext1 END AS ext2,
         fix OR conv AS moved, coalesce(json_path, '') AS jp0, {basename("coalesce(json_path, '')")} AS jname0
  FROM cv8),
cv10 AS (
  SELECT *, CASE WHEN moved AND jp0 <> '' THEN {_renamed('jp0', 'jname0', 'name2')[0]} ELSE json_filename END AS jn2,
         CASE WHEN moved THEN {_renamed('jp0', 'jname0', 'name2')[1]} ELSE json_path END AS jp2,
         {lower_suffix('name2')} AS e2
  FROM cv9),
cv11 AS (
  SELECT *, media0 <> '' AND e2 IN ('.avi', '.mpg', '.mpeg', '.mts', '.3gp') AS vid,
         regexp_replace(e2, '^\\.', '') AS vtag, coalesce(jp2, '') AS jp2c, {basename("coalesce(jp2, '')")} AS jname2
  FROM cv10),
cv12 AS (
  SELECT *, CASE WHEN vid THEN {stem('name2')} || '_' || vtag || '_conv.mp4' ELSE name2 END AS name3 FROM cv11),
cv13 AS (
  SELECT *, CASE WHEN vid THEN {append_hist('act2', "'Converted .' || vtag || ' → .mp4'")} ELSE act2 END AS act3,
         CASE WHEN vid THEN '.mp4' ELSE ext2 END AS ext3,
         CASE WHEN vid AND jp2c <> '' THEN {_renamed('jp2c', 'jname2', 'name3')[0]} ELSE jn2 END AS jn3,
         CASE WHEN vid THEN {_renamed('jp2c', 'jname2', 'name3')[1]} ELSE jp2 END AS jp3
  FROM cv12),
changes AS (
  SELECT row_id, concat_ws('/', {parent('media0')}, name3) AS media_path,
         concat_ws('/', {parent('media0')}, name3) AS corrected_path, ext3 AS new_ext,
         jn3 AS json_filename, jp3 AS json_path, act3 AS action_taken
  FROM cv13 WHERE fix OR conv OR vid)"""


def recovery_sql() -> str:
    """Sequential serial dictatorship as a recursive CTE: sidecar i (path
    order) takes its first candidate media not taken by sidecars 1..i-1."""
    jkey = "regexp_replace(regexp_replace(lower(" + basename("path") + "), '\\.+json$', ''), '[^a-zA-Z0-9]', '', 'g')"
    mkey = "regexp_replace(lower(" + stem(basename("path")) + "), '[^a-zA-Z0-9]', '', 'g')"
    return BASE + quarantine_ctes() + f""",
qfiles AS (
  SELECT media_path AS path FROM quar WHERE row_type = 'unmatched_media'
  UNION ALL SELECT json_path FROM quar WHERE row_type = 'unmatched_json'),
jj AS (
  SELECT row_number() OVER (ORDER BY path) AS i, path, {jkey} AS k FROM qfiles
  WHERE starts_with(path, '{ROOT}/__UNMATCHED_JSON__/') AND ends_with(lower(path), '.json')),
mm AS (
  SELECT row_number() OVER (ORDER BY path) AS o, path, {mkey} AS k FROM qfiles
  WHERE starts_with(path, '{ROOT}/__UNMATCHED_MEDIA__/')),
cand AS (
  SELECT jj.i, mm.o FROM jj JOIN mm ON jj.k <> '' AND mm.k <> ''
    AND (jj.k = mm.k OR contains(jj.k, mm.k) OR contains(mm.k, jj.k))),
r AS (
  SELECT 0 AS i, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS pick
  UNION ALL
  SELECT r.i + 1,
         CASE WHEN p.o IS NULL THEN r.taken ELSE list_append(r.taken, p.o) END,
         p.o
  FROM r LEFT JOIN LATERAL (
      SELECT min(c.o) AS o FROM cand c WHERE c.i = r.i + 1 AND NOT list_contains(r.taken, c.o)) p ON true
  WHERE r.i < (SELECT coalesce(max(i), 0) FROM jj)),
won AS (SELECT jj.path AS json_path, mm.path AS media_path FROM r JOIN jj ON jj.i = r.i JOIN mm ON mm.o = r.pick)"""


def quarantine_ctes() -> str:
    """CTE ``quar``: the manifest after its unmatched rows were pointed at quarantine."""
    mroot, jroot = f"{ROOT}/__UNMATCHED_MEDIA__", f"{ROOT}/__UNMATCHED_JSON__"
    def newcol(c, cond, root):
        old = strip(f"coalesce({c}, '')")
        return (f"CASE WHEN {cond} AND {quarantine(old, root)} IS NOT NULL AND {quarantine(old, root)} <> {old} "
                f"THEN {quarantine(old, root)} END")
    rt = "lower(coalesce(row_type, ''))"
    return f""",
qa AS (
  SELECT *, {newcol('media_path', f"contains({rt}, 'unmatched_media')", mroot)} AS n_media,
            {newcol('corrected_path', f"contains({rt}, 'unmatched_media')", mroot)} AS n_corr,
            {newcol('json_path', f"contains({rt}, 'unmatched_json')", jroot)} AS n_json
  FROM manifest),
qb AS (
  SELECT *, concat_ws('; ', CASE WHEN n_media IS NOT NULL THEN 'media_path updated to ' || n_media END,
                            CASE WHEN n_corr IS NOT NULL THEN 'corrected_path updated to ' || n_corr END,
                            CASE WHEN n_json IS NOT NULL THEN 'json_path updated to ' || n_json END) AS joined
  FROM qa),
quar AS (
  SELECT row_id, row_type, coalesce(n_media, media_path) AS media_path, coalesce(n_corr, corrected_path) AS corrected_path,
         coalesce(n_json, json_path) AS json_path,
         CASE WHEN joined <> '' THEN regexp_replace(coalesce(trim(notes), '') || '; ' || joined, '^[; ]+|[; ]+$', '', 'g')
              ELSE notes END AS notes,
         joined <> '' AS changed
  FROM qb)"""


def batch2() -> dict[str, str]:
    out: dict[str, str] = {}
    F = "WITH " + FIXTURE_CTES
    out["timestamps_from_json"] = F + f"""
SELECT path, {json_ts('content')} AS timestamp_unix, {fmt_time(json_ts('content'))} AS formatted_time
FROM sidecar_files"""
    out["backfill_timestamps"] = BASE + f""",
sc_now AS (SELECT path, content FROM inventory_now WHERE origin = 'sidecar')
SELECT m.row_id, {json_ts('s.content')} AS timestamp_unix, {fmt_time(json_ts('s.content'))} AS formatted_time,
       CASE WHEN {strip('m.media_path')} <> '' THEN {lower_suffix(basename(strip('m.media_path')))} ELSE '' END AS new_ext
FROM manifest m JOIN sc_now s ON {strip("coalesce(m.json_path, '')")} = s.path
WHERE lower(trim(coalesce(m.row_type, ''))) = 'matched' AND {json_ts('s.content')} <> 0"""
    jpeg = f"{lower_suffix(basename("coalesce(media_path, '')"))} IN ('.jpg', '.jpeg')"
    t = "coalesce(formatted_time, '')"
    out["tag_csv"] = BASE + f"""
SELECT coalesce(media_path, '') AS SourceFile,
       CASE WHEN {jpeg} THEN {t} ELSE '' END AS DateTimeOriginal,
       CASE WHEN {jpeg} THEN {t} ELSE '' END AS CreateDate,
       CASE WHEN {jpeg} THEN {t} ELSE '' END AS ModifyDate,
       CASE WHEN {jpeg} THEN '' ELSE {t} END AS MediaCreateDate,
       CASE WHEN {jpeg} THEN '' ELSE {t} END AS TrackCreateDate
FROM manifest"""
    ext = "CASE WHEN starts_with(lower(trim(new_ext)), '.') THEN lower(trim(new_ext)) ELSE '.' || lower(trim(new_ext)) END"
    cls = ("CASE WHEN ext IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.tif', '.webp', '.raw', '.heic', '.heif', '.jfif') "
           "THEN 'photo' WHEN ext IN ('.mp4', '.avi', '.mov', '.wmv', '.flv', '.mkv', '.webm', '.m4v', '.3gp', '.mpg', '.mpeg', '.mts') "
           "THEN 'video' ELSE 'other' END")
    ft = f""",
ft AS (SELECT {ext} AS ext, count(*) AS n_rows FROM manifest WHERE NOT {blank('new_ext')} GROUP BY 1),
ftc AS (SELECT ext, n_rows, {cls} AS file_class FROM ft)"""
    out["file_types"] = BASE + ft + "\nSELECT * FROM ftc"
    out["file_type_lists"] = BASE + ft + """
SELECT file_class, string_agg(ext, ', ' ORDER BY ext) AS extensions, count(*) AS n_extensions
FROM ftc GROUP BY file_class"""
    out["remove_rows"] = BASE + """
SELECT row_id, row_type, json_path FROM manifest WHERE lower(trim(coalesce(row_type, ''))) = 'unmatched_json'"""
    out["clear_column"] = BASE + f"""
SELECT row_id, 'notes' AS column_name, notes AS old_value FROM manifest WHERE NOT {blank('notes')}"""
    ex = "(SELECT path FROM inventory_now)"
    out["prune_missing"] = BASE + f"""
SELECT row_id, media_path, json_path FROM manifest
WHERE NOT {blank('media_path')} AND NOT {blank('json_path')}
  AND NOT ({strip('media_path')} IN {ex} AND {strip('json_path')} IN {ex})"""
    out["invalid_paths"] = BASE + f""",
live AS (SELECT * FROM manifest WHERE NOT contains(lower(coalesce(row_type, '')), 'unmatched')),
long AS (
  SELECT row_id, 'json_path' AS column_name, {strip('json_path')} AS path FROM live UNION ALL
  SELECT row_id, 'media_path', {strip('media_path')} FROM live UNION ALL
  SELECT row_id, 'corrected_path', {strip('corrected_path')} FROM live)
SELECT * FROM long WHERE path <> '' AND path NOT IN {ex}"""
    win = """,
win AS (
  SELECT row_id,
         CASE WHEN media_path <> '' THEN 'C:' || replace(media_path, '/', '\\') ELSE media_path END AS media_path,
         CASE WHEN json_path <> '' THEN ' D:' || replace(json_path, '/', '\\') || ' ' ELSE json_path END AS json_path,
         corrected_path
  FROM manifest)"""
    parts = " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS column_name, {c} AS old_value, {to_wsl(c)} AS new_value FROM win"
        for c in ["media_path", "json_path", "corrected_path"])
    out["windows_to_posix"] = BASE + win + f"""
SELECT * FROM ({parts}) WHERE old_value IS DISTINCT FROM new_value"""
    mroot, jroot = f"{ROOT}/__UNMATCHED_MEDIA__", f"{ROOT}/__UNMATCHED_JSON__"
    quar = quarantine_ctes()
    out["quarantine_paths"] = BASE + quar + """
SELECT row_id, media_path, corrected_path, json_path, notes FROM quar WHERE changed"""
    def restore(src, qroot):
        rel = f"substr({src}, {len(qroot) + 2})"
        a = f"regexp_extract({rel}, '^([^/]+)/(.+)$', 1)"
        r = f"regexp_extract({rel}, '^([^/]+)/(.+)$', 2)"
        dst = f"CASE WHEN {a} <> '' THEN '{ROOT}/' || {a} || '/Takeout/Google Photos/' || {r} END"
        return (f"SELECT CASE WHEN ({dst}) IS NOT NULL THEN 'move' ELSE 'skip' END AS op, {src} AS src, "
                f"coalesce({dst}, '') AS dst, CASE WHEN ({dst}) IS NOT NULL THEN 'restore' ELSE 'unexpected structure' END AS reason")
    out["restore_paths"] = BASE + quar + f"""
{restore('media_path', mroot)} FROM quar WHERE row_type = 'unmatched_media' AND starts_with(media_path, '{mroot}/')
UNION ALL
{restore('json_path', jroot)} FROM quar WHERE row_type = 'unmatched_json' AND starts_with(json_path, '{jroot}/')"""
    out["conversion_plan"] = BASE + DEDUPED + CONVERSION + "\nSELECT * FROM changes"
    cells = " OR ".join(f"regexp_matches(coalesce(CAST({c} AS VARCHAR), ''), '(?i)_conv.\\b')"
                        for c in DEDUPED_COLUMNS)
    out["row_regex_count"] = BASE + DEDUPED + CONVERSION + f""",
applied AS (
  SELECT d.* REPLACE (coalesce(c.media_path, d.media_path) AS media_path,
                      coalesce(c.corrected_path, d.corrected_path) AS corrected_path,
                      CASE WHEN c.row_id IS NOT NULL THEN c.new_ext ELSE d.new_ext END AS new_ext,
                      CASE WHEN c.row_id IS NOT NULL THEN c.json_filename ELSE d.json_filename END AS json_filename,
                      CASE WHEN c.row_id IS NOT NULL THEN c.json_path ELSE d.json_path END AS json_path,
                      CASE WHEN c.row_id IS NOT NULL THEN c.action_taken ELSE d.action_taken END AS action_taken)
  FROM deduped d LEFT JOIN changes c ON d.row_id = c.row_id)
SELECT count(*) AS n_rows FROM applied WHERE {cells}"""
    sample = ", ".join(q(e) for e in [".jpg", ".gif", ".png", ".heic", ".jpeg", ".tif", ".webp", ".jfif", ".tiff",
                                       ".3gp", ".avi", ".mpg", ".mov", ".mp4", ".mts", ".thm", ".dng", ".nef"])
    out["sample_per_extension"] = BASE + f""",
s AS (SELECT *, {lower_suffix(basename("coalesce(media_path, '')"))} AS ext FROM manifest),
f AS (SELECT ext, min(row_id) AS row_id FROM s WHERE ext IN ({sample}) GROUP BY ext)
SELECT s.ext, s.row_id, s.media_path FROM s JOIN f ON s.ext = f.ext AND s.row_id = f.row_id
WHERE s.media_path IN {ex} AND ({blank('s.json_path')} OR s.json_path IN {ex})"""
    out["archive_intake_plan"] = "WITH " + DOWNLOADS + f""",
z AS (SELECT path, {basename('path')} AS name, {parent('path')} AS dir FROM downloads),
n AS (SELECT *, regexp_extract(name, '-(\\d{{3}})\\.zip$', 1) AS num FROM z
      WHERE {lower_suffix('name')} = '.zip' AND NOT starts_with(name, 'Z')),
s AS (SELECT *, concat_ws('/', dir, 'Z' || num || '.zip') AS std FROM n),
t AS (SELECT s.*, s.std IN (SELECT path FROM z) OR name <> min(name) OVER (PARTITION BY std) AS taken FROM s)
SELECT name, 'extract' AS op, '{ROOT}/Z' || num AS dst, 'new archive' AS reason FROM t WHERE num <> ''
UNION ALL
SELECT name, CASE WHEN taken THEN 'keep_name' ELSE 'rename' END, std,
       CASE WHEN taken THEN 'target exists' ELSE 'standard name' END FROM t WHERE num <> ''
UNION ALL
SELECT name, 'skip', '', 'no archive number' FROM t WHERE num = ''"""
    out["search_names"] = F + "," + ARCHIVE_MEMBERS + f"""
SELECT path AS found, 'file' AS kind FROM inventory WHERE instr(lower({basename('path')}), 'img_0001') > 0
UNION ALL
SELECT zip_path || ' ▶ ' || member, 'archive_member' FROM archive_members WHERE instr(lower(member), 'img_0001') > 0"""
    pat = "takeout/google photos/photos from 2012/img_00012.jpg"
    out["search_names_exact"] = F + "," + ARCHIVE_MEMBERS + f"""
SELECT path AS found, 'file' AS kind FROM inventory WHERE lower({basename('path')}) = '{pat}'
UNION ALL
SELECT zip_path || ' ▶ ' || member, 'archive_member' FROM archive_members WHERE lower(member) = '{pat}'"""
    out["stage_stats"] = stage_stats_sql()
    return out


# ---------------------------------------------------------------- similarity

UROOT = f"{ROOT}/__UNMATCHED_MEDIA__"
SIM_ROOT = f"{ROOT}/__SIM__"

SIMILARITY = f"""WITH
e AS (
  SELECT vec_id, label,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0
              THEN CASE WHEN i = 64 THEN (-9223372036854775808)::HUGEINT ELSE (1::BIGINT << (i - 1)::INT)::HUGEINT END ELSE 0 END)) AS BIGINT) AS fp
  FROM embeddings),
cand AS (
  SELECT vec_id AS c_order,
         '{ROOT}/Z' || printf('%03d', vec_id % 3 + 1) || '/Takeout/Google Photos/Photos from ' || CAST(2010 + label AS VARCHAR)
           || '/IMG_V' || printf('%05d', vec_id) || CASE WHEN vec_id % 10 = 7 THEN '.mp4' ELSE '.jpg' END AS c_path,
         fp AS c_hash, vec_id % 10 = 7 AS is_video, 'Photos from ' || CAST(2010 + label AS VARCHAR) AS c_year,
         strftime(epoch_ms((1262304000 + vec_id * 3600) * 1000), '%Y:%m:%d %H:%M:%S') AS c_time
  FROM e WHERE vec_id % 4 <> 0),
quar AS (
  SELECT u.vec_id,
         '{UROOT}/Z' || printf('%03d', u.vec_id % 3 + 1) ||
           CASE WHEN u.vec_id % 20 = 0 THEN ''
                WHEN u.vec_id % 36 = 8 THEN '/_review/Photos from ' || CAST(2010 + s.label AS VARCHAR)
                ELSE '/Photos from ' || CAST(2010 + s.label AS VARCHAR) END
           || '/IMG_U' || printf('%05d', u.vec_id) || '.jpg' AS u_path,
         xor(s.fp, (1::BIGINT << CAST((u.vec_id // 4) % 14 AS INTEGER)) - 1) AS u_hash,
         CASE WHEN u.vec_id % 20 = 0 THEN '' ELSE 'Photos from ' || CAST(2010 + s.label AS VARCHAR) END AS u_year,
         u.vec_id % 20 <> 0 AND u.vec_id % 36 = 8 AS masked
  FROM e u JOIN e s ON s.vec_id = u.vec_id + 1
  WHERE u.vec_id % 4 = 0)"""


def near_sql(t: int, year_only: bool = False) -> str:
    extra = ("AND q.u_year <> '' AND regexp_matches(c.c_path, '^/data/Processing/[Zz][^/]*/Takeout/Google Photos/'"
             " || c.c_year || '/')") if year_only else ""
    return SIMILARITY + f""",
near AS (
  SELECT q.u_path AS unmatched, c.c_path AS match, bit_count(xor(q.u_hash, c.c_hash)) AS distance,
         c.c_order, c.c_time
  FROM quar q, cand c
  WHERE NOT q.masked AND NOT c.is_video AND bit_count(xor(q.u_hash, c.c_hash)) <= {t}
    AND (q.u_year = '' OR q.u_year = c.c_year) {extra}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unmatched ORDER BY distance, c_order, match) AS rank FROM near)"""


def similarity_sql() -> dict[str, str]:
    out = {}
    out["hamming_nearest"] = near_sql(10) + """
SELECT unmatched, match, CAST(distance AS BIGINT) AS distance FROM ranked WHERE rank = 1"""
    out["hamming_nearest_8bands"] = out["hamming_nearest"]
    out["hamming_nearest_year_only"] = near_sql(10, year_only=True) + """
SELECT unmatched, match, CAST(distance AS BIGINT) AS distance FROM ranked WHERE rank = 1"""
    out["hamming_top5"] = near_sql(64) + """
SELECT unmatched, match, CAST(distance AS BIGINT) AS distance, rank FROM ranked WHERE rank <= 5"""
    rel = f"substr(unmatched, {len(UROOT) + 2})"
    name = basename(rel)
    out["reconcile_actions"] = near_sql(10) + f""",
b AS (SELECT *, {rel} AS rel FROM ranked WHERE rank = 1)
SELECT unmatched, match, CASE WHEN distance = 0 THEN 'delete' ELSE 'move' END AS op,
       CASE WHEN distance = 0 THEN '' ELSE concat_ws('/', '{SIM_ROOT}', CASE WHEN {parent('rel')} <> '' THEN {parent('rel')} END,
            {stem(basename('rel'))} || '_sim' || {suffix(basename('rel'))}) END AS dest,
       CASE WHEN distance > 0 AND {lower_suffix(basename('match'))} IN ('.jpg', '.jpeg', '.png', '.heic') AND c_time <> ''
            THEN c_time END AS timestamp,
       CAST(distance AS BIGINT) AS distance
FROM b"""
    return out


def file_sql() -> dict[str, str]:
    out = {}
    out["csv_roundtrip"] = BASE + "\nSELECT * FROM manifest"
    F_ = "WITH " + FIXTURE_CTES
    out["sidecar_scan"] = F_ + f"""
SELECT path, {json_ts('content')} AS timestamp_unix, {fmt_time(json_ts('content'))} AS formatted_time
FROM sidecar_files"""
    out["inventory_scan"] = F_ + """
SELECT path, CAST(strlen(content) AS BIGINT) AS length FROM sidecar_files
UNION ALL
SELECT m.path, CAST(12 + strlen(d.text) AS BIGINT) FROM media_files m JOIN documents d ON d.doc_id = m.file_id"""
    out["zip_listing"] = F_ + "," + ARCHIVE_MEMBERS + """
SELECT regexp_extract(zip_path, '/(Z[0-9]{3})\\.zip$', 1) AS archive, member, 'ok' AS status FROM archive_members
UNION ALL SELECT 'Z999', NULL, 'error'"""
    jpeg = f"{lower_suffix(basename('media_path'))} IN ('.jpg', '.jpeg')"
    out["tag_dump_pivot"] = BASE + f"""
SELECT media_path AS file,
       CASE WHEN {jpeg} THEN NULL ELSE formatted_time END AS track_create_date,
       CASE WHEN {jpeg} THEN NULL ELSE formatted_time END AS media_create_date,
       CASE WHEN {jpeg} THEN formatted_time END AS date_time_original
FROM manifest WHERE media_path <> '' AND coalesce(formatted_time, '') <> ''"""
    return out


def same_archive_sql() -> str:
    """Pairing inside each archive first, then of what is left; bare sidecars too."""
    return "WITH " + FIXTURE_CTES + "," + FILES + f""",
named AS (
  SELECT file_id, path, name, archive, year_folder, is_json,
         CASE WHEN NOT is_json THEN lower(name) ELSE lower(coalesce({expected_media('name')},
           CASE WHEN regexp_matches(lower(name), '^.+[.][^.]+[.]json$') THEN left(name, length(name) - 5) END)) END AS k
  FROM files),
home AS (
  SELECT *, row_number() OVER (PARTITION BY archive, year_folder, k, is_json ORDER BY name, file_id) AS rk,
         least(count(*) FILTER (is_json) OVER w, count(*) FILTER (NOT is_json) OVER w) AS room
  FROM named WHERE k IS NOT NULL WINDOW w AS (PARTITION BY archive, year_folder, k)),
tiers AS (
  SELECT path, name, year_folder, k, is_json, archive AS tier, rk FROM home WHERE rk <= room
  UNION ALL
  SELECT path, name, year_folder, k, is_json, '', row_number() OVER (PARTITION BY year_folder, k, is_json ORDER BY archive, name, file_id)
  FROM home WHERE rk > room)
SELECT j.path AS json_path, j.name AS json_name, m.path AS media_path, m.name AS media_name, year_folder
FROM tiers j JOIN tiers m USING (year_folder, k, tier, rk) WHERE j.is_json AND NOT m.is_json"""


def picture_sql() -> dict[str, str]:
    """The pixel queries from the block pictures' definition (64 components:
    8 x 8 blocks): SHA-1 over the pixel bytes, the 8 x 8 low DCT coefficients as
    sums over blocks, pixel differences block by block."""
    scale = "(x - list_min({v})) / (list_max({v}) - list_min({v}) + 1e-12) * 200 + 20"
    pic = lambda v: f"list_transform({v}, lambda x: {scale.format(v=v)})"      # noqa: E731
    base = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
both_e AS (SELECT e.vec_id, e.v, coalesce(n.v, list_reverse(e.v)) AS nv FROM e LEFT JOIN e n ON n.vec_id = e.vec_id + 1),
f AS (SELECT vec_id, {pic("v")} AS a, {pic("nv")} AS n FROM both_e),
pics AS (
  SELECT 2 * vec_id AS id, 'orig/v' || printf('%05d', vec_id) || '.png' AS file, 8 AS px,
         list_transform(a, lambda x: trunc(x)::INTEGER) AS b FROM f
  UNION ALL
  SELECT 2 * vec_id + 1, 'copy/v' || printf('%05d', vec_id) || '.png', CASE WHEN vec_id % 3 = 1 THEN 12 ELSE 8 END,
         CASE vec_id % 3 WHEN 0 THEN list_transform(a, lambda x: trunc(least(x + 6, 255))::INTEGER)
                         WHEN 1 THEN list_transform(a, lambda x: trunc(x)::INTEGER)
                         ELSE list_transform(n, lambda x: trunc(x)::INTEGER) END FROM f),
side AS (SELECT unnest(range(8)) AS r),
g AS (SELECT u.r AS u, p.r, list_sum(list_transform(range(4 * p.r, 4 * p.r + 4), lambda i: 2 * cos(pi() * (2 * i + 1) * u.r / 64))) AS w
      FROM side u, side p),
cells AS (SELECT id, k // 8 AS r, k % 8 AS c, b[k + 1] AS x FROM pics, range(64) t(k)),
coef AS (SELECT id, gu.u AS u, gv.u AS v, sum(x * gu.w * gv.w) AS f FROM cells JOIN g gu ON gu.r = cells.r JOIN g gv ON gv.r = cells.c
         GROUP BY id, gu.u, gv.u),
bits AS (SELECT id, 8 * u + v AS k, (f > median(f) OVER (PARTITION BY id))::INTEGER AS bit FROM coef),
hashes AS (SELECT id, string_agg(printf('%x', nib), '' ORDER BY j) AS h
           FROM (SELECT id, k // 4 AS j, sum(bit << (3 - k % 4)::INTEGER)::INTEGER AS nib FROM bits GROUP BY id, k // 4) GROUP BY id)"""
    checked = base + """,
pairs AS (SELECT c.id, c.file, list_sum(list_transform(range(1, 65), lambda i: abs(a.b[i] - c.b[i]))) / 64.0 AS diff
          FROM pics a JOIN pics c ON c.id = a.id + 1 AND a.id % 2 = 0),
far AS (SELECT c.id AS id, sum((a.bit <> c.bit)::INTEGER)::BIGINT AS distance
        FROM bits a JOIN bits c ON c.id = a.id + 1 AND a.id % 2 = 0 AND a.k = c.k GROUP BY c.id)"""
    out = {"image_phash": base + "\nSELECT file, h AS phash64 FROM pics JOIN hashes USING (id)"}
    line = "list_aggregate(list_transform(range(8), lambda c: repeat(printf('%02x', b[8 * r + c + 1]), 3 * px)), 'string_agg', '')"
    out["image_fingerprints"] = base + f""",
lines AS (SELECT id, string_agg(repeat({line}, px), '' ORDER BY r) AS bytes FROM pics, side GROUP BY id)
SELECT file, sha1(unhex(repeat(printf('%02x', 8 * px) || '000000', 2) || bytes)) AS content_sha1, h AS phash64
FROM pics JOIN hashes USING (id) JOIN lines USING (id)"""
    out["guardrail_pixels"] = checked + """
SELECT file, round(diff, 3) AS diff, distance AS hash_distance,
       CASE WHEN diff > 10 OR distance > 4 THEN 'guardrail_uncertain' ELSE 'keep_flag' END AS verdict
FROM pairs JOIN far USING (id)"""
    out["guardrail_first_pass"] = checked + """
SELECT file, round(diff, 3) AS diff, CASE WHEN diff > 3 THEN 'guardrail_uncertain' ELSE 'keep_flag' END AS verdict FROM pairs"""
    out["guardrail_writeback"] = base + """,
same AS (SELECT id, file, b, min(id) OVER (PARTITION BY h) AS keeper, count(*) OVER (PARTITION BY h) AS n FROM pics JOIN hashes USING (id)),
judged AS (SELECT s.id, s.file, s.id = s.keeper AS kept,
                  list_sum(list_transform(range(1, 65), lambda i: abs(a.b[i] - s.b[i]))) / 64.0 > 3 AS apart
           FROM same s JOIN pics a ON a.id = s.keeper WHERE s.n > 1)
SELECT id AS row_id, '/data/Pictures/' || file AS media_path, CASE WHEN kept OR apart THEN 'false' ELSE 'true' END AS delete_flag,
       CASE WHEN kept THEN 'best_candidate' WHEN apart THEN 'guardrail_uncertain' ELSE 'phash' END AS dedup_reason
FROM judged"""
    return out


def plan_sql() -> dict[str, str]:
    out = {}
    gp = f"'{ROOT}/Z' || printf('%03d', doc_id % 3 + 1) || '/Takeout/Google Photos'"
    out["photos_root_prune"] = "WITH " + FIXTURE_CTES + f""",
listing AS (
  SELECT path FROM inventory
  UNION ALL SELECT {gp} || '/Album ' || CAST(doc_id % 4 AS VARCHAR) || '/IMG_A' || printf('%05d', doc_id) || '.jpg'
            FROM documents WHERE doc_id % 25 = 0
  UNION ALL SELECT {gp} || '/Trash/IMG_T' || printf('%05d', doc_id) || '.jpg' FROM documents WHERE doc_id % 40 = 0),
parts AS (SELECT string_split(regexp_replace(path, '^/', ''), '/') AS p FROM listing WHERE starts_with(path, '{ROOT}/')),
dirs AS (
  SELECT DISTINCT d AS depth, '/' || array_to_string(p[1:d], '/') AS dir
  FROM parts, unnest(generate_series(1, len(p) - 1)) AS g(d)),
dirs2 AS (
  SELECT *, {basename('dir')} AS name, {parent('dir')} AS parent,
         regexp_extract(dir, '^{ROOT}/([^/]+)', 1) AS archive
  FROM dirs),
years AS (SELECT * FROM dirs2 WHERE archive <> '' AND regexp_matches(trim(name), '^Photos from [0-9]{{4}}$')),
roots AS (SELECT archive, arg_min(parent, (depth, parent)) AS root FROM years GROUP BY archive)
SELECT d.archive, r.root, 'delete_tree' AS op, d.dir AS dst, 'non-year folder next to year folders' AS reason
FROM dirs2 d JOIN roots r ON d.archive = r.archive AND d.parent = r.root
WHERE NOT regexp_matches(trim(d.name), '^Photos from [0-9]{{4}}$')"""
    mroot = f"{ROOT}/__UNMATCHED_MEDIA__"
    rel = f"substr(media_path, {len(mroot) + 2})"
    a = f"regexp_extract({rel}, '^([^/]+)/(.+)$', 1)"
    r = f"regexp_extract({rel}, '^([^/]+)/(.+)$', 2)"
    out["restore_collision_plan"] = BASE + quarantine_ctes() + f""",
tgt AS (
  SELECT media_path AS src, '{ROOT}/' || {a} || '/Takeout/Google Photos/' || {r} AS dst
  FROM quar WHERE row_type = 'unmatched_media' AND starts_with(media_path, '{mroot}/') AND {a} <> ''),
alt AS (SELECT *, {parent('dst')} || '/' || {stem(basename('dst'))} || '_restored' || {suffix(basename('dst'))} AS dst1,
               {parent('dst')} || '/' || {stem(basename('dst'))} || '_restored_1' || {suffix(basename('dst'))} AS dst2 FROM tgt)
SELECT 'move' AS op, src,
       CASE WHEN dst NOT IN (SELECT path FROM inventory_now) THEN dst
            WHEN dst1 NOT IN (SELECT path FROM inventory_now) THEN dst1 ELSE dst2 END AS dst,
       CASE WHEN dst NOT IN (SELECT path FROM inventory_now) THEN 'restore' ELSE 'restore (target exists)' END AS reason
FROM alt"""
    return out


def option_sql() -> dict[str, str]:
    """Options of the back-fill and of deduplication, failed conversions, a widened header."""
    out = {}
    jp = strip("coalesce(m.json_path, '')")
    out["backfill_retry_zero"] = BASE + f""",
side AS (
  SELECT file_id, path, CASE WHEN {json_ts('content')} = 0 AND file_id % 2 = 0
           THEN '{{"photoTakenTime": {{"timestamp": "' || CAST(1262304000 + file_id * 86400 AS VARCHAR) || '"}}}}'
           ELSE content END AS content
  FROM inventory_now WHERE origin = 'sidecar'),
near AS (SELECT file_id, {parent('path')} || '/' || {stem(basename('path'))} AS p FROM side),
present AS (
  SELECT path FROM inventory_now
  UNION ALL SELECT p || '.MP4' FROM near WHERE file_id % 5 = 1
  UNION ALL SELECT p || '.A.jpg' FROM near WHERE file_id % 10 = 1),
others AS (SELECT path, {parent('path')} AS dir, {basename('path')} AS name FROM present
           WHERE lower({basename('path')}) NOT LIKE '%.json'),
todo AS (
  SELECT m.row_id, {jp} AS jp, {json_ts('s.content')} AS ts,
         CASE WHEN m.row_id % 3 <> 0 THEN m.media_path ELSE '' END AS media
  FROM manifest m JOIN side s ON {jp} = s.path
  WHERE m.row_type = 'matched' AND (m.row_id % 2 = 0 OR m.timestamp_unix IS NULL OR m.timestamp_unix = 0)),
sib AS (
  SELECT t.row_id, arg_min({lower_suffix('o.name')}, o.path) AS ext
  FROM todo t JOIN others o ON o.dir = {parent('t.jp')} AND starts_with(o.name, {stem(basename('t.jp'))} || '.')
  GROUP BY t.row_id)
SELECT t.row_id, t.ts AS timestamp_unix, {fmt_time('t.ts')} AS formatted_time,
       CASE WHEN t.media <> '' THEN {lower_suffix(basename('t.media'))} ELSE coalesce(sib.ext, '') END AS new_ext
FROM todo t LEFT JOIN sib ON t.row_id = sib.row_id WHERE t.ts <> 0"""
    failed = f"""
failed AS (
  SELECT path, {parent('path')} AS dir, {stem(basename('path'))} AS stem,
         CASE WHEN file_id % 12 = 5 THEN 'encoder stopped' ELSE 'picture not decoded' END AS reason
  FROM inventory_now WHERE origin = 'media' AND (file_id % 12 = 5 OR file_id % 18 = 3))"""
    def there(p):
        return f"'{ROOT}/__FAILED_FILES__/' || substr({p}, {len(ROOT) + 2})"
    dst = there("n.path")
    out["failed_moves"] = "WITH " + FIXTURE_CTES + "," + failed + f""",
earlier AS (SELECT {there('path')} AS path FROM inventory_now WHERE origin = 'media' AND file_id % 24 = 5)
SELECT 'move' AS op, n.path AS src,
       CASE WHEN {dst} IN (SELECT path FROM earlier)
            THEN {parent(dst)} || '/' || {stem(basename('n.path'))} || '_1' || {suffix(basename('n.path'))}
            ELSE {dst} END AS dst, min(f.reason) AS reason
FROM inventory_now n JOIN failed f ON {parent('n.path')} = f.dir AND starts_with({basename('n.path')}, f.stem || '.')
GROUP BY n.path"""
    out["conversion_failures"] = BASE + "," + failed + """
SELECT 'conversion failed' AS event, m.row_id, m.media_path AS path, f.reason AS detail,
       trim(coalesce(m.notes, '')) <> '' AS noted
FROM manifest m JOIN failed f ON m.media_path = f.path"""
    out["dedup_reset"] = BASE + STALE + """
SELECT m.row_id, m.media_path, coalesce(v.dedup_group_id, '') AS dedup_group_id,
       coalesce(v.delete_flag, '') AS delete_flag, coalesce(v.duplicate_of, '') AS duplicate_of, m.deletion_status
FROM del1 m LEFT JOIN d2_v v ON m.media_path = v.media_path"""
    out["tool_log_summary"] = BASE + """,
calls AS (
  SELECT 'run-' || printf('%05d', row_id // 500) || '.log' AS log, count(*) AS n,
         count(*) FILTER (WHERE coalesce(formatted_time, '') = '') AS bad
  FROM manifest WHERE media_path <> '' GROUP BY row_id // 500)
SELECT log, 'progress' AS kind, CAST(NULL AS VARCHAR) AS line, n AS current, n AS total FROM calls
UNION ALL SELECT log, 'summary', '1 directories scanned', NULL, NULL FROM calls
UNION ALL SELECT log, 'summary', CAST(n - bad AS VARCHAR) || ' image files updated', NULL, NULL FROM calls
UNION ALL SELECT log, 'summary', CAST(bad AS VARCHAR) || ' files weren''t updated due to errors', NULL, NULL
          FROM calls WHERE bad > 0"""
    out["csv_widened"] = BASE + FP_MANIFEST + """
SELECT CAST(row_id AS VARCHAR) AS row_id, media_path, notes, content_sha1, phash64,
       coalesce(CAST(hash_mtime AS VARCHAR), '') AS hash_mtime,
       'notes,media_path,row_id,content_sha1,phash64,hash_mtime' AS header
FROM fpm"""
    return out


def quarantine_move_sql() -> str:
    mroot, jroot = f"{ROOT}/__UNMATCHED_MEDIA__", f"{ROOT}/__UNMATCHED_JSON__"
    qm = quarantine("media_path", mroot)
    qj = quarantine("json_path", jroot)
    def variant(t, n):
        return f"{parent(t)} || '/' || {stem(basename(t))} || '_{n}' || {suffix(basename(t))}"
    return BASE + f""",
mv AS (
  SELECT row_id, media_path AS src, {qm} AS target FROM manifest WHERE lower(row_type) = 'unmatched_media'
  UNION ALL
  SELECT row_id, json_path, {qj} FROM manifest WHERE lower(row_type) = 'unmatched_json'),
earlier AS (
  SELECT {qm} AS path FROM manifest WHERE row_type = 'unmatched_media'),
ex AS (
  SELECT path FROM inventory_now
  UNION ALL SELECT path FROM earlier WHERE regexp_matches(path, '/IMG_[0-9]*[02468]\\.[a-z]+$'))
SELECT row_id, 'move' AS op, src,
       CASE WHEN target NOT IN (SELECT path FROM ex) THEN target
            WHEN {variant('target', 1)} NOT IN (SELECT path FROM ex) THEN {variant('target', 1)}
            ELSE {variant('target', 2)} END AS dst,
       CASE WHEN target NOT IN (SELECT path FROM ex) THEN 'quarantine' ELSE 'quarantine (name taken)' END AS reason
FROM mv WHERE target IS NOT NULL"""


def stage_stats_sql() -> str:
    """One statement: recovery (recursive), dedup, conversion and similarity
    CTEs side by side, then one count per metric."""
    import re
    sim = near_sql(10)[len("WITH"):]
    sim = re.sub(r"\bcand\b", "s_cand", sim)
    sim = re.sub(r"\bquar\b", "s_quar", sim)
    rec = recovery_sql()[len("WITH"):]
    return "WITH RECURSIVE" + rec + DEDUPED + CONVERSION + "," + sim + f""",
fl AS (SELECT * FROM deduped WHERE {flag_is('delete_flag', 'true')}),
dl AS (SELECT *, media_path <> '' AND trim(media_path) IN (SELECT path FROM inventory_now) AS gone FROM fl)
SELECT 'media_files' AS metric, count(*) FILTER (WHERE NOT is_json) AS value FROM files
UNION ALL SELECT 'sidecar_files', count(*) FILTER (WHERE is_json) FROM files
UNION ALL SELECT 'matched', count(*) FILTER (WHERE row_type = 'matched') FROM manifest
UNION ALL SELECT 'unmatched_json', count(*) FILTER (WHERE row_type = 'unmatched_json') FROM manifest
UNION ALL SELECT 'unmatched_media', count(*) FILTER (WHERE row_type = 'unmatched_media') FROM manifest
UNION ALL SELECT 'rows_with_notes', count(*) FILTER (WHERE coalesce(notes, '') <> '') FROM manifest
UNION ALL SELECT 'manifest_rows', count(*) FROM manifest
UNION ALL SELECT 'flagged_copies', count(*) FROM fl
UNION ALL SELECT 'group_rows', count(*) FILTER (WHERE dedup_group_id <> '') FROM deduped
UNION ALL SELECT 'deleted_media', count(*) FILTER (WHERE gone) FROM dl
UNION ALL SELECT 'recovered_pairs', count(*) FROM won
UNION ALL SELECT 'media_rows_after_dedup',
  (SELECT count(*) FROM deduped WHERE media_path <> '') - (SELECT count(*) FROM dl WHERE gone)
UNION ALL SELECT 'converted', count(*) FILTER (WHERE contains(action_taken, 'Converted')) FROM changes
UNION ALL SELECT 'similar_recovered', count(*) FILTER (WHERE rank = 1 AND distance > 0) FROM ranked"""


def type_from_magic_sql() -> str:
    ext = lower_suffix(basename("path"))
    return "WITH " + FIXTURE_CTES + f""",
h AS (SELECT path, {ext} AS ext, upper(header_hex) AS h FROM media_files),
t AS (
  SELECT path, ext,
         CASE WHEN starts_with(h, 'FFD8FF') AND ext <> '.jpg' THEN '.jpg'
              WHEN substr(h, 9, 8) = '66747970'
                   AND len(list_filter(range(0, 11), lambda i: substr(h, i * 2 + 1, 4) = '7174')) > 0
                   AND ext <> '.mov' THEN '.mov' END AS true_ext
  FROM h)
SELECT path, ext AS current_ext, true_ext FROM t WHERE true_ext IS NOT NULL"""
