"""DuckDB SQL for the queries that SQL can express: the fixity audit, the
benchmark windows and the hard negatives. The other operators are tested
against brute force, round trips or held-out accuracy in ``tests/llm``."""

from __future__ import annotations

from . import fixity

EOL = "chr(13) || chr(10)"


def _up(source: str, name: str) -> str:
    """One more level of a tree: ``fanout`` ordered nodes under one hash."""
    return f"""{name} AS (
  SELECT file, node // {fixity.FANOUT} AS node, min("first") AS "first", max("last") AS "last",
         sha256(string_agg("first"::VARCHAR || ':' || "last"::VARCHAR || ':' || hash, '|' ORDER BY node)) AS hash
  FROM {source} GROUP BY file, node // {fixity.FANOUT})"""


def _lines(k: int) -> str:
    """Header text as a DuckDB expression."""
    return f" || {EOL} || ".join(f"'{part}'" for part in fixity.HEADS[k].split("\r\n"))


def fixity_sql() -> str:
    levels, width = [], fixity.PER_FILE
    names = {"m": "m0", "c": "c0"}
    while width > 1:
        width = -(-width // fixity.FANOUT)
        for side in names:
            up = f"{side}{int(names[side][1:]) + 1}"
            levels.append(_up(names[side], up))
            names[side] = up
    return f"""
WITH numbered AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(html) NULLS FIRST) - 1 AS n
  FROM pages),
parts AS (
  SELECT page_id, n, {_lines(0)} || regexp_replace(md5(n::VARCHAR || '|' || url || '|' || sha256(html)),
           '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
           || {_lines(1)} || url || {_lines(2)} || strlen(html)::VARCHAR || {_lines(3)} || html || {EOL} || {EOL} AS rec
  FROM numbered),
recs AS (
  SELECT page_id, n // {fixity.PER_FILE} AS file, n % {fixity.PER_FILE} AS pos, strlen(rec)::BIGINT AS length, rec,
         coalesce(page_id, 0) % 211 = 11 AS lost, coalesce(page_id, 0) % 97 = 7 AS rotten
  FROM parts),
placed AS (
  SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY pos) - length)::BIGINT AS "offset", sha256(rec) AS mine,
         sha256(CASE WHEN rotten THEN left(rec, length(rec) - 5) || '?' || right(rec, 4) ELSE rec END) AS copy
  FROM recs),
m0 AS (SELECT file, pos AS node, "offset" AS "first", "offset" + length AS "last", mine AS hash FROM placed),
c0 AS (SELECT file, pos AS node, "offset" AS "first", "offset" + length AS "last", copy AS hash FROM placed WHERE NOT lost),
{", ".join(levels)}
SELECT p.file::BIGINT AS file, p.pos::BIGINT AS pos, p.page_id, p."offset", p.length, p.mine AS sha256,
       CASE WHEN NOT p.lost THEN p.copy END AS replica_sha256, m.hash AS root, c.hash AS replica_root,
       CASE WHEN p.lost THEN 'missing' WHEN p.copy <> p.mine THEN 'corrupt' ELSE 'ok' END AS status
FROM placed p LEFT JOIN {names["m"]} m ON m.file = p.file LEFT JOIN {names["c"]} c ON c.file = p.file
"""


DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)),
spots AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
          FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT r, n, i, item_id FROM spots JOIN wins USING (n, win)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_warc_fixity": fixity_sql(), "op12_decontamination": DECONTAMINATION, "op13_hard_negatives": HARD_NEGATIVES}
