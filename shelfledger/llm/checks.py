"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from shelfledger.llm import minmax_hash, ptolemaic_clusters, quality_lines, rlz_dedup

WORDS = r"""w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

WORD_DEDUP = f"""WITH {WORDS},
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + {rlz_dedup.WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {rlz_dedup.WINDOW - 2})) AS i FROM w)),
 early AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT win.doc_id, i, unnest(range({rlz_dedup.WINDOW})) AS j
  FROM win JOIN early USING (k) WHERE least < win.doc_id)),
 one AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(words, '')) AS kept_sha256, coalesce(words, '') AS text FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_R = quality_lines.LineRules()
_BOILER = " OR ".join(f"contains(lower(x), '{p}')" for p in quality_lines.BOILERPLATE)
_LESS = lambda pattern: f"(length(x) - length(regexp_replace(x, '{pattern}', '', 'g')))"
_BARS, _SOLID = r"(length(x) - length(replace(x, '|', '')))", "length(replace(x, ' ', ''))"
_FAULT = rf"""(({_BARS} >= {_R.bars} AND length(x) - {_SOLID} + 1 <= {_BARS} * {_R.words_per_bar + 1} + {_R.words_per_bar})
 OR {_LESS(quality_lines.SYMBOL)} * 100 > {_SOLID} * {_R.symbol_percent}
 OR ({_SOLID} >= {_R.upper_chars} AND {_LESS(chr(92) + 'p{Lu}')} * 100 > {_SOLID} * {_R.upper_percent})
 OR (length(x) <= {_R.boilerplate_chars} AND ({_BOILER})))"""

QUALITY = rf"""WITH {WORDS},
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + {quality_lines.WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality_lines.WINDOW - 2})) AS i FROM w)),
 twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range({quality_lines.WINDOW})) AS j
  FROM win SEMI JOIN twice USING (doc_id, k)) GROUP BY doc_id),
 lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS spoken,
  list_filter(string_split(text, chr(10)), lambda x: NOT {_FAULT}) AS good FROM w),
 c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '{quality_lines.SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(spoken) - len(list_distinct(spoken)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(array_to_string(ws, '')) - length(array_to_string(regexp_extract_all(array_to_string(good, chr(10)), '[^\x20\x09-\x0D]+'), ''))
   AS BIGINT) AS lost_chars FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {quality_lines.MIN_WORDS} OR 100 * n_repeat_words > {quality_lines.MAX_REPEAT_PERCENT} * n_words AS base_failed,
 NOT (n_words < {quality_lines.MIN_WORDS} OR 100 * n_repeat_words > {quality_lines.MAX_REPEAT_PERCENT} * n_words)
 AND NOT lost_chars * 100 > word_chars * {_R.max_lost_percent} AS kept FROM c"""

MINMAX_GROUPS = rf"""WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {minmax_hash.SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {minmax_hash.SHINGLE - 2}))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 alike AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE {minmax_hash.BOUND.of} * c >= {minmax_hash.BOUND.alike} * (x.n + y.n - c)),
 edges AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
 least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""

_P = ptolemaic_clusters


def _clusters() -> str:
    """Lloyd rounds by comparing every vector with every centroid."""
    parts = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({_P.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {_P.WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {_P.WIDTH})""",
             f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, x FROM
  (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {_P.CLUSTERS}))"""]
    for r in range(_P.ROUNDS + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, any_value(v.x) AS x, min((list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS b
  FROM v, c{r} k GROUP BY vec_id)""")
        if r < _P.ROUNDS:
            parts.append(f"""s{r} AS (SELECT b[2] AS c, unnest(range({_P.WIDTH})) AS i, unnest(x) AS y FROM a{r}),
 m{r} AS (SELECT c, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM s{r} GROUP BY c, i),
 c{r + 1} AS (SELECT k.c, coalesce(n.x, k.x) AS x FROM c{r} k LEFT JOIN (SELECT c, list(y ORDER BY i) AS x FROM m{r} GROUP BY c) n ON n.c = k.c)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(b[2] AS INTEGER) AS cluster, CAST(b[1] AS BIGINT) AS distance, CAST(sum(b[1]) OVER (PARTITION BY b[2]) AS BIGINT) AS cluster_inertia,
 CAST(sum(b[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{_P.ROUNDS} a JOIN c{_P.ROUNDS} k ON k.c = a.b[2]"""


CLUSTERS = _clusters()
