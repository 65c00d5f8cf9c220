"""DuckDB SQL of the queries that SQL can express on whole tables."""

_MIX = """
WITH RECURSIVE counts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source
),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts
),
terms(source, rate, k, log_term, total) AS (
  SELECT source, rate, CAST(0 AS BIGINT), -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log_term + ln(rate) - ln(k + 1), total + exp(log_term + ln(rate) - ln(k + 1))
  FROM terms WHERE k < CAST(ceil(rate + 12 * sqrt(rate)) AS BIGINT) + 30
),
cdfs AS (SELECT source, list(total ORDER BY k) AS cdf FROM terms GROUP BY source),
draws AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
    CAST('0x' || substr(md5('20240:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents
),
counted AS (
  SELECT draws.*, len(list_filter(cdf, lambda c: c < u)) AS copies
  FROM draws JOIN cdfs ON draws.source IS NOT DISTINCT FROM cdfs.source
),
copied AS (SELECT *, unnest(range(0, copies)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy, md5('20240:' || name || ':' || copy) AS mix_key FROM copied
"""

_LINES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
    coalesce('=' || doc_id, '') || ':' || md5(coalesce(text, '')) AS k, string_split(text, chr(10)) AS parts
  FROM documents
),
numbered AS (SELECT rid, k, parts, unnest(range(0, len(parts))) AS line_no FROM docs),
plain AS (
  SELECT rid, k, line_no, trim(regexp_replace(parts[line_no + 1], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain,
    parts[line_no + 1] AS line
  FROM numbered
),
masked AS (
  SELECT *, string_split(masked, ' ') AS tokens FROM (
    SELECT *, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM plain WHERE plain <> ''
  )
),
placed AS (
  SELECT masked.*, len(tokens) AS n_tokens, len(tokens) || ':' || array_to_string(tokens[1:3], ' ') AS leaf,
    first_value(masked.k) OVER (PARTITION BY masked.masked ORDER BY doc_id NULLS FIRST, masked.k) AS first_k
  FROM masked JOIN docs USING (rid)
),
lines AS (SELECT masked, n_tokens, leaf, count(DISTINCT k) AS docs FROM placed GROUP BY masked, n_tokens, leaf),
again AS (
  SELECT rid, line_no FROM placed JOIN lines USING (masked)
  WHERE docs >= 10 OR (placed.n_tokens >= 20 AND docs >= 2 AND k <> first_k)
),
leaves AS (SELECT leaf FROM lines WHERE n_tokens > 3 GROUP BY leaf HAVING sum(docs) >= 10 AND count(*) >= 2),
exploded AS (
  SELECT rid, k, line_no, leaf, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS place
  FROM placed JOIN leaves USING (leaf)
),
constants AS (
  SELECT leaf, place, token FROM exploded WHERE token <> '<*>' GROUP BY leaf, place, token HAVING count(*) >= 10
),
judged AS (
  SELECT e.rid, e.k, e.line_no, e.leaf, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY e.place) AS template
  FROM exploded e LEFT JOIN constants c ON e.leaf = c.leaf AND e.place = c.place AND e.token = c.token
  GROUP BY e.rid, e.k, e.line_no, e.leaf
  HAVING 100 * count(c.token) FILTER (e.place >= 3) >= 60 * (count(*) - 3)
),
recurring AS (SELECT leaf, template FROM judged GROUP BY leaf, template HAVING count(DISTINCT k) >= 10),
dropped AS (
  SELECT rid, line_no FROM judged JOIN recurring USING (leaf, template) UNION SELECT rid, line_no FROM again
),
kept AS (
  SELECT p.rid, string_agg(p.line, chr(10) ORDER BY p.line_no) FILTER (d.rid IS NULL) AS text,
    count(*) FILTER (p.plain <> '') AS n_lines, count(d.rid) AS n_dropped
  FROM plain p LEFT JOIN dropped d ON p.rid = d.rid AND p.line_no = d.line_no
  GROUP BY p.rid
)
SELECT docs.doc_id, CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM docs LEFT JOIN kept USING (rid)
"""

_SEARCH = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tokens AS (
  SELECT rid, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
),
tf AS (SELECT rid, term, count(*) AS tf FROM tokens GROUP BY rid, term),
sizes AS (SELECT rid, count(*) AS n FROM tokens GROUP BY rid),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
lengths AS (SELECT rid, 100 - 25 + (25 * n * docs) // terms AS m FROM sizes, totals),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term
),
items AS (SELECT row_number() OVER () AS item, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
wanted AS (
  SELECT item, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
),
scores AS (
  SELECT item, any_value(item_id) AS item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (rid)
  GROUP BY item, rid
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
    doc_id, score
  FROM scores JOIN texts USING (rid) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_CRC_STEP = "xor(x >> 1, 3988292384 * (x & 1))"
_FIELDS = "concat({0})".format(
    ", ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("doc_id", "source", "lang", "n_chars{0}", "text")
    )
)
_MANIFEST = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, sha256({_FIELDS.format("")}) AS leaf,
    sha256({_FIELDS.format(" + 1")}) AS altered,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda digit: CAST(ascii(digit) AS BIGINT))), lambda crc, byte: list_reduce(
        [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: {_CRC_STEP})), 4294967295) AS crc
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows
),
nodes AS (
  SELECT tree, CAST(0 AS BIGINT) AS level, place, leaf AS h FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, place // 2, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM nodes) WHERE size > 1 GROUP BY tree, place // 2
),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
subroots AS (
  SELECT nodes.tree, h, row_number() OVER (ORDER BY nodes.tree) - 1 AS place FROM nodes JOIN heights
  ON nodes.tree = heights.tree AND level = height
),
tops AS (
  SELECT CAST(0 AS BIGINT) AS level, place, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 2, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS size FROM tops) WHERE size > 1 GROUP BY place // 2
),
top_height AS (SELECT max(level) AS height FROM tops),
steps AS (
  SELECT rid, level AS step, place >> CAST(level AS INTEGER) AS node, tree
  FROM placed JOIN heights USING (tree), LATERAL (SELECT unnest(range(0, height)) AS level)
),
top_steps AS (
  SELECT rid, heights.height + level AS step, level, subroots.place >> CAST(level AS INTEGER) AS node
  FROM placed JOIN heights USING (tree) JOIN subroots USING (tree), top_height,
    LATERAL (SELECT unnest(range(0, top_height.height)) AS level)
),
siblings AS (
  SELECT rid, step, node, nodes.h AS sibling FROM steps LEFT JOIN nodes
  ON nodes.tree = steps.tree AND nodes.level = step AND nodes.place = xor(node, 1)
  UNION ALL
  SELECT rid, step, node, tops.h FROM top_steps LEFT JOIN tops ON tops.level = top_steps.level AND tops.place = xor(node, 1)
),
proofs AS (SELECT rid, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM siblings GROUP BY rid),
climbs AS (
  SELECT rid, CAST(0 AS BIGINT) AS step,
    CASE WHEN crc % 7 = 0 THEN altered ELSE leaf END AS h FROM placed
  UNION ALL
  SELECT climbs.rid, climbs.step + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN node & 1 = 1 THEN sibling || h
    ELSE h || sibling END)
  FROM climbs JOIN siblings ON siblings.rid = climbs.rid AND siblings.step = climbs.step
),
reached AS (SELECT rid, arg_max(h, step) AS folded_root FROM climbs GROUP BY rid),
root AS (SELECT h AS root FROM tops, top_height WHERE level = height)
SELECT doc_id, leaf, subroots.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN reached USING (rid) LEFT JOIN proofs USING (rid), root
"""

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": _MIX, "op4_line_dedup": _LINES, "op12_merkle_manifest": _MANIFEST, "op13_lexical_search": _SEARCH}
