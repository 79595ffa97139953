"""DuckDB SQL for the queries that SQL can express."""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to FROM g"""

OP6 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, max({'n': length(rule_host || rule_path), 'h': length(rule_host), 'v': rule_verdict, 'r': rule_host || rule_path}) AS best
  FROM s JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT s.page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)"""

_LEDGER = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + 8], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(0, len(words) - 7)) AS pos FROM w)),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper_words,
  len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter FROM w LEFT JOIN hit USING (doc_id)),
b AS (SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines, 2 * n_upper_words > n_words, word_chars > 40 * n_words, 5 * n_stutter > n_words, 2 * n_dup_lines > n_lines] AS f FROM m)"""

OP8 = (
    _LEDGER
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f[1] OR f[2] AS base_failed, NOT (f[1] OR f[2] OR f[3] OR f[5] OR f[6] OR f[7] OR f[8]) AS kept,
  CAST(list_sum(list_transform(range(0, 8), lambda k: CASE WHEN f[k + 1] THEN 1 << k ELSE 0 END)) AS BIGINT) AS failed_rules FROM b"""
)

ABLATION = (
    _LEDGER
    + """,
v AS (SELECT ['few_words', 'repeated_windows', 'symbol_share', 'half_duplicate_lines', 'upper_case', 'long_words', 'stutter'] AS names, [f[1], f[2], f[3], f[8], f[5], f[6], f[7]] AS f FROM b),
e AS (SELECT unnest(names) AS rule, unnest(f) AS hit, len(list_filter(f, lambda x: x)) AS many FROM v)
SELECT rule, CAST(count_if(hit) AS BIGINT) AS n_failed, CAST(count_if(hit AND many = 1) AS BIGINT) AS n_failed_alone, CAST(count_if(many = 0) AS BIGINT) AS n_passed FROM e GROUP BY rule"""
)

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos + 1 : pos + least(len(w), 10)], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS pos FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, pos, array_to_string(w[pos + 1 : pos + n], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS pos FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, pos, n, item_id FROM dw JOIN iw USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM (SELECT doc_id, pos, unnest(range(0, n)) AS k FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

ALL = {"op1_warc": OP1, "op6_urls": OP6, "op8_rules": OP8, "rules_ablation": ABLATION, "op9_decontamination": OP9}
