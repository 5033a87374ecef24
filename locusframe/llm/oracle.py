"""DuckDB SQL for the corpus operators that SQL can express.

Not here: op1 (XXH64 fingerprints), op2 (sequential training), op3 (tokenising, sequential packing) and op6 (patterns
that look behind). Their tests compare with brute-force versions instead.
"""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

#: Words of documents by place: w (doc_id, n, p, word).
_WORDS = rf"""
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM d WHERE len(ws) > 0)
"""


def _gram(k: int, column: str = "word") -> str:
    """The k words up to a place as one string, null near the start."""
    parts = [f"lag({column}, {j}) OVER (PARTITION BY doc_id ORDER BY p)" if j else column for j in range(k - 1, -1, -1)]
    return " || ' ' || ".join(parts)


OP4 = rf"""
WITH i AS (SELECT DISTINCT item_id, ws AS ws FROM (
    SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[j:j + least(len(ws), 13) - 1], ' ') AS win
    FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS j FROM i)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, k, j, array_to_string(ws[j:j + k - 1], ' ') AS win
    FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS j FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, j, dw.k FROM dw JOIN iw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(j, j + k - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP5 = rf"""
WITH rules(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT host, path, h || q AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || q) DESC, v DESC, length(h) DESC, h || q) AS n
    FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (FROM m WHERE n = 1) USING (host, path)
"""

OP7 = f"""
WITH {_WORDS},
g AS (SELECT doc_id, p, word AS g1, {_gram(2)} AS g2, {_gram(3)} AS g3, lag(word) OVER (PARTITION BY doc_id ORDER BY p) AS c1 FROM w),
h AS (SELECT *, lag(g2) OVER (PARTITION BY doc_id ORDER BY p) AS c2 FROM g),
n1 AS (SELECT g1, count(*) AS n FROM g GROUP BY g1), n2 AS (SELECT g2, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY g2), n3 AS (SELECT g3, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY g3),
s AS (SELECT doc_id, CASE WHEN n3.n >= 2 THEN ln(n3.n / b.n) WHEN n2.n >= 2 THEN ln(n2.n / a.n) + (least(p, 3) - 2) * ln(0.4)
        ELSE ln(n1.n / (SELECT count(*) FROM w)) + (least(p, 3) - 1) * ln(0.4) END AS x
    FROM h JOIN n1 USING (g1) LEFT JOIN n2 USING (g2) LEFT JOIN n3 USING (g3) LEFT JOIN n1 a ON a.g1 = c1 LEFT JOIN n2 b ON b.g2 = c2),
r AS (SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(x, 0), 4) AS log_score, round(x / n, 6) AS mean_log_score FROM documents LEFT JOIN r USING (doc_id)
"""

OP8 = f"""
WITH {_WORDS},
g AS (SELECT doc_id, p - 12 AS p, {_gram(13)} AS win FROM w),
f AS (SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p FROM g JOIN f USING (win) WHERE first < doc_id),
k AS (SELECT doc_id, count(*) AS n, count(gone.p) AS lost, string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS kept FROM w LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""

OP9 = rf"""
WITH {_WORDS},
g AS (SELECT doc_id, p - 2 AS p, {_gram(3)} AS win FROM w),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g WHERE win IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(p, p + 2)) AS q FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
written AS (SELECT * FROM l WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM written GROUP BY doc_id),
norm AS (SELECT doc_id, source, digest, {_LOWER.format(f"trim(regexp_replace(line, '{_SPACE}+', ' ', 'g'))")} AS line, len(regexp_extract_all(line, '{_WORD}')) AS n FROM written),
hosts AS (SELECT source, count(DISTINCT md5(coalesce(text, ''))) AS n_host FROM documents GROUP BY source),
often AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT digest) AS n FROM norm GROUP BY source, line) JOIN hosts USING (source) WHERE n >= 20 AND n >= 0.1 * n_host),
lost AS (SELECT doc_id, sum(n) AS n_removed FROM norm JOIN often USING (source, line) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
    FROM documents JOIN d USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_removed >= 0.3 * n_words AS kept FROM f
"""

OP10 = rf"""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE regexp_matches(line, '{_WORD}')),
r AS (SELECT *, (v + 31 * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY p), 0)) % 2 = 0 AS cuts FROM w),
e AS (SELECT doc_id, p FROM (SELECT *, lag(cuts) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r) WHERE k > 1 AND k < n - 1 AND cuts AND (k = 2 OR NOT before)),
c AS (SELECT l.*, coalesce(sum(CASE WHEN e.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.doc_id ORDER BY l.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM l LEFT JOIN e USING (doc_id, p)),
k AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY p) AS chunk, count(*) FILTER (regexp_matches(line, '{_WORD}')) AS written FROM c GROUP BY doc_id, c),
f AS (SELECT *, written > 0 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, c) > 1 AS gone FROM k),
o AS (SELECT doc_id, coalesce(sum(written) FILTER (gone), 0) AS lost, coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed_lines, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4,
        "op5_url_filter": OP5,
        "op7_lm_scoring": OP7,
        "op8_substring_dedup": OP8,
        "op9_quality_rules": OP9,
        "op10_line_dedup": OP10,
    }
