"""DuckDB SQL of the text queries that SQL can express, written from the contracts."""

from __future__ import annotations

from evencut.llm import mixing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: Words of documents and items by place; windows of ten words, or all words of a shorter item; hit words.
DECONTAMINATION = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS MATERIALIZED (SELECT DISTINCT n FROM p),
g AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT r, k, n, item FROM g JOIN p USING (n, t)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM (SELECT DISTINCT r, k, n FROM f)) GROUP BY 1),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM f) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""

#: Every string of 100 bytes, as hexadecimal digits, by place; a later occurrence goes with all its bytes.
SUFFIX_DEDUP = """
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT r, s, md5_number(substr(x, 2 * s + 1, 200)) AS t FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 99)) AS s FROM d WHERE length(x) >= 200)),
f AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY t ORDER BY r, s) AS n FROM g) WHERE n > 1),
o AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM f),
m AS MATERIALIZED (SELECT r, min(s) AS a, max(s) + 100 AS e FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM o) GROUP BY r, k),
c AS (SELECT r, x, a, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM m JOIN d USING (r)),
k AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(x, 2 * e + 1) ELSE '' END, '' ORDER BY a) AS kept FROM c GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


def mix() -> str:
    """Targets by filling the sources in the order of their limits per weight; words taken by place in each source's shuffled order."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)) + " END"
    most = mixing.MOST
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY 1),
w AS MATERIALIZED (SELECT source, total, {weight} AS weight FROM t),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {most} * total / weight::DOUBLE, source NULLS LAST) AS k FROM w),
l AS (SELECT k, total, weight, (SELECT sum(total) FROM w)::BIGINT - coalesce(sum({most} * total) OVER before, 0)::BIGINT AS left_, (SELECT sum(weight) FROM w)::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS open_ FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT k, left_, open_ FROM l WHERE left_::DOUBLE * weight / open_ <= {most} * total ORDER BY k LIMIT 1),
g AS MATERIALIZED (SELECT source, total, CASE WHEN o.k < (SELECT k FROM f) OR (SELECT k FROM f) IS NULL THEN ({most} * total)::DOUBLE ELSE (SELECT left_ FROM f)::DOUBLE * weight / (SELECT open_ FROM f) END AS target FROM o),
a AS (SELECT *, least(floor(target + 0.5)::BIGINT, {most} * total) AS take FROM g),
b AS (SELECT greatest(1, (count(*) + {mixing.ROWS_PER_BUCKET - 1}) // {mixing.ROWS_PER_BUCKET}) AS buckets FROM d),
p AS (SELECT d.*, (sum(size) OVER (PARTITION BY source ORDER BY h % (SELECT buckets FROM b), h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM d)
SELECT p.doc_id, p.size, total AS source_size, target, p.source,
  CASE WHEN p.size = 0 THEN 0 ELSE (take // total) * p.size + greatest(0, least(stop, take % total) - (stop - p.size)) END::BIGINT AS taken
FROM p JOIN a ON p.source IS NOT DISTINCT FROM a.source"""


def sqls() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op9_suffix_dedup": SUFFIX_DEDUP, "op10_mixing": mix()}
