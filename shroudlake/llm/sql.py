"""DuckDB SQL that computes the same rows as the queries, where SQL can."""

from __future__ import annotations

#: A word of texts split at ASCII white space.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The table of the reflected CRC-32 polynomial, and the checksum of a text's UTF-8 bytes.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _jump(n: int, name: str) -> str:
    """A recursive table of (key, shard) for n shards over the table `hashed`."""
    return f"""
{name}_steps AS (
  SELECT h, h::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT h FROM hashed)
  UNION ALL
  SELECT h, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT, j,
    floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((((k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT) // 8589934592::UHUGEINT)::DOUBLE + 1)))::BIGINT
  FROM {name}_steps WHERE j < {n}
), {name} AS (SELECT h, max(b)::INTEGER AS s FROM {name}_steps WHERE j >= {n} GROUP BY h)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near_ctes(table: str, words: int) -> str:
    """Tables near_d (r, doc_id, w, n_shingles) and near_min (r, component_id) over a table of documents."""
    return rf"""
near_d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
near_s AS (SELECT DISTINCT r, array_to_string(w[i : i + {words - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM near_d WHERE len(w) > 0)),
near_n AS (SELECT r, count(*) AS n FROM near_s GROUP BY r),
near_p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM near_s a JOIN near_s b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
near_l AS (SELECT x, y FROM near_p JOIN near_n a ON a.r = x JOIN near_n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
near_e AS (SELECT x, y FROM near_l UNION ALL SELECT y, x FROM near_l),
near_reach AS (SELECT r, r AS z FROM near_d UNION SELECT near_reach.r, near_e.y FROM near_reach JOIN near_e ON near_e.x = near_reach.z),
near_min AS (SELECT near_reach.r, min(near_d.doc_id) AS component_id FROM near_reach JOIN near_d ON near_d.r = z GROUP BY near_reach.r)"""


def near_sql(table: str, words: int) -> str:
    """Near-duplicate groups by comparing all pairs that share a shingle."""
    return f"""WITH RECURSIVE {near_ctes(table, words)}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM near_d LEFT JOIN near_n USING (r) JOIN near_min USING (r)"""


def leak_ctes(table: str) -> str:
    """Tables leak_d (r, doc_id, w) and leak_r (r, n_hit, n_items, ids): what documents share with the benchmark."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
leak_d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM {table}),
leak_i AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
leak_w AS (SELECT DISTINCT item_id, len, array_to_string(w[i : i + len - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 8) AS len, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM leak_i WHERE len(w) > 0)),
leak_p AS (SELECT r, i, len, array_to_string(w[i : i + len - 1], ' ') AS win FROM (SELECT r, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM leak_d, (SELECT DISTINCT len FROM leak_w) WHERE len(w) >= len)),
leak_o AS (SELECT r, i, len, item_id FROM leak_p JOIN leak_w USING (win, len)),
leak_h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + len)) AS p FROM leak_o) GROUP BY r),
leak_r AS (SELECT r, n_hit, n_items, ids FROM leak_h JOIN (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM leak_o GROUP BY r) USING (r))"""


def leak_sql(table: str) -> str:
    return f"""WITH {leak_ctes(table)}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM leak_d LEFT JOIN leak_r USING (r)"""


#: The rules of the ledger, in the order of their bits.
_CONDITIONS = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "shouting": "2 * n_upper > n_letters",
    "repeated_lines": "n_dup_lines >= 5 AND 2 * n_dup_words > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "mostly_digits": "10 * n_digits > 3 * word_chars",
    "words_without_letters": "10 * n_bare > 4 * n_words",
    "poor_vocabulary": "n_words >= 100 AND 20 * n_distinct < n_words AND n_distinct < 50",
    "endless_word": "longest > 1000",
    "bullet_list": "n_lines >= 5 AND 10 * n_bullets > 9 * n_lines",
    "broken_off_lines": "n_lines >= 5 AND 10 * n_open > 3 * n_lines",
    "control_characters": "100 * n_control > word_chars",
}
#: Tables up to b (doc_id, measures, failed_bits): the ledger.
LEDGER = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r),
each_line AS (SELECT r, line, count(*) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]') AS bullet, regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$') AS open_end
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
lines AS (SELECT r, sum(k)::BIGINT AS n, sum(k - 1)::BIGINT AS dup, sum((k - 1) * words)::BIGINT AS dup_words, coalesce(sum(k) FILTER (bullet), 0)::BIGINT AS bullets, coalesce(sum(k) FILTER (open_end), 0)::BIGINT AS open_ends FROM each_line GROUP BY r),
each_word AS (SELECT r, count(DISTINCT x) AS kinds, max(octet_length(encode(x))) AS longest, count(*) FILTER (NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')) AS bare FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lines.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
  coalesce(dup_words, 0) AS n_dup_words, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, coalesce(bare, 0) AS n_bare, coalesce(kinds, 0) AS n_distinct, coalesce(longest, 0) AS longest,
  coalesce(bullets, 0) AS n_bullets, coalesce(open_ends, 0) AS n_open, length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F\x{{FFFD}}]', '', 'g')) AS n_control
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r) LEFT JOIN each_word USING (r)),
b AS (SELECT *, {" + ".join(f"{1 << k} * ({c})::BIGINT" for k, c in enumerate(_CONDITIONS.values()))} AS failed_bits FROM m)"""


SQL: dict[str, str] = {
    "op1_jump_sharding": f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, {_CRC} AS text_crc32,
  ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents, crc_table),
{_jump(24, "now")}, {_jump(25, "grown")}
SELECT doc_id, size, text_crc32, 'key' AS law, n.s AS shard,
  row_number() OVER (PARTITION BY n.s ORDER BY d.h, text_crc32, size) - 1 AS slot, g.s AS grown_shard
FROM hashed d JOIN now n USING (h) JOIN grown g USING (h)""",
    "op3_hamming_neardup": near_sql("documents", 4),
    "op4_prefix_decontamination": leak_sql("documents"),
    "op5_revisit_resolution": r"""
WITH raw AS (
  SELECT page_id AS k, url, octet_length(encode(coalesce(html, ''))) AS size, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || ((page_id % 28 + 28) % 28) AS day FROM pages),
rec AS (
  SELECT k * 2 AS record_id, url, k * 10 AS ts, 'response' AS kind, tag AS etag, day AS last_modified,
    'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;etag=' || tag || ';last-modified=' || day AS headers, size FROM raw
  UNION ALL
  SELECT k * 2 + 1, regexp_replace(url, '^https?://', 'https://www.') || '#again', k * 10 + CASE WHEN k % 7 = 3 THEN -5 ELSE 5 END, 'revisit',
    CASE WHEN k % 5 = 0 THEN '"other"' WHEN k % 5 < 4 THEN 'W/' || tag END, CASE WHEN k % 3 > 0 THEN day END,
    concat('cache-control=max-age=120;content-length=0;date=day 30', ';etag=' || CASE WHEN k % 5 = 0 THEN '"other"' WHEN k % 5 < 4 THEN 'W/' || tag END, ';server=edge'), size FROM raw),
named AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM rec),
canon AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\d*\.', '')
    || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/$', '') || CASE WHEN len(own) > 0 THEN '?' || array_to_string(own, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid)(=|$)'))) AS own
    FROM (SELECT *, array_to_string(list_transform(string_split(regexp_replace(bare, '^[^/?]*', ''), '%'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN upper(x[1:2]) || x[3:] ELSE x END), '%') AS rest FROM named))),
found AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'day': last_modified, 'size': size} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM canon),
judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN f IS NULL THEN 'missing'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = f.day THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS status FROM found)
SELECT record_id, canonical_url, ts, kind, CASE WHEN status = 'resolved' THEN f.id END AS refers_to, status,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=120;content-length=' || f.size || ';content-type=text/html;date=day 30;etag=' || coalesce(etag, f.etag) || ';last-modified=' || f.day ELSE headers END AS headers
FROM judged""",
    "op6_rule_ledger": f"""
WITH {LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b""",
    "rule_ablation": f"""
WITH {LEDGER}, rules(rule, bit) AS (VALUES {", ".join(f"('{name}', {1 << k})" for k, name in enumerate(_CONDITIONS))})
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS failed, count(*) FILTER (failed_bits = bit) AS failed_alone, count(*) FILTER (failed_bits = 0 OR failed_bits = bit) AS kept_without FROM b, rules GROUP BY rule""",
    "op7_fair_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(sha256('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(source_rank - 1) % 3 + 1] AS weight, (3 * source_size)::DOUBLE AS lim FROM s),
p AS (SELECT *, row_number() OVER o AS place, lim / weight AS ratio,
  ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY lim / weight, source_rank)),
best AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM p WHERE ratio >= level),
t AS (SELECT source, source_size, source_rank, CASE WHEN p.place >= best.place THEN least(weight * best.level, lim) ELSE lim END AS target FROM p, best),
c AS (SELECT d.*, source_size, source_rank, target, sum(size) OVER (PARTITION BY source_rank ORDER BY h, doc_id) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, h, size, source_rank, (e * source_size + upto)::DOUBLE / target AS finish FROM c, range(3) r(e) WHERE size > 0 AND target > 0),
got AS (SELECT doc_id, h, sum(size)::BIGINT AS taken FROM (SELECT *, sum(size) OVER (ORDER BY finish, source_rank) AS total FROM copies) WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id, h)
SELECT c.doc_id, c.size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN got ON c.doc_id = got.doc_id AND c.h = got.h""",
    "op9_quotation_links": r"""
WITH m AS (SELECT *, lag(text) OVER w AS t1, lag(text, 2) OVER w AS t2, row_number() OVER w - 1 AS place, min(turn) OVER (PARTITION BY conv_id) AS root FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, md5(trim(text, E' \t\n\r\x0b\x0c')) AS text_md5, length(trim(text, E' \t\n\r\x0b\x0c'))::BIGINT AS n_chars,
  ((t1 IS NOT NULL)::BIGINT + (t2 IS NOT NULL)::BIGINT) AS n_levels, ((t1 IS NOT NULL)::BIGINT + (t2 IS NOT NULL)::BIGINT) AS n_quotes, ((t1 IS NOT NULL)::BIGINT + (t2 IS NOT NULL)::BIGINT) AS n_linked,
  CASE WHEN t1 IS NOT NULL THEN turn - 1 END AS parent, root, place AS depth, place FROM m""",
}
