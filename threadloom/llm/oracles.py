"""DuckDB SQL of the training-data queries that SQL expresses; the others are tested against plain Python."""

from __future__ import annotations

_OP4 = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, list_slice(w, i, i + 9) AS seq
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), sizes AS (SELECT DISTINCT len(seq) AS n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN windows win ON list_slice(p.w, p.i, p.i + p.n - 1) = win.seq),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

_OP3 = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), least AS (SELECT h, min(doc_id) AS first_doc FROM places GROUP BY h),
gone AS (SELECT DISTINCT p.doc_id, unnest(range(p.i, p.i + 13)) AS j FROM places p JOIN least l USING (h) WHERE l.first_doc < p.doc_id),
cut AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, k: NOT list_contains(js, k)), ' ') END) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""

_OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(w) < 5 THEN 'whole ' || array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.r = a),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: One tree: recursive CTEs over a table of leaves (k, pos, n, digest), and the climb of every leaf through it.
def _tree(name: str, leaves: str) -> str:
    return f"""{name} AS (
  SELECT 0 AS lvl, k, pos, CAST(n AS BIGINT) AS width, digest, CAST(NULL AS VARCHAR) AS pre FROM {leaves}
  UNION ALL
  SELECT lvl + 1, k, pos // 16, CAST(max((width + 15) // 16) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)), string_agg(digest, '' ORDER BY pos) FROM {name} WHERE width > 1 GROUP BY lvl, k, pos // 16
)"""


def _climb(name: str, tree: str, start: str) -> str:
    return f"""{name} AS (
  SELECT id, 0 AS lvl, k, pos, digest, h, sib FROM {start}
  UNION ALL
  SELECT c.id, c.lvl + 1, c.k, c.pos // 16, t.digest, sha256(left(t.pre, 64 * (c.pos % 16)) || c.h || substr(t.pre, 64 * (c.pos % 16) + 65)), c.sib || left(t.pre, 64 * (c.pos % 16)) || substr(t.pre, 64 * (c.pos % 16) + 65)
  FROM {name} c JOIN {tree} t ON t.k = c.k AND t.lvl = c.lvl + 1 AND t.pos = c.pos // 16
), {name}_top AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)"""


def _crc32(text: str) -> str:
    """Bit by bit, of the bytes of an ASCII text."""
    step = "list_reduce([xor(c, b)] || range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INTEGER, 1))::BIGINT), lambda c, b: {step}), 4294967295)"


def _leaf(text: str) -> str:
    part = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    return "sha256(" + " || ".join(part(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


_OP11 = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '-') AS k, {_leaf("text")} AS digest,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM rows
), {_tree("tree", "leaves")},
tops AS (SELECT k AS grp, digest, '' AS k, row_number() OVER (ORDER BY k::BLOB) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE width = 1),
{_tree("upper_tree", "tops")},
start_low AS (SELECT id, k, pos, digest, coalesce(tampered, digest) AS h, '' AS sib FROM leaves),
{_climb("low", "tree", "start_low")},
start_high AS (SELECT l.id, t.k, t.pos, t.digest, l.h, l.sib FROM low_top l JOIN tops t ON t.grp = l.k),
{_climb("high", "upper_tree", "start_high")}
SELECT r.doc_id, r.digest AS leaf, l.digest AS subroot, h.digest AS root, sha256(h.sib) AS proof_sha256, h.h AS folded_root, h.h = h.digest AS verified
FROM leaves r JOIN low_top l USING (id) JOIN high_top h USING (id)
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), raw AS (
  SELECT id, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT *, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM raw
), named AS (
  SELECT *, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm FROM lines WHERE len(lw) > 0
), dup AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM named GROUP BY id),
grams AS (SELECT id, i, md5(array_to_string(list_slice(w, i, i + 7), ' ')) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT id, i FROM grams QUALIFY count(*) OVER (PARTITION BY id, g) >= 2),
rep AS (SELECT id, count(DISTINCT j) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY id),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
freq AS (SELECT host, norm FROM named JOIN hosts USING (host) GROUP BY host, norm HAVING count(DISTINCT text) > greatest(10.0, 0.02::DOUBLE * any_value(n))),
lost AS (SELECT id, sum(len(lw)) AS n FROM named SEMI JOIN freq USING (host, norm) GROUP BY id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (id) LEFT JOIN rep USING (id) LEFT JOIN lost USING (id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 20 AND n_removed_words * 100 <= n_words * 50 AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _OP3, "op4_decontamination": _OP4, "op9_ngram_join": _OP9, "op11_merkle": _OP11, "op12_line_rules": _OP12}
