"""DuckDB SQL for the registered queries; names and types as in queries.py."""

from __future__ import annotations

from .queries import KEYWORDS, PATTERNS

_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _pos(text: str, pattern: str) -> str:
    return f"CAST(nullif(instr({text}, {pattern}), 0) - 1 AS BIGINT)"


def _after(text: str, pattern: str, start: int) -> str:
    """The first place at or after start."""
    return f"CAST(nullif(instr(substring({text}, {start + 1}), {pattern}), 0) + {start - 1} AS BIGINT)"


def _list(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}::BIGINT, '{w}')" for i, w in enumerate(words)) + ") v(idx, pat)"


def _known(words: list[str]) -> str:
    return f"(SELECT pat, max(idx) AS idx FROM {_list(words)} GROUP BY pat)"


#: Every occurrence (key, pattern, start), left to right without overlaps, from the pieces between them.
def _occurrences(source: str, key: str, pats: str) -> str:
    return f"""
  SELECT {key}, idx, pat, CAST(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + (i - 1) * length(pat) AS BIGINT) AS start, i
  FROM (SELECT {key}, idx, pat, p, unnest(range(1, len(p))) AS i
        FROM (SELECT {key}, idx, pat, string_split(text, pat) AS p FROM {source}, {pats} k WHERE contains(text, pat)))"""


_TRIE = """
WITH RECURSIVE words AS (SELECT pat, max(idx) AS idx FROM {src} GROUP BY pat),
 n AS (SELECT substring(pat, 1, k) AS prefix, max(CASE WHEN k = length(pat) THEN idx END) AS mark
       FROM (SELECT pat, idx, unnest(range(1, length(pat) + 1)) AS k FROM words) GROUP BY 1
       UNION ALL SELECT '', NULL),
 nodes AS (SELECT prefix, CASE WHEN prefix <> '' THEN substring(prefix, 1, length(prefix) - 1) END AS parent,
       CASE WHEN prefix <> '' THEN right(prefix, 1) END AS label, CAST(length(prefix) AS BIGINT) AS depth, CAST(mark AS BIGINT) AS mark FROM n)
"""
_NAMES = "(SELECT r_name AS name FROM region UNION SELECT p_name FROM part)"
_SUBSTRINGS = f"""
WITH names AS (SELECT name FROM {_NAMES}),
 subs AS (SELECT name, i, j, substring(name, i, j) AS s, substring(name, i + j, 1) AS nxt
   FROM (SELECT name, i, unnest(range(1, length(name) - i + 2)) AS j FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM names))),
 leaves AS (SELECT name, s AS path FROM subs GROUP BY name, s HAVING count(*) = 1 AND max(CASE WHEN nxt = '' THEN 1 ELSE 0 END) = 1),
 inner_nodes AS (SELECT name, s AS path, CAST(length(s) AS BIGINT) AS depth FROM subs WHERE nxt <> '' GROUP BY name, s HAVING count(DISTINCT nxt) > 1)
"""
_FIRST = f"""
SELECT d.doc_id, f.start, f.idx FROM documents d LEFT JOIN (
  SELECT doc_id, start, idx, row_number() OVER (PARTITION BY doc_id ORDER BY start + length(pat), length(pat) DESC, idx DESC) AS k
  FROM (SELECT doc_id, idx, pat, {_pos("text", "pat")} AS start FROM documents, {_known(PATTERNS)} p WHERE contains(text, pat))
) f ON f.doc_id = d.doc_id AND f.k = 1"""
_ALL = f"""SELECT doc_id, start, idx, CAST(start + length(pat) AS BIGINT) AS "end" FROM ({_occurrences("documents", "doc_id", _known(PATTERNS))})"""
_LINES = "(SELECT doc_id, i - 1 AS line_no, p[i] AS line, p FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"
_OFFSETS = f"(SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM {_LINES})"
_URL = r"([\p{L}]+)://([^/?#]+)([^?#]*)"
_WORD = r"[\p{Lu}][\p{Ll}]+tion[\p{L}\p{Nd}_]*"
_PUNCT = r"[`~!@#$%^&*()\-+=\[\]{}|;:'',./<>?\"]"


def _mismatch(a: str, b: str) -> str:
    return f"""(SELECT min(i) FROM unnest(range(0, greatest(length({a}), length({b})))) t(i)
      WHERE substring({a}, i + 1, 1) <> substring({b}, i + 1, 1))"""


def _order(op: str) -> str:
    b = "'red widget'"
    return f"CASE WHEN p_name {op} {b} THEN CAST(coalesce(m, length(p_name)) AS BIGINT) END"


ORACLES: dict[str, str] = {
    "pos_first": f"SELECT doc_id, {_pos('text', chr(39) + 'tion' + chr(39))} AS pos FROM documents",
    "pos_by_algorithm": "SELECT doc_id, " + ", ".join(f"{_pos('text', chr(39) + 'ment' + chr(39))} AS {n}" for n in ("brute", "bm", "bmh", "bmh8", "rk", "kmp", "sor", "ac", "tabac")) + " FROM documents",
    "pos_prepared": f"SELECT doc_id, {_pos('text', chr(39) + 'ing' + chr(39))} AS a, {_after('substring(text, 1, 200)', chr(39) + 'ing' + chr(39), 10)} AS b FROM documents",
    "pos_octets": "SELECT doc_id, CASE WHEN contains(text, 'é') THEN CAST(strlen(string_split(text, 'é')[1]) AS BIGINT) END AS pos FROM documents",
    "pos_from": f"SELECT doc_id, {_after('text', chr(39) + 'on' + chr(39), 50)} AS pos FROM documents",
    "pos_window": f"SELECT doc_id, {_after('substring(text, 1, 60)', chr(39) + 'on' + chr(39), 20)} AS pos FROM documents",
    "pos_pattern_slice": f"SELECT doc_id, {_after('substring(text, 1, 500)', chr(39) + 'tion' + chr(39), 5)} AS pos FROM documents",
    "pos_by_column": f"""SELECT item_id, {_pos('t', 'string_split(t, chr(32))[-1]')} AS pos FROM (SELECT item_id, translate(text, {_UP}, {_LOW}) AS t FROM benchmark)""",
    "contains_filter": "SELECT doc_id, lang FROM documents WHERE contains(text, 'worthless')",
    "prefixed": "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://www.')",
    "suffixed": "SELECT page_id, ends_with(url, '.html') AS is_html FROM pages",
    "count_nonoverlap": "SELECT doc_id, CAST((length(text) - length(replace(text, 'on', ''))) // 2 AS BIGINT) AS n, CAST((length(text) - length(replace(text, 'anan', ''))) // 4 AS BIGINT) AS aa FROM documents",
    "count_overlap": "SELECT doc_id, CAST(len(list_filter(range(1, length(text) + 1), lambda i: substring(text, i, 4) = 'anan')) AS BIGINT) AS n FROM documents",
    "positions_all": f"SELECT conv_id, turn, i - 1 AS k, start AS pos FROM ({_occurrences('conversations', 'conv_id, turn', '(SELECT 0 AS idx, ' + chr(39) + 'on' + chr(39) + ' AS pat)')})",
    "rk_fingerprint": "SELECT p_partkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substring(p_name, 1, 8), ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 256 + x) % 723925871) AS BIGINT) AS hash FROM part",
    "multi_first": _FIRST,
    "multi_first_by_algorithm": f"SELECT doc_id, start AS search_ac, start AS search_compiled_ac, start AS search_cw FROM ({_FIRST})",
    "multi_first_blocks": _FIRST,
    "multi_first_automaton": _FIRST,
    "multi_all": _ALL,
    "multi_all_automaton": _ALL,
    "multi_benchmark_words": f"SELECT doc_id, start, idx FROM ({_occurrences('documents', 'doc_id', '(SELECT text AS pat, max(item_id) AS idx FROM benchmark GROUP BY text)')})",
    "multi_count_by_pattern": f"SELECT idx, count(*) AS n FROM ({_ALL}) GROUP BY idx",
    "multi_any_semi": "SELECT doc_id FROM documents WHERE contains(text, 'idiot') OR contains(text, 'moron') OR contains(text, 'clown')",
    "multi_none_anti": "SELECT doc_id FROM documents WHERE NOT (contains(text, 'the') OR contains(text, 'que') OR contains(text, 'und'))",
    "trie_nodes": _TRIE.format(src=_list(KEYWORDS)) + "SELECT * FROM nodes",
    "trie_empty": "SELECT '' AS prefix, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS label, CAST(0 AS BIGINT) AS depth, CAST(NULL AS BIGINT) AS mark",
    "trie_printed": _TRIE.format(src=_list(KEYWORDS)) + """SELECT '{"prefix":"' || prefix || '"' || coalesce(',"parent":"' || parent || '","label":"' || label || '"', '') || ',"depth":' || depth || coalesce(',"mark":' || mark, '') || '}' AS line FROM nodes""",
    "trie_dot": _TRIE.format(src=_list(["he", "she", "his", "hers"])) + """, s AS (SELECT a.prefix, b.prefix AS fail, row_number() OVER (PARTITION BY a.prefix ORDER BY b.depth DESC) AS k
  FROM nodes a JOIN nodes b ON ends_with(a.prefix, b.prefix) AND b.depth < a.depth)
  SELECT 'digraph {' AS line UNION ALL SELECT '}' UNION ALL SELECT '  "' || prefix || '" [shape=' || CASE WHEN mark IS NULL THEN 'circle' ELSE 'doublecircle' END || '];' FROM nodes
  UNION ALL SELECT '  "' || parent || '" -> "' || prefix || '" [label="' || label || '"];' FROM nodes WHERE depth > 0
  UNION ALL SELECT '  "' || prefix || '" -> "' || fail || '" [style=dashed];' FROM s WHERE k = 1 AND fail <> ''""",
    "trie_from_names": _TRIE.format(src="(SELECT p_name AS pat, min(p_partkey) AS idx FROM part GROUP BY p_name)") + "SELECT prefix, parent, depth, mark FROM nodes",
    "trie_fail_links": _TRIE.format(src=_list([*KEYWORDS, "edge", "dg", "get"])) + """, s AS (SELECT a.prefix, b.prefix AS fail, row_number() OVER (PARTITION BY a.prefix ORDER BY b.depth DESC) AS k
  FROM nodes a JOIN nodes b ON ends_with(a.prefix, b.prefix) AND b.depth < a.depth) SELECT prefix, fail FROM s WHERE k = 1""",
    "trie_transitions": _TRIE.format(src=_list(["he", "she", "his", "hers"])) + """, l AS (SELECT DISTINCT label FROM nodes WHERE label IS NOT NULL),
  s AS (SELECT a.prefix, l.label, b.prefix AS target, row_number() OVER (PARTITION BY a.prefix, l.label ORDER BY b.depth DESC) AS k
    FROM nodes a, l, nodes b WHERE ends_with(a.prefix || l.label, b.prefix)) SELECT prefix, label, target FROM s WHERE k = 1""",
    "trie_find_child": _TRIE.format(src=_list(KEYWORDS)) + "SELECT q.parent, q.label, nodes.prefix, nodes.mark FROM (VALUES ('', 'r'), ('re', 'd'), ('re', 'x'), ('red', ' ')) q(parent, label) LEFT JOIN nodes USING (parent, label)",
    "trie_contains": f"SELECT p_partkey, CAST(idx AS BIGINT) AS mark FROM part LEFT JOIN {_known(KEYWORDS)} k ON p_name = pat",
    "trie_longest_prefix": f"SELECT p_partkey, CAST(max(length(pat)) AS BIGINT) AS length FROM part LEFT JOIN {_list(KEYWORDS)} ON starts_with(p_name, pat) GROUP BY p_partkey",
    "trie_walk": _TRIE.format(src=_list(KEYWORDS)) + "SELECT prefix, row_number() OVER (ORDER BY depth, prefix) - 1 AS level_rank, row_number() OVER (ORDER BY prefix) - 1 AS deep_rank FROM nodes",
    "suffix_tree_leaves": _SUBSTRINGS + "SELECT name, path FROM leaves",
    "suffix_tree_internal": _SUBSTRINGS + "SELECT name, path, depth FROM inner_nodes",
    "suffix_tree_edges": _SUBSTRINGS + """, nodes AS (SELECT name, path FROM leaves UNION ALL SELECT name, path FROM inner_nodes UNION ALL SELECT name, '' FROM names),
  edges AS (SELECT a.name, a.path, length(a.path) - max(length(b.path)) AS n FROM nodes a JOIN nodes b ON a.name = b.name AND starts_with(a.path, b.path) AND length(b.path) < length(a.path) GROUP BY a.name, a.path)
  SELECT n.name, CAST(count(*) AS BIGINT) AS nodes, CAST(coalesce((SELECT sum(e.n) FROM edges e WHERE e.name = n.name), 0) AS BIGINT) AS edge_chars FROM nodes n GROUP BY n.name""",
    "suffix_tree_walk": _SUBSTRINGS + """, nodes AS (SELECT name, path FROM leaves UNION ALL SELECT name, path FROM inner_nodes UNION ALL SELECT name, '' FROM names)
  SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS rank FROM nodes""",
    "suffix_tree_links": _SUBSTRINGS + """, nodes AS (SELECT name, path FROM leaves UNION ALL SELECT name, path FROM inner_nodes UNION ALL SELECT name, '' FROM names)
  SELECT i.name, i.path, n.path AS "to" FROM inner_nodes i JOIN nodes n ON n.name = i.name AND n.path = substring(i.path, 2)""",
    "suffix_tree_equal": "SELECT true AS same, false AS other",
    "re_find": f"""SELECT doc_id, CASE WHEN hit THEN m END AS "match", CASE WHEN hit THEN s END AS start, CASE WHEN hit THEN s + length(m) END AS "end"
  FROM (SELECT doc_id, regexp_matches(text, '{_WORD}') AS hit, regexp_extract(text, '({_WORD})', 1) AS m, CAST(length(regexp_extract(text, '^((?s:.)*?)(?:{_WORD})', 1)) AS BIGINT) AS s FROM documents)""",
    "re_find_window": r"""SELECT doc_id, CASE WHEN hit THEN m END AS "match", CASE WHEN hit THEN s END AS start, CASE WHEN hit THEN s + length(m) END AS "end"
  FROM (SELECT doc_id, regexp_matches(t, '[\p{L}]+') AS hit, regexp_extract(t, '([\p{L}]+)', 1) AS m, CAST(30 + length(regexp_extract(t, '^((?s:.)*?)[\p{L}]+', 1)) AS BIGINT) AS s FROM (SELECT doc_id, substring(text, 31, 30) AS t FROM documents))""",
    "re_match_start": r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[\p{Lu}]') THEN regexp_extract(text, '^[\p{Lu}][\p{Ll}]*') END AS m FROM documents",
    "re_match_exact": "SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#[0-9]|Brand#[0-9][0-9]') THEN p_brand END AS brand FROM part",
    "re_find_all": r"SELECT doc_id, i - 1 AS k, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{Lu}][\p{Ll}]+ing') AS w FROM documents))",
    "re_find_all_groups": """WITH w AS (SELECT page_id, substring(html, 6, 1995) AS t FROM pages),
  p AS (SELECT page_id, regexp_extract_all(t, '<([\\p{L}]+)([^>]*)>') AS m, regexp_extract_all(t, '<([\\p{L}]+)([^>]*)>', 1) AS g, regexp_extract_all(t, '<([\\p{L}]+)([^>]*)>', 2) AS r, regexp_split_to_array(t, '<([\\p{L}]+)([^>]*)>') AS s FROM w),
  x AS (SELECT page_id, i, m[i] AS "match", g[i] AS tag, r[i] AS rest, length(s[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p)),
  y AS (SELECT *, sum(gap + length("match")) OVER (PARTITION BY page_id ORDER BY i) AS e FROM x)
  SELECT page_id, i - 1 AS k, "match", tag, rest, CAST(5 + e - length("match") AS BIGINT) AS start, CAST(5 + e AS BIGINT) AS "end" FROM y""",
    "re_split_window": r"SELECT doc_id, array_to_string(regexp_split_to_array(substring(text, 11, 80), '[ \t\r\n]+'), '|') AS pieces FROM documents",
    "re_replace_window": r"SELECT doc_id, md5(substring(text, 1, 10) || regexp_replace(substring(text, 11, 80), '[\p{L}]+', '<*>', 'g') || substring(text, 91)) AS said FROM documents",
    "re_long_loops": r"""SELECT doc_id, CASE WHEN m <> '' THEN s END AS start, CASE WHEN m <> '' THEN s + length(m) END AS "end"
  FROM (SELECT doc_id, regexp_extract(text, '(?:[\p{L}]+[ \t\r\n])+') AS m, CAST(length(regexp_extract(text, '^((?s:.)*?)[\p{L}]+[ \t\r\n]', 1)) AS BIGINT) AS s FROM documents)""",
    "re_groups_url": f"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS host, regexp_extract(url, '{_URL}', 3) AS path FROM pages",
    "re_with_match": f"SELECT page_id, CASE WHEN regexp_matches(url, '{_URL}') THEN regexp_extract(url, '{_URL}', 2) || ' by ' || regexp_extract(url, '{_URL}', 1) ELSE 'none' END AS said FROM pages",
    "re_boundary": "SELECT page_id, CAST(len(regexp_extract_all(html, '<(?s:.)*?>')) AS BIGINT) AS tags FROM pages",
    "re_split_first": r"SELECT doc_id, p[1] AS head, CASE WHEN len(p) > 1 THEN CAST(length(text) - length(p[1]) - length(regexp_extract(text, '[.,][ \t]*')) AS BIGINT) END AS tail_chars FROM (SELECT doc_id, text, regexp_split_to_array(text, '[.,][ \t]*') AS p FROM documents)",
    "re_split_all": rf"SELECT doc_id, CAST(len(regexp_split_to_array(text, '[ \t\r\n]')) AS BIGINT) AS n, CAST(len(regexp_split_to_array(text, '{_PUNCT}+')) AS BIGINT) AS m FROM documents",
    "re_split_coalesce": r"SELECT doc_id, piece FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\r\n.]')) AS piece FROM documents) WHERE piece <> ''",
    "re_replace_all": r"SELECT doc_id, md5(array_to_string(regexp_split_to_array(text, '[\p{L}]+ing'), '$1\')) AS said FROM documents",
    "re_replace_first": r"SELECT doc_id, md5(regexp_replace(text, '[\p{L}]+ing', '<*>')) AS said FROM documents",
    "re_rearrange": r"SELECT page_id, regexp_replace(url, '([\p{L}]+)://([^/?#]+)', '\2 \1:', 'g') AS said FROM pages",
    "re_replace_function": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CAST(length(w) AS VARCHAR)), ' ') AS said FROM part",
    "re_count_lines": rf"SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_LINES} WHERE regexp_matches(line, '[\p{{L}}]+://[^ \t]+|[\p{{L}}\p{{Nd}}_.]+@[\p{{L}}\p{{Nd}}_]+\.[\p{{L}}\p{{Nd}}_]+')",
    "scanf_brand": "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '^Brand#([0-9]+)', 1) AS BIGINT) AS brand, regexp_matches(p_brand, '^Brand#[0-9]+') AS matched FROM part",
    "scanf_source": "SELECT doc_id, TRY_CAST(regexp_extract(source, '^src([0-9]+)', 1) AS BIGINT) AS number, CASE WHEN regexp_matches(source, '^src[0-9]+') THEN CAST(length(regexp_extract(source, '^src[0-9]+')) AS BIGINT) END AS chars, regexp_matches(source, '^src[0-9]+') AS matched FROM documents",
    "scanf_customer": "SELECT c_custkey, 'Customer' AS word, CAST(substring(c_name, 13, 3) AS BIGINT) AS high, CAST(substring(c_name, 16) AS BIGINT) AS low, true AS matched FROM customer",
    "scanf_priority": "SELECT o_orderkey, CAST(regexp_extract(o_orderpriority, '^([0-9]+)-([A-Z ]+)', 1) AS BIGINT) AS level, regexp_extract(o_orderpriority, '^([0-9]+)-([A-Z ]+)', 2) AS name FROM orders",
    "scanf_props": """SELECT event_id, regexp_extract(props, '"(.)"', 1) AS key, CAST(regexp_extract(props, ': ([0-9]+)', 1) AS BIGINT) AS value, true AS matched FROM events""",
    "scanf_float": "SELECT p_partkey, CAST(printf('%.2f', CAST(p_retailprice AS DOUBLE)) AS DOUBLE) AS price, 'USD' AS unit FROM part",
    "scanf_radix": "SELECT p_partkey, CAST(p_partkey AS BIGINT) AS hex, CAST(p_partkey AS BIGINT) AS oct FROM part",
    "scanf_partial": "SELECT p_partkey, nullif(regexp_extract(p_name, '^[a-z]+'), '') AS colour, CASE WHEN regexp_matches(p_name, '^[a-z]+ *wid') THEN regexp_extract(p_name, '^[a-z]+ *wid([^ ]*)', 1) END AS rest, regexp_matches(p_name, '^[a-z]+ *wid') AS matched FROM part",
    "ub_compare_index": f"SELECT p_partkey, {_order('<>')} AS ne, {_order('<')} AS lt, {_order('>')} AS gt, {_order('<=')} AS le, {_order('>=')} AS ge FROM (SELECT p_partkey, p_name, {_mismatch('p_name', chr(39) + 'red widget' + chr(39))} AS m FROM part)",
    "ub_compare_slices": "SELECT p_partkey, " + ", ".join(f"CASE WHEN substring(p_name, 2, 4) {op} 'ed w' THEN CAST(1 + coalesce({_mismatch('substring(p_name, 2, 4)', chr(39) + 'ed w' + chr(39))}, 4) AS BIGINT) END AS {n}" for n, op in (("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="))) + " FROM part",
    "ub_char_order": "SELECT p_partkey, a = b AND b = 't' AS eq, a <> b AND a <> 't' AND b <> 't' AS ne, a < b AND b < 't' AS lt, a > b AND b > 't' AS gt, a <= b AND b <= 't' AS le, a >= b AND b >= 't' AS ge FROM (SELECT p_partkey, substring(p_name, 1, 1) AS a, substring(p_name, -1, 1) AS b FROM part)",
    "ub_equal_slices": "SELECT p_partkey, substring(p_name, 1, 3) = 'red' AS same, CASE WHEN substring(p_name, 1, 3) <> 'red' THEN CAST(CASE WHEN substring(p_name, 1, 1) <> 'r' THEN 0 WHEN substring(p_name, 2, 1) <> 'e' THEN 1 ELSE 2 END AS BIGINT) END AS at FROM part",
    "ub_case": f"SELECT doc_id, md5(translate(text, {_LOW}, {_UP})) AS up, md5(translate(text, {_UP}, {_LOW})) AS down FROM documents",
    "ub_capitalize": "SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE substring(o_orderpriority, 1, 3) || lower(substring(o_orderpriority, 4)) END AS said FROM orders",
    "ub_chars": "SELECT p_partkey, substring(p_brand, 7, 1) AS c, CAST(ascii(substring(p_brand, 7, 1)) AS BIGINT) AS code, false AS alpha, true AS alnum, CAST(substring(p_brand, 7, 1) AS BIGINT) AS weight, true AS upper, false AS lower FROM part",
    "ub_translate": "SELECT p_partkey, translate(p_name, 'ae', 'u3') AS said FROM part",
    "ub_round_trip": "SELECT p_partkey, p_name AS said, '0061FF' AS codes FROM part",
    "ub_subseq": "SELECT p_partkey, substring(p_name, 3, 4) AS said, ltrim(p_name, 'r') AS trimmed FROM part",
    "lines_split": f"SELECT doc_id, line_no, line FROM {_LINES}",
    "line_offsets": f'SELECT doc_id, line_no, "offset" FROM {_OFFSETS}',
    "lines_of_files": """SELECT c_mktsegment AS segment, CAST(3 * count(*) + 1 AS BIGINT) AS n, CAST(sum(b) + 1 AS BIGINT) AS chars, CAST(sum(b) AS BIGINT) AS last, CAST(count(*) + 1 AS BIGINT) AS blank
  FROM (SELECT c_mktsegment, length(c_custkey || ' ' || c_name) + length(c_mktsegment) + 3 AS b FROM customer) GROUP BY c_mktsegment""",
    "lines_from_position": f'SELECT doc_id, line_no, substring(line, CAST(greatest(100 - "offset", 0) AS BIGINT) + 1) AS line, greatest("offset", 100) AS "offset" FROM {_OFFSETS} WHERE "offset" + length(line) >= 100',
}
