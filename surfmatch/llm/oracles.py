"""SQL for the manifest and the conversation repair, by plain recursion over levels and over turns."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(s, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda s, b: {byte}), 4294967295::UBIGINT)"


def field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def row_digest(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def levels(start: str) -> str:
    """All nodes of all trees of start(tree, pos, digest, n), level by level; n nodes on a level."""
    return f"""SELECT tree, 0 AS level, pos, digest, n FROM {start} UNION ALL
SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {{nodes}} WHERE n > 1 GROUP BY tree, level, pos // 2"""


def paths(start: str, nodes: str) -> str:
    """Of every leaf of start the list of its siblings, L or R by their side, N where there is none."""
    return f"""SELECT f.k, list(CASE WHEN s.digest IS NULL THEN 'N' WHEN (f.pos >> l.level) % 2 = 1 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY l.level) FILTER (l.level IS NOT NULL) AS path
FROM {start} f LEFT JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE n > 1) l ON l.tree = f.tree
LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = l.level AND s.pos = xor(f.pos >> l.level, 1) GROUP BY f.k"""


MANIFEST = f"""WITH RECURSIVE
made AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {row_digest()} AS digest,
CASE WHEN {crc32("coalesce(doc_id::VARCHAR, 'none')")} % 7 = 0 AND doc_id IS NOT NULL THEN {row_digest("(n_chars::HUGEINT + 1)")} END AS version FROM documents),
leaf AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, digest) AS k,
row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM made),
nodes AS ({levels("leaf").format(nodes="nodes")}),
subs AS (SELECT tree AS k, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS ({levels("subs").format(nodes="upper")}),
low AS ({paths("leaf", "nodes")}), high AS ({paths("subs", "upper")}),
whole AS (SELECT f.doc_id, f.digest AS leaf, s.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root, coalesce(f.version, f.digest) AS start,
list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path FROM leaf f JOIN subs s ON s.k = f.tree JOIN low ON low.k = f.k JOIN high ON high.k = f.tree),
folded AS (SELECT *, list_reduce(list_prepend(start, path), lambda d, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || d) WHEN 'R' THEN sha256(d || s[2:]) ELSE sha256(d) END) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

CONVERSATIONS = f"""WITH RECURSIVE
given AS (SELECT *, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind, coalesce(conv_id::VARCHAR, 'none') AS c FROM conversations),
kept AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM given WHERE kind <> 0),
placed AS (SELECT *, role[1] AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM kept),
turns AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM placed),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY c),
steps(state, role, target) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
filled(state, target, edits, lines) AS (VALUES ('-', '-', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
('-', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']), ('a', 'u', 'I', ['user:']), ('-', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])),
due(state, target, role) AS (VALUES ('-', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
edits AS (SELECT c, i, s.state, s.state AS target, 4 AS cost, 'D' AS edit, []::VARCHAR[] AS lines FROM turns, (SELECT DISTINCT state FROM due) s
UNION ALL SELECT c, i, s.state, s.target, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', [turns.role || ':' || text] FROM turns JOIN steps s ON s.role = initial WHERE fault NOT IN ('b', 'd')
UNION ALL SELECT c, i, s.state, s.target, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', [s.role || ':' || text] FROM turns, due s WHERE fault NOT IN ('b', 'd')),
moves AS (SELECT c, i, f.state, e.target, e.cost + 3 * length(f.edits) AS cost, f.edits || e.edit AS edits, list_concat(f.lines, e.lines) AS lines FROM edits e JOIN filled f ON f.target = e.state),
walk AS (SELECT DISTINCT c, 0::BIGINT AS i, '-' AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM given
UNION ALL SELECT w.c, w.i + 1, m.target, min({{'cost': (w.best.cost + m.cost)::BIGINT, 'audit': w.best.audit || m.edits, 'lines': list_concat(w.best.lines, m.lines)}})
FROM walk w JOIN moves m ON m.c = w.c AND m.i = w.i + 1 AND m.state = w.state GROUP BY w.c, w.i, m.target),
last AS (SELECT w.c, min({{'cost': (w.best.cost + 3 * length(f.edits))::BIGINT, 'audit': w.best.audit || f.edits, 'lines': list_concat(w.best.lines, f.lines)}}) AS best
FROM walk w LEFT JOIN counts USING (c) JOIN filled f USING (state) WHERE w.i = coalesce(counts.n, 0) AND f.target IN ('-', 'a') GROUP BY w.c)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM given) g LEFT JOIN counts USING (c) JOIN last USING (c)"""
