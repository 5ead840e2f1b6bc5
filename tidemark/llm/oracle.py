"""DuckDB SQL for the queries of operators 4, 9 and 11 to 13."""

from __future__ import annotations

from tidemark.llm.manifest import ARITY

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS k FROM starts),
least AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM windows JOIN least USING (k) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(n, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.n, link.b FROM reach JOIN link ON link.a = reach.c),
root AS (SELECT n, min(c) AS c FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept FROM v JOIN root ON root.n = vec_id LEFT JOIN degree ON a = vec_id"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS s,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [a, b, c, s, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, i, [ascii(o[j]) - 64 FOR j IN range(1, i)] AS before, ascii(o[i]) - 64 AS own FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS i)),
each AS (SELECT *, list_bool_or(list_prepend(false, [fails[j] FOR j IN before])) AS gone, fails[own] AS hit, len(list_filter(fails, lambda x: x)) = 1 AS lone FROM m, steps),
summed AS (SELECT part, o AS filter_order, i AS step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND lone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM summed"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item, least(len(w), 10) AS n, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM iw),
lengths AS (SELECT DISTINCT n FROM windows),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM dw),
found AS (SELECT doc_id, n, s, item FROM hits JOIN windows USING (n, k)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TAMPERED = "list_reduce(list_prepend(4294967295, flatten([[(ascii(c) >> b) & 1 FOR b IN range(8)] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))"


def _climb(name: str, levels: int) -> str:
    """CTEs ``name1`` to ``name{levels}`` over ``name0`` (tree, pos, digest): parents of sixteen; a tree of one node stays as it is."""
    return ",\n".join(
        f"{name}{i + 1} AS (SELECT tree, pos // {ARITY} AS pos, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{i}) GROUP BY tree, pos // {ARITY})"
        for i in range(levels)
    )


def _siblings(name: str, levels: int, rows: str) -> str:
    """CTEs ``{name}_s{i}``: ``rows`` (doc_id, tree, pos, proof, seen) with the siblings of level i appended to proof and folded into seen."""
    out, last = [], rows
    for i in range(levels):
        out.append(
            f"{name}_s{i} AS (SELECT r.doc_id, r.tree, r.pos // {ARITY} AS pos, r.proof || coalesce(b, '') || coalesce(a, '') AS proof, "
            f"CASE WHEN n = 1 THEN r.seen ELSE sha256(coalesce(b, '') || r.seen || coalesce(a, '')) END AS seen FROM {last} r JOIN "
            f"(SELECT tree, pos, count(*) OVER (PARTITION BY tree) AS n, string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, "
            f"string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM {name}{i} WINDOW w AS (PARTITION BY tree, pos // {ARITY} ORDER BY pos)) x "
            f"ON r.tree = x.tree AND r.pos = x.pos)"
        )
        last = f"{name}_s{i}"
    return ",\n".join(out)


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: Five levels: up to a million rows a source and a million sources.
OP13 = rf"""
WITH d AS (SELECT *, xor({_TAMPERED}, 4294967295) % 5 = 0 AS bad, coalesce('=' || source, '') AS tree FROM documents),
leaves AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, {_leaf('text')} AS digest,
  CASE WHEN bad THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS seen FROM d),
l0 AS (SELECT tree, pos, digest FROM leaves),
{_climb('l', 5)},
t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, tree AS source FROM l5),
{_climb('t', 5)},
start AS (SELECT doc_id, tree, pos, '' AS proof, seen FROM leaves),
{_siblings('l', 5, 'start')},
turn AS (SELECT doc_id, '' AS tree, t0.pos AS pos, proof, seen FROM l_s4 r JOIN t0 ON r.tree = t0.source),
{_siblings('t', 5, 'turn')}
SELECT doc_id, leaves.digest AS leaf, l5.digest AS subroot, t5.digest AS root, sha256(proof) AS proof_sha256, t_s4.seen AS folded_root, t_s4.seen = t5.digest AS verified
FROM leaves JOIN l5 USING (tree) JOIN t_s4 USING (doc_id) CROSS JOIN t5"""
