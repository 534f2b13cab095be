"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_SPANS = """list_transform(range(1, len({m}) + 1), lambda i: {{'k': '{kind}', 'r': {rank}, 'inner': {inner}[i], 'm': {m}[i],
    's': CAST(list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)}})"""


def _secrets() -> str:
    from corpusmill.llm.secrets import ACCESS, ALLOWED, ASSIGN, CANDIDATE, CLASSES, HEX

    plain = lambda p: p.replace("(?:[/", "([/").replace("++", "+").replace("*+", "*")  # noqa: E731  RE2 has no possessive loops and needs none
    q = lambda p: "'" + plain(p).replace("'", "''") + "'"
    kinds = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("entropy", CANDIDATE, 0))
    cols = ", ".join(f"regexp_extract_all(t, {q(p)}, 0) AS m{i}, regexp_extract_all(t, {q(p)}, {g}) AS i{i}, string_split_regex(t, {q(p)}) AS g{i}" for i, (_, p, g) in enumerate(kinds))
    lists = ", ".join(_SPANS.format(m=f"m{i}", inner=f"i{i}", g=f"g{i}", kind=k, rank=i) + f" AS s{i}" for i, (k, _, _) in enumerate(kinds))
    # RE2 has no back-references: a character seven more times in a row is tested by splitting windows of eight.
    allowed = " OR ".join(f"regexp_matches(x.m, {q(p)})" for p in ALLOWED if "\\1" not in p)
    allowed += " OR len(list_filter(range(1, length(x.m) - 6), lambda j: len(list_distinct(string_split(substring(x.m, j, 8), ''))) = 1)) > 0"
    limit = "CASE " + " ".join(f"WHEN regexp_matches(x.m, {q(p)}) THEN {b}" for _, p, b in CLASSES) + " END"
    weight = "list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (length(w) - length(replace(w, c, ''))) * log2(length(w) - length(replace(w, c, '')))))"
    peak = f"list_max(list_transform(list_transform(range(1, length(x.m) - 18), lambda j: substring(x.m, j, 20)), lambda w: log2(20) - {weight} / 20))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, {cols} FROM d),
s AS (SELECT doc_id, {lists} FROM r),
f AS (SELECT doc_id, list_filter(s0, lambda x: length(x.inner) >= 8) AS a, s1 AS b, s2 AS c,
             list_filter(s3, lambda x: NOT ({allowed}) AND {peak} >= {limit}) AS e FROM s),
o AS (SELECT doc_id, len(a) AS n_assign, len(b) AS n_access, len(c) AS n_hex,
             list_sort(list_transform(a || b || c, lambda x: {{'s': x.s, 'r': x.r, 'e': x.s + length(x.m), 'k': x.k}})) AS base,
             list_sort(list_transform(a || b || c || e, lambda x: {{'s': x.s, 'r': x.r, 'e': x.s + length(x.m), 'k': x.k}})) AS every FROM f)
SELECT doc_id, n_assign, n_access, n_hex,
       sha256(coalesce(array_to_string(list_transform(base, lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')) AS base_sha256,
       coalesce(array_to_string(list_transform(every, lambda x: x.k || ':' || x.s || ':' || x.e), ','), '') AS spans
FROM o
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(lower(x), ''), lambda c: lpad(CAST(bin(strpos('0123456789abcdef', c) - 1) AS VARCHAR), 4, '0')), '') AS bits FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substring(bits, 5 * i + j + 1, 1) AS INTEGER) * (1 << (4 - j)))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

# A hexadecimal digest's first four groups of eight digits as integers.
_GROUP = "CAST(list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substring({h}, {at} + i, 1)) - 1) * CAST(pow(16, 8 - i) AS BIGINT))) AS BIGINT)"

FIM = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_GROUP.format(h="h", at=0)} AS h1, {_GROUP.format(h="h", at=8)} AS h2, {_GROUP.format(h="h", at=16)} AS h3, {_GROUP.format(h="h", at=24)} AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM r),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM p
"""


def _urls() -> str:
    from corpusmill.llm.urls import CANONICAL, CONTENT, HREF, OTHER_SCHEME, REFRESH, TAGS, WAIT, WITH_HOST

    q = lambda p: "'" + p.replace("'", "''") + "'"
    host = "lower(regexp_extract({r}, '^[^/?#]*'))"
    rest = "CASE WHEN strpos({u}, '://') > 0 THEN substring({u}, strpos({u}, '://') + 3) ELSE '' END"
    tail = "substring({r}, length(regexp_extract({r}, '^[^/?#]*')) + 1)"
    parts = lambda r: f"{host.format(r=r)} AS host, regexp_extract({tail.format(r=r)}, '^[^?#]*') AS path, regexp_extract({tail.format(r=r)}, '^[^#]*') AS query"
    bare = r"""trim(regexp_replace({x}, '^["'']|["'']$', '', 'g'), ' ' || chr(9) || chr(10) || chr(12) || chr(13))"""
    goal = f"""CASE WHEN regexp_matches(x, {q(CANONICAL)}) THEN {bare.format(x=f"regexp_extract(x, {q(HREF)}, 1)")}
        ELSE regexp_replace(regexp_extract({bare.format(x=f"regexp_extract(x, {q(CONTENT)}, 1)")}, {q(WAIT + '.+')}), {q(WAIT)}, '') END"""
    clean = "trim(replace({x}, '&amp;', '&'), ' ''\"' || chr(9) || chr(10) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
pg AS (SELECT page_id, url, html, {rest.format(u="url")} AS r FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)),
pages_cut AS (SELECT page_id, url, html, {parts("r")} FROM pg),
tags AS (SELECT host, path, query, unnest(regexp_extract_all(html, {q(TAGS)})) AS x FROM pages_cut),
goals AS (SELECT host, path, query, {clean.format(x="g")} AS g FROM (SELECT host, path, query, {goal} AS g FROM tags WHERE regexp_matches(x, {q(CANONICAL)}) OR regexp_matches(x, {q(REFRESH)}))),
targets AS (SELECT host || query AS u, host, path, CASE WHEN g = '' OR starts_with(g, '#') THEN NULL WHEN regexp_matches(g, {q(WITH_HOST)}) THEN g WHEN starts_with(g, '//') THEN 'http:' || g
    WHEN regexp_matches(g, {q(OTHER_SCHEME)}) THEN NULL WHEN starts_with(g, '/') THEN 'http://' || host || g WHEN starts_with(g, '?') THEN 'http://' || host || path || g
    ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || g END AS v FROM goals WHERE host <> ''),
ends AS (SELECT u, host, path, {rest.format(u="v")} AS r FROM targets WHERE v IS NOT NULL),
two AS (SELECT u, host AS u_host, path AS u_path, {parts("r")} FROM ends),
edges AS (SELECT DISTINCT u, u_host, u_path, host || query AS v, host, path FROM two WHERE host <> '' AND u <> host || query),
nodes AS (SELECT u AS node, u_host AS host, u_path AS path FROM edges UNION SELECT v, host, path FROM edges),
judged AS (SELECT node, (SELECT arg_max(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS verdict FROM nodes),
steps AS (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges),
bad(node) AS (SELECT node FROM judged WHERE verdict = 'block' UNION SELECT b FROM bad JOIN steps ON a = node),
found AS (SELECT page_id, host, path, query,
    (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT arg_max(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS verdict FROM pages_cut)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host <> '' AND host || query IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM found
"""


TRIE = """
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(n AS BIGINT))) AS tb),
own AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS BIGINT) AS pos,
               sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS sig, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM own),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(tb[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 6 AS h FROM ids, crc_table),
joined AS (SELECT h.conv_id, 0 AS part, pos, sig, chars FROM h JOIN own ON own.conv_id = h.base WHERE pos <= h
           UNION ALL SELECT h.conv_id, 1, pos, sig, chars FROM h JOIN own USING (conv_id) WHERE pos > h),
turns AS (SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS depth, chars, sha256(string_agg(sig, '') OVER w) AS node FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
member AS (SELECT conv_id, depth, chars, node FROM turns UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS length FROM member GROUP BY conv_id),
nodes AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                 string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM member JOIN lengths USING (conv_id) GROUP BY depth, node),
up AS (SELECT n.depth, n.node, n.conv_id, p.node AS parent, m.conv_id AS parent_conv_id FROM nodes n LEFT JOIN member p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes m ON m.node = p.node AND m.depth = n.depth - 1),
kids AS (SELECT parent, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT a.node AS top, n.node, n.n_convs, n.chars, k.n_children FROM nodes n JOIN member a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids k ON k.parent = n.node),
sums AS (SELECT top, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM above GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN up USING (node) JOIN sums s ON s.top = n.node LEFT JOIN kids k ON k.parent = n.node
"""

ORACLE_SQL = {
    "op3_exact_dedup": EXACT_DEDUP,
    "op5_line_dedup": LINE_DEDUP,
    "op7_topk": TOP_K,
    "op8_secrets": _secrets(),
    "op10_warc": WARC,
    "op11_fim": FIM,
    "op12_url_filter": _urls(),
    "op13_prefix_trie": TRIE,
}
