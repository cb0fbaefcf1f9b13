"""DuckDB SQL of the operators on vectors, URLs and conversations."""

from barloom.llm.url_filter import ALLOW, BIN, BLOCK, END, FOLDS, MOST_BIN, ODD, ORDER, OTHER, RULES, START, UNIT


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Vectors of one length that parts divides."""

    def assigned(k: int) -> str:
        return f"""
d{k} AS (SELECT r, pt.p, e, CAST(list_sum(list_transform(list_zip(pt.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM pt JOIN c{k} c ON pt.p = c.p),
a{k} AS (SELECT r, p, min(d * {entries} + e) % {entries} AS e, min(d) AS d FROM d{k} GROUP BY r, p),"""

    def moved(k: int) -> str:
        return f"""
s{k} AS (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k} a JOIN pt ON a.r = pt.r AND a.p = pt.p) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY p, e),
c{k + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e),"""

    steps = "".join(assigned(k) + moved(k) for k in range(rounds)) + assigned(rounds)
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
c0 AS (SELECT p, r AS e, x FROM pt WHERE r < {entries}),{steps}
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
t AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM t JOIN k USING (r), b"""


def url_filter() -> str:
    """The rules and both character models."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(rules))
    rule = "CASE " + cases.format(*(h + p for _, h, p in rules)) + " END"
    ruled = "CASE " + cases.format(*(k for k, _, _ in rules)) + " END"

    def chance(c: str) -> str:
        return f"CASE WHEN n_{c} = 0 THEN p_{c} ELSE ({c} + t_{c} * p_{c}) / (n_{c} + t_{c}) END AS p_{c}"

    levels = ""
    for k in range(ORDER + 1):
        before = "base" if k == 0 else f"f{k - 1} ON right(l.gram, {k}) = f{k - 1}.gram"
        levels += f"""
l{k} AS (SELECT *, sum(good) OVER c AS n_good, sum(bad) OVER c AS n_bad, count(*) FILTER (good > 0) OVER c AS t_good, count(*) FILTER (bad > 0) OVER c AS t_bad
  FROM (SELECT right(gram, {k + 1}) AS gram, CAST(sum(good) AS DOUBLE) AS good, CAST(sum(bad) AS DOUBLE) AS bad FROM counts GROUP BY ALL) WINDOW c AS (PARTITION BY left(gram, {k}))),
f{k} AS (SELECT l.gram, {chance("good")}, {chance("bad")} FROM l{k} l JOIN {before}{" ON true" if k == 0 else ""}),"""
    start, end = "chr(2)", "chr(3)"
    assert (START, END) == ("\x02", "\x03")
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {rule} AS rule, {ruled} AS ruled, ('0x' || left(md5(host || path), 7))::BIGINT % {FOLDS} = 0 AS held,
  repeat({start}, {ORDER}) || regexp_replace(host || path, '{ODD}', '{OTHER}', 'g') || {end} AS padded FROM h),
g AS (SELECT r, held, ruled, substr(padded, i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(padded) - {ORDER} + 1)) AS i FROM j)),
counts AS (SELECT gram, count(*) FILTER (NOT held AND ruled = '{ALLOW}') AS good, count(*) FILTER (NOT held AND ruled = '{BLOCK}') AS bad FROM g GROUP BY gram),
base AS (SELECT 1::DOUBLE / (count(*) FILTER (n > 0) + 1) AS p_good, 1::DOUBLE / (count(*) FILTER (n > 0) + 1) AS p_bad FROM (SELECT right(gram, 1) AS c, sum(good + bad) AS n FROM counts GROUP BY c)),{levels}
w AS (SELECT gram, CAST(round((ln(p_good) - ln(p_bad)) * {UNIT}) AS BIGINT) AS weight FROM f{ORDER}),
s AS (SELECT r, CAST(sum(weight) AS BIGINT) AS score, count(*) AS n FROM g JOIN w USING (gram) GROUP BY r),
b AS (SELECT *, least(greatest(CAST(floor(CAST(score AS DOUBLE) / (n * {BIN})) AS BIGINT), -{MOST_BIN}), {MOST_BIN}) AS step FROM s JOIN j USING (r)),
c AS (SELECT step, count(*) FILTER (ruled = '{ALLOW}') AS a, count(*) FILTER (ruled = '{BLOCK}') AS b FROM b WHERE held AND ruled IS NOT NULL GROUP BY step),
d AS (SELECT step, sum(a) AS a, sum(b) AS b FROM (SELECT * FROM c UNION ALL SELECT step + 1, 0, 0 FROM c) GROUP BY step),
e AS (SELECT x.step, (SELECT sum(a) FROM d) AS na, (SELECT sum(b) FROM d) AS nb, coalesce((SELECT sum(a) FROM d WHERE step < x.step), 0) AS pa, coalesce((SELECT sum(b) FROM d WHERE step < x.step), 0) AS pb FROM d x),
t AS (SELECT step FROM e WHERE na > 0 AND nb > 0 ORDER BY (na - pa) * nb + pb * na DESC, abs(step), step LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN step >= coalesce((SELECT step FROM t), 0) THEN '{ALLOW}' ELSE '{BLOCK}' END) AS verdict,
  CAST(floor(CAST(score AS DOUBLE) / n) AS BIGINT) AS score, n AS n_chars FROM b"""


PREFIX_TRIE = """
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
told AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM told),
fact AS (
  SELECT c, c - c % 5 AS base, coalesce(xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9, 0) AS h FROM ids, tab),
part AS (
  SELECT fact.c, 0 AS half, pos, role, text FROM fact JOIN told ON told.c = base AND pos <= h
  UNION ALL SELECT fact.c, 1, pos, role, text FROM fact JOIN told ON told.c IS NOT DISTINCT FROM fact.c AND pos > h),
re AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY half, pos) AS d, md5(strlen(role) || ':' || role || text) AS turn, strlen(text) AS n_bytes FROM part),
path AS (
  SELECT c, 0 AS d, '' AS k, 0 AS n_bytes FROM fact
  UNION ALL SELECT c, d, array_to_string(list(turn) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ''), n_bytes FROM re),
last AS (SELECT c, max(d) AS d FROM path GROUP BY c),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved, CASE WHEN d > 0 THEN left(k, 32 * (d - 1)::INT) END AS up FROM path GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
tot AS (SELECT a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved FROM full_node a JOIN full_node b ON b.d >= a.d AND starts_with(b.k, a.k) GROUP BY a.k),
fin AS (SELECT k, string_agg(coalesce(CAST(path.c AS VARCHAR), ''), ',' ORDER BY path.c NULLS LAST) AS ends FROM path JOIN last ON path.c IS NOT DISTINCT FROM last.c AND path.d = last.d GROUP BY k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(tot.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_node n JOIN tot USING (k) LEFT JOIN node p ON p.k = n.up LEFT JOIN fin ON fin.k = n.k"""
