"""One query for each operator, over its whole table, with production parameters; and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import block_dedup, chat, decontam, jaccard, license_scan, line_templates, lm, mixing, oracles, prefix_trie, quality, suffix_dedup, url_filter, vector_codes
from barloom.llm.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    return chat.digest(chat.format_conversations(messages))


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    shared_folder(spark)
    documents, _ = mixing.mix_sources(table(spark, folder, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("spans")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return quality.score_documents(docs, model)


def op5_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.digest(table(spark, folder, "documents"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(table(spark, folder, "documents"))


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_documents(table(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return block_dedup.remove_repeats(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), slop=decontam.SLOP))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encode(table(spark, folder, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(table(spark, folder, "conversations"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_source_mixing": op2_source_mixing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_templates": op5_line_templates,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_url_filter": op12_url_filter,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS er,
    replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS et FROM rows),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, er, et) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, er, et), '') AS loss,
    sum(14 + length(er) + length(et)) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
    "op2_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, CAST(source_size * 2 AS DOUBLE) AS most FROM s),
r AS (SELECT *, most / weight AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5
      - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL THEN most ELSE least(most, v.level * weight) END AS target FROM l, v),
e AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
    sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high, sum(target) OVER () AS whole FROM t),
n AS (SELECT CAST(ceil(coalesce(max(whole), 0) / 1024) AS BIGINT) AS n_slots FROM e),
u AS (SELECT slot, fmod(slot * CAST(0.6180339887498949 AS DOUBLE), 1) AS u FROM (SELECT unnest(range(n_slots)) AS slot FROM n)),
sl AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block FROM u JOIN e ON u * whole >= low AND u * whole < high),
given AS (SELECT e.source, count(sl.slot) AS k FROM e LEFT JOIN sl ON e.source IS NOT DISTINCT FROM sl.source GROUP BY e.source),
sched AS (
  SELECT slot, source, block FROM sl
  UNION ALL SELECT n_slots, e.source, unnest(range(k, (goal + 1023) // 1024)) FROM e JOIN given ON e.source IS NOT DISTINCT FROM given.source, n),
p AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.source, d.size, e.source_size, e.target, e.goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
x AS (SELECT r, source, goal, CAST(a + pass * source_size AS BIGINT) AS b, CAST(a + pass * source_size + size AS BIGINT) AS c FROM p, (VALUES (0), (1)) v(pass) WHERE size > 0 AND a + pass * source_size < goal),
y AS (SELECT *, unnest(range(b // 1024, (c - 1) // 1024 + 1)) AS block FROM x),
z AS (
  SELECT r, sum(least(c, (y.block + 1) * 1024, goal) - greatest(b, y.block * 1024)) AS taken, min(slot) AS first_slot, count(*) AS n_slots
  FROM y JOIN sched ON y.source IS NOT DISTINCT FROM sched.source AND y.block = sched.block WHERE y.block * 1024 < goal GROUP BY r)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots
FROM p LEFT JOIN z USING (r)""",
    "op5_line_templates": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, text FROM documents),
l0 AS (SELECT r, id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
l1 AS (SELECT *, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS fields, trim(line, ' ') <> '' AS filled FROM l0),
l2 AS (SELECT *, CASE WHEN regexp_matches(line, '[0-9]') AND len(list_filter(string_split(fields, ' '), lambda x: x <> '<*>' AND x <> '')) < 3 THEN line ELSE fields END AS masked FROM l1),
l AS (SELECT *, string_split(masked, ' ') AS tok, len(string_split(masked, ' ')) AS n, array_to_string(string_split(masked, ' ')[1:3], ' ') AS lead FROM l2),
own AS (SELECT DISTINCT id, text, n, lead, masked, tok FROM l WHERE filled),
leaf AS (SELECT n, lead, count(*) AS total FROM own GROUP BY n, lead HAVING count(*) >= 5),
m AS (SELECT n, lead, masked, any_value(tok) AS tok, count(*) AS docs, min(id) AS first, any_value(total) AS total FROM own JOIN leaf USING (n, lead) GROUP BY n, lead, masked),
p AS (SELECT n, lead, masked, docs, first, total, len(list_filter(tok, lambda x: x <> '<*>' AND x <> '')) AS size, unnest(tok) AS token, generate_subscripts(tok, 1) AS pos FROM m),
c AS (SELECT n, lead, pos, token FROM p GROUP BY n, lead, pos, token HAVING sum(docs) >= greatest(5, max(total) * CAST(0.1 AS DOUBLE))),
s AS (
  SELECT n, lead, masked, docs, first, size, string_agg(pos || ':' || token, ' ' ORDER BY pos) AS fixed, count(*) FILTER (token <> '<*>' AND token <> '') AS k
  FROM p JOIN c USING (n, lead, pos, token) GROUP BY n, lead, masked, docs, first, size),
t AS (SELECT *, sum(docs) OVER (PARTITION BY n, lead, fixed) AS total, min(first) OVER (PARTITION BY n, lead, fixed) AS keeper FROM s WHERE k >= CAST(0.7 AS DOUBLE) * size AND k >= 3),
g AS (SELECT masked, n, lead, min(keeper) AS keeper FROM (SELECT masked, n, lead, keeper FROM t WHERE total >= 5 UNION ALL SELECT masked, n, lead, first FROM m WHERE docs >= 5) GROUP BY ALL),
k AS (SELECT l.*, l.filled AND g.keeper IS NOT NULL AND l.id > g.keeper AS gone FROM l LEFT JOIN g USING (n, lead, masked)),
a AS (
  SELECT r, count(*) FILTER (filled) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone) AS kept FROM k GROUP BY r)
SELECT d.doc_id, CAST(coalesce(a.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)""",
    "op8_license_scan": license_scan.oracle(),
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM p),
m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM h JOIN m USING (k) WHERE first < doc_id),
g AS (SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op10_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw WHERE len(w) > 0),
hits AS (
  SELECT pos.doc_id, win.item_id, pos.i, win.n FROM pos JOIN lens ON pos.i + lens.n - 1 <= len(pos.w)
  JOIN win ON win.n = lens.n AND win.phrase = array_to_string(pos.w[pos.i : pos.i + lens.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id),
posn AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM dw),
freq AS (SELECT word, count(*) AS c FROM posn GROUP BY word),
term AS (SELECT phrase, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS off FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS t FROM win WHERE n = 10)),
lead AS (SELECT phrase, arg_min(off, c * 100 + off) AS off, arg_min(word, c * 100 + off) AS word FROM term LEFT JOIN freq USING (word) GROUP BY phrase HAVING count(c) = 10),
cand AS (SELECT DISTINCT phrase, doc_id, i - off + unnest([-1, 0, 1]) AS s FROM lead JOIN posn USING (word)),
close AS (SELECT c.phrase, c.doc_id, s FROM (SELECT *, s + off + unnest([-1, 0, 1]) AS i FROM cand JOIN term USING (phrase)) c JOIN posn p ON p.doc_id = c.doc_id AND p.i = c.i AND p.word = c.word GROUP BY ALL HAVING count(DISTINCT off) = 10),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN win ON win.phrase = close.phrase AND win.n = 10 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op11_vector_codes": oracles.vector_codes(),
    "op12_url_filter": oracles.url_filter(),
    "op13_prefix_trie": oracles.PREFIX_TRIE,
}
