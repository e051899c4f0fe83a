"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, fill_in_middle, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, topk_search, toxicity, turn_repair
from .common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_windows(rows.unionByName(more)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.by_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.by_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(turn_repair.edits(turn_repair.damaged(table(spark, sf_dir, "conversations"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), packed=True))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_token_counts, op4_toxicity, op5_chat_format, op6_packing, op7_simhash, op8_topk_search, op9_quality_rules, op10_quality_classifier, op11_fill_in_middle, op12_turn_repair, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_line_dedup": OP2_SQL, "op8_topk_search": OP8_SQL, "op9_quality_rules": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_turn_repair": OP12_SQL}


OP1_SQL = rf"""
WITH s AS (
  SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
laid AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size, k) - size AS start FROM s),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([3.0::DOUBLE, 1.0, 2.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER) AS weight
  FROM s GROUP BY source),
lev AS (
  SELECT *, ({mixing.SHARE}::DOUBLE * sum(source_size) OVER ()
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
tgt AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size <= level * weight THEN 2.0 * source_size::DOUBLE
              ELSE weight * min_by(level, source_size / weight) FILTER (WHERE 2 * source_size > level * weight) OVER () END AS target
  FROM lev),
edges AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY source DESC NULLS FIRST) = 1 THEN {mixing.POINTS}
                 ELSE floor(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () * {mixing.POINTS})::BIGINT END AS high
  FROM tgt WHERE target > 0),
ranges AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low FROM edges),
slots AS (
  SELECT (i % 2147483648 * {mixing.GOLDEN}) % {mixing.POINTS} AS point
  FROM range((SELECT floor(sum(target) / {mixing.BLOCK_WORDS})::BIGINT FROM tgt)) AS r(i)),
used AS (SELECT source, count(*) AS n FROM slots JOIN ranges ON point >= low AND point < high GROUP BY source),
plan AS (
  SELECT t.source, source_size, target, ceil(source_size / {mixing.BLOCK_WORDS})::BIGINT AS blocks, coalesce(n, 0) AS n
  FROM tgt t LEFT JOIN used u ON t.source IS NOT DISTINCT FROM u.source),
passes AS (SELECT *, least(n, 2 * blocks) AS m FROM plan)
SELECT doc_id, size, source_size, target,
       CASE WHEN blocks = 0 THEN 0 ELSE m // blocks * size + greatest(0, least(start + size, m % blocks * {mixing.BLOCK_WORDS}) - start) END::BIGINT AS taken
FROM laid l JOIN passes p ON l.source IS NOT DISTINCT FROM p.source
"""

OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
content AS (
  SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k,
         lead(t, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS t1, lead(t, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS t2
  FROM lines WHERE t <> ''),
windows AS (
  SELECT doc_id, k, {line_dedup.SPAN} AS span, t, t1, t2 FROM content WHERE t2 IS NOT NULL),
firsts AS (SELECT *, first_value((doc_id, k)) OVER (PARTITION BY span, t, t1, t2 ORDER BY doc_id, k) AS f FROM windows),
covered AS (
  SELECT DISTINCT doc_id, k + d AS k
  FROM firsts, range({line_dedup.SPAN}) AS o(d)
  WHERE (doc_id, k) > f AND d < span AND (f[1] <> doc_id OR k + d >= f[2] + span)),
kept AS (
  SELECT l.doc_id, l.pos, l.line, v.k IS NOT NULL AS gone, c.k AS ck
  FROM lines l LEFT JOIN content c USING (doc_id, pos) LEFT JOIN covered v ON v.doc_id = c.doc_id AND v.k = c.k),
m AS (
  SELECT doc_id, count(ck)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM kept GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN text ELSE rest END AS text FROM m JOIN documents USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q, v c WHERE c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP9_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT k, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
windows AS (
  SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM s)),
repeated AS (SELECT *, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM windows),
covered AS (
  SELECT k, count(DISTINCT i + d) AS n_repeat_words
  FROM repeated, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY k),
m AS (
  SELECT doc_id,
         len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '\p{{Lu}}', '', 'g')) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS not_upper,
         length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS upper,
         len(list_filter(w, lambda x: list_contains(string_split('{" ".join(quality_rules.STOP_WORDS)}', ' '), rtrim(lower(x), '.,;:!?')))) AS n_stop
  FROM s LEFT JOIN covered USING (k)),
r AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN upper + not_upper > 0 THEN upper::DOUBLE / (upper + not_upper) ELSE 0 END AS upper_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(
           test for rule in quality_rules.RULES for test in (
               [f"{rule.metric} >= {rule.low}"] if rule.low is not None else []) + (
               [f"{rule.metric} <= {rule.high}"] if rule.high is not None else []))} AS kept
FROM r
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS d
  FROM t),
c AS (
  SELECT *, len(tokens) AS n, least(d[1] % (len(tokens) + 1), d[2] % (len(tokens) + 1)) AS low, greatest(d[1] % (len(tokens) + 1), d[2] % (len(tokens) + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM s),
p AS (
  SELECT *, array_to_string(tokens[:low], '') AS prefix, array_to_string(tokens[low + 1:high], '') AS middle, array_to_string(tokens[high + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
drawn AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b:
              list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda z: z::BIGINT)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 20 AS draw
  FROM src),
broken AS (
  SELECT c, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM broken),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY c ORDER BY i) AS prior FROM placed),
r AS (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM seen),
rows_of AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END::BIGINT AS t FROM r),
convs AS (SELECT c, any_value(conv_id) AS conv_id FROM src GROUP BY c),
n_of AS (SELECT convs.c, conv_id, count(i)::BIGINT AS n FROM convs LEFT JOIN rows_of USING (c) GROUP BY convs.c, conv_id),
-- costs to go by state: nothing yet, behind system, user, assistant
go(c, i, f) AS (
  SELECT c, n + 1, [0, 6, 3, 0]::BIGINT[] FROM n_of
  UNION ALL
  SELECT c, i, [least(g[1], 3 + least(g[3], 3 + g[4])), least(g[2], 3 + least(g[3], 3 + g[4])), least(g[3], 3 + g[4]), least(g[4], 3 + g[3])]
  FROM (
    SELECT go.c, q.i, [
      least(f[1] + 4, CASE WHEN gone THEN 1000000000 WHEN ini = 's' THEN least(f[2], 3 + f[3]) + t WHEN ini = 'u' THEN f[3] + t ELSE 3 + f[3] + t END),
      least(f[2] + 4, CASE WHEN gone THEN 1000000000 WHEN ini = 'u' THEN f[3] + t ELSE 3 + f[3] + t END),
      least(f[3] + 4, CASE WHEN gone THEN 1000000000 WHEN ini = 'a' THEN f[4] + t ELSE 3 + f[4] + t END),
      least(f[4] + 4, CASE WHEN gone THEN 1000000000 WHEN ini = 'u' THEN f[3] + t ELSE 3 + f[3] + t END)] AS g
    FROM go JOIN rows_of q ON q.c = go.c AND q.i = go.i - 1) x),
-- the walk; grown is the state behind an inserted turn
walk(c, i, s, audit, told) AS (
  SELECT c, 1::BIGINT, 1::BIGINT, '', []::VARCHAR[] FROM n_of
  UNION ALL
  SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE grown END, audit || e,
         CASE e WHEN 'D' THEN told WHEN 'K' THEN list_append(told, role || ':' || text) WHEN 'R' THEN list_append(told, called || ':' || text) ELSE list_append(told, called || ':') END
  FROM (
    SELECT *, CASE WHEN role IS NOT NULL AND after[s] + 4 = now[s] THEN 'D' WHEN now[grown] + 3 = now[s] THEN 'I' WHEN after[kept] + t = now[s] THEN 'K' ELSE 'R' END AS e,
           CASE grown WHEN 3 THEN 'user' ELSE 'assistant' END AS called
    FROM (
      SELECT w.*, h.f AS now, a.f AS after, q.role, q.text, q.t, CASE w.s WHEN 3 THEN 4 ELSE 3 END::BIGINT AS grown,
             CASE WHEN gone THEN NULL WHEN w.s = 1 AND ini = 's' THEN 2 WHEN w.s <> 3 AND ini = 'u' THEN 3 WHEN w.s = 3 AND ini = 'a' THEN 4 END::BIGINT AS kept
      FROM walk w JOIN go h ON h.c = w.c AND h.i = w.i LEFT JOIN go a ON a.c = w.c AND a.i = w.i + 1 LEFT JOIN rows_of q ON q.c = w.c AND q.i = w.i) y
    WHERE role IS NOT NULL OR now[s] > 0) z),
ended AS (SELECT w.c, audit, told FROM walk w JOIN n_of USING (c) WHERE i = n + 1 AND s IN (1, 4)),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(coalesce(fault = 'blank', false))::BIGINT AS blank, count_if(coalesce(fault = 'duplicate', false))::BIGINT AS duplicate,
         count_if(coalesce(fault = 'truncated', false))::BIGINT AS truncated, count_if(coalesce(i > 1 AND left(prior, 1) || ini NOT IN ('su', 'ua', 'au'), false))::BIGINT AS illegal
  FROM n_of LEFT JOIN rows_of USING (c) GROUP BY c)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, f[1] AS cost, audit, sha256(array_to_string(told, chr(10))) AS repaired_sha256
FROM n_of JOIN counts USING (c) JOIN go ON go.c = n_of.c AND go.i = 1 JOIN ended ON ended.c = n_of.c
"""
