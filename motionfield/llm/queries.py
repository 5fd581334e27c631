"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokens
from .common import crc_mod
from .conversations import conversation_report
from .decontaminate import find_items
from .gru import lm_scores
from .itq import embedding_links
from .licenses import DIGESTS, HEADERS, NAMES, PHRASES, SPELLINGS, TEXTS, license_scan
from .linededup import line_dedup
from .mil import fit_attention, fit_noisy_or, labelled_sample, score_quality, score_toxicity
from .packing import pack
from .simhash import simhash_groups
from .substring import substring_dedup
from .warc import warc_round_trip


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most labelled rows that a classifier is fitted on.
FIT_ROWS = 16_000


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _judged(rows: DataFrame, threshold: float, *more: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *more)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_noisy_or(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", FIT_ROWS))
    return _judged(score_toxicity(docs, model).withColumnRenamed("id", "doc_id"), 0.5, "offending", "worst_sentence")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        F.when(F.col("mf_id") != F.lit(2**63 - 1), F.col("mf_id")).alias("doc_id"), "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated",
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_attention(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", FIT_ROWS))
    return _judged(score_quality(docs, model), 0.3, "top_passage")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_packing, op3_toxicity, op4_decontamination, op5_substring_dedup, op6_warc, op7_simhash, op8_lm_scoring, op9_license_scan, op10_quality, op11_token_alignment, op12_line_dedup, op13_conversation_repair, pipeline)}


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, o, o + size - 1), ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS o FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, o, array_to_string(list_slice(w, o, o + size - 1), ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS o FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.o, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + size)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, o, md5(array_to_string(list_slice(w, o, o + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS o FROM d WHERE len(w) >= 50)),
lead AS (SELECT h, min(doc_id) AS lead FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(o, o + 50)) AS p FROM win JOIN lead USING (h) WHERE doc_id > lead),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS lead FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > lead THEN lead END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


OP12_SQL = r"""
WITH l AS (SELECT doc_id, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents)),
held AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, p, line, coalesce(doc_id < keeper, false) AS gone FROM l LEFT JOIN held USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY 1
"""


#: Dynamic programming over rows and states (0 start, 1 system, 2 user, 3 assistant); crc32 bit by bit.
OP13_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS cv, turn, coalesce(turn::VARCHAR, ' ') AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(cv || ':' || t, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS d FROM src),
dm AS (SELECT cv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE d <> 0),
rw AS (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY turn NULLS FIRST, role, text, copy) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM dm),
f AS MATERIALIZED (SELECT cv, k, turn, role, text, role[1] AS a, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY cv, role, text ORDER BY k) > 1 THEN 'd' WHEN right(said, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault FROM rw),
ins(q, p, c, e, o) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
ed(p, a, r, e, c) AS (VALUES (0, '', 0, 'D', 3), (1, '', 1, 'D', 3), (2, '', 2, 'D', 3), (3, '', 3, 'D', 3), (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0), (0, '', 2, 'R', 2), (1, '', 2, 'R', 2), (2, '', 3, 'R', 2), (3, '', 2, 'R', 2)),
st AS MATERIALIZED (SELECT ins.q, ed.r, ins.c + ed.c AS c, ins.e || ed.e AS e, ins.o, ed.a, ed.e AS kind FROM ins JOIN ed USING (p)),
dp AS (SELECT DISTINCT cv, 0::BIGINT AS k, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS done FROM src
  UNION ALL SELECT cv, k, q, cost, audit, done FROM (
    SELECT dp.cv, f.k, st.r AS q, dp.cost + st.c + CASE WHEN kind <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost, dp.audit || st.e AS audit,
      dp.done || st.o || CASE kind WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE st.r WHEN 3 THEN 'assistant:' ELSE 'user:' END || text END AS done,
      row_number() OVER (PARTITION BY dp.cv, st.r ORDER BY dp.cost + st.c + CASE WHEN kind <> 'D' AND fault = 't' THEN 1 ELSE 0 END, dp.audit || st.e) AS rk
    FROM dp JOIN f ON f.cv = dp.cv AND f.k = dp.k + 1 JOIN st ON st.q = dp.q WHERE (kind = 'D' OR fault IN ('-', 't')) AND (kind <> 'K' OR f.a = st.a)) WHERE rk = 1),
n AS (SELECT cv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS b, count(*) FILTER (fault = 'd') AS d, count(*) FILTER (fault = 't') AS t FROM f GROUP BY 1),
bad AS (SELECT cv, count(*) AS illegal FROM (SELECT cv, k, lag(a) OVER (PARTITION BY cv ORDER BY k) || a AS two FROM f) WHERE k > 1 AND two NOT IN ('su', 'ua', 'au') GROUP BY 1),
best AS (SELECT cv, cost, audit, done FROM (SELECT dp.cv, cost + c AS cost, audit || e AS audit, done || o AS done, row_number() OVER (PARTITION BY dp.cv ORDER BY cost + c, audit || e) AS rk
  FROM dp LEFT JOIN n ON n.cv = dp.cv JOIN ins ON ins.q = dp.q WHERE dp.k = coalesce(n.n, 0) AND ins.p IN (0, 3)) WHERE rk = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(b, 0)::BIGINT AS blank, coalesce(d, 0)::BIGINT AS duplicate, coalesce(t, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(done[2:]) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cv FROM src) LEFT JOIN n USING (cv) LEFT JOIN bad USING (cv) JOIN best USING (cv)
"""


def _canonical_sql(column: str) -> str:
    t = rf"regexp_replace(lower({column}), '(?m)^[ \t\r\f\v]*(copyright|\(c\)|©|portions copyright)[^\n]*$', ' ', 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F©]+', ' ', 'g')"
    for old, new in SPELLINGS.items():
        t = rf"regexp_replace({t}, '\b{old}\b', '{new}', 'g')"
    return f"trim({t})"


def _op9_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = lambda pairs: ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in pairs)
    texts = [*TEXTS.items(), *HEADERS.items(), *((k, f"SPDX-License-Identifier: {k}") for k in NAMES), ("proprietary", "All rights reserved.")]
    names = [(k, n) for k, of in NAMES.items() for n in of]
    return f"""
WITH texts AS (SELECT * FROM (VALUES {rows(texts)}) AS v(license, t)
               UNION ALL SELECT license, replace(p, '{{}}', n) FROM (VALUES {rows(names)}) AS a(license, n), (VALUES {", ".join(f"({quoted(p)})" for p in PHRASES)}) AS b(p)),
reg AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical_sql("t")}) AS digest FROM texts UNION ALL SELECT * FROM (VALUES {rows(DIGESTS.items())}) AS d(license, digest)) GROUP BY 1),
whole AS (SELECT doc_id, {_canonical_sql("text")} AS c FROM documents),
lines AS (SELECT doc_id, {_canonical_sql("line")} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN reg ON sha256(c) = digest WHERE c <> '' GROUP BY 1)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS text_digest, license, coalesce(n, 0)::BIGINT AS n_notice_lines, coalesce(notices, '') AS notices
FROM whole LEFT JOIN reg ON c <> '' AND sha256(c) = digest LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict:
    return {"op4_decontamination": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op9_license_scan": _op9_sql(), "op12_line_dedup": OP12_SQL, "op13_conversation_repair": OP13_SQL}
