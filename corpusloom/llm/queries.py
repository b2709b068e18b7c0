"""Registered queries of the pipeline operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from corpusloom.functions.scale import scratch_path
from corpusloom.llm import decontaminate, language_crf, line_templates, merkle_versions, mixture, near_dup, packed_ids, quality_nbsvm, quality_rules, secrets_markov, toxicity_fm, url_filter, whiten_charpoly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_nbsvm_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_crf_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.languages(table(spark, sf_dir, "documents"))


@query("op3_url_logistic")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


@query("op4_markov_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_markov.digest(secrets_markov.secrets(table(spark, sf_dir, "documents")))


@query("op5_toxicity_fm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_simhash_near_dup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op6_spaced_seed_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_words", "share")


@query("op8_mixture_schedule")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS line_no FROM d),
flat AS (SELECT doc_id, t, line_no, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS f FROM raw),
cut AS (SELECT doc_id, t, line_no, string_split(regexp_replace(f, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS w FROM flat WHERE f <> ''),
lines AS (SELECT *, len(w) AS n, w[1:3] AS head FROM cut),
leaves AS (SELECT n, head FROM lines GROUP BY ALL HAVING count(*) >= 5),
kinds AS (SELECT n, head, w, count(DISTINCT t) AS docs FROM lines SEMI JOIN leaves USING (n, head) GROUP BY n, head, w),
tok AS (SELECT n, head, w, docs, unnest(w) AS token, unnest(range(n)) AS pos FROM kinds),
con AS (SELECT n, head, pos, token FROM tok GROUP BY ALL HAVING sum(docs) >= 5),
tpl AS (SELECT n, head, w, string_agg(pos || ':' || token, ' ' ORDER BY pos) AS template FROM tok JOIN con USING (n, head, pos, token)
        GROUP BY n, head, w HAVING 100 * count(*) >= 60 * n),
found AS (SELECT doc_id, t, line_no, n, head, template FROM lines JOIN tpl USING (n, head, w)),
often AS (SELECT n, head, template, min({'d': doc_id, 'l': line_no}) AS f FROM found GROUP BY ALL HAVING count(DISTINCT t) >= 5),
gone AS (SELECT doc_id, line_no FROM found JOIN often USING (n, head, template) WHERE doc_id <> f.d OR line_no <> f.l),
kept AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.line_no) AS text FROM raw ANTI JOIN gone ON raw.doc_id = gone.doc_id AND raw.line_no = gone.line_no GROUP BY raw.doc_id)
SELECT documents.doc_id, coalesce(a.n, 0) AS n_lines, coalesce(b.n, 0) AS n_dropped,
       CASE WHEN b.n IS NULL THEN documents.text ELSE coalesce(kept.text, '') END AS text
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_line_template_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query("op10_perplexity_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge(docs, carry=["doc_id"])
    return judged.select("doc_id", *[f"_q.{c}" for c in quality_rules.BASE], "_q.base_failed", "_q.kept", "_q.perplexity")


@query("op11_charpoly_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten_charpoly.whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS b, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 4294967295::UBIGINT AS c FROM documents
  UNION ALL SELECT doc_id, s[2:], xor(crc.c >> 8, bits.c) FROM crc JOIN bits ON bits.k = 8 AND bits.b = xor(crc.c & 255, ascii(s[1])::UBIGINT) WHERE s <> ''
), hit AS (SELECT doc_id FROM crc WHERE s = '' AND xor(c, 4294967295::UBIGINT) % 2 = 0),
enc AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS new,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM enc
), lv AS (
  SELECT source, 0 AS level, i, leaf AS h, n FROM leaf
  UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY source, level, i // 3, n
), sub AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1
), up AS (
  SELECT 0 AS level, i, subroot AS h, n FROM sub
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY level, i // 3, n
), sides AS (
  SELECT a.source, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM lv a JOIN lv b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL
), up_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM up a JOIN up b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL
), path AS (
  SELECT d.doc_id, s.level AS k, l, r FROM leaf d JOIN sides s ON s.source IS NOT DISTINCT FROM d.source AND s.i = d.i // (3 ** s.level)::BIGINT
  UNION ALL SELECT d.doc_id, b.height + u.level, l, r FROM leaf d JOIN sub b ON b.source IS NOT DISTINCT FROM d.source JOIN up_sides u ON u.i = b.i // (3 ** u.level)::BIGINT
), fold AS (
  SELECT doc_id, 0 AS k, new AS h, '' AS proof FROM leaf
  UNION ALL SELECT f.doc_id, f.k + 1, sha256(l || h || r), proof || l || r FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.k = f.k
), top AS (SELECT doc_id, arg_max(h, k) AS folded_root, sha256(arg_max(proof, k)) AS proof_sha256 FROM fold GROUP BY doc_id)
SELECT d.doc_id, d.leaf, b.subroot, (SELECT h FROM up WHERE n = 1) AS root, t.proof_sha256, t.folded_root, t.folded_root = (SELECT h FROM up WHERE n = 1) AS verified
FROM leaf d JOIN sub b ON b.source IS NOT DISTINCT FROM d.source JOIN top t ON t.doc_id = d.doc_id
"""


@query("op12_merkle_versions", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = merkle_versions.without_line_feeds(table(spark, sf_dir, "documents"))
    return merkle_versions.digests(merkle_versions.manifest(docs))


@query("op13_packed_token_ids")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, folder = public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "packed-ids")
    encoded = packed_ids.encode_documents(table(spark, sf_dir, "documents"), vocabulary, end_id=2, by_word=True)
    packed_ids.write_ids(encoded, folder, packed_ids.vocabulary_size(vocabulary))
    return packed_ids.digests(packed_ids.read_ids(spark, folder))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
