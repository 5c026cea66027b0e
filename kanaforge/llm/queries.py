"""The queries of this subpackage: one for each operator, and the document pipeline's
helpers. QUERIES maps names to (spark, sf_dir) -> DataFrame, ORACLES names to DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, line_dedup, mixing, packing, quality, sharding, simhash, spelling, suffix, token_counts, toxicity, warc
from .common import materialize, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return g.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda p: p.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    p = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, payload=digest)
    return p.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs, min_sites=line_dedup.MIN_SITES, removed_as="n_removed").select("doc_id", "text", "n_removed")


def op4_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_severity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_severity(docs, model)


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return m.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"),
                    F.round("probability", 6).alias("probability"), "sampled")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("doc_id", *[F.col("features")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    "base_failed", "kept", "quality")


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages")), path)
    return warc.resolve_revisits(materialize(warc.capture_digests(warc.assemble(spark, path, payloads=False))))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix.drop_repeats(table(spark, sf_dir, "documents"), length=400)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows.select("conv_id"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), damage_every=97))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return n.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_best_fit_packing, op3_line_dedup, op4_toxicity_severity, op5_permutation_index, op6_balanced_sharding, op7_source_mixing, op8_quality_rules, op9_warc_transactions,
                                op10_suffix_dedup, op11_conversation_repair, op12_spelling_variants, op13_token_counts)}
_BARE = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                          unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
        b AS (SELECT *, {_BARE} AS bare FROM l),
        g AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 15),
        k AS (SELECT doc_id, string_agg(CASE WHEN g.bare IS NULL THEN line END, chr(10) ORDER BY i) AS text, count(g.bare) AS n_removed,
                     100 * sum(CASE WHEN g.bare IS NULL THEN length(line) ELSE 0 END) >= 20 * sum(length(line)) AS cut
              FROM b LEFT JOIN g ON b.bare = g.bare GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NOT NULL AND k.cut THEN coalesce(k.text, '') ELSE d.text END AS text,
               CAST(CASE WHEN k.cut THEN k.n_removed ELSE 0 END AS BIGINT) AS n_removed
        FROM documents d LEFT JOIN k USING (doc_id)""",
    "op7_source_mixing": mixing.mix_sql(),
    "op9_warc_transactions": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
        w AS (SELECT digest, max(page_id) AS largest FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN largest <> page_id THEN largest END AS refers_to
        FROM d LEFT JOIN w USING (digest)""",
    "op11_conversation_repair": conversations.repair_sql(),
    "op12_spelling_variants": spelling.variants_sql(damage_every=97),
}
