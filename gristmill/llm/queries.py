"""One query for each operator, over its whole table, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, language_crf, licenses, line_dedup, mixing, ngram_join, packing, quality_knn, quality_rules, resampling, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), "n_known")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8, tolerance=1e-6)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    back = warc.read_archive(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", warc.referred_page("refers_to_record").alias("refers_to"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"),
        quality_rules.passes("v1").alias("kept"),
        F.col("failed_bits").cast("long").alias("failed_bits"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_crf.predict(docs.drop("lang"), language_crf.fit(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(20).alias("contaminated"),
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, seed=17)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    repair = conversations.Repair(conversations.damage(given))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    ids, report, hashed = given.select("conv_id").distinct(), repair.report(), conversations.digests(repair.rows())
    rows = ids.join(report, same(ids, report), "left").join(hashed, same(ids, hashed), "left")
    count = lambda c: F.coalesce(report[c], F.lit(0).cast("long")).alias(c)
    return rows.select(
        ids["conv_id"], *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(packing.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text")), capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark"), percent=5, min_words=20, n=3, buckets=10_000, seed=42)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_archive": op6_warc_archive,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_mix_sources": op10_mix_sources,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_packing": op12_packing,
    "op13_importance_resampling": op13_importance_resampling,
}
