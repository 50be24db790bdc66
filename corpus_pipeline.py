"""A corpus pipeline: from raw documents to a shuffled training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
result as Parquet in the shared folder and rereads it as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, line_dedup, mixing, ngram_join, oracles, quality_rules
from gristmill.llm.storage import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1 of the quality rules."""
    entries = quality_rules.ledger(docs, keep=tuple(docs.columns))
    return entries.filter(quality_rules.passes("v1")).select(docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in one; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, min_docs=3, min_chars=20)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id (null ids come last) of each group linked by similarities of 0.8 or more.

    Rows have numbers of their own here: those that share a doc_id, or have none, are
    grouped by their texts alone. Texts without words are in no group; only such a row
    that repeats the doc_id and the text of another goes, not where the doc_id is null.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    classes = ngram_join.near_duplicates(rows, n=5, threshold=0.8, doc_id="__row")
    # equal (doc_id, text) are told apart by their other columns, so that no run prefers another
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("all"), "__row")
    ranked = classes.withColumnRenamed("doc_id", "__row").join(rows.select("__row", order.alias("rank")), "__row")
    first = ranked.groupBy("class_id").agg(F.min("rank").alias("rank")).select("rank.*")
    repeated = F.when(F.col("last"), F.col("__row"))
    kept = first.groupBy("doc_id", "text", repeated.alias("own")).agg(F.min(F.struct("all", "__row")).alias("best")).select("best.__row")
    return rows.join(written(kept, "near-duplicates"), "__row", "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 is in passages of the benchmark."""
    marked = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    return marked.filter(~decontaminate.contaminated(20)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root weights of their sources, shuffled."""
    return mixing.mix(docs, temperature=0.5, seed=17)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


ORACLE_SQL = f"""
WITH good AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({oracles.quality_sql()}) q USING (doc_id) WHERE q.kept),
lined AS MATERIALIZED (SELECT g.doc_id, l.text, g.lang, g.source, length(l.text) AS n_chars FROM good g JOIN ({oracles.line_dedup_sql("good", with_text=True)}) l USING (doc_id)),
single AS MATERIALIZED (SELECT d.* FROM lined d JOIN ({oracles.near_duplicates_sql("lined")}) c USING (doc_id) WHERE c.class_id = d.doc_id),
clean AS MATERIALIZED (SELECT d.* FROM single d JOIN ({oracles.decontamination_sql("single")}) c USING (doc_id) WHERE NOT c.contaminated)
SELECT * FROM ({oracles.mixing_sql("clean")})"""
