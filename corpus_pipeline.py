"""A corpus pipeline: five stages from raw documents to coded token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Rows with a null doc_id pass the filters unchanged up to the mixing
stage, which leaves them out. Null, empty and wordless texts go in the quality stage. Rows that
repeat an id stay or go together. Empty tables pass through. Further columns pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import decontaminate, jaccard_join, kneser_ney, mixing, token_ids
from wardspark.llm.common import sized, stored, table
from wardspark.llm.queries import domain_labels, tokenizer_path, trusted_ids

MIXTURE_WEIGHTS = {"clean": 0.97, "toxic": 0.03}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity exceeds their language's threshold go."""
    judged = kneser_ney.classify(docs, trusted_ids(spark, sf_dir))
    rejected = stored(judged.where("not kept").select("doc_id"), "rejected")
    return docs.join(sized(rejected, 16), "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return jaccard_join.drop_near_duplicates(docs, threshold=0.8, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.8, shingle=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned by rates that bring the expected tokens of each domain to the target weights.

    The quality stage has left next to no junk to weigh, so domains here are toxic and clean.
    """
    domain = F.when(F.col("domain") == "toxic", "toxic").otherwise("clean").alias("domain")
    labels = domain_labels(spark, sf_dir).select("doc_id", domain)
    return mixing.mix(docs, mixing.mixing_rates(docs, labels, MIXTURE_WEIGHTS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Coded token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.read_token_digest(spark, token_ids.write_token_ids(docs, tokenizer_path(), end_id=2))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: No stage but the third can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
