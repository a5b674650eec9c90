"""A training-data pipeline of five stages over documents. Each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanchion.llm import jaccard_join as _jaccard
from stanchion.llm import mixing as _mixing
from stanchion.llm import pieces as _pieces
from stanchion.llm import substring_dedup as _substring
from stanchion.llm import toxicity as _toxicity
from stanchion.llm._base import free_name, keep


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    model = _toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs.columns, "toxicity_score")
    return _toxicity.score(docs, model, name=name).filter(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    gone = _jaccard.jaccard_join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(keep(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go; no row goes, even if nothing of it is left."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = _substring.substring_dedup(docs, carry=rest)
    out = out.select("row.*", F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars"))
    return out.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document goes in at least once; those of smaller sources again, up to their source's weight."""
    return _mixing.mix(docs).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_pieces, exact (whether the ids decode to the text)."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return _pieces.encode(docs, model_path).select("doc_id", "ids", F.size("ids").alias("n_pieces"), "exact")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the classifier or the pieces; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
