"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .text_search import search

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, docs.filter(F.col("doc_id") % 100 == 0))
    return found.withColumn("score", F.round("score", 6))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import allot

    out = allot(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.round("weight", 6).alias("weight"), "copies")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from .token_store import new_store, read_tokens, write_tokens

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    out = new_store(spark)
    write_tokens(_table(spark, sf_dir, "documents"), out, tokenizer_path)
    return read_tokens(spark, out, with_ids=False)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality."""
    from .lm_score import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = score(docs, fit(docs, good))
    return out.withColumns({c: F.round(c, 6) for c in ("loss_target", "loss_background", "score")})


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from .pieces import round_trip

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return round_trip(_table(spark, sf_dir, "documents"), model_path)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file of the table after the upsert, read back from the files."""
    from .upsert import create, latest, new_table, upsert

    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    clients = _table(spark, sf_dir, "clients")
    rows_per_file = 1 + clients.count() // 700
    folder = new_table(spark, "clients")
    create(clients.filter(crc(F.col("client_id")) % 7 > 3), folder, "client_id", rows_per_file)

    def action(first, change):
        h = crc(first) % 12
        deletes = F.coalesce(change.op == "D", F.lit(False)) | F.coalesce(crc(change.change_id) % 8 < h, F.lit(False))
        return F.when(h > 7, "ignore").when(deletes, "delete").otherwise("set")

    changes = latest(_table(spark, sf_dir, "client_changes"), "client_id", ["seq", "change_id"])
    made = upsert(folder, changes, action, clients.schema, "client_id", ["source", "segment", "city", "balance"], rows_per_file)

    table = spark.read.schema(clients.schema).parquet(folder)
    balance = F.col("balance").cast("double")
    cents = F.when(F.abs(balance) < float("inf"), F.floor(100 * balance + 0.5)).otherwise(0)
    text = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")))
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col("_metadata.row_index").alias("at"), "client_id"))), lambda x: x.client_id.cast("string"))
    per_file = table.groupBy(F.col("_metadata.file_name").alias("name")).agg(
        F.min("client_id").alias("first_id"),
        F.count("*").alias("n_rows"),
        F.sum(cents).cast("long").alias("cents"),
        F.sum(F.crc32(text.cast("binary"))).alias("rows_crc"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("ids_sha256"),
    )
    return per_file.select(
        "first_id", "n_rows", "cents", "rows_crc", "ids_sha256",
        F.lit(",".join(table.columns)).alias("columns"),
        F.concat(F.lit(f"{folder}/"), "name").alias("path"),
        F.col("name").isin(made).alias("rewritten"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
