"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, langid, line_dedup, main_text, mixing, packing, periodic, sharding, simhash, token_files, topk, toxicity
from .scratch import scratch_path
from .tokens import vocabulary_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS = [f"shard-{k:03d}" for k in range(96)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "source", "n_chars", "slot", "shard")


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents"))


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op4_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary=vocabulary_path(), end_id=1)
    return token_files.read_token_files(spark, path, with_ids=False)


def op5_ball_tree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5, factor=256)


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "removed_lines", "removed_runs", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, *langid.fit(docs))


def op8_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), words=3)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary=vocabulary_path(), end_id=2, window=4096)


def op10_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(_table(spark, sf_dir, "pages"))


def op12_pointer_jump_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {"a_path": vocabulary_path(alignment.A_VOCABULARY), "b_path": vocabulary_path(alignment.B_VOCABULARY)}
    return alignment.align(_table(spark, sf_dir, "documents"), **paths, with_groups=False)


def op13_synchronising_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(_table(spark, sf_dir, "documents"), tail=periodic.stated_tail, with_runs=False).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_permutation_sharding,
        op2_chunk_recipes,
        op3_subword_toxicity,
        op4_rans_token_files,
        op5_ball_tree_top5,
        op6_line_chunks,
        op7_subword_language,
        op8_simhash_multi_index,
        op9_best_fit_packing,
        op10_golden_ratio_mix,
        op11_tag_path_ratios,
        op12_pointer_jump_alignment,
        op13_synchronising_runs,
        pipeline,
    )
}

ORACLES = {
    "op5_ball_tree_top5": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 5""",
    "op2_chunk_recipes": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents)
        WINDOW g AS (PARTITION BY low)""",
}
