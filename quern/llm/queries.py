"""The registered queries of the operators, over whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import alignment, chat, collocations, decontamination, exact_dedup, gam, isolation, line_dedup, mixing, packing, sharding, simhash, token_files
from quern.llm.shared import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The mixing tree of ``documents``: a domain read off the source's name, then language, then source.
LEVELS = {
    "domain": "CASE WHEN length(source) <= 4 THEN 'primary' ELSE 'secondary' END",
    "lang": "lang",
    "source": "source",
}
#: Target weights of tree nodes; a node that is not named weighs 1.
WEIGHTS = {
    ("primary",): 3,
    ("secondary",): 2,
    ("primary", "en"): 4,
    ("primary", "de"): 2,
    ("secondary", "en"): 3,
    ("primary", "en", "src0"): 5,
}


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"), LEVELS, WEIGHTS, share=(3, 5), max_epochs=4, seed=7)
    return rows.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch", "taken", "order_key")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = isolation.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept", "anomaly", "threshold")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Sequences of up to 4096 tokens; ``tokenizer``: a tiktoken rank file, by default the public byte-level one, whose id 50256 is free."""
    import public_tokenizers

    return packing.pack(docs, str(tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")), 50256, public_tokenizers.PATTERN)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select(
        F.col("id").alias("doc_id"), (~gam.learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def token_files_query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: path of the tokenizer's file; by default the public one of the contract."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = _table(spark, sf_dir, "documents")
    # 49,408 ids fit two bytes
    manifest = token_files.write_files(docs, str(tokenizer), scratch_path(spark, "tokens"), end_id=2, item=2)
    return token_files.read_digests(manifest).withColumnRenamed("id", "doc_id")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of 4096 ids each, appended and compacted once; where every document ends up."""
    docs = _table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"))
    store.append(docs, F.floor(F.col("doc_id") / 4096))
    store.compact(docs.schema)
    store.vacuum()
    return store.read(docs.schema).select("doc_id", "shard_id", "shard_tier", "shard_rows", "shard_bytes", "shard_version")


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.repair(_table(spark, sf_dir, "conversations"))
    digest = F.sha2("rendered", 256).alias("rendered_sha256")
    return rows.select("conv_id", "turn", "role", "role_out", "action", "inserted", "cost", digest)


def alignment_query(spark: SparkSession, sf_dir: str, byte_json: str | None = None, piece_model: str | None = None) -> DataFrame:
    """``byte_json``, ``piece_model``: paths of both tokenizers' files; by default the public ones of the contract."""
    import public_tokenizers

    both = str(byte_json or public_tokenizers.path("byte_bpe_50k.json")), str(piece_model or public_tokenizers.path("piece_bpe_32k.model"))
    rows = alignment.link_statistics(_table(spark, sf_dir, "documents"), alignment.tokenizers(spark, *both, public_tokenizers.PATTERN))
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return rows.select(F.col("id").alias("doc_id"), *counts, F.coalesce(F.lower(F.hex("digest")), F.lit("")).alias("groups_sha256"))


def collocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collocations.collocations(_table(spark, sf_dir, "documents"))
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_items, digest = F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", n_items, digest, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": mixing_query,
    "op2_line_dedup": line_dedup_query,
    "op3_quality_rules": quality_rules_query,
    "op4_best_fit_packing": packing_query,
    "op5_token_files": token_files_query,
    "op6_simhash_near_dedup": simhash_query,
    "op7_sharding": sharding_query,
    "op8_exact_dedup": exact_dedup_query,
    "op9_quality_classifier": quality_classifier_query,
    "op10_chat_formatting": chat_query,
    "op11_tokenizer_alignment": alignment_query,
    "op12_phrase_collocations": collocation_query,
    "op13_decontamination": decontamination_query,
}
