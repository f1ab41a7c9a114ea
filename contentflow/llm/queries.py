"""The registered queries of this subpackage, and SQL for those that SQL can say on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentflow.llm import (
    alignment, decontamination, embeddings, langid, language_model, minhash, mixing, oracles, packing, pii, prefix_trie, quality,
    sharding, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


def space_words(text: Column) -> Column:
    """Number of runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


SHARDS = 8


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


@query("op5_shard_bytes")
def shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    docs = documents.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.crc32(F.col("text")).alias("text_crc32"), text_bytes(F.col("text")).alias("bytes"),
    )
    placed = sharding.shard(docs, SHARDS, F.col("bytes"), text="text_hash")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0


def source_weight() -> Column:
    return F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), (F.col("position") % len(SOURCE_WEIGHTS) + 1).cast("int"))


@query("op6_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    docs = documents.select("doc_id", "source", space_words(F.col("text")).alias("size"))
    targets = mixing.source_targets(docs, source_weight(), most=MOST_COPIES)
    mixed = mixing.mix(docs, targets)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_quality_ranking")
def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents.select("doc_id", "text"), labels.filter(remainder(5) != 0))
    docs = documents.select("doc_id", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    scored = quality.predict(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op10_language_codes")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(remainder(4) != 2).select("doc_id", "text", "lang"))
    docs = documents.select("doc_id", "text", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


@query("op1_toxic_neighbours")
def toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(documents.select("doc_id", "text"), labels.filter(remainder(3) != 1), documents.select("text"))
    docs = documents.select("doc_id", "text", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"))
    scored = toxicity.predict(docs, index, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    chosen = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op2_personal_spans", oracles.PERSONAL_SPANS)
def personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(documents, keep=["doc_id"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, pii.BASE_KINDS), F.sha2(listed(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256"), listed(F.col("spans"), pii.KINDS).alias("spans")
    )


@query("op3_near_duplicates", oracles.NEAR_DUPLICATES)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(documents, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_benchmark_windows", oracles.BENCHMARK_WINDOWS)
def benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.decontaminate(documents.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_embedding_links", oracles.EMBEDDING_LINKS)
def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return embeddings.embedding_links(vectors).select("vec_id", "n_links", "component_id", "kept")


@query("op7_maxent_scores")
def maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    docs = documents.select("doc_id", "text", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"))
    return language_model.score(docs, remainder(7) != 2, keep=["doc_id", "held_out"])


HEAD_TURNS = 5


@query("op11_prefix_trie", oracles.PREFIX_TRIE)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_hashes(table(spark, sf_dir, "conversations"))
    rebuilt, members = prefix_trie.with_heads(turns, F.col("conv") - F.col("conv") % 100, remainder(HEAD_TURNS + 1, "conv"), HEAD_TURNS)
    return prefix_trie.trie(rebuilt, members)


def tokenizer(name: str) -> str:
    """Where a file of the public tokenizers lies. The package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op12_packed_sequences")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = alignment.align(
        documents, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), keep=lambda groups: F.sha2(groups, 256)
    )
    return found.withColumnRenamed("groups", "groups_sha256")
