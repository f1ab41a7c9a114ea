"""From raw documents to sharded training data: each stage reads all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentflow.llm import decontamination, langid, minhash, mixing, queries, sharding
from contentflow.llm.folders import stored, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. Those without a letter (null and empty texts), or between two languages, go.

    Texts of any length are read whole; rows that repeat stay or go together. An empty table stays empty.
    """
    model = langid.fit(docs.filter(queries.remainder(4) != 2).select("doc_id", "text", "lang"))
    told, unclear = unused(docs, "told"), unused(docs, "unclear")
    named = docs.withColumnsRenamed({c: unused(docs, f"its_{c}") for c in ("lang_pred", "score", "ambiguous") if c in docs.columns})
    found = langid.predict(named, model).withColumnsRenamed({"lang_pred": told, "ambiguous": unclear})
    kept = found.filter((F.col(told) != "und") & ~F.col(unclear)).drop(told, unclear, "score")
    return kept.toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Of rows that repeat this doc_id one stays, the same in every run; a null doc_id is the smallest only among nulls. Null and empty texts are no
    one's copies, but rows that repeat doc_id and text are one. An empty table stays empty.
    """
    return minhash.keep_one(docs, minhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; rows that repeat go or stay together.

    Without benchmark items all documents stay, an empty table stays empty.
    """
    clash = {c: unused(docs, f"its_{c}") for c in ("n_words", "n_hit", "hits", "items") if c in docs.columns}
    found = decontamination.decontaminate(docs.withColumnsRenamed(clash), queries.table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").drop("n_words", "n_hit", "hits", "items").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, whole. A null source is a source.

    Texts without words are drawn by their source's rate. Rows that repeat are drawn each. An empty table stays empty.
    """
    size, copies = unused(docs, "mix_size"), unused(docs, "copies")
    clash = {c: unused(docs, f"its_{c}") for c in ("source_size", "target", "copies") if c in docs.columns}
    sized = docs.withColumnsRenamed(clash).withColumn(size, queries.space_words(F.col("text")))
    targets = mixing.source_targets(sized, queries.source_weight(), size=size, most=queries.MOST_COPIES)
    mixed = mixing.mix(sized, targets, size=size).filter("copies > 0").withColumnRenamed("copies", copies)
    repeated = mixed.withColumn(unused(mixed, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies))))
    names = [clash.get(c, c) for c in docs.columns]
    return repeated.select(*names).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards of nearly equal bytes: the columns of documents with size, law, shard and slot.

    Every row gets a place, null texts, repeated rows and null ids too. An empty table stays empty.
    """
    placed = sharding.shard(docs, queries.SHARDS, queries.text_bytes(F.col("text")))
    return placed.withColumn("law", F.lit("bytes"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Trained models and drawn copies cannot be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
