"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. A stage
works on all rows that the one before kept, and treats rows that share a ``doc_id`` as one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import line_dedup, mixing, near_copies, packing, queries, simhash, toxicity
from pixelweave.schema import cut, ensure_checkpoint_dir


def as_texts(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "node_id", "source": "node_type"})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of ``toxicity`` does not reject. It learns from the labels that op7 learns from."""
    labels = queries.table(spark, sf_dir, "labels").filter(~queries.held_out("doc_id")).select(F.col("doc_id").alias("node_id"), "toxic")
    texts = docs.withColumnRenamed("doc_id", "node_id")
    scored = toxicity.score_toxicity(texts, toxicity.fit_model(texts, labels))
    return scored.filter("predicted = 0").withColumnRenamed("node_id", "doc_id").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier lines match; a document that loses all its text goes."""
    out = line_dedup.dedup_lines(as_texts(docs)).withColumnsRenamed({"node_id": "doc_id", "node_type": "source"})
    out = out.filter((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id; documents without an id stay."""
    groups = simhash.simhash_groups(as_texts(docs)).filter("node_id = component_id").select(F.col("node_id").alias("doc_id")).distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What ``drop_near_copies`` keeps, and of each group of texts that share four fifths of their five-word shingles the smallest id."""
    left = cut(drop_near_copies(spark, docs, sf_dir))
    gone = near_copies.near_copies(as_texts(left), width=5, t=0.8).select(F.col("node_id").alias("doc_id"))
    kept = left.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.union(left.filter(F.col("doc_id").isNull()).select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it whole, and the beginning that it takes of the last one of a source.

    Rows without an id are documents of their own, known by a row number that is written with them.
    """
    none = cut(docs.filter(F.col("doc_id").isNull()).withColumn("_row", F.monotonically_increasing_id()))
    some = docs.filter(F.col("doc_id").isNotNull()).withColumn("_row", F.lit(None).cast("long"))
    key = F.struct("node_id", "_row")  # hashes like the id alone where there is one
    taken = mixing.mix_sources(as_texts(some.union(none)).withColumn("node_id", key)).groupBy("node_id").agg(F.sum("taken").alias("taken"))
    taken = taken.select(F.col("node_id.node_id").alias("_id"), F.col("node_id._row").alias("_no"), "taken")
    one = some.dropDuplicates(["doc_id"]).union(none)
    t = one.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_row").eqNullSafe(F.col("_no")))
    t = t.withColumn("_size", mixing.word_count(F.col("text"))).filter("taken > 0 and _size > 0")
    rest = F.col("taken") % F.col("_size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("_size")).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("_words", F.explode(copies))
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the space before it
    text = F.when(F.col("_words") > 0, F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), "")).otherwise(F.col("text"))
    t = t.withColumn("text", text).withColumn("n_chars", F.when(F.col("_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return t.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 1024."""
    return packing.pack_texts(as_texts(docs), **queries.public_tokenizer()).withColumnRenamed("node_id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_similar), ("mixing", mix), ("packing", pack)]

#: SQL has no tokenizer and no trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result goes to the shared folder and is read again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
