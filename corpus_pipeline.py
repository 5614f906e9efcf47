"""A training-corpus pipeline over documents: each stage works on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir), with docs(doc_id, text, lang, ...), and all but the last return the columns
of docs, whatever further ones there are and whatever their names. For all stages: a null text has no words and no
spans; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam_sam, langid_ftrl, secret_link, sentencepiece_sampling, superminhash
from strandline.llm.common import Scratch, sweep

#: A document whose language cannot be told goes: no letter, or a calibrated probability below this.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; the model learns from the rows that are not held out.

    Null texts and texts without a letter go, from whatever source. Repeated rows are judged alike. Where no row has
    a language to learn from, nothing can be recognised or rejected, and all rows stay.
    """
    model = langid_ftrl.train(docs, ~langid_ftrl.held_out())
    if model is None:
        return docs
    columns = docs.columns
    names = [f"c{k}" for k in range(len(columns))]  # lang_pred and score may be columns of docs
    judged = langid_ftrl.predict(docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, columns, strict=True)], F.col("text")), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*names).toDF(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity 0.8), that with the least doc_id.

    Of rows with that doc_id the one with the least hash stays (of its text, then of all columns but maps). A null doc_id takes a negative
    number from a 63-bit hash of its text, so that rows without an id group like others. Texts without words link
    with nothing.
    """
    columns = docs.columns
    names = [f"c{k}" for k in range(len(columns))]
    text, plain = F.coalesce(F.col("text").cast("string"), F.lit("")), [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    key = F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(text), 1))
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, columns, strict=True)], key.alias("key"), text.alias("text"), F.xxhash64(text).alias("tag"), F.xxhash64(*plain).alias("all"))
    groups = superminhash.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text", "tag"), tag="tag")
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("key"), "tag").agg(F.count("*").alias("n")).groupBy("key").agg(F.min(F.struct("tag", "n")).alias("m")).select("key", "m.tag", "m.n")
    rows = keyed.drop("text").join(kept, ["key", "tag"])  # one shuffle of the rows; what repeats is few
    once = rows.where("n = 1").select(*names)
    again = rows.where("n > 1").groupBy("key").agg(F.min_by(F.struct(*names), "all").alias("r")).select("r.*")
    return once.unionAll(again).toDF(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; documents of which they are 5 % or more go. Repeated rows are treated alike."""
    return decontam_sam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no row goes. Spans that overlap or touch are replaced once."""
    return secret_link.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and samples: the piece ids of two sampled segmentations of each document, with their inclusion scores.

    Null text has no samples; repeated rows get equal samples, as doc_id seeds them (null: 0).
    """
    return sentencepiece_sampling.encode_samples(docs.select("doc_id", "text"), F.col("doc_id"), samples=2).drop("text")


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("SentencePiece encoding", encode)]

#: Stages train a model, group near copies and sample segmentations, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again; only the last table is kept."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.keep(f"stage-{k}")
        sweep(after=scratch)
    return docs
