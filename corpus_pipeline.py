"""The corpus pipeline: five stages over documents, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last
return the columns of documents, further columns of any name included.  Rows
are judged one by one in the first two stages, so ties and repeated rows fare
alike, and no stage drops a row for a null in another column.  An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ngram_join, packing, quality, suffix_radix, toxicity
from quillspark.llm.queries import TOXIC_FROM, tokenizer_path
from quillspark.llm.store import discard, materialize


def _renamed(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """docs with other names for the columns that a stage does not use, so that none clashes with its own."""
    return docs.toDF(*[c if c in used else f"extra_{i}" for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below TOXIC_FROM; null and empty texts have the model's floor and stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = _renamed(docs, ("doc_id", "text"))
    return toxicity.score(own, model).where(F.col("expected_severity") < TOXIC_FROM).select(own.columns).toDF(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands (an unknown or null language: their script's); null and empty texts fail the base rules."""
    own = _renamed(docs, ("doc_id", "text", "lang"))
    return quality.judge_quality(own, tokenizer_path("piece_bpe_32k.model")).where("kept").select(own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, a missing one last; null, empty and blank texts are no duplicates."""
    return ngram_join.keep_one_per_class(docs, threshold=0.8, n=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 200-byte strings; a character cut in two goes as a whole, and n_chars follows.

    A null text becomes the empty text; a text that repeats whole stays as an empty document.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix_radix.remove_repeated_bytes(docs, length=200, whole_characters=True, carry=others)
    out = out.select("doc_id", F.col("kept").cast("string").alias("text"), *[F.col("carry").getField(c).alias(f"extra_{i}") for i, c in enumerate(others)])
    back = dict(zip(others, (f"extra_{i}" for i in range(len(others))), strict=True)) | {"doc_id": "doc_id", "text": "text"}
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(back[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens, with their ids; an empty text has its end token.

    Workers share their executors with those of the stages before, so the caches are small.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, cache_bytes=40 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: Tokenizers and a trained model are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
