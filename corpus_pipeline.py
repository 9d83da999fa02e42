"""The corpus pipeline: quality classifier, near-duplicate join, repeated substrings, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of `documents`. A stage's result is written to the shared folder as
Parquet, and the next stage reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerlake.llm import mixing, ngram_join, packing, quality, queries, suffix
from showerlake.llm.common import fresh, settled, table

#: A passage of over 50 words goes if it repeats: 51 words of three bytes and a blank each are over 200 bytes.
REPEAT_BYTES = 200


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", ~queries.held_out(3, 1))
    score = fresh(docs, "_score")
    return quality.with_score(docs, model, score).filter(F.col(score) >= 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Texts without words are no near duplicates; all of them stay."""
    return ngram_join.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without the bytes of repeated strings of REPEAT_BYTES; a cut inside a character drops what is left of it.
    A document of which nothing is left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_row"))
    cut = suffix.without_repeats(rows, REPEAT_BYTES, with_text=True).filter((F.length("_kept") > 0) | (F.col("n_bytes") == 0))
    new = {"text": F.col("_kept"), "doc_id": F.col("doc_id"), "n_chars": F.length("_kept")}
    return cut.select(*[new.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat as their shards are taken."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: No stage but the mixing can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again, and goes once the next is written."""

    def after(n: int) -> DataFrame:
        if not n:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[n - 1]
        return settled(spark, name.replace(" ", "-"), lambda: stage(spark, after(n - 1), sf_dir))

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
