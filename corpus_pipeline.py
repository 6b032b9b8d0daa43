"""Corpus pipeline: language ID, toxicity, near-duplicates, mixing, encoding.

Every stage works on all documents its predecessor kept. Filtering stages return the columns of ``documents`` for the rows
they keep; mixing returns a row as often as the mix takes it; the last stage returns the encoding of each row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import bpe, language_id, mixing, near_dup, toxicity
from contrail.llm.common import drop_stored, held_out, stored, table, with_small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those no language has for its own (posterior below one half)."""
    model = language_id.fit(docs.where(~held_out("doc_id")), language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    keyed = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return language_id.predict(keyed, model, id_col="row").where(f"lang_pred <> '{language_id.UND}' and score >= 0.5").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic."""
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    keyed = docs.select(F.struct(*COLUMNS).alias("row"), "text")
    return toxicity.score(keyed, model, id_col="row").where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of texts: that of the smallest id (a null id after all others), then of a hash of the row.

    Texts, not ids, are compared: rows without id or with an id that others have too are rows like all others. A row
    without text is like no other; only its exact repeats under the same id fall away.
    """
    said = docs.where("text is not null").withColumn("key", near_dup.text_key("text"))
    said = said.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.xxhash64("key", "lang", "source", "n_chars").alias("r")))
    linked = near_dup.text_classes(docs)
    # the best row of each text, then of each class; only these meet the texts, by a hash of the row that copies do not share
    best = stored(said.groupBy("key").agg(F.min("rank").alias("rank")).join(linked.select("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    keep = best.groupBy("root").agg(F.min(F.struct("rank", "key")).alias("b")).select("b.rank", "b.key")
    keep = stored(keep.select(F.col("key").alias("k"), F.col("rank.doc_id").alias("i"), F.col("rank.r").alias("r")).withColumn("spread", F.xxhash64("k", "i", "r")))
    for done in (linked, best):
        drop_stored(done)
    said = said.withColumn("spread", F.xxhash64("key", "doc_id", "rank.r"))
    same = (said["spread"] == keep["spread"]) & (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rank.r") == keep["r"])
    kept = said.join(keep, same, "left_semi").dropDuplicates(["key"])
    silent = docs.where("text is null")
    silent = silent.where("doc_id is not null").dropDuplicates(COLUMNS).union(silent.where("doc_id is null"))
    return kept.select(*COLUMNS).union(silent.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes."""
    x = mixing.mix(docs, keep=("text", "lang", "n_chars")).where("repetitions > 0")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repetitions")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row's encoding."""
    return bpe.round_trip_digests(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [(name, with_small_batches(f)) for name, f in (("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("bpe", encode))]

#: The stages learn models and hash words: SQL can't express them. tests/llm/test_pipeline.py holds each stage's effect and
#: run() against a brute-force version, given what the two fitted models decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written and read again; a table goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
