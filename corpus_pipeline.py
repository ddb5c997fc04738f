"""From documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept, as it was written and read again. All but
the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. line dedup: later copies of repeated runs of lines are deleted from the texts;
   documents of which nothing but blank lines is left go.
3. SimHash near-dedup: one document of each group stays. Texts are linked whose
   five-word shingles are 0.8 alike or more; three bits of a fingerprint, the setting
   of op3's query, would leave most of them (see ``simhash.near_texts``).
4. mixing: documents are taken as often as the mix says, once or twice.
5. packing: the documents' tokens in sequences of 1,024.

Defined results: nulls, empty and repeated rows as each operator defines them; a
stage that gets no rows returns none. A document that had no words before line dedup
stays, as nothing of it was deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import linededup, mixing, packing, simhash, toxicity
from vecloom.llm.common import SPACES, cut, mark, release, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = linededup.deduplicated(docs)
    left = (F.col("_lines_deleted") == 0) | (F.btrim("text", F.lit(SPACES)) != "")
    length = F.when(F.col("_lines_deleted") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return edited.where(left).withColumn("n_chars", length).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packing.packed(docs, ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the suffix ranks, fingerprints and the tokenizer;
#: tests hold the stages to plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
