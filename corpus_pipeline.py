"""The corpus pipeline: from raw documents to token ids, five stages one after the other.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last keep the columns of docs, extra ones included. Null and empty
texts, repeated rows and empty tables pass through every stage as its operator defines; repeated rows (of one id and
one text) end as one document after the near-duplicate stage, null and reused ids of other texts lose nothing there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import load, staged
from brindle.llm.exact_dedup import build_index
from brindle.llm.labelled import fold
from brindle.llm.sentencepiece_fst import sentencepiece
from brindle.llm.simhash_golay import simhash_groups
from brindle.llm.source_mix import mixed_documents
from brindle.llm.toxicity_fm import toxicity

#: From this score on a document is rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; learns from the labels outside the held-out fold."""
    aside = "score" + "_" * max(map(len, docs.columns))  # a name that no column has
    scored = toxicity(docs.withColumnRenamed("score", aside), load(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return scored.where(F.col("score") < TOXIC).drop("score").withColumnRenamed(aside, "score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the one with the largest doc_id."""
    return build_index(docs).where(F.col("row.doc_id").eqNullSafe(F.col("keep_id"))).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates, the document with the smallest doc_id, or any id rather than none.

    A row goes by its id and its text together, so that null ids and ids of several texts decide nothing about other rows.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("digest"))
    groups = staged(simhash_groups(docs.select(key.alias("key"), "text"), "key"), "groups")
    dropped = groups.where("id <> component_id").select(F.col("id").alias("key")).distinct()
    repeated = groups.where("id = component_id").groupBy("id").count().where("count > 1").limit(1).count()
    kept = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(dropped, "key", "left_anti")
    return (kept.dropDuplicates(["key"]) if repeated else kept).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or the parts of them, that the mix of sources takes; one row for each pass over a document."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers), n_pieces, decoded of each mixed document."""
    import public_tokenizers

    found = sentencepiece(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "ids", F.expr("octet_length(ids) div 4").cast("long").alias("n_pieces"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("sentencepiece", encode),
]

#: Learnt scores, pseudorandom draws and the encoder have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
