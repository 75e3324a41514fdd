"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark passages go, sources are
mixed to their targets, and the mix is dealt out to shards.

For all stages: every row is looked at by itself, so a null or repeated doc_id is no special case but where a stage says so; null texts
count as empty; all but the last return the columns of ``documents`` alone and no others that a table may have; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import contamination, minhash, mixing, sharding, toxicity
from tideline.llm.scratch import drop, materialize, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; it learns from ``labels``.

    Rows with a null doc_id or text are scored like all others (an empty text by the model's bias); equal texts go or stay alike; without labels
    all stay.
    """
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (shingles of five words, similarity 0.8): that of the least doc_id, null last.

    Of repeated rows of that doc_id, and of rows that are all without one, the first stays; texts without words are in no group and stay.
    """
    return minhash.drop_near_duplicates(docs, one_row=True).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of ``benchmark``, those with a null doc_id too.

    Of a repeated doc_id only the rows that hold one go; null items are not looked for, items of fewer than five words only as the whole of a text;
    without a benchmark all stay.
    """
    return contamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), null_ids=True).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken, twice at most.

    Null sources are one source; texts without words take no budget and are in no mix; ties of the virtual finish time go by a hash of doc_id.
    """
    return mixing.mix(docs).select(COLUMNS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard and slot; rows with equal or null doc_ids are dealt out one by one, a column ``shard`` or ``slot`` of old is replaced."""
    return sharding.shard(docs).select(*COLUMNS, F.col("shard"), F.col("slot"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again, and what it needed for that is deleted then."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scope() as own:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            own.keep(docs)
        if before is not None:
            drop(before)
        before = docs
    return docs


#: Learned scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
