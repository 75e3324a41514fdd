"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source shuffles its documents by a hash of doc_id.  A document's virtual finish time is the running count of its
source's words up to its end, divided by the source's target; a second pass over the source queues behind the
first.  All passes are range-sorted by finish time and cut off where the running total reaches the budget,
so at every moment of the mix each source has given its share to within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.ordered import running_totals
from tideline.llm.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
COPIES = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``row``, numbered and with their words; written, so that both stay what they are."""
    size = count_words(F.col("text").cast("string")).alias("size")
    return materialize(docs.select(F.monotonically_increasing_id().alias("mix_row"), "doc_id", "source", size, F.struct("*").alias("row")), "sized")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> tuple[DataFrame, float]:
    """One row a source of ``sizes(source, size)``, with its ``target``, and the budget ``share`` * all sizes.

    Sources by code point, null last, weigh ``weights`` in turn.  A target stops at ``COPIES`` times
    its source's size; the excess goes to the others by weight, until none is above.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_totals(of, [F.col("source").asc_nulls_last()], ["one", "source_size"], "sources")
    at = (F.col("total_one") - 1).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at % len(weights) + 1)
    ranked = ranked.select(
        "source", "source_size", at.alias("source_rank"), weight.alias("weight"), (F.col("source_size") * float(COPIES)).alias("most"), (F.col("total_source_size") - F.col("source_size")).alias("words_before")
    )
    full = F.lit(False)
    count, level = -1, F.lit(0.0)
    budget = 0.0
    while True:
        free = F.when(~full, F.col("weight"))
        all_words, held, weighs, stopped = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(free), F.sum(full.cast("int"))).first()
        budget = share * (all_words or 0)
        if stopped == count or not weighs:
            break
        count, level = stopped, F.lit((budget - (held or 0.0)) / weighs)
        full = F.col("most") <= level * F.col("weight")
    return ranked.withColumn("target", F.when(full, F.col("most")).otherwise(level * F.col("weight"))), budget


def fair_queue(rows: DataFrame, targets: DataFrame, budget: float) -> DataFrame:
    """The passes taken of ``rows(mix_row, doc_id, source, size)``: mix_row, mix_pass, mix_finish, mix_total, size.

    mix_total is the running total of words in the order of the mix, mix_finish the virtual finish time.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sources = targets.select(F.col("source").alias("of_source"), "source_rank", "words_before", "source_size", "target")
    queued = rows.where("size > 0").join(sources, F.col("source").eqNullSafe(F.col("of_source"))).select("mix_row", "size", "source_rank", "words_before", "source_size", "target", key.alias("key"))
    own = running_totals(queued, ["source_rank", "key", "size", "mix_row"], ["size"], "queued")
    passes = own.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    reached = F.col("total_size") - F.col("words_before") + F.col("mix_pass") * F.col("source_size")
    timed = passes.select("mix_row", "mix_pass", "size", "key", (reached / F.col("target")).alias("mix_finish"))
    placed = running_totals(timed, ["mix_finish", "key", "mix_pass", "size", "mix_row"], ["size"], "mix")
    return placed.where(F.col("total_size") <= F.lit(budget)).select("mix_row", "mix_pass", "mix_finish", F.col("total_size").alias("mix_total"), "size")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Documents of the mix: the columns of ``docs`` with mix_pass, mix_finish and mix_total, a row a document and pass.

    Nothing of ``docs`` but doc_id, source and text is read, the rest is carried along.  Sort by
    mix_total to have the mix in order.  Texts without words take no budget and are in no mix; a source of
    such texts has the target 0.  Repeated rows queue one by one.  Null sources form one source, a null doc_id
    shuffles as an empty one.  An empty table gives an empty mix.
    """
    own = sized(docs)
    sizes = own.select("mix_row", "doc_id", "source", "size")
    taken = fair_queue(sizes, *source_targets(sizes, weights, share)).drop("size")
    added = ("mix_pass", "mix_finish", "mix_total")
    return own.select("mix_row", "row").join(taken, "mix_row").select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def mixed_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, size, source_size, target and ``taken``, the words that the mix takes of it, repeats counted.

    A row for every row of ``docs``; nulls, ties, repeated and no rows are as in ``mix``; texts without words have size and taken 0.
    """
    size = count_words(F.col("text").cast("string")).alias("size")
    sizes = materialize(docs.select(F.monotonically_increasing_id().alias("mix_row"), "doc_id", "source", size), "sizes")
    targets, budget = source_targets(sizes, weights, share)
    taken = fair_queue(sizes, targets, budget).groupBy("mix_row").agg(F.sum("size").alias("taken"))
    sources = targets.select(F.col("source").alias("of_source"), "source_size", "target")
    return (
        sizes.join(sources, F.col("source").eqNullSafe(F.col("of_source")))
        .join(taken, "mix_row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
