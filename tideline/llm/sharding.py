"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns ``VIRTUAL`` points of a ring of ``CELLS`` places; a document belongs to the first point at or after its
own place.  A shard takes no more than its bound, the mean number of rows rounded up or down, so that counts are at most one
apart; rows that find their shard full continue clockwise to the next point whose shard has room.  The walk is
done on counts of the arcs between points (a table of fixed size), and each row finds its piece of an arc by its
rank on the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.ordered import global_rank

CELLS = 1 << 16
VIRTUAL = 64
#: The walk takes (shards * VIRTUAL)^2 steps at most, all in one row, some ten million for these; for more, deal into groups of shards first.
MOST_SHARDS = 50


def _cell(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def _points(docs: DataFrame, shards: int) -> DataFrame:
    """(arc, shard, from_cell, to_cell): arc i holds the cells after point i - 1 up to and with point i; the last wraps."""
    spark = docs.sparkSession
    points = spark.range(shards * VIRTUAL).select((F.col("id") % shards).cast("int").alias("shard"), F.md5(F.concat(F.lit("point "), (F.col("id") % shards).cast("string"), F.lit(" "), F.floor(F.col("id") / shards).cast("string"))).alias("digest"))
    w = Window.orderBy("cell", "digest")
    return points.withColumn("cell", _cell(F.col("digest"))).select((F.row_number().over(w) - 1).alias("arc"), "shard", (F.coalesce(F.lag("cell").over(w), F.lit(-1)) + 1).alias("from_cell"), F.col("cell").alias("to_cell"))


#: Arcs with more rows than their shard has room for, in turn; each hands its rows on clockwise, point by point.
_WALK = """
aggregate(over, named_struct('room', room, 'got', cast(array() as array<struct<arc:int,step:int,shard:int,n:bigint>>), 'need', 0L),
  (s, o) -> aggregate(sequence(1, {points}), named_struct('room', s.room, 'got', s.got, 'need', o.need),
    (t, i) -> case when t.need = 0L or t.room[ring[(o.arc + i) % {points}]] = 0L then t else named_struct(
      'room', transform(t.room, (x, k) -> if(k = ring[(o.arc + i) % {points}], x - least(x, t.need), x)),
      'got', array_append(t.got, named_struct('arc', o.arc, 'step', i, 'shard', ring[(o.arc + i) % {points}], 'n', least(t.room[ring[(o.arc + i) % {points}]], t.need))),
      'need', t.need - least(t.room[ring[(o.arc + i) % {points}]], t.need)) end)).got
"""


def _pieces(arcs: DataFrame, shards: int) -> DataFrame:
    """(arc, pieces): which shard takes which ranks of the arc's rows.  ``arcs(arc, shard, n)`` has every arc."""
    whole = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(whole)
    bound = F.floor(total / shards).cast("long") + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    own = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    homes = arcs.withColumn("bound", bound).withColumn("home", F.greatest(F.lit(0), F.least("n", F.col("bound") - F.sum("n").over(own) + F.col("n"))))
    left = homes.withColumn("left", F.col("bound") - F.sum("home").over(Window.partitionBy("shard")))
    ring = left.agg(
        F.transform(F.array_sort(F.collect_set(F.struct("shard", "left"))), lambda x: x["left"]).alias("room"),
        F.transform(F.array_sort(F.collect_list(F.struct("arc", "shard"))), lambda x: x["shard"]).alias("ring"),
        F.array_sort(F.collect_list(F.when(F.col("n") > F.col("home"), F.struct("arc", (F.col("n") - F.col("home")).alias("need"))))).alias("over"),
    )
    walked = ring.select(F.explode(F.expr(_WALK.format(points=shards * VIRTUAL))).alias("p")).select("p.*")
    pieces = homes.select("arc", F.lit(0).alias("step"), "shard", F.col("home").alias("n")).unionByName(walked).where("n > 0")
    along = Window.orderBy("arc", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("shard").orderBy("arc", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pieces.withColumn("upto", F.sum("n").over(along)).withColumn("shift", F.sum("n").over(within) - F.col("upto"))
    return ends.groupBy("arc").agg(F.array_sort(F.collect_list(F.struct("upto", "shard", "shift"))).alias("pieces"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with shard (0 to shards - 1) and slot, gapless from 0 in each shard; counts are at most one apart.

    The key is doc_id as text (null: empty); rows with equal keys count one by one, so even a key that holds most rows is
    shared out once its shard is full.  Only doc_id and text are read, other columns are carried along (those
    named shard or slot are replaced).  An empty table gives no rows.  ``shards`` is 1 to MOST_SHARDS.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct("*").alias("row"), digest.alias("digest"), crc.alias("crc"))
    ranked = global_rank(keyed, ["digest", "crc"], "ring").withColumn("cell", _cell(F.col("digest")))
    points = _points(docs, shards)
    last = points.agg(F.max("to_cell").alias("last"))
    inside = points.select("arc", F.explode(F.expr("if(from_cell <= to_cell, sequence(from_cell, to_cell), cast(array() as array<int>))")).alias("cell"))
    # rows after the last point belong to arc 0 but rank last; they are its second stretch, counted as an arc of their own
    beyond = last.select(F.lit(shards * VIRTUAL).alias("arc"), F.explode(F.expr(f"if(last < {CELLS - 1}, sequence(last + 1, {CELLS - 1}), cast(array() as array<int>))")).alias("cell"))
    cells = inside.unionByName(beyond)
    counts = ranked.groupBy("cell").agg(F.count("*").alias("rows"))
    filled = cells.join(counts, "cell").groupBy("arc").agg(F.sum("rows").alias("rows"))
    arcs = points.select("arc", "shard").unionByName(points.where("arc = 0").select(F.lit(shards * VIRTUAL).alias("arc"), "shard"))
    counted = arcs.join(filled, "arc", "left").select("arc", "shard", F.coalesce("rows", F.lit(0)).cast("long").alias("n"))
    lookup = cells.join(_pieces(counted, shards), "arc").select("cell", "pieces")
    piece = F.filter("pieces", lambda p: p["upto"] > F.col("rank"))[0]
    placed = ranked.join(F.broadcast(lookup), "cell").withColumn("piece", piece)  # at most CELLS rows
    slot = (F.col("rank") + F.col("piece.shift")).alias("slot")
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], F.col("piece.shard").alias("shard"), slot)


def sharded_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, the law kept, shard and slot.

    A null text has no bytes; nulls, ties, repeated and no rows are as in ``shard``; of equal doc_ids the text's crc32 tells the order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = slim.withColumn("text", F.col("text_crc32").cast("string"))  # orders equal keys; the texts themselves need not move
    return shard(keyed, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
