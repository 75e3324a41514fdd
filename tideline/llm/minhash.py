"""Circulant MinHash near-duplicate groups.

Two permutations make a whole signature.  The first, sigma, scatters shingles over ``UNIVERSE``
places; the second, pi, is one fixed table of that length.  Coordinate k is the least value of pi, circularly
shifted by k, over the places that a document occupies, so a shingle's share in all
coordinates is one contiguous slice of the table.  Coordinates are banded; documents
that agree in a band are candidates, and only pairs whose full shingle sets reach the threshold are links.

How it stays linear where copies abound:

* documents with equal words in equal order form one class (a cryptographic digest of them) and only a class's least
  document goes on, so thousands of exact copies cost one aggregate;
* each bucket first compares its members with one hub, the member that shares most buckets (the
  middle of a group of near copies), and the links found are contracted to components; a hub's text moves once
  for ``CHUNK`` members, whatever its length;
* only members of *different* components that still share a bucket go on to an exact prefix-filter join, so no
  link that could join two components is lost, while a large group of near copies is settled by its hub.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import text_kernel as kernel
from tideline.llm.components import connected_components
from tideline.llm.scratch import BROADCAST_ROWS, drop, materialize, numbered, scope, without

#: A pair at similarity 0.8 shares no band with a chance of (1 - 0.8^5)^30 = 7e-6.
BANDS, ROWS = 30, 5
UNIVERSE = 1 << 20
#: Members that one copy of a hub's text is compared with.
CHUNK = 512
_WORDS = kernel.alphabet(kernel.ASCII_SPACE, fold_case=True)
_FOLD = np.where(_WORDS.inside, np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)), 32).astype(np.uint8)


def _second_permutation(length: int) -> np.ndarray:
    """pi as a table of UNIVERSE values, its head repeated so that every circular slice is contiguous."""
    pi = np.random.Generator(np.random.PCG64(20)).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: length - 1]]), length)


def _band_keys(s: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """The band keys of one document's distinct shingles, 2048 shingles at a time."""
    place = (kernel.mix(s, 11) % np.uint64(UNIVERSE)).astype(np.int64)
    least = slices[place[:2048]].min(axis=0)
    for at in range(2048, len(place), 2048):
        least = np.minimum(least, slices[place[at : at + 2048]].min(axis=0))
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
    for r in range(ROWS):
        total = kernel.mix(total + rows[:, r], r)
    return total.view(np.int64)


def _plain(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each document's words, folded, one blank apart."""
    inside = _WORDS.inside[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    folded = _FOLD[data[keep]].tobytes()
    return [folded[a:b].strip(b" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _scan(shingle_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = _second_permutation(BANDS * ROWS)
        for batch in batches:
            n = batch.num_rows
            size, k1, k2 = (np.zeros(n, np.int64) for _ in range(3))
            keys, counts = [], np.zeros(n + 1, np.int32)
            for lo, hi, data, offsets in kernel.chunks(batch.column("text")):
                w, plain = kernel.words(data, offsets, _WORDS), _plain(data, offsets)
                for i in range(hi - lo):
                    s = kernel.shingles(w.hash[w.bounds[i] : w.bounds[i + 1]], shingle_words)
                    if not len(s):
                        continue
                    size[lo + i] = len(s)
                    k1[lo + i], k2[lo + i] = np.frombuffer(hashlib.blake2b(plain[i], digest_size=16).digest(), np.int64)
                    keys.append(_band_keys(s, slices))
                    counts[lo + i + 1] = BANDS
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(flat))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": size, "k1": k1, "k2": k2, "bands": bands})

    return scan


def _wide_sets(texts: pa.Array, shingle_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles as 128 bits: sorted hashes, and beside each another one of the same words."""
    for lo, hi, data, offsets in kernel.chunks(texts):
        w = kernel.words(data, offsets, _WORDS)
        other = kernel.span_hashes(data, w.start, w.end, _WORDS, seed=1)
        for i in range(hi - lo):
            own = slice(w.bounds[i], w.bounds[i + 1])
            words = list(range(min(shingle_words, own.stop - own.start)))
            if not words:
                yield w.hash[:0], w.hash[:0]
                continue
            first, at = np.unique(kernel.windows(w.hash[own], words), return_index=True)
            yield first, kernel.windows(other[own], words)[at]


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    if not len(x[0]) or not len(y[0]):
        return 0
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    return int(((x[0][at] == y[0]) & (x[1][at] == y[1])).sum())


def _verify(shingle_words: int, percent: int):
    """Rows come as a hub's text, then those of a chunk of its members; in the hub's own row it is the member."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("hub", "chunk", "member", "is_hub"))
            found = []
            for hub, chunk, member, is_hub, s in zip(*columns, _wide_sets(batch.column("text"), shingle_words), strict=True):
                if (hub, chunk) not in sets:
                    sets = {(hub, chunk): []}
                if is_hub:
                    sets[hub, chunk].append(s)
                    continue
                for of_hub in sets[hub, chunk]:  # a doc_id with several texts has several
                    both = _shared(of_hub, s)
                    if both and 100 * both >= percent * (len(of_hub[0]) + len(s[0]) - both):
                        found.append((min(hub, member), max(hub, member)))
                        break
            cols = np.array(found, np.int64).reshape(-1, 2)
            yield pa.record_batch({"a": pa.array(cols[:, 0]), "b": pa.array(cols[:, 1])})

    return verify


def _shingle_rows(shingle_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernel.chunks(batch.column("text")):
                w = kernel.words(data, offsets, _WORDS)
                sets = [kernel.shingles(w.hash[w.bounds[i] : w.bounds[i + 1]], shingle_words).view(np.int64) for i in range(hi - lo)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch(
                    {"rep": part.column("doc_id"), "n": part.column("n"), "component": part.column("component"), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))}
                )

    return rows


def scan_documents(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): a document's set size, the digest of its words and its band keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan(shingle_words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
    )


def _confirm(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Of the pairs (hub, member), those (as a < b) whose full shingle sets reach the threshold.

    A hub's members are dealt to chunks of about CHUNK, and its text goes to each chunk once; members' texts go with their pairs.
    """
    chunks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.col("chunks")).alias("chunk"))
    dealt = materialize(dealt, "pairs")
    of = lambda name: texts.select(F.col("doc_id").alias(name), "text")
    members = dealt.join(of("member"), "member").select("hub", "chunk", F.lit(False).alias("is_hub"), "member", "text")
    hubs = dealt.select("hub", "chunk").distinct().join(of("hub"), "hub").select("hub", "chunk", F.lit(True).alias("is_hub"), F.col("hub").alias("member"), "text")
    rows = hubs.unionByName(members).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.desc("is_hub"))
    return rows.select("hub", "chunk", "member", "is_hub", "text").mapInArrow(_verify(shingle_words, percent), "a long, b long").distinct()


def _across_components(members: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Every pair (a, b) of ``members(rep, n, component)`` in two components that can reach the threshold.

    Prefix filter: with shingles in one order, rarest first, two sets that share ``need`` shingles share one among
    the first ``n - need + 1`` of each.  Shingles that occur in one component only come first in that order;
    they use up places but never make a pair, so a copy with many changes of its own meets nobody.
    """
    tokens = materialize(
        texts.join(members.withColumnRenamed("rep", "doc_id"), "doc_id")
        .select("doc_id", "n", "component", "text")
        .mapInArrow(_shingle_rows(shingle_words), "rep long, n long, component long, shingles array<long>")
        .select("rep", "n", "component", F.explode("shingles").alias("shingle")),
        "tokens",
    )
    spread = tokens.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    found = tokens.join(spread.select("shingle", "df"), "shingle")
    of_rep = Window.partitionBy("rep")
    placed = found.withColumn("place", F.col("n") - F.count("*").over(of_rep) + F.row_number().over(of_rep.orderBy("df", "shingle")))
    least = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    prefix = materialize(placed.where(F.col("place") <= F.col("n") - least + 1).select("rep", "n", "component", "shingle", "place"), "prefix")
    drop(tokens)
    meet = "x.shingle = y.shingle and x.component < y.component and x.n * 100 >= y.n * {p} and y.n * 100 >= x.n * {p}"
    need = "ceil((x.n + y.n) * {p} / (100 + {p}))"
    early = " and x.place <= x.n - {need} + 1 and y.place <= y.n - {need} + 1".replace("{need}", need)
    return (
        prefix.alias("x")
        .join(prefix.alias("y"), F.expr((meet + early).replace("{p}", str(percent))))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
    )


def _towards_hubs(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as (hub, member), the hub being the end that is in more of them."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    of = lambda name: ends.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"))
    first = F.col("n_a") >= F.col("n_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"))


def _grouped(docs: DataFrame, shingle_words: int, percent: int, unique_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the scanned documents, the classes of equal texts, and the component of each class that has a link."""
    scanned = materialize(scan_documents(docs, shingle_words), "scan")
    classes = materialize(
        scanned.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    buckets = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(buckets.join(shared, "bucket"), "members")
    fits = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)

    central = members.groupBy("rep").agg(F.sum("members").alias("shares"))
    ranked = members.join(central, "rep")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("shares", (-F.col("rep")).alias("minus_rep"), "n")).alias("top")).select(
        "bucket", (-F.col("top.minus_rep")).alias("hub"), F.col("top.n").alias("hub_n")
    )
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = materialize(
        members.join(hubs, "bucket").where(F.col("hub") != F.col("rep")).where(fits(F.col("n"), F.col("hub_n"))).select("hub", F.col("rep").alias("member")).distinct(),
        "stars",
    )
    candidates = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    near = F.broadcast if candidates.count() <= BROADCAST_ROWS else lambda df: df
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(near(candidates), "doc_id", "left_semi")
    texts = materialize(texts if unique_ids else texts.dropDuplicates(["doc_id", "text"]), "texts")
    links = materialize(_confirm(stars, texts, shingle_words, percent), "links")

    first = connected_components(links)
    placed = materialize(
        members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("bucket", "rep", "n", "component"), "placed"
    )
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    unsettled = placed.join(open_buckets, "bucket").select("rep", "n", "component").distinct()
    tried = stars.select(*pair(F.col("hub"), F.col("member"))).distinct()
    across = materialize(_across_components(unsettled, texts, shingle_words, percent).join(tried, ["a", "b"], "left_anti"), "across")
    more = materialize(_confirm(_towards_hubs(across), texts, shingle_words, percent), "links")
    component = materialize(connected_components(links.unionByName(more)).withColumnRenamed("node", "rep"), "components")
    return scanned, classes, component


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, unique_ids: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text, ...)``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct shingles
    of ``shingle_words`` words (A-Z lower-cased, words apart by ASCII white space).  component_id is the least
    doc_id reachable over links; kept marks the one row of a component that stays.

    Nulls and ties: a null or wordless text has an empty set and no link; a text of fewer words has
    its whole sequence as one shingle.  A doc_id with several texts is linked by each of them (``unique_ids`` says that there is none).
    A null doc_id takes the component of documents with its words, else null, and is kept only then.  Empty tables give no rows;
    other columns are not read.
    """
    with scope() as own:
        scanned, classes, component = _grouped(docs, shingle_words, percent, unique_ids)
        own.keep(scanned, classes, component)
    of_class = classes.select("k1", "k2", "rep").join(component, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    found = scanned.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, one_row: bool = False) -> DataFrame:
    """``docs`` with the rows of one doc_id, the least, of each group; of repeated rows of a doc_id all stay, as do rows with a null doc_id.

    Groups are of rows, so a row of a doc_id can go while another with a text of its own stays.  With ``one_row`` exactly
    one row of each group stays: that of the least doc_id, null last, and among its rows the first.
    """
    with scope() as made:
        own = numbered(docs)
        ids = own.select("row_id", F.col("row.doc_id").cast("long").alias("doc_id"))
        found = near_duplicates(own.select(F.col("row_id").alias("doc_id"), F.col("row.text").alias("text")), shingle_words, percent, unique_ids=True)
        placed = materialize(found.select(F.col("doc_id").alias("row_id"), "component_id").join(ids, "row_id"), "placed")
        least = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")).alias("least"))
        gone = placed.join(least.select("least.row_id"), "row_id", "left_anti")
        if not one_row:
            gone = gone.join(least, "component_id").where(F.col("doc_id") != F.col("least.doc_id"))
        gone = materialize(gone.select("row_id"), "gone")
        made.keep(own, gone)
    return without(own, gone).select("row.*")
