"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words that ignores some places, so a window still meets its source when a word there
was replaced.  Hashes of all windows of the benchmark are joined with those of all windows of the documents; around
each hit the passage is laid on the document word by word (a word that agrees counts 1, one that does not costs
``MISMATCH``).  The passage is held if the widest stretch that does not count below zero has enough words that agree;
what they share is the best stretch where that alone has enough, else the widest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import text_kernel as kernel
from tideline.llm.scratch import materialize, numbered, scope, without

#: 1 reads a word, 0 ignores it.  Replacing every third, fourth or fifth word leaves a window of some mask whole, and so
#: does any choice of a fifth of the words of a passage of eight or more; the last two masks are for those.
MASKS = ("111111", "1111011", "1110111", "11011011", "110101011", "11100111")
MISMATCH = 2
#: Words that a shared stretch must hold, and the share of the passage that does in its stead for shorter ones.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
#: Passages of fewer words than SHORTEST say nothing inside a text and count only as the whole of one; those of fewer than MASKED have masks of their own.
SHORTEST, MASKED = 5, 8
#: Replacing any one word of a passage of five to seven leaves a window of one of these whole.
SHORT_MASKS = ("1111", "10111", "11011", "11101")
#: Places of a seed in the filter, and bits that the filter has for each seed: one false hit in some 140,000 windows.
PLACES, BITS_A_SEED = 6, 40
#: Bits of a filter, as powers of two (the greatest takes 32 MB); a benchmark with more seeds is searched in parts, each with a filter of its own.
LEAST_BITS, MOST_BITS = 20, 28
#: Places of passages that one row holds for verification; a document with more has several rows.
LAID = 512
_WORDS = kernel.alphabet(kernel.ASCII_PUNCTUATION, fold_case=True)
_OFFSETS = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS + SHORT_MASKS]


def _seeds(w: kernel.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, hash) of the windows of a chunk, mask by mask; then texts of one to SHORTEST - 1 words as a whole."""
    of, size = w.documents(), np.diff(w.bounds)
    for k, at in enumerate(_OFFSETS):
        h = kernel.mix(kernel.windows(w.hash, at), 20 + k)
        inside = of[: len(h)] == of[at[-1] : at[-1] + len(h)]
        yield np.flatnonzero(inside), h[inside]
    for n in range(1, SHORTEST):
        own = w.hash[size[of] == n]
        yield w.bounds[:-1][size == n], kernel.mix(kernel.windows(own, list(range(n)))[::n], 60 + n) if len(own) else own


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, offsets in kernel.chunks(batch.column("text")):
            w = kernel.words(data, offsets, _WORDS)
            of, size = w.documents(), np.diff(w.bounds)
            ids = np.asarray(batch.column("item_id"))
            for k, (at, h) in enumerate(_seeds(w)):
                n = size[of[at]]
                own = n < SHORTEST if k >= len(_OFFSETS) else (n >= SHORTEST) & (n < MASKED) if k >= len(MASKS) else n >= MASKED
                at, h = at[own], h[own]
                yield pa.record_batch({"item_id": pa.array(ids[lo + of[at]], pa.int64()), "item_at": pa.array(at - w.bounds[of[at]], pa.int64()), "seed": h.view(np.int64)})


def _bits(seeds: DataFrame, power: int) -> np.ndarray:
    """The filter as 2^power bits, put together on the cluster; at most 2^power / 64 rows come back."""
    first, step = F.shiftrightunsigned("seed", 32), F.col("seed").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    places = seeds.select(F.explode(F.array(*[(first + i * step).bitwiseAND(F.lit((1 << power) - 1)) for i in range(PLACES)])).alias("place"))
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (power - 6), np.uint64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _passing(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Which of the seeds pass the filter."""
    mask = np.uint64(64 * len(table) - 1)
    first, step = seed >> np.uint64(32), (seed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    some = np.arange(len(seed))
    for i in range(PLACES):
        place = (first[some] + np.uint64(i) * step[some]) & mask
        some = some[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return some


_SUSPECTS = "row_id long, doc_id long, text string, hits array<struct<doc_at:long,seed:long>>"


def _suspects(table):
    """The rows with a window that passes the filter, with those windows; all others end here, and their texts never move."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for lo, hi, data, offsets in kernel.chunks(batch.column("text")):
                w = kernel.words(data, offsets, _WORDS)
                of = w.documents()
                found = [(of[at[some]], at[some], h[some]) for at, h in _seeds(w) for some in [_passing(bits, h)] if len(some)]
                if not found:
                    continue
                doc, at, seed = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(doc, kind="stable")
                docs, first = np.unique(doc[order], return_index=True)
                hits = pa.StructArray.from_arrays([pa.array((at - w.bounds[doc])[order], pa.int64()), pa.array(seed[order].view(np.int64))], ["doc_at", "seed"])
                rows = batch.slice(lo, hi - lo).take(pa.array(docs))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), hits)
                yield pa.record_batch([*(rows.column(c) for c in ("row_id", "doc_id", "text")), lists], names=["row_id", "doc_id", "text", "hits"])

    return suspects


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(first, end, words that agree) of the stretch with the highest count of words that agree less MISMATCH each that does not."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    first = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return first, end, int(same[first:end].sum())


def widest_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(first, end, words that agree) of the stretch with most words that agree of those that do not count below zero, its ends agreeing."""
    agree = np.concatenate([[0], np.cumsum(same)])
    total = (1 + MISMATCH) * agree - MISMATCH * np.arange(len(agree))
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(agree - agree[first]))
    inside = first[end] + np.flatnonzero(same[first[end] : end])
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def shared(same: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
    """(first, end, words that agree) of what a document shares with a passage laid on it; None where that is not enough."""
    enough = lambda found: found[2] and found[2] >= min(LEAST_WORDS, LEAST_SHARE * item_words)
    return next(filter(enough, (f(same) for f in (best_stretch, widest_stretch))), None)


def _lay(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for lo, hi, data, offsets in kernel.chunks(texts):
        w = kernel.words(data, offsets, _WORDS)
        out += [w.hash[w.bounds[i] : w.bounds[i + 1]] for i in range(hi - lo)]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row is a document with LAID passages at most to lay on it: (item_id, shift, text)."""
    for batch in batches:
        for row in range(batch.num_rows):
            doc = _lay(batch.column("text").slice(row, 1))[0]
            laid = batch.column("laid").slice(row, 1).flatten()
            ids, shifts = laid.field("item_id").to_pylist(), laid.field("shift").to_pylist()
            found = []
            for item_id, shift, item in zip(ids, shifts, _lay(laid.field("item")), strict=True):
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                if hit := shared(item[lo:hi] == doc[lo + shift : hi + shift], len(item)):
                    first, end, agree = hit
                    found.append((item_id, lo + first + shift, end - first, agree, len(item)))
            cols = np.array(found, np.int64).reshape(-1, 5)
            own = {k: batch.column(k).take(pa.array(np.full(len(found), row))) for k in ("row_id", "doc_id")}
            yield pa.record_batch({**own, **{k: pa.array(cols[:, j]) for j, k in enumerate(("item_id", "doc_word", "n_words", "n_same", "item_words"))}})


def _search(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_id, doc_id, item_id, ...) of all passages held by ``texts(row_id, doc_id, text)``, a row a shift; written.

    Only rows with a window that passes the filter are written and shuffled.  Where the benchmark needs more than one filter,
    ``texts`` is written first, so that its row numbers hold from one part to the next.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    seeds = materialize(items.mapInArrow(_passages, "item_id long, item_at long, seed long"), "seeds")
    bits = seeds.count() * BITS_A_SEED
    parts = max(1, -(-bits >> MOST_BITS))
    power = max(LEAST_BITS, min(MOST_BITS, max(1, bits // parts).bit_length()))
    own = texts if parts == 1 else materialize(texts, "texts")
    checked = None
    for part in range(parts):
        some = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == part) if parts > 1 else seeds
        table = texts.sparkSession.sparkContext.broadcast(_bits(some, power))
        suspects = materialize(own.mapInArrow(_suspects(table), _SUSPECTS), "suspects")
        found = _checked(suspects, some, items)
        checked = found if checked is None else checked.unionByName(found)
    return materialize(checked, "checked")


def _checked(suspects: DataFrame, seeds: DataFrame, items: DataFrame) -> DataFrame:
    hits = suspects.select("row_id", F.inline("hits"))
    laid = materialize(hits.join(seeds, "seed").select("row_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    piece = F.floor((F.row_number().over(Window.partitionBy("row_id").orderBy("item_id", "shift")) - 1) / LAID).alias("piece")
    places = laid.select("row_id", "item_id", "shift", piece).join(items.withColumnRenamed("text", "item"), "item_id")
    of_row = places.groupBy("row_id", "piece").agg(F.collect_list(F.struct("item_id", "shift", "item")).alias("laid"))
    return suspects.select("row_id", "doc_id", "text").join(of_row, "row_id").select("row_id", "doc_id", "text", "laid").mapInArrow(_verify, "row_id long, doc_id long, item_id long, doc_word long, n_words long, n_same long, item_words long")


def contaminated(docs: DataFrame, benchmark: DataFrame, null_ids: bool = False) -> DataFrame:
    """(doc_id, item_id, doc_word, n_words, n_same, item_words): passages of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``.

    A row a document and passage, its longest shared stretch: from word ``doc_word`` over ``n_words`` words, of which ``n_same``
    agree: LEAST_WORDS, or LEAST_SHARE of a shorter passage, and at least MISMATCH of MISMATCH + 1 words there.  A passage of MASKED or
    more words with LEAST_SHARE of them in place is always found; with fewer in place, where a window of some mask is whole.
    Words are runs of letters and digits (and all beyond ASCII), A-Z lower-cased.

    Null and empty texts hold nothing; a passage under SHORTEST words is held by texts that are it and nothing else; rows with a null item_id are
    not looked at, those with a null doc_id only with ``null_ids``, and are one document then.  Repeated rows of a doc_id are searched one by one and their best is given; those of an item_id are looked at
    together.  Empty tables give no rows; other columns are not read.
    """
    texts = docs.where("text is not null" if null_ids else "doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scope() as own:
        checked = _search(texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), benchmark)
        own.keep(checked)
    best = F.max_by(F.struct("doc_word", "n_words", "n_same", "item_words"), F.struct("n_same", -F.col("n_words"), -F.col("doc_word"))).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, null_ids: bool = False) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; rows with a null doc_id are looked at with ``null_ids``, else they stay.

    Null and empty texts stay; of repeated rows each is judged by its text; all columns are carried along in a struct, whatever their names; without documents
    or passages nothing goes.
    """
    with scope() as own:
        rows = numbered(docs)
        held = _held(rows, benchmark, null_ids)
        own.keep(rows, held)
    return without(rows, held).select("row.*")


def _held(rows: DataFrame, benchmark: DataFrame, null_ids: bool) -> DataFrame:
    """(row_id) of the ``rows(row_id, row)`` that hold a passage; written."""
    texts = rows.select("row_id", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")).where("text is not null")
    return materialize(_search(texts if null_ids else texts.where("doc_id is not null"), benchmark).select("row_id").distinct(), "held")
