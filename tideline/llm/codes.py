"""Vector codes: product quantization in whole numbers, with nearest entries found by a vantage-point tree for each part position.

Components become integers, vectors are cut into ``PARTS`` parts, and each part position has a codebook of at most ``ENTRIES`` entries that
rounds of assignment and averaging move.  An assignment is one pass over the vectors: tasks find the nearest entries by branch and
bound and give one row of counts and sums for each entry, so a round shuffles rows in proportion to tasks, not to vectors.  The codebooks
(parts x entries) are all that the driver holds.

Branches are cut on rounded distances, but never wrongly: the distances at which a child's entries lie are kept widened, the bound of a query is
widened too, and a child at exactly the bound is visited; which entry is nearest is decided on integer squares alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import BROADCAST_ROWS, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components may have so many bits; squares of their differences, summed over a vector of up to 64 components, then fit in a long.
MOST_BITS = 27
_ROWS = 8192
#: By so much distances are rounded outwards; square roots of longs are exact to 2^-52.
_WIDER = 2.0**-48


class RangeError(ValueError):
    """Components too large for whole-number distances."""


@dataclass(frozen=True)
class Node:
    """A vantage entry, and its children with the least and greatest distance of their entries from it, rounded outwards."""

    entry: int
    middle: float
    children: tuple[tuple[float, float, Node], ...]


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = points - entry
    return np.einsum("ij,ij->i", away, away)


def build(entries: np.ndarray, own: np.ndarray | None = None) -> Node:
    """A vantage-point tree over the rows of ``entries``: the first stands apart, the nearer half of the rest on one side, the others on the other."""
    own = np.arange(len(entries)) if own is None else own
    rest = own[1:]
    d = np.sqrt(_squares(entries[rest], entries[own[0]]).astype(np.float64))
    order = np.argsort(d, kind="stable")
    half = (len(rest) + 1) // 2
    children = tuple((float(d[g].min() * (1 - _WIDER)), float(d[g].max() * (1 + _WIDER)), build(entries, rest[g])) for g in (order[:half], order[half:]) if len(g))
    return Node(int(own[0]), children[0][1] if children else 0.0, children)


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of the nearest entry, the lowest of equals, and its integer squared distance; ``visits`` gets how many entries each step met."""
    best, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(entries))

    def visit(node: Node, rows: np.ndarray) -> None:
        if visits is not None:
            visits.append(len(rows))
        square = _squares(points[rows], entries[node.entry])
        better = (square < best[rows]) | ((square == best[rows]) & (node.entry < at[rows]))
        best[rows[better]], at[rows[better]] = square[better], node.entry
        if not node.children:
            return
        d = np.sqrt(square.astype(np.float64))
        inner = d <= node.middle
        for side, order in ((inner, node.children), (~inner, node.children[::-1])):  # the likelier child first, so that the other is met with a better bound
            for least, most, child in order:
                bound = np.sqrt(best[rows].astype(np.float64)) * (1 + _WIDER)
                reach = side & (d * (1 - _WIDER) - bound <= most) & (d * (1 + _WIDER) + bound >= least)
                if reach.any():
                    visit(child, rows[reach])

    if len(points):
        visit(tree, np.arange(len(points)))
    return at, best


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of ``vectors(vec_id, embedding, label)``: components times SCALE, rounded down; written.

    Rows whose vector is null or holds a null or non-finite component are left out; one beyond MOST_BITS bits raises a RangeError.
    """
    fit = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    kept = vectors.where(fit).select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v")).withColumn("wide", F.exists("v", lambda x: (x >= 1 << MOST_BITS) | (x < -(1 << MOST_BITS))))
    table = materialize(kept.select("vec_id", "label", F.when(~F.col("wide"), F.col("v").cast("array<int>")).alias("v")), "vectors")
    if found := table.where("v is null").limit(3).collect():
        raise RangeError(f"components of {MOST_BITS} bits or more: {[r.vec_id for r in found]}")
    return table


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _matrix(part.column("v"), width)


def _assigned(books: list[np.ndarray], trees: list[Node], x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, nearest entries, squared distances) for each part position of the vectors ``x``."""
    w = x.shape[1] // PARTS
    for p, (book, tree) in enumerate(zip(books, trees, strict=True)):
        part = np.ascontiguousarray(x[:, p * w : (p + 1) * w])
        yield p, part, *nearest(tree, book, part)


def _summer(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(b) for b in books]
        k, w = len(books[0]), width // PARTS
        n, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, w), np.int64)
        for _, x in _batches(batches, width):
            for p, part, at, _ in _assigned(books, trees, x):
                n[p] += np.bincount(at, minlength=k)
                np.add.at(sums[p], at, part)
        held = np.argwhere(n > 0)
        columns = {"part": held[:, 0], "entry": held[:, 1], "n": n[n > 0]} | {f"s{i}": sums[n > 0][:, i] for i in range(w)}
        yield pa.record_batch({c: pa.array(v.astype(np.int64)) for c, v in columns.items()})

    return run


def _coder(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(b) for b in books]
        for part, x in _batches(batches, width):
            codes, errors = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, _, at, square in _assigned(books, trees, x):
                codes[:, p] = at
                errors += square
            text = [c.tobytes().hex() for c in codes]
            yield pa.record_batch({"vec_id": part.column("vec_id"), "label": part.column("label"), "code": pa.array(text, pa.string()), "error": pa.array(errors)})

    return run


def train(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of assignment and averaging over all ``vectors`` of ``width`` components, by part position."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, width // PARTS)
    books = [np.ascontiguousarray(start[:, p]) for p in range(PARTS)]
    sums = [f"s{i}" for i in range(width // PARTS)]
    for _ in range(rounds):
        found = vectors.select("v").mapInArrow(_summer(books, width), ", ".join(f"{c} long" for c in ("part", "entry", "n", *sums)))
        rows = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect()  # parts x entries at most
        books = [b.copy() for b in books]
        for r in rows:
            books[r.part][r.entry] = [r[s] // r.n for s in sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of the codebooks, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of ``vectors(vec_id, embedding, label)``.

    Codebooks start as the parts of the least vec_ids (null last, of equal ids the least vector); entries that no part is nearest to stay.  All
    kept vectors must have the length of the first of these: others, and all of a length that PARTS does not divide, get null code, error
    and label_error, for no code can stand for them.  Errors are summed over all rows with an equal label, nulls together.  Repeated rows are rows of
    their own; further columns are not read; no rows give no rows.
    """
    kept = whole_vectors(vectors)
    lead = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).limit(1).collect()
    width = lead[0].n if lead else 0
    even = F.lit(width % PARTS == 0) & (F.size("v") == width)
    own = kept.where(even)
    books = train(own, width) if lead and width % PARTS == 0 else []
    out = "vec_id long, label long, code string, error long"
    named = own.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v")
    coded = materialize(named.mapInArrow(_coder(books, width), out), "codes") if books else kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).where("false")
    errors = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "errors")
    few = errors.count() <= BROADCAST_ROWS
    of = errors.withColumnRenamed("label", "of")
    rows = coded.join(F.broadcast(of) if few else of, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error")
    odd = kept.where(~even).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
    return rows.unionByName(odd).withColumn("codebooks_sha256", F.lit(digest(books)))
