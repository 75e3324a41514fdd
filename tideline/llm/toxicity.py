"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its terms, hashed into ``BUCKETS`` places.  Over the labelled rows of the training sample, each
place's share in toxic and other documents is counted; the ``TERMS`` places that tell most apart become the model's features.  The
machine learns a weight for each and, by ``FACTORS`` latent factors, one for every pair, so that a term may
count only beside another.  Scoring reads each whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text_kernel as kernel
from tideline.llm.scratch import drop, materialize

BUCKETS = 1 << 20
TERMS = 2048
FACTORS = 8
#: Of them, so many are chosen for what they tell beside one of the ``ANCHORS`` that stand best on their own.
BESIDE, ANCHORS = 256, 16
#: Rows of the sample that tell what stands beside the anchors.
BESIDE_ROWS = 8_000
#: Standard errors that a term must tell apart, alone and beside an anchor; of thousands of terms that tell nothing few reach them.
LEAST_Z, LEAST_Z_BESIDE = 2.5, 4.0
#: Terms are words and, of longer ones, the first so many letters, which inflected forms have in common.
PREFIXES = (4, 5)
#: What a toxic row weighs in the loss; toxic rows are few, and a miss costs more than a false alarm.
TOXIC_WEIGHT = 3.0
#: Labelled rows that the machine is fitted on.
SAMPLE = 40_000
_TERMS = kernel.alphabet(kernel.ASCII_PUNCTUATION, fold_case=True)


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of <v_i, v_j>) over the features ``places`` of a text."""

    places: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factor
        z = self.bias + x @ self.weight + 0.5 * (s * s - x @ (self.factor * self.factor)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of the distinct terms of a chunk, by document and place."""
    w = kernel.words(data, offsets, _TERMS)
    of = w.documents().astype(np.uint64) * np.uint64(BUCKETS)
    keys = [of + kernel.mix(w.hash, 9) % np.uint64(BUCKETS)]
    letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each begins
    first = np.searchsorted(letters, w.start)
    for k in PREFIXES:
        end = letters[np.minimum(first + k, len(letters) - 1)]
        long = end < w.end
        h = kernel.span_hashes(data, w.start[long], end[long], _TERMS)
        keys.append(of[long] + kernel.mix(h, 9 + k) % np.uint64(BUCKETS))
    key = np.unique(np.concatenate(keys))
    return (key // np.uint64(BUCKETS)).astype(np.int64), (key % np.uint64(BUCKETS)).astype(np.int32)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in kernel.chunks(batch.column("text")):
            doc, place = _terms(data, offsets)
            ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
            part = batch.slice(lo, hi - lo)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "terms": pa.ListArray.from_arrays(pa.array(ends), pa.array(place))})


def _scores(machine: Machine, feature: np.ndarray, texts: pa.Array) -> np.ndarray:
    scores = [np.zeros(0)]
    for lo, hi, data, offsets in kernel.chunks(texts):
        doc, place = _terms(data, offsets)
        at = feature[place]
        for first in range(0, hi - lo, 256):
            n = min(256, hi - lo - first)
            own = (doc >= first) & (doc < first + n) & (at >= 0)
            x = np.zeros((n, len(machine.places)), np.float32)
            x[doc[own] - first, at[own]] = 1
            scores.append(machine.score(x))
    return np.concatenate(scores).astype(np.float64)


def _features(machine: Machine) -> np.ndarray:
    feature = np.full(BUCKETS, -1, np.int32)
    feature[machine.places] = np.arange(len(machine.places))
    return feature


def _scorer(machine: Machine):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = _features(machine)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(_scores(machine, feature, batch.column("text")))})

    return score


def _keeper(machine: Machine):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = _features(machine)
        for batch in batches:
            yield batch.filter(pa.array(_scores(machine, feature, batch.column("text")) < 0.5))

    return keep


def fit_machine(x: list[np.ndarray], y: np.ndarray, places: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 1e-3, batch: int = 256, seed: int = 9) -> Machine:
    """Logistic loss, AdaGrad, in batches; ``x`` holds each row's feature numbers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = len(places)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    bias, w, v = np.log(base / (1 - base)), np.zeros(k, np.float32), rng.normal(0, 0.01, (k, FACTORS)).astype(np.float32)
    gb, gw, gv = 1e-6, np.full(k, 1e-6, np.float32), np.full((k, FACTORS), 1e-6, np.float32)
    for _ in range(epochs if k else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            m = np.zeros((len(rows), k), np.float32)
            for i, r in enumerate(rows):
                m[i, x[r]] = 1
            s = m @ v
            z = bias + m @ w + 0.5 * (s * s - m @ (v * v)).sum(1)
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[rows]) * np.where(y[rows] > 0, TOXIC_WEIGHT, 1)
            e = e.astype(np.float32) / len(rows)
            db, dw = float(e.sum()), m.T @ e + decay * w
            dv = m.T @ (e[:, None] * s) - (m.T @ e)[:, None] * v + decay * v
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias -= rate * db / np.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine(places, float(bias), w, v)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the model must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _tells(n: Column, n1: Column, rows: Column, toxic: Column) -> Column:
    """How far apart a term's shares in toxic and other rows are, in standard errors."""
    p1, p0 = (n1 + 0.5) / (toxic + 1.0), (n - n1 + 0.5) / (rows - toxic + 1.0)
    return F.abs(F.log(p1 / p0) / F.sqrt(1 / (n1 + 0.5) + 1 / (n - n1 + 0.5)))


def choose_terms(lists: DataFrame, terms: int = TERMS, beside: int = BESIDE, anchors: int = ANCHORS) -> np.ndarray:
    """The places of ``lists(toxic, terms)`` that the machine is fitted on, ascending.

    Most stand out on their own.  The rest tell toxic from other rows among those that hold a common term or one of the best: a term
    that means nothing alone and something beside another is found so, and the machine learns the pair.
    """
    rows, toxic = lists.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = lists.select("toxic", F.explode("terms").alias("place")).groupBy("place").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).where("n >= 4")
    counts = materialize(counts.withColumn("z", _tells(F.col("n"), F.col("n1"), F.lit(rows), F.lit(toxic))), "counts")
    alone = [r[0] for r in counts.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "place").limit(terms).select("place").collect()]
    # half of the anchors stand best on their own, half are the most frequent in toxic rows
    often = [r[0] for r in counts.orderBy(F.desc("n1"), "place").limit(anchors).select("place").collect()]
    wanted = list(dict.fromkeys([*alone[: anchors // 2], *often]))[:anchors]
    some = lists.where(F.pmod(F.xxhash64("terms"), F.lit(1_000_000)) < int(min(1.0, BESIDE_ROWS / max(1, rows)) * 1_000_000))
    held = some.select("toxic", "terms", F.explode(F.array_intersect("terms", F.array(*[F.lit(int(a)) for a in wanted]).cast("array<int>"))).alias("anchor")) if wanted else None
    if held is None:
        return np.zeros(0, np.int64)
    of_anchor = held.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum("toxic").alias("of_toxic"))
    pairs = held.select("anchor", "toxic", F.explode("terms").alias("place")).where("place <> anchor").groupBy("anchor", "place").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).where("n >= 4")
    told = pairs.join(F.broadcast(of_anchor), "anchor").withColumn("z", _tells(F.col("n"), F.col("n1"), F.col("rows"), F.col("of_toxic")))
    best = told.groupBy("place").agg(F.max("z").alias("z")).where(F.col("z") >= LEAST_Z_BESIDE).orderBy(F.desc("z"), "place").limit(terms).select("place").collect()
    own = list(dict.fromkeys([*alone[: terms - beside], *wanted, *(r[0] for r in best), *alone]))[:terms]
    drop(counts)
    return np.sort(np.array(own, np.int64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from about ``sample`` of the labelled texts that are not held out, drawn by a hash of doc_id, then of the text's terms.

    The bound lets the labels be broadcast, so no text is shuffled.  Rows without a label of 0 or 1 are left out; a document labelled
    both ways is toxic; rows of a doc_id with the same terms count once, so that the sample is bounded however often a doc_id
    repeats.  Without labels every score is the prior.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    part = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(part * 1_000_000_000))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = lists = materialize(texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_term_lists, "doc_id long, toxic int, terms array<int>").distinct(), "terms")
    if (rows := lists.count()) > sample:
        lists = lists.where(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(1_000_000_000)) < int(sample / rows * 1_000_000_000))
    places = choose_terms(lists)
    wanted = F.array(*[F.lit(int(p)) for p in places]).cast("array<int>")
    got = lists.select("doc_id", "toxic", F.array_sort(F.array_intersect("terms", wanted)).alias("terms")).toPandas()
    drop(made)
    got = got.assign(key=[tuple(t) for t in got["terms"]]).sort_values(["doc_id", "toxic", "key"], kind="stable")
    return fit_machine([np.searchsorted(places, np.asarray(t, np.int64)) for t in got["terms"]], got["toxic"].to_numpy(np.float32), places)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; rows with a null doc_id or text are scored like all others.

    What stays is written to the shared folder.  Repeated rows go or stay alike; no rows give no rows; all columns are carried along.
    """
    machine = train(docs, labels, sample)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return materialize(rows.mapInArrow(_keeper(machine), rows.schema), "clean")


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs(doc_id, text)``.

    An empty, wordless or null text gets the model's bias.  Repeated rows are scored one by one, a null doc_id
    is scored and not held out.  Other columns are not read; no rows give no rows.
    """
    machine = train(docs, labels, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialize(texts.mapInArrow(_scorer(machine), "doc_id long, score double"), "scores")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
