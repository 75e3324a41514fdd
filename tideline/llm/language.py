"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into stretches of ``STRETCH`` bytes.  Each is read from both ends, every position gets a probability for each language from the
two states there, and a document's probabilities are the mean over all positions of all its stretches.  Training sees a bounded
sample of stretches with the language of their document; scoring reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text_kernel as kernel
from tideline.llm.scratch import drop, materialize

STRETCH = 96
UNITS = 8
#: Of the training rows, documents drawn for each language, languages (the most frequent), stretches drawn of a document, and stretches in all.
DOCS, LANGS, OF_DOCUMENT, SAMPLE = 2_000, 64, 4, 8_192
EPOCHS, BATCH, RATE = 8, 512, 0.03
#: Stretches that are read at a time.
_BLOCK = 2_048
_KINDS = ("forward", "backward")


@dataclass(frozen=True)
class Reader:
    """The languages and the parameters: for each direction the inputs of update gate, reset gate and candidate by byte (3, 256, units), their recurrent
    matrices (3, units, units) and the inner bias of the candidate; one output matrix (2 units, languages) over both states."""

    langs: tuple[str, ...]
    of: dict[str, np.ndarray]


def new_reader(langs: tuple[str, ...], units: int = UNITS, seed: int = 11) -> Reader:
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    of = {"out": draw(2 * units, len(langs), scale=0.3), "bias": np.zeros(len(langs), np.float32)}
    for k in _KINDS:
        of |= {f"{k}_in": draw(3, 256, units, scale=0.5), f"{k}_state": draw(3, units, units, scale=units**-0.5), f"{k}_inner": np.zeros(units, np.float32)}
    return Reader(langs, of)


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): where a recurrent unit usually has a hyperbolic tangent, at a fifth of its time; its slope is (1 - |y|)^2 at the value y."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def _gate(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1, with the slope 0.5 * (1 - |2 y - 1|)^2."""
    y = _squash(x)
    y *= 0.5
    y += 0.5
    return y


def _scan(of: dict[str, np.ndarray], kind: str, codes: np.ndarray, live: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
    """The state (n, units) at each step over ``codes(steps, n)``; where a stretch is not ``live`` its state is zero.  ``keep`` gets what going back needs."""
    table, matrix, inner = of[f"{kind}_in"], of[f"{kind}_state"], of[f"{kind}_inner"]
    h = np.zeros((codes.shape[1], matrix.shape[-1]), table.dtype)
    for c, alive in zip(codes.astype(np.intp), live, strict=True):
        x = [np.take(t, c, axis=0, mode="clip") for t in table]
        for part, m in zip(x, matrix[:2], strict=False):
            part += h @ m
        z, r, q = _gate(x[0]), _gate(x[1]), h @ matrix[2] + inner
        x[2] += r * q
        new = _squash(x[2])
        before, h = h, new + z * (h - new)
        if not alive.all():
            h *= alive[:, None]
        if keep is not None:
            keep.append((before, z, r, q, new))
        yield h


def _probabilities(reader: Reader, codes: np.ndarray, live: np.ndarray) -> np.ndarray:
    """(steps, languages, n): the probability of each language at each position."""
    out, units = np.ascontiguousarray(reader.of["out"].T), len(reader.of["out"]) // 2
    scores = np.empty((len(codes), len(reader.langs), codes.shape[1]), out.dtype)
    for t, h in enumerate(_scan(reader.of, "forward", codes, live)):
        np.matmul(out[:, :units], h.T, out=scores[t])
    for t, h in zip(range(len(codes) - 1, -1, -1), _scan(reader.of, "backward", codes[::-1], live[::-1]), strict=True):
        scores[t] += out[:, units:] @ h.T
    scores += reader.of["bias"][:, None]
    scores -= np.max(scores, 1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= np.sum(scores, 1, keepdims=True)
    return scores


def loss_and_gradients(reader: Reader, codes: np.ndarray, live: np.ndarray, lang: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the live positions, and its gradients by backpropagation through time in both directions."""
    of, (steps, n) = reader.of, codes.shape
    units = len(of["out"]) // 2
    kept: dict[str, list] = {k: [] for k in _KINDS}
    ahead = np.stack(list(_scan(of, "forward", codes, live, kept["forward"])))
    back = np.stack(list(_scan(of, "backward", codes[::-1], live[::-1], kept["backward"])))[::-1]
    states = np.concatenate([ahead, back], axis=2)
    scores = states @ of["out"] + of["bias"]
    scores -= scores.max(2, keepdims=True)
    error = np.exp(scores)
    error /= error.sum(2, keepdims=True)
    weight = (live / live.sum()).astype(error.dtype)
    loss = float(-(np.log(np.maximum(error[:, np.arange(n), lang], 1e-30)) * weight).sum())
    error[:, np.arange(n), lang] -= 1
    error *= weight[:, :, None]
    grads = {"out": states.reshape(-1, 2 * units).T @ error.reshape(-1, error.shape[2]), "bias": error.sum((0, 1))}
    from_out = error @ of["out"].T
    for k, reached, order in (("forward", from_out[:, :, :units], range(steps)), ("backward", from_out[:, :, units:], range(steps - 1, -1, -1))):
        matrix = of[f"{k}_state"]
        g_state, g_inner = np.zeros_like(matrix), np.zeros_like(of[f"{k}_inner"])
        inputs = np.zeros((3, steps, n, units), matrix.dtype)
        dh = np.zeros((n, units), matrix.dtype)
        for t, (before, z, r, q, new) in zip(reversed(order), reversed(kept[k]), strict=True):
            dh = (dh + reached[t]) * live[t][:, None]
            d_new = dh * (1 - z) * (1 - np.abs(new)) ** 2
            d_z = dh * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_r, d_q = d_new * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2, d_new * r
            inputs[0, t], inputs[1, t], inputs[2, t] = d_z, d_r, d_new
            dh = dh * z
            for i, d in enumerate((d_z, d_r, d_q)):
                g_state[i] += before.T @ d
                dh += d @ matrix[i].T
            g_inner += d_q.sum(0)
        at = codes.ravel()
        tables = [np.stack([np.bincount(at, column, 256) for column in part.reshape(-1, units).T], axis=1) for part in inputs]
        grads |= {f"{k}_in": np.stack(tables).astype(matrix.dtype), f"{k}_state": g_state, f"{k}_inner": g_inner}
    return loss, grads


def fit(stretches: list[bytes], lang: np.ndarray, langs: tuple[str, ...], epochs: int = EPOCHS, seed: int = 11) -> Reader:
    """A reader fitted on stretches and the numbers of their languages, by Adam; languages count alike, however many stretches they have."""
    reader = new_reader(langs, seed=seed)
    rng = np.random.Generator(np.random.PCG64(seed))
    codes, live = _grid(stretches)
    share = 1 / np.maximum(np.bincount(lang, minlength=len(langs)), 1)
    first, second = ({n: np.zeros_like(v) for n, v in reader.of.items()} for _ in range(2))
    step = 0
    for _ in range(epochs if len(langs) > 1 else 0):
        order = rng.choice(len(lang), len(lang), p=share[lang] / share[lang].sum())
        for at in range(0, len(order), BATCH):
            rows, step = order[at : at + BATCH], step + 1
            _, grads = loss_and_gradients(reader, codes[:, rows], live[:, rows], lang[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for n, g in grads.items():
                g = g / max(1.0, norm)
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
                reader.of[n] = (reader.of[n] - RATE * move).astype(np.float32)
    return reader


def _grid(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, n) of byte values and of whether there is a byte."""
    steps = max((len(s) for s in stretches), default=0)
    codes, live = np.zeros((steps, len(stretches)), np.uint8), np.zeros((steps, len(stretches)), bool)
    for i, s in enumerate(stretches):
        codes[: len(s), i], live[: len(s), i] = np.frombuffer(s, np.uint8), True
    return codes, live


def _cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the stretches of a chunk's documents."""
    size = np.diff(offsets)
    n = -(-size // STRETCH)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, offsets[doc] + k * STRETCH, np.minimum(STRETCH, size[doc] - k * STRETCH)


def document_probabilities(reader: Reader, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): the mean over all positions of each document; zeros for an empty one."""
    doc, start, length = _cut(offsets)
    sums = np.zeros((len(offsets) - 1, len(reader.langs)))
    order = np.argsort(length, kind="stable") if reader.langs else []  # the short ones together
    for at in range(0, len(order), _BLOCK):
        own = order[at : at + _BLOCK]
        steps = np.arange(int(length[own].max()))[:, None]
        live = steps < length[own]
        p = _probabilities(reader, data[np.where(live, start[own] + steps, 0)], live)
        np.add.at(sums, doc[own], np.einsum("tkn,tn->nk", p, live.astype(np.float32)))
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def _guesser(reader: Reader):
    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*reader.langs, "und"], object)
        for batch in batches:
            texts = batch.column("text")
            lettered = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            p = np.concatenate([np.zeros((0, len(reader.langs)))] + [document_probabilities(reader, data, offsets) for _, _, data, offsets in kernel.chunks(texts)])
            known = lettered & bool(reader.langs)
            best = np.where(known, p.argmax(1) if reader.langs else 0, len(reader.langs))
            score = np.where(known, np.clip(p.max(1), 0, 1) if reader.langs else 0.0, 0.0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs[best], pa.string()), "score": pa.array(score.astype(np.float64))})

    return guess


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to OF_DOCUMENT stretches of each text, drawn by a hash of their bytes and place."""
    names = kernel.alphabet(b"", fold_case=False)
    for batch in batches:
        for lo, hi, data, offsets in kernel.chunks(batch.column("text")):
            doc, start, length = _cut(offsets)
            drawn = kernel.mix(kernel.span_hashes(data, start, start + length, names) + kernel.mix(start.astype(np.uint64) - offsets[doc].astype(np.uint64)))
            order = np.lexsort([drawn, doc])
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc[order])
            own = order[rank < OF_DOCUMENT]
            parts = [data[start[i] : start[i] + length[i]].tobytes() for i in own]
            lang = batch.column("lang").slice(lo, hi - lo).take(pa.array(doc[own]))
            yield pa.record_batch({"lang": lang, "stretch": pa.array(parts, pa.binary()), "drawn": pa.array(drawn[own].view(np.int64))})


def held_out(doc_id: Column) -> Column:
    """Rows whose language the reader must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Reader:
    """A reader from at most ``sample`` stretches of texts that are not held out and have a language, about DOCS documents a language.

    Documents are drawn by a hash of doc_id, so rows without one are not learned from; equal stretches of a language count once.  Of more than
    LANGS languages the most frequent are learned.  Without rows no language is known.
    """
    texts = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    texts = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    if not counts:
        return new_reader(())
    part = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, DOCS / r.n))]), F.col("lang"))
    drawn = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    made = materialize(drawn.select("text", "lang").mapInArrow(_sampler, "lang string, stretch binary, drawn long").distinct(), "stretches")
    sizes = made.groupBy("lang").agg(F.count("*").alias("n")).collect()  # LANGS rows at most
    most = sample // max(1, len(sizes))
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, most / r.n))]), F.col("lang"))
    some = made.where(F.pmod("drawn", F.lit(1_000_000)) < share * 1_000_000) if sizes else made
    rows = some.orderBy("drawn", "lang", "stretch").limit(sample).select("lang", "stretch").collect()
    drop(made)
    langs = tuple(sorted({r.lang for r in rows}))
    return fit([bytes(r.stretch) for r in rows], np.array([langs.index(r.lang) for r in rows], np.int64), langs)


def predict_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its probability) of every row of ``docs(doc_id, text, lang)``.

    A text that is null, empty or without a letter of any script is ``und`` with score 0, and so is every text where no language was learned.  A null
    doc_id is predicted, not held out and not learned from; repeated rows are predicted one by one; further columns are not read; no rows
    give no rows.  Of equal probabilities the language that sorts first wins.
    """
    reader = train(docs, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(texts.mapInArrow(_guesser(reader), "doc_id long, lang_pred string, score double"), "languages")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
