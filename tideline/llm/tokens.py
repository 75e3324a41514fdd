"""Exact token counts of every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

The last token of a piece's encoding is the one token that ends there and stands beside the last token before it as
byte-pair merging would leave them; so the count of a prefix is one more than the count of the prefix before its last
token.  Each distinct piece is worked out once a worker, and a text's prefixes are sums of its pieces'.  From the
stored counts, questions of truncation and budget are answered without encoding anything again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text_kernel as kernel
from tideline.llm.scratch import materialize

#: Distinct pieces (and pairs of tokens) that a worker keeps, and the pieces' code points together; beyond, it starts anew.
KEEP, KEEP_POINTS = 1_000_000, 1 << 24
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: What the pre-tokenizer splits off after an apostrophe.
_ONE, _TWO = "stmd", ("re", "ve", "ll")
#: Unicode white space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    import unicodedata

    of = {"L": LETTER, "N": NUMBER}
    table = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[_WHITE] = SPACE
    return table


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Prefix counts under the tokenizer file at ``path``: byte-level BPE with the usual split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True) or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a byte-level BPE tokenizer without normalizer")
        symbol = _byte_symbols()
        raw = lambda token: bytes(symbol[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        self.longest = max(map(len, self.tokens))
        self.beside: dict[tuple[bytes | None, bytes], bool] = {}
        self.classes = _classes()
        points = np.arange(0x110000, dtype=np.uint64)
        self.alphabet = kernel.Alphabet(np.ones(1, bool), kernel.mix(points, 15) | np.uint64(1))
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.table, self.used = np.zeros(1 << 16, np.int32), 0

    def _merge(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])), default=1 << 30)
            if best == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.rank.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _stands(self, before: bytes | None, token: bytes) -> bool:
        """Whether merging leaves ``before`` and ``token`` as they are, side by side."""
        known = self.beside.get((before, token))
        if known is None:
            if len(self.beside) > KEEP:
                self.beside.clear()
            known = self.beside[before, token] = self._merge((before or b"") + token) == ([token] if before is None else [before, token])
        return known

    def piece(self, text: bytes) -> list[int]:
        """The token count of each prefix of a piece, by bytes.

        One token at most can end a prefix and stand beside what comes before, so the order of trial is free.
        """
        count, last = [0], [None]
        known, tokens, longest = self.beside.get, self.tokens, self.longest
        for end in range(1, len(text) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = text[start:end]
                if token in tokens:
                    before = last[start]
                    stands = known((before, token))
                    if stands or stands is None and self._stands(before, token):
                        break
            count.append(count[start] + 1)
            last.append(token)
        return count

    def _rows(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the prefix counts of each piece (by code points) stand in ``table``; pieces are told apart by what they are, not by a hash."""
        raw = points.astype("<u4").tobytes()
        first, back = _alike(points, start, end, kernel.span_hashes(points, start, end, self.alphabet))
        if len(self.at) > KEEP or self.used > KEEP_POINTS:
            self._forget()
        rows = np.empty(len(first), np.int64)
        for k, (a, b) in enumerate(zip((4 * start[first]).tolist(), (4 * end[first]).tolist(), strict=True)):
            key = raw[a:b]
            row = self.at.get(key)
            if row is None:
                text = key.decode("utf-32-le").encode()
                counts = self.piece(text)
                ends = range(1, len(counts)) if text.isascii() else [i for i in range(1, len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80]
                if self.used + len(ends) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros(max(len(self.table), len(ends)), np.int32)])
                self.table[self.used : self.used + len(ends)] = [counts[i] for i in ends]
                row = self.at[key] = self.used
                self.used += len(ends)
            rows[k] = row
        return rows[back]

    def _plain(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Counts after each code point of texts without special strings; ``offsets`` bound the texts."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        cls = self.classes[points]
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True
        fresh = opens[:n].copy()
        fresh[1:] |= cls[1:] != cls[:-1]
        start = np.flatnonzero(fresh)
        kind = cls[start]
        ends_text = opens[np.append(start[1:], n)]
        begins_text = opens[start]
        # contractions: an apostrophe alone, not after a blank, takes one or two letters of the run behind it
        alone = (kind == OTHER) & (np.diff(np.append(start, n)) == 1) & (points[start] == ord("'")) & ~ends_text
        alone &= begins_text | (points[np.maximum(start - 1, 0)] != 32)
        takes = np.zeros(len(start), np.int64)
        for k in np.flatnonzero(alone):
            if kind[k + 1] == LETTER:
                stop = start[k + 2] if k + 2 < len(start) else n
                letters = points[start[k + 1] : min(stop, start[k + 1] + 2)]
                word = "".join(map(chr, letters))
                takes[k] = 1 if word[:1] in _ONE else 2 if word in _TWO else 0
        moved = np.flatnonzero(takes)
        start[moved + 1] += takes[moved]
        stop = np.append(start[1:], n)
        kept = start < stop
        keep_at = np.cumsum(kept) - 1
        long = keep_at[moved[takes[moved] == 2]]
        start, stop, kind, ends_text, begins_text = start[kept], stop[kept], kind[kept], opens[stop[kept]], opens[start[kept]]
        white = kind == SPACE
        lead = np.zeros(len(start), bool)
        lead[1:] = white[:-1] & ~white[1:] & ~begins_text[1:] & (points[start[1:] - 1] == 32)
        first = start - lead
        apart = np.flatnonzero(white & ~ends_text & (points[stop - 1] != 32))
        rows = self._rows(points, np.append(first, stop[apart] - 1), np.append(stop, stop[apart]))
        row, single = rows[: len(first)], rows[len(first) :]
        length = stop - first
        adds = self.table[row + length - 1].astype(np.int64)
        inner = np.flatnonzero(white & ~ends_text)  # the last white character of these goes to the next piece or stands alone
        adds[inner] = np.where(length[inner] > 1, self.table[row[inner] + np.maximum(length[inner] - 2, 0)], 0)
        adds[apart] += self.table[single]
        total = np.cumsum(adds)
        before = total - adds
        opening = np.flatnonzero(begins_text)
        base = before - np.repeat(before[opening], np.diff(np.append(opening, len(start))))
        span = stop - start
        at = np.arange(n) - np.repeat(start, span)
        out = np.repeat(base, span) + self.table[np.repeat(row + lead, span) + at]
        out[start[long] + 1] = base[long] + 2  # half a contraction is an apostrophe and a letter
        return out

    def count(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token count after each code point."""
        parts, of = [], []
        for t in texts:
            mine = [t]
            for s in self.special:
                mine = [x for m in mine for x in _split(m, s)] if s in t else mine
            of.append(mine)
            parts += mine
        offsets = np.cumsum([0, *map(len, parts)])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        counts = iter(np.split(self._plain(points, offsets), offsets[1:-1]) if parts else [])
        return [self._join(mine, [next(counts) for _ in mine]) for mine in of]

    def _join(self, parts: list[str], counts: list[np.ndarray]) -> np.ndarray:
        """Each part but the last ends with a special string short of its last character."""
        if len(parts) == 1:
            return counts[0]
        out, base = [], 0
        for k, (part, c) in enumerate(zip(parts, counts, strict=True)):
            out.append(base + c)
            if k + 1 < len(parts):
                s = next(s for s in self.special if part.endswith(s[:-1]))
                text = len(part) - len(s) + 1
                base += (int(c[text - 1]) if text else 0) + 1
                out.append(np.array([base]))
        return np.concatenate(out)


def _alike(points: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each kind, the kind of each span).  Spans of equal hashes are compared; where two differ, all are told apart by themselves."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    of, length = first[back], end - start
    if (length == length[of]).all():
        upto = np.cumsum(length)
        place = np.arange(upto[-1]) - np.repeat(upto - length, length)
        if (points[place + np.repeat(start, length)] == points[place + np.repeat(start[of], length)]).all():
            return first, back
    kinds: dict[bytes, int] = {}
    back = np.array([kinds.setdefault(points[a:b].tobytes(), len(kinds)) for a, b in zip(start, end, strict=True)])
    return np.unique(back, return_index=True)[1], back


def _split(text: str, special: str) -> list[str]:
    """``text`` cut at each special string, which stays, short of its last character, with what comes before it."""
    parts = text.split(special)
    return [p + special[:-1] for p in parts[:-1]] + parts[-1:]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker and tokenizer file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _strings(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, nulls as empty, in lists of about a chunk's bytes."""
    for lo, hi, data, offsets in kernel.chunks(texts):
        raw = data.tobytes()
        yield [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _counted(path: str, column: str, of_prefixes):
    """Batches with doc_id, n_bytes, n_tokens and what ``of_prefixes`` makes of each text's counts as ``column``, if any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            done = 0
            for texts in _strings(batch.column("text")):
                prefixes = of.count(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                totals = pa.array([int(p[-1]) if len(p) else 0 for p in prefixes], pa.int64())
                columns = {"doc_id": part.column("doc_id"), "n_bytes": pc.fill_null(pc.cast(pc.binary_length(part.column("text")), pa.int64()), 0), "n_tokens": totals}
                if column:
                    columns[column] = of_prefixes(prefixes)
                yield pa.record_batch(columns)

    return count


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(prefixes: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).astype(np.int32)))


def prefix_token_counts(docs: DataFrame, path: str, keep_prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ``prefix_tokens`` of every row of ``docs(doc_id, text)``.

    prefix_tokens[i] is the number of tokens of the text's first i + 1 code points, each taken as a text of its own;
    n_tokens is the last of them, 0 for an empty or null text.  Special strings count as the one token that they are.  Without
    ``keep_prefixes`` the array stays in the worker.  Repeated rows are counted one by one; other columns are not read; no rows give no rows.
    """
    count = _counted(path, "prefix_tokens" * keep_prefixes, _lists)
    return _texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long" + ", prefix_tokens array<int>" * keep_prefixes)


def _packed(prefixes: list[np.ndarray]) -> pa.Array:
    """Each text's steps from count to count as 16-bit numbers, deflated; nothing for an empty text."""
    out = []
    for counts in prefixes:
        steps = np.diff(counts, prepend=0)
        if len(steps) and max(-steps.min(), steps.max()) >= 1 << 15:
            raise ValueError("a step of prefix counts is out of range")
        out.append(zlib.compress(steps.astype("<i2").tobytes(), 1) if len(steps) else b"")
    return pa.array(out, pa.binary())


def unpacked(steps: bytes) -> np.ndarray:
    """The token count of every prefix of a text, from its stored steps."""
    return np.cumsum(np.frombuffer(zlib.decompress(steps), "<i2"), dtype=np.int64) if steps else np.zeros(0, np.int64)


def store_prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """The prefix counts of every row of ``docs(doc_id, text)``, written to the shared folder once: doc_id, n_bytes and ``steps``.

    ``steps`` holds, packed, what each code point adds to the count of its prefix (less than nothing where it completes a longer token): a
    few bits a code point, where the counts would take as much room as the texts.  ``unpacked`` gives the counts back, ``prefix_answers``
    answers from them; texts are not encoded again.  An empty or null text has no steps.  Repeated rows have rows of their own, a null doc_id stays
    null, an empty table gives an empty one, and other columns are not read.
    """
    counted = _texts(docs).mapInArrow(_counted(path, "steps", _packed), "doc_id long, n_bytes long, n_tokens long, steps binary")
    return materialize(counted.drop("n_tokens"), "prefixes")


def _answers(budget: int):
    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, steps in enumerate(batch.column("steps").to_pylist()):
                counts = unpacked(steps)
                fits = np.flatnonzero(counts <= budget)
                rows[:, i] = (counts[-1], fits[-1] + 1 if len(fits) else 0, len(counts)) if len(counts) else 0
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": rows[0], "fitting_chars": rows[1], "n_chars": rows[2]})

    return answers


def prefix_answers(stored: DataFrame, budget: int) -> DataFrame:
    """What stored prefix counts tell of a budget, without encoding: doc_id, n_bytes, n_chars, n_tokens, fitting_chars and over_limit; written.

    fitting_chars is the length of the longest prefix of at most ``budget`` tokens (0 if there is none), over_limit whether the
    whole text has more.  Of an empty text all are 0 and it is not over the limit; a row is given for each stored one, none for none.
    """
    found = materialize(stored.mapInArrow(_answers(budget), "doc_id long, n_bytes long, n_tokens long, fitting_chars long, n_chars long"), "answers")
    return found.withColumn("over_limit", F.col("n_tokens") > budget)


def fitting_chars(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens, from the stored counts."""
    fits = F.reverse(F.transform(prefix_tokens, lambda n: n <= budget))
    return F.when(F.array_contains(fits, True), F.size(fits) - F.array_position(fits, F.lit(True)) + 1).otherwise(0)
