"""Quality rules: a base filter on word statistics and a decision list learned from labelled rows.

Sequential covering: a rule grows by the threshold condition of highest information gain until it covers (almost) only
labelled junk, is pruned on rows that it did not grow on, and is kept while it stays precise there; rows that it covers
are set aside and the next rule grows on the rest.  The list becomes an ordered Spark conditional expression.
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

_WORDS = kernel.alphabet(kernel.ASCII_SPACE, fold_case=False)
_LINES = kernel.alphabet(b"\n", fold_case=False)
_MASKS = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_lower": bytes(range(97, 123)),
    "n_marks": b"!?.,;:\"'()[]{}-_/\\",
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_marks", "n_lines", "n_distinct"]
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)


def _repeated(keys: np.ndarray, others: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal another of their document, and which equal an earlier one; items are equal if both their hashes are."""
    own = kernel.mix(keys ^ kernel.mix(docs.astype(np.uint64), 3), 4)
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    alike = (others[order][1:] == others[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    if (same & ~alike).any():  # a collision: both hashes and the document order them
        order = np.lexsort((np.arange(len(keys)), others, keys, docs))
        same = (keys[order][1:] == keys[order][:-1]) & (others[order][1:] == others[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def _chunk(data: np.ndarray, offsets: np.ndarray, repeat_words: int) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    w, lines = kernel.words(data, offsets, _WORDS), kernel.words(data, offsets, _LINES)
    of_word, of_line = w.documents(), lines.documents()
    word2, line2 = (kernel.span_hashes(data, x.start, x.end, a, seed=1) for x, a in ((w, _WORDS), (lines, _LINES)))
    out = {"n_words": np.diff(w.bounds), "word_chars": per(_WORDS.inside[data] & ((data & 0xC0) != 0x80))}
    out |= {k: per(np.isin(np.arange(256), list(b))[data]) for k, b in _MASKS.items()}
    has_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    line_docs = of_line[has_word]
    out["n_lines"] = np.bincount(line_docs, minlength=n)
    out["n_dup_lines"] = np.bincount(line_docs[_repeated(lines.hash[has_word], line2[has_word], line_docs)[1]], minlength=n)
    out["n_distinct"] = out["n_words"] - np.bincount(of_word[_repeated(w.hash, word2, of_word)[1]], minlength=n)
    h, h2 = (kernel.windows(x, list(range(repeat_words))) for x in (w.hash, word2))
    inside = np.flatnonzero(of_word[: len(h)] == of_word[repeat_words - 1 : repeat_words - 1 + len(h)])
    found = inside[_repeated(h[inside], h2[inside], of_word[inside])[0]]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + repeat_words, -1)
    out["n_repeat_words"] = np.bincount(of_word[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


def _scan(repeat_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_chunk(data, offsets, repeat_words) for _, _, data, offsets in kernel.chunks(batch.column("text"))]
            columns = {s: np.concatenate([p[s] for p in parts]) if parts else np.zeros(0, np.int64) for s in STATS}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{s: pa.array(c, pa.int64()) for s, c in columns.items()}})

    return scan


def text_statistics(docs: DataFrame, repeat_words: int = 5) -> DataFrame:
    """``STATS`` of every row of ``docs(doc_id, text)``, over the whole text.

    A null or empty text has zeros; repeated rows have rows of their own, a null doc_id stays null; equal lines and words are told by two hashes; other
    columns are not read; no rows give no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(repeat_words), SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


#: What conditions may test, as SQL over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.expr(FEATURES[self.feature]) >= self.threshold if self.above else F.expr(FEATURES[self.feature]) <= self.threshold

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.of(x)
    return out


def _cuts(x: dict[str, np.ndarray], cuts: int) -> list[Condition]:
    found = []
    for f, v in x.items():
        at = np.unique(v)
        if len(at) > cuts:
            at = np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="nearest"))
        between = (at[1:] + at[:-1]) / 2
        found += [Condition(f, above, float(t)) for t in between for above in (True, False)]
    return found


def _grow(x: dict[str, np.ndarray], junk: np.ndarray, most_conditions: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(junk), bool)
    while len(rule) < most_conditions and (~junk[inside]).any():
        here = {f: v[inside] for f, v in x.items()}
        p0, n0 = junk[inside].sum(), inside.sum()
        best = (0.0, None)
        for c in _cuts(here, cuts):
            m = c.of(here)
            p, n = (junk[inside] & m).sum(), m.sum()
            if p:
                gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                if gain > best[0] + 1e-9:
                    best = (gain, c)
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].of(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], junk: np.ndarray) -> tuple[float, int]:
    m = _covers(rule, x)
    p, n = int((m & junk).sum()), int(m.sum())
    return (2 * p - n) / n if n else -1.0, p


def learn_rules(x: dict[str, np.ndarray], junk: np.ndarray, fold: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 5, cuts: int = 64) -> list[Rule]:
    """An ordered list of conjunctions that mark junk.  ``fold`` 0 prunes, others grow.

    ``precision`` is what a rule must reach on the pruning rows, ``least`` how much junk it must catch there.
    """
    rules: list[Rule] = []
    left = np.ones(len(junk), bool)
    while len(rules) < most_rules and junk[left].any():
        grow, prune = left & (fold != 0), left & (fold == 0)
        at = lambda m: {f: v[m] for f, v in x.items()}
        if not junk[grow].any():
            break
        rule = _grow(at(grow), junk[grow], most_conditions, cuts)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, at(prune), junk[prune])[0])
        worth, caught = _worth(rule, at(prune), junk[prune])
        if worth < 2 * precision - 1 or caught < least:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered expression: the first rule that fits rejects, else the row stays."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test &= c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(stats: DataFrame, labels: DataFrame, sample: int = 40_000) -> list[Rule]:
    """Rules from about ``sample`` of the labelled rows that pass the base filter, drawn by a hash of their doc_id and statistics.

    Rows without a label of 0 or 1 are left out; a document labelled both ways counts as junk.  Rows of a doc_id with equal
    statistics count once, so that the sample is bounded however often a doc_id repeats.
    """
    labelled = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = materialize(stats.where(~base_failed()).join(labelled, "doc_id").distinct(), "labelled")
    part = min(1.0, sample / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id", *STATS), F.lit(1_000_000_000))
    drawn = rows.where(place < int(part * 1_000_000_000)).select("quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("fold"), *[F.expr(sql).alias(f) for f, sql in FEATURES.items()], "doc_id")
    got = drawn.toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    drop(rows)
    if not len(got):
        return []
    return learn_rules({f: got[f].to_numpy(float) for f in FEATURES}, (got["quality"] == 0).to_numpy(), got["fold"].to_numpy())


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = 40_000) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row of ``docs(doc_id, text)``.

    A null or empty text has no words, so it fails the base filter.  Repeated rows are judged one by one; with no
    labels the list is empty and only the base filter rejects.  Other columns are not read; no rows give no rows.
    """
    stats = materialize(text_statistics(docs), "statistics")
    rules = fit_rules(stats, labels, sample)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
