"""Decontamination against all pairs of passage and document, short passages, rows without an id, and recall where many words are replaced."""

import random
import re

import numpy as np
import pytest
from tideline.llm import contamination

WORDS = [f"w{i}" for i in range(40)]


def brute(docs, items):
    """Every passage laid on every document at every shift; whole equality for the shortest."""
    found = set()
    split = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").lower())
    for doc_id, text in docs:
        doc = split(text)
        for item_id, passage in items:
            item = split(passage)
            if not item or item_id is None:
                continue
            if len(item) < contamination.SHORTEST:
                if doc == item:
                    found.add((doc_id, item_id))
                continue
            for shift in range(-len(item) + 1, len(doc)):
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                same = [item[i] == doc[i + shift] for i in range(lo, hi)]
                if same and contamination.shared(np.array(same), len(item)):
                    found.add((doc_id, item_id))
    return found


def test_all_pairs_of_a_small_table(spark):
    rng = random.Random(1)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 30])] + [(None, "x y z u v"), (77, None), (78, ""), (79, "...")]
    docs = []
    for d in range(160):
        words, (i, passage) = say(rng.choice([0, 3, 40])), rng.choice(items[:12])
        part = passage.split()
        if len(part) >= 8 and rng.random() < 0.5:  # a fifth of the words replaced at most
            for k in rng.sample(range(len(part)), len(part) // 5):
                part[k] = "other"
        docs.append((d if d % 9 else None, " ".join(words + (part if rng.random() < 0.7 else []) + (words if rng.random() < 0.5 else [])).title()))
    docs += [(900, items[3][1]), (901, items[3][1].upper() + "!"), (902, items[3][1] + " more"), (903, None), (904, "")]
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), null_ids=True).collect()}
    want = brute(docs, items)
    sure = {(d, i) for d, i in want if i in range(12)}
    assert got <= want and {p for p in sure if p[1] < 4} <= got and (900, 3) in got and (901, 3) in got and (902, 3) not in got
    assert any(d is None for d, _ in got) and len(sure - got) <= 0.02 * len(sure)
    plain = {(r.doc_id, r.item_id) for r in contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert plain == {p for p in got if p[0] is not None}


@pytest.mark.parametrize(("n", "replaced", "least"), [(20, 7, 0.9), (20, 6, 0.95), (30, 10, 0.98), (20, 4, 1.0), (8, 1, 1.0)])
def test_recall_between_two_thirds_and_four_fifths(spark, n, replaced, least):
    rng = random.Random(n + replaced)
    items = [(i, " ".join(f"a{rng.randrange(10**6)}" for _ in range(n))) for i in range(400)]
    docs = []
    for i, text in items:
        words = text.split()
        for k in rng.sample(range(n), replaced):
            words[k] = f"b{rng.randrange(10**6)}"
        docs.append((i, " ".join([f"c{rng.randrange(10**6)}" for _ in range(30)] + words + [f"c{rng.randrange(10**6)}" for _ in range(30)])))
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    held = {i for (i, text), (_, doc) in zip(items, docs, strict=True) if contamination.widest_stretch(np.array([a == b for a, b in zip(text.split(), doc.split()[30 : 30 + n], strict=True)]))[2] >= min(contamination.LEAST_WORDS, 0.8 * n)}
    assert {d for d, i in got if d == i} <= set(range(400)) and len({d for d, i in got if d == i and d in held}) >= least * len(held)
    print(n, replaced, len(held), len({d for d, i in got if d == i and d in held}) / max(1, len(held)))
