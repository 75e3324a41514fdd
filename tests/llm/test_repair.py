"""Conversation repair: every edit sequence by brute force, odd rows, and the replay of the audit."""

import itertools
import re

import numpy as np
import pytest
from tideline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns: list[tuple[str, str]]) -> tuple[int, str]:
    """The cheapest audit, the least of equals, over all ways to treat each turn and up to two inserts in each place."""
    seen, faults = set(), []
    for role, text in turns:
        core = text.strip(repair.SPACE)
        faults.append("lost" if not core or (role, text) in seen else "cut" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    options = [["D"] if f == "lost" else ["D", "K", "Ru", "Ra"] for f in faults]
    for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(turns) + 1):
        for edits in itertools.product(*options):
            initials, audit, cost = inserts[0], "I" * len(inserts[0]), 5 * len(inserts[0])
            for e, (role, _), f, more in zip(edits, turns, faults, inserts[1:], strict=True):
                cost += {"D": 2, "K": 0}.get(e, 1) + (5 if f == "cut" and e != "D" else 0) + 5 * len(more)
                initials += {"D": "", "K": role[:1] or "?"}.get(e, e[1:]) + more
                audit += e[0] + "I" * len(more)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_cheapest_edits_equal_all_edits(spark):
    rng = np.random.default_rng(13)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["One.", "Two!", "Cut", " ", "Three? \n"]
    conversations = [[(roles[rng.integers(5) if rng.random() < 0.3 else rng.integers(2)], texts[rng.integers(5)]) for _ in range(n)] for n in (1, 2, 3, 3) for _ in range(12)]
    rows = [(c, i, role, text) for c, turns in enumerate(conversations) for i, (role, text) in enumerate(turns)]
    found = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, turns in enumerate(conversations):
        if turns:
            r = found[c]
            assert (r.cost, r.audit) == brute(turns), turns
            assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.repaired))
            kept = [turns[i] for i, e in enumerate(r.audit.replace("I", "")) if e == "K"]
            assert [(t.role, t.text) for t in r.repaired if (t.role, t.text) in kept] == kept


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "Hi."), (1, 5, "assistant", "Yes!"), (1, 5, "assistant", "Yes!"),
        (None, 1, "user", "a?"), (None, None, "system", "Be good."), (None, 2, "assistant", "x" * 200_000 + "."), (2, 0, "user", ""), (3, None, "user", "Go."), (3, None, "assistant", "So."),
    ]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], SCHEMA + ", place string, fault boolean")
    got = {r.conv_id: r for r in repair.repair(df).collect()}
    assert got[1].asDict() | {"repaired": None} == {"conv_id": 1, "gaps": 2, "blank": 1, "duplicate": 1, "truncated": 0, "illegal": 2, "cost": 4, "audit": "DKKD", "repaired": None}
    assert (got[None].audit, got[None].cost, [t.role for t in got[None].repaired]) == ("KKK", 0, ["system", "user", "assistant"])
    assert (got[2].audit, got[2].cost, got[2].gaps, got[2].repaired) == ("D", 2, 0, [])
    assert (got[3].gaps, got[3].audit, [(t.role, t.text) for t in got[3].repaired]) == (0, "RR", [("user", "So."), ("assistant", "Go.")])  # equal turns go by role
    assert repair.repair(df.limit(0)).collect() == []


def test_lost_turns_keep_their_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {c} {t}.") for c in range(40) for t in range(2)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    gone = repair.damaged(df)
    assert gone.where("gone").count() and gone.count() == len(rows) + gone.groupBy(*gone.columns).count().where("count > 1").count()
    out = repair.repair_digests(df).collect()
    assert {r.conv_id for r in out} == {r[0] for r in rows}
    empty = [r for r in repair.repair_digests(df.where("conv_id is not null")).collect() if not r.audit]
    assert all((r.gaps, r.cost, r.illegal) == (0, 0, 0) and r.repaired_sha256.startswith("e3b0c44298fc1c14") for r in empty)


@pytest.mark.parametrize("turns", [1500])
def test_long_conversation(spark, turns):
    df = spark.range(turns).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Line ', id, if(id % 100 = 0, '', '.')) AS text")
    r = repair.repair(df).first()
    assert len(r.audit) == turns and r.truncated == turns // 100 and r.cost == 4 * (turns // 100)  # each lost user turn takes an assistant turn with it
