"""Vector codes: trees against full comparison, whole rounds against plain Python, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from tideline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 26])
def test_tree_finds_what_a_full_comparison_finds(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 3, 7, 16, 40):
        entries = rng.integers(-spread, spread + 1, (k, 8))
        entries[k // 2] = entries[0]  # equal entries: the lower index wins
        points = np.concatenate([rng.integers(-spread, spread + 1, (500, 8)), entries])
        square = ((points[:, None] - entries[None]) ** 2).sum(2)
        at, best = codes.nearest(codes.build(entries), entries, points)
        assert (at == square.argmin(1)).all() and (best == square.min(1)).all()


def test_tree_leaves_branches_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-40_000, 40_000, (16, 8))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    visits: list[int] = []
    codes.nearest(codes.build(centres), centres, points, visits)
    assert sum(visits) < 0.5 * 16 * len(points)


def brute(rows):
    """Codes, errors and digest by plain loops."""
    kept = [(i, [math.floor(4096 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(6):
        at = [[near(v, p)[1] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for e in range(len(books[p])):
                if own := [cut(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p] == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, [near(v, p) for p in range(8)], l) for i, v, l in kept]
    errors = [sum(d for d, _ in f) for _, f, _ in found]
    by_label: dict = {}
    for (_, _, l), e in zip(found, errors, strict=True):
        by_label[l] = by_label.get(l, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{n:02x}" for _, n in f), e, by_label[l], sha) for (i, f, l), e in zip(found, errors, strict=True))


def test_rounds_equal_plain_loops(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], int(rng.integers(3)) if i % 7 else None) for i in range(90)]
    rows += [(200, rows[3][1], 1)] * 20 + [(5, rows[4][1], 2), (None, rows[9][1], None)]  # copies, a repeated id, no id
    rows += [(300, None, 1), (301, [1.0, None] * 8, 1), (302, [math.nan] * 16, 1), (303, [math.inf] + [0.0] * 15, 1), (304, [-math.inf] + [0.0] * 15, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, v int")
    got = codes.encode(df).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 8, 1), (3, [], None), (4, [-0.00001] * 16, 1)], SCHEMA)
    got = {r.vec_id: r for r in codes.encode(df).collect()}
    assert got[2].code is None and got[3].code is None and got[1].code == "00" * 8 and got[4].code == "01" * 8 and got[1].label_error == 0
    assert codes.encode(df.limit(0)).collect() == []
    assert [r.code for r in codes.encode(df.where("vec_id = 3")).collect()] == ["00" * 8]
    assert [r.code for r in codes.encode(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA)).collect()] == [None]
    with pytest.raises(codes.RangeError):
        codes.encode(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA))
