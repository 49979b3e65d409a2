"""Hard negatives against brute force, and the bounds that leave vectors out."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lanewise.llm import hard_negatives as hn

TYPE = "vec_id long, embedding array<double>, label int, score double, row long, block string"


def by_hand(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in q) < 2**62:
            kept.append((vec_id, q, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    first = lambda found: sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:5]
    out = []
    for i, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(v, sum(x * y for x, y in zip(q, r, strict=False)), own == label) for j, (v, r, own) in enumerate(kept) if j != i]
        for positive, top, _ in first([s for s in scored if s[2]]):
            window = [s for s in scored if not s[2] and 80 * top <= 100 * s[1] <= 100 * top]
            out += [(anchor, positive, k, v, top, s) for k, (v, s, _) in enumerate(first(window), 1)]
    return sorted(out, key=str)


def mined(df, **names):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in columns) for r in hn.hard_negatives(df, **names).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 3, "b") for r in rows], TYPE).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    near = lambda c, s: [x + rnd.gauss(0, s) for x in c]
    out = [(20 * k, near(rnd.choice(centres), 0.3), rnd.randrange(3)) for k in range(240)]
    out += [(k, near(centres[0], 0.01), rnd.randrange(10)) for k in range(1, 60)]
    same = near(centres[1], 0.1)
    out += [(10_000 + k, same, k % 2) for k in range(30)] + [(10_000, same, 0), (10_000, same, 1)]  # ties, repeated ids and rows
    out += [(None, same, 0), (None, centres[2], 1), (400, None, 1), (401, [1.0, None], 1), (500, [math.nan] * 8, 0), (501, [math.inf] + [0.0] * 7, 0), (600, centres[3], None)]
    out += [(700, [], 1), (701, [0.0] * 8, 1), (800, [1.0, -2.0], 2), (-100, near(centres[4], 0.2), 4), (900, [3e7] * 8, 1), (901, [2.9e7] * 8, 2), (902, [2.8e7] * 8, 1), (1000, [1e300] * 8, 1), (903, [4e6, -4e6, 3.0], 1)]
    return out


def test_brute_force(spark, rows):
    want = by_hand(rows)
    assert len(want) > 300 and mined(frame(spark, rows)) == want


def test_small_blocks_and_samples(spark, rows, monkeypatch):
    for name, value in (("BLOCK_ROWS", 17), ("BLOCK_ANCHORS", 5), ("SAMPLE", 9), ("_ROWS", 4), ("_ANCHORS", 2), ("REFERENCES", 3)):
        monkeypatch.setattr(hn, name, value)
    assert mined(frame(spark, rows)) == by_hand(rows)


def test_nothing_usable(spark, none):
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(100, None, 1), (200, [1.0], None)])) == []
    assert mined(frame(spark, [(100, [0.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 2)])) == [(100, 3, 1, 4, 0, 0)]


def test_bounds_hold_and_leave_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    q = np.floor(256 * np.concatenate([c + rng.normal(size=(60, 12)) * 0.1 for c in centres]))
    norms, refs = hn._norms(q), hn.references(q, 8)
    assert hn._norms(refs) == pytest.approx(np.ones(8))
    angles = np.arccos(np.clip(q @ refs.T / norms[:, None], -1, 1)).astype(np.float32)
    both = norms[:, None] * norms[None]
    low, high = hn.score_bounds(*hn.apart(angles, angles), both, both)
    scores = q @ q.T
    assert (low <= scores).all() and (scores <= high).all()
    best = np.partition(scores, -20, axis=1)[:, -20]
    assert (high >= best[:, None]).mean() < 0.35  # of clustered vectors most need not be multiplied


def test_window_start_is_exact():
    for score in [*range(0, 60), 2**61 - 1, 2**61 + 3, -1, -7]:
        start = hn.window_start(score)
        assert 100 * start >= 80 * score > 100 * (start - 1)
