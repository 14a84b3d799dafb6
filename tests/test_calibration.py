"""Isotonic calibration against the min-max formula."""

import random
from fractions import Fraction

import pytest

from fathom.operators import calibration


def plain(pairs):
    """score -> rate by max over starts of min over ends of the mean between them."""
    sums = {}
    for score, label in pairs:
        n, s = sums.get(score, (0, 0))
        sums[score] = (n + 1, s + label)
    keys = sorted(sums)
    fit = {}
    for i, key in enumerate(keys):
        best = None
        for a in range(i + 1):
            low = None
            for b in range(i, len(keys)):
                n = sum(sums[k][0] for k in keys[a : b + 1])
                s = sum(sums[k][1] for k in keys[a : b + 1])
                low = Fraction(s, n) if low is None else min(low, Fraction(s, n))
            best = low if best is None else max(best, low)
        fit[key] = best
    return fit


def frame(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id bigint, score double, label int")


@pytest.mark.parametrize("chunk", [200_000, 7, 2])
def test_blocks_equal_the_min_max_formula(spark, chunk):
    """Small chunks need several passes over moving borders."""
    random.seed(chunk)
    for trend in (0.6, -0.9):
        pairs = []
        for _ in range(120):
            score = random.randint(0, 24) / 24
            pairs.append((score, int(random.random() < 0.5 + trend * (score - 0.5))))
        want = plain(pairs)
        df = frame(spark, pairs)
        blocks = calibration.isotonic_blocks(df, chunk_blocks=chunk)
        rates = [r.confidence for r in blocks.collect()]
        assert rates == sorted(rates) and len(set(rates)) == len(rates)
        got = {r.score: r.confidence for r in calibration.calibrate(df, blocks).collect()}
        assert got == {s: float(f) for s, f in want.items()}


def test_pooling_pooled_parts_gives_the_same():
    random.seed(1)
    points = [(float(i), float(i), random.randint(1, 5), 0) for i in range(300)]
    points = [(a, b, n, random.randint(0, n)) for a, b, n, _ in points]
    whole = calibration.pooled(points)
    for cut in (1, 50, 299):
        assert calibration.pooled(calibration.pooled(points[:cut]) + calibration.pooled(points[cut:])) == whole


def test_scores_beside_the_blocks_and_odd_rows(spark):
    pairs = [(0.2, 0), (0.2, 0), (0.6, 1), (0.6, 0), (0.9, 1), (None, 1), (0.5, None), (float("nan"), 1), (-0.0, 0), (0.0, 0)]
    blocks = calibration.isotonic_blocks(frame(spark, pairs))
    assert [(r.score_from, r.score_to, r.n, r.confidence) for r in blocks.collect()] == [
        (0.0, 0.2, 4, 0.0), (0.6, 0.6, 2, 0.5), (0.9, 0.9, 1, 1.0)
    ]
    new = spark.createDataFrame(
        [(-1.0, "a"), (0.3, "b"), (0.6, "c"), (0.75, "d"), (2.0, "e"), (None, "f"), (float("nan"), "g"), (2.0, "e")],
        "score double, _place string",
    )
    got = sorted((r["_place"], r.confidence) for r in calibration.calibrate(new, blocks).collect())
    assert got == [("a", 0.0), ("b", 0.0), ("c", 0.5), ("d", 0.5), ("e", 1.0), ("e", 1.0), ("f", None), ("g", None)]


def test_no_rows(spark):
    empty = frame(spark, [])
    blocks = calibration.isotonic_blocks(empty)
    assert blocks.count() == 0
    new = spark.createDataFrame([(0.5,)], "score double")
    assert calibration.calibrate(new, blocks).first().confidence is None
    assert calibration.calibrate(new.limit(0), blocks).count() == 0


def test_calibrated_confidence_is_what_was_observed(spark, scored):
    blocks = calibration.isotonic_blocks(scored)
    calibrated = calibration.calibrate(scored, blocks)
    assert calibrated.count() == scored.count()
    before = calibration.calibration_error(scored, "score", "label").agg({"gap": "max"}).first()[0]
    after = calibration.calibration_error(calibrated, "confidence", "label").agg({"gap": "max"}).first()[0]
    assert after < 1e-9 < before
