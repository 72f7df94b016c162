"""Results that only large tables or large values get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fossilframe.operators import hypothesis, macroevolution, transforms


def test_mann_whitney_of_large_groups(spark):
    """n1 * n2 * (n1 + n2 + 1) is beyond a long."""
    n = 3_000_000
    d = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("group"), (F.col("id") % 4).cast("double").alias("x"))
    r = hypothesis.mann_whitney(d, "a", "b").first()
    u = n * n / 4  # a has 0 and 2, b 1 and 3: only 2 is above 1
    assert r["u"] == u
    assert r["z"] == pytest.approx((u - n * n / 2) / math.sqrt(n * n * (2 * n + 1) / 12))


def test_boxcox_of_large_values(spark):
    """Values of 1e8 to the power -2 against 1: their differences are beyond a double's digits."""
    x = np.random.default_rng(1).uniform(1, 2, 40)
    rows = [(i, v, float(y * s)) for i, y in enumerate(x) for v, s in (("one", 1.0), ("large", 1e8))]
    got = {r["variable"]: r for r in transforms.boxcox_lambda(spark.createDataFrame(rows, "row int, variable string, value double")).collect()}
    # a scale leaves the best lambda alone and takes n ln s from the likelihood
    assert got["large"]["lambda"] == got["one"]["lambda"]
    assert got["large"]["likelihood"] == pytest.approx(got["one"]["likelihood"] - 40 * math.log(1e8), abs=1e-6)


def test_concordance_leaves_sums_only(spark, monkeypatch):
    """The driver gets sums by time and range of predictors, not the rows; the share is that of the pairs."""
    rng = np.random.default_rng(2)
    n, seen = 3000, []
    time, event, lp = rng.integers(0, 4, n), rng.integers(0, 2, n), np.round(rng.normal(size=n), 3)
    d = spark.createDataFrame(list(zip(time.tolist(), event.tolist(), lp.tolist(), strict=True)), "time long, event int, lp double")
    kind = type(d)
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: (t := plain(self), seen.append(t.num_rows))[0])
    got = macroevolution._concordance(d)
    first = (event == 1)[:, None] & (time[:, None] < time)
    want = (first & (lp[:, None] > lp)).sum() + (first & (lp[:, None] == lp)).sum() / 2
    assert got == pytest.approx(want / first.sum(), rel=1e-12)
    assert max(seen) <= 4 * macroevolution.PIECES
    assert macroevolution._concordance(d.limit(0)) == 0.5
