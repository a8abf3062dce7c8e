"""Attribution terms on a small estate, sliding slopes and horizons."""

import numpy as np
from pyspark.sql import functions as F

from opsloom.operators import attribution, detect, folds


def estate(spark):
    """db feeds api, api feeds web and job: a fault of db at step 2 spreads, cache is calm."""
    causal = {"db": [0, 0, 0.5, 0.7, 0.9, 0.9], "api": [0, 0, 0, 0.2, 0.2, 0.3], "web": [0, 0, 0, 0, 0.1, 0.1], "job": [0, 0, 0, 0, 0, 0], "cache": [0] * 6}
    hazard = {"db": [0, 0, 0.1, 0.2, 0.4, 0.5], "api": [0, 0, 0, 0.1, 0.4, 0.5], "web": [0, 0, 0, 0, 0.3, 0.6], "job": [0, 0, 0, 0, 0, 0.3], "cache": [0] * 6}
    rows = [(k, i * 60, float(causal[k][i]), float(hazard[k][i])) for k in causal for i in range(6)]
    up = [("api", "db"), ("web", "api"), ("web", "db"), ("job", "api"), ("job", "db"), ("api", "ghost")]
    upstream = spark.createDataFrame(up, "entity string, cause string")
    return spark.createDataFrame(rows, "entity string, moment long, causal double, confidence double"), upstream


def test_all_terms(spark):
    e, up = estate(spark)
    got = {(r.subject, r.moment, r.cause): r for r in attribution.attribute(e, up, up, 60, lookback_s=300, scale_s=120.0).collect()}
    assert ("api", 300, "ghost") not in got and {k[0] for k in got if k[1] == 300} == {"db", "api", "web", "job"}
    r = got[("web", 300, "db")]  # affects all four in distress and nobody else
    assert (r.rank, r.coverage, r.precision, r.precedence) == (1, 1.0, 1.0, 1.0) and r.local == 0.9
    x, y = [0, 0, 0.5, 0.7, 0.9, 0.9], [0, 0, 0, 0, 0.3, 0.6]
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    assert abs(r.correlation - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
    assert abs(r.score - 0.9 * (1 + 0.9 + 0.5 + 0.5 * r.correlation)) < 1e-8
    own = got[("job", 300, "job")]
    assert (own.local, own.precedence, own.correlation, own.coverage, own.precision) == (attribution.SELF_FLOOR, 0.0, 0.0, 1.0, 0.25)
    assert got[("db", 240, "db")].rank == 1


def test_tolerance_looks_back(spark):
    e, up = estate(spark)
    late = e.filter("not (entity = 'db' and moment = 300)")
    strict = {(r.subject, r.cause): r.local for r in attribution.attribute(late, up, up, 60, 300).filter("moment = 300").collect()}
    loose = {(r.subject, r.cause): r.local for r in attribution.attribute(late, up, up, 60, 300, tolerance_s=120).filter("moment = 300").collect()}
    assert strict[("web", "db")] == 0.0 and loose[("web", "db")] == 0.9


def test_nothing_in_distress(spark):
    e, up = estate(spark)
    assert attribution.attribute(e.filter("entity = 'cache'"), up, up, 60).count() == 0
    assert attribution.attribute(e.limit(0), up, up, 60).count() == 0


def test_sliding_slopes_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(t), i, None if rng.random() < 0.1 else float(rng.normal())) for k in "ab" for i, t in enumerate(np.sort(rng.integers(0, 500, 150)))]
    got = folds.sliding_theil_sen(spark.createDataFrame(rows, "k string, t double, i long, v double"), ["k"], ["t", "i"], "v", 60.0, 3).collect()
    assert len(got) == 300
    for r in got:
        seen = [(t, v) for k, t, i, v in rows if k == r.k and v is not None and (t, i) <= (r.t, r.i) and t >= r.t - 60]
        pairs = [(q[1] - p[1]) / (q[0] - p[0]) for a, p in enumerate(seen) for q in seen[a + 1 :] if q[0] > p[0]]
        assert r.n_points == len(seen)
        if len(seen) < 3:
            assert r.slope is None or np.isnan(r.slope)
        else:
            assert abs(r.slope - (np.median(pairs) if pairs else 0.0)) < 1e-9


def test_horizon_prefers_the_soonest_wall(spark):
    rows = [(1000.0, 500.0, 50.0), (None, 900.0, 50.0), (None, None, 4000.0), (None, None, None), (-5.0, None, 800.0), (1e9, None, None), (10.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, e double")
    got = [r[0] for r in df.select(detect.horizon(F.col("a"), F.col("b"), elapsed=F.col("e"))).collect()]
    assert got == [500, 900, 4000, 300, 800, 7200, 300]
