"""Yinyang clustering against a full scan in plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from propgraph.llm import yinyang


def brute(vectors, k, rounds):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) of [(id, components)] whose order is by (id's hash, components)."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vectors]
        for j in range(len(at)):
            members = [v for (_, v), o in zip(vectors, own, strict=True) if o == j]
            if members:
                at[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in vectors]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found]


def run(spark, rows, k, rounds, dims, scale=1):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, cluster int")
    order = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [tuple(r) for r in yinyang.cluster(yinyang.integers(df, dims=dims, scale=scale), order, k, rounds).collect()]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize(("n", "k", "dims", "spread", "seed"), [(400, 40, 6, 9, 1), (300, 25, 3, 3, 2), (60, 12, 2, 2, 3), (200, 11, 4, 5_000_000, 4), (7, 40, 5, 50, 5)])
def test_same_as_full_scan(spark, n, k, dims, spread, seed):
    """Many ties and repeated vectors (small spread), components too large for floating point, fewer vectors than centroids."""
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, None, 7]), [float(rng.randint(-spread, spread)) for _ in range(dims)], "x", 1) for i in range(n)]
    rows += rows[: n // 3]
    found = run(spark, rows, k, 5, dims)
    assert sorted(found, key=key) == sorted(brute([(i, [int(x) for x in v]) for i, v, *_ in rows], k, 5), key=key)


def test_rows_left_out_and_floors(spark):
    good = [(i, [i / 7, -i / 3], None, None) for i in range(30)]
    odd = [(100, None, "", 0), (101, [1.0], "", 0), (102, [1.0, None], "", 0), (103, [float("nan"), 1.0], "", 0), (104, [1.0, float("-inf")], "", 0), (105, [1.0, 2.0, 3.0], "", 0), (106, [], "", 0)]
    found = run(spark, good + odd, 4, 3, 2, 256)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in good]
    assert sorted(found) == sorted(brute(whole, 4, 3))
    assert run(spark, odd, 4, 3, 2) == []
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30, 0.0], "", 0)], 4, 3, 2)


def test_filters_skip_and_stay_exact():
    """After centroids move a little most vectors are skipped; bounds stay bounds."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 200, (3000, 8)) + 3000 * rng.integers(0, 6, (3000, 1))).astype("i8")
    c = yinyang.grouped(x[rng.permutation(len(x))[:40]])
    own, _, upper, lower = yinyang.scan(x, c)
    seen = []
    for _ in range(6):
        c = c.to(np.stack([np.floor(x[own == j].mean(0)).astype("i8") if (own == j).any() else c.at[j] for j in range(40)]))
        own, exact, upper, lower = yinyang.filtered(x, c, own, upper, lower)
        d = yinyang.squared(x, c.at)
        assert (own == d.argmin(1)).all()
        true = np.sqrt(d.astype("f8"))
        assert (upper >= true[np.arange(len(x)), own] - 1e-6).all()
        true[np.arange(len(x)), own] = np.inf
        assert (lower <= np.stack([true[:, c.group == g].min(1) for g in range(c.groups)], 1) + 1e-6).all()
        seen.append((exact >= 0).mean())
    assert seen[-1] < 0.8
