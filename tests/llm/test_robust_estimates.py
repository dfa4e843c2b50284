"""The minimum covariance determinant against all subsets, and a group of copies that may not draw the estimate."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules as q

ROWS = "__lang string, __source string, x0 long, x1 long, x2 long, x3 long"


def free(spark, groups):
    zero = [F.lit(0.0).alias(c) for c in ("nu", *(f"p{i}" for i in range(4)), *(f"p{i}_{j}" for i, j in q.PAIRS))]
    return spark.createDataFrame(groups, "__lang string, __source string").select("*", *zero)


def floored(x, share):
    c = np.cov(x.T, bias=True) * q._consistency(share)
    return c, c + np.diag((np.array(q.FLOOR) * q.SCALE) ** 2)


def test_the_determinant_is_the_least_of_all_subsets(spark):
    g = np.random.default_rng(7)
    groups = {}
    for name, n in (("a", 11), ("b", 13)):
        x = np.rint(g.normal(size=(n, 4)) * [40, 300, 500, 150] + [1600, 200, 100, 50]).astype(int)
        x[:3] += np.array([900, 2500, 4000, 500])  # a cluster of outliers
        groups[name] = x
    rows = spark.createDataFrame([(k, "*", *map(int, v)) for k, x in groups.items() for v in x], ROWS)
    prior = free(spark, [(k, "*") for k in groups])
    best = {r["__lang"]: r for r in q.concentrated(rows, prior, True, False).collect()}
    final = {r["__lang"]: r for r in q.estimates(rows, prior, True, False).collect()}
    for k, x in groups.items():
        h = (len(x) + 5) // 2
        least, core = min((np.linalg.slogdet(floored(x[list(s)], 0.5)[1])[1], s) for s in combinations(range(len(x)), h))
        assert best[k]["logdet"] == pytest.approx(least, abs=2e-2)  # a bin of distances may hold two rows
        assert set(core).isdisjoint({0, 1, 2})
        mean, cov = np.array([best[k][f"m{i}"] for i in range(4)]), np.zeros((4, 4))
        for i, j in q.PAIRS:
            cov[i, j] = best[k][f"l{i}_{j}"]
        z = np.linalg.solve(cov, (x - mean).T)
        inside = x[(z**2).sum(axis=0) <= q.WITHIN]
        want, _ = floored(inside, 0.975)
        assert [final[k][f"m{i}"] for i in range(4)] == pytest.approx(inside.mean(axis=0))
        assert [final[k][f"c{i}_{j}"] for i, j in q.PAIRS] == pytest.approx([want[i, j] for i, j in q.PAIRS], abs=1e-6 * np.abs(want).max())


def test_copies_of_junk_in_a_third_of_a_group_are_rejected(spark):
    plain = lambda i: " ".join(f"word{(i * 7 + j) % 97}" for j in range(40 + i % 9))
    junk = " ".join(f"jun{j}###$$$" for j in range(40))
    rows = [(i, plain(i), "en", f"s{i % 2}") for i in range(80)] + [(1000 + i, junk, "en", "s0") for i in range(20)] + [(2000, junk, "de", "s9"), (2001, plain(3), "de", "s9")]
    got = {r["doc_id"]: r["kept"] for r in q.reject_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(80)) and not any(got[1000 + i] for i in range(20))
