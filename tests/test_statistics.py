"""Hand-computed and brute-force values of the statistical operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.functions.exprs import ln_factorial, log_hypergeometric
from telesift.operators import clusters as Cl
from telesift.operators import evaluate as E
from telesift.operators import stability as St


def pairs_df(spark, groups):
    rows = [(g, i, float(a), float(b)) for g, ab in groups.items() for i, (a, b) in enumerate(ab)]
    return spark.createDataFrame(rows, "g string, i int, a double, b double")


def brute_signed_rank(diffs):
    d = np.array([x for x in diffs if x != 0])
    order = np.abs(d)
    ranks = np.array([(order < x).sum() + ((order == x).sum() + 1) / 2 for x in order])
    w = ranks[d > 0].sum()
    sums = np.array([sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))])
    return w, (sums >= w).mean(), (sums <= w).mean()


def test_wilcoxon_against_enumeration(spark):
    rng = np.random.default_rng(1)
    groups = {
        "ties": list(zip([3, 1, 4, 1, 5, 9, 2, 6], [1, 1, 2, 3, 3, 4, 4, 1])),
        "plain": list(zip(rng.integers(0, 1000, 9) / 64, rng.integers(0, 1000, 9) / 64)),
        "wins": [(i + 1, 0) for i in range(10)],
        "same": [(1, 1)] * 6,
        "few": [(2, 1)] * 4,
    }
    got = {r["g"]: r for r in St.wilcoxon(pairs_df(spark, groups), ["g"]).collect()}
    for g in ("ties", "plain", "wins"):
        w, ge, le = brute_signed_rank([a - b for a, b in groups[g]])
        assert got[g]["w_plus"] == pytest.approx(w)
        assert got[g]["p_greater"] == pytest.approx(ge)
        assert got[g]["p_less"] == pytest.approx(le)
    assert got["wins"]["p_two_sided"] == pytest.approx(0.001953125)
    assert got["same"]["p_two_sided"] is None and got["few"]["p_two_sided"] is None


def test_wilcoxon_long_sample_uses_the_normal_law(spark):
    n = 80
    rows = [(1.0 if i % 3 else -1.0) * (i + 1) for i in range(n)]
    got = St.wilcoxon(pairs_df(spark, {"x": [(d, 0.0) for d in rows]}), ["g"]).first()
    w = sum(abs(d) for d in rows if d > 0)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert got["p_greater"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_tost_minimum_and_unequal(spark):
    got = {r["g"]: r["tost_p"] for r in St.tost(pairs_df(spark, {"eq": [(0.5, 0.5)] * 10, "far": [(0.5 + i / 100, 0.3) for i in range(10)]}), ["g"]).collect()}
    assert got["eq"] == pytest.approx(0.0009765625)
    assert got["far"] == pytest.approx(1.0)


def test_student_t(spark):
    d = [0.3, -0.1, 0.4, 0.2, 0.5, 0.1]
    got = St.paired_t(pairs_df(spark, {"x": [(v, 0.0) for v in d]}), ["g"]).first()
    t = np.mean(d) / (np.std(d, ddof=1) / math.sqrt(len(d)))
    x = np.linspace(0, t, 200001)
    pdf = math.gamma(3) / (math.sqrt(5 * math.pi) * math.gamma(2.5)) * (1 + x * x / 5) ** -3
    tail = 0.5 - float(((pdf[1:] + pdf[:-1]) / 2 * np.diff(x)).sum())
    assert got["t"] == pytest.approx(t)
    assert got["t_p_one"] == pytest.approx(tail, abs=1e-8)
    assert got["t_p_two"] == pytest.approx(2 * tail, abs=1e-8)


def test_verdicts(spark):
    rows = [(0.1, 0.01, 0.01), (0.1, 0.01, 0.5), (-0.1, 0.01, 0.01), (0.0, 0.5, 0.01), (0.0, None, None)]
    df = spark.createDataFrame(rows, "d double, w double, t double")
    got = [r[0] for r in df.select(St.verdict(F.col("d"), F.col("w"), F.col("t"))).collect()]
    assert got == ["Superior (equiv.)", "Superior", "Inferior (equiv.)", "Equivalent", "Inconclusive"]


def test_nogueira_against_definition(spark):
    z = np.array([[1, 1, 0, 0], [1, 0, 1, 0], [1, 1, 0, 1]])
    rows = [(i, 1, j) for i in range(3) for j in range(4) if z[i, j]]
    df = spark.createDataFrame(rows, "run_id int, seed int, pos int")
    m, d = z.shape
    p, k = z.mean(axis=0), z.sum(axis=1).mean()
    want = 1 - (m / (m - 1) * p * (1 - p)).mean() / (k / d * (1 - k / d))
    assert St.nogueira(df, 4).first()["nogueira"] == pytest.approx(want)
    full = spark.createDataFrame([(i, 1, j) for i in range(2) for j in range(4)], "run_id int, seed int, pos int")
    assert St.nogueira(full, 4).first()["nogueira"] is None


def test_jaccard_of_empty_rest_is_one(spark):
    full = spark.createDataFrame([(i, 1, j) for i in range(2) for j in range(3)], "run_id int, seed int, pos int")
    row = St.jaccard_pairs(full, 3).first()
    assert row["jaccard"] == 1.0 and row["jaccard_removed"] == 1.0


def test_agreement_of_equal_swapped_and_trivial_labelings(spark):
    rows = [("same", i % 3, (i + 1) % 3) for i in range(30)] + [("one", 0, 0) for _ in range(5)]
    cells = Cl.contingency(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", ["g"])
    for fn, name in ((Cl.ari, "ari"), (Cl.ami, "ami"), (Cl.nmi, "nmi")):
        got = {r["g"]: r[name] for r in fn(cells, ["g"]).collect()}
        assert got["same"] == pytest.approx(1.0) and got["one"] == pytest.approx(1.0)


def test_expected_information_of_large_tables(spark):
    rows = [(1, a, b, 10_000_000 + 1000 * a * b) for a in range(3) for b in range(3)]
    got = Cl.ami(spark.createDataFrame(rows, "g int, a int, b int, n bigint"), ["g"]).first()["ami"]
    assert abs(got) < 1e-3


def test_ln_factorial(spark):
    ns = [0, 1, 2, 7, 15, 16, 17, 100, 12345, 10**9]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select(ln_factorial(F.col("n"))).collect()]
    assert got == pytest.approx([math.lgamma(n + 1) for n in ns], rel=1e-12, abs=1e-10)


def test_metrics_with_absent_and_only_predicted_classes(spark):
    y, p = ["a", "a", "b", "b", "c"], ["a", "b", "b", "z", "a"]
    conf = E.confusion(spark.createDataFrame(list(zip(y, p)), "y string, p string"), [])
    m = E.metrics(conf, []).first()
    assert m["f1_macro"] == pytest.approx((0.5 + 0.5 + 0 + 0) / 4)
    assert m["accuracy"] == pytest.approx(0.4)
    f = E.fidelity(conf, []).first()
    assert f["balanced_accuracy"] == pytest.approx((0.5 + 0.5 + 0) / 3) and f["macro_f1"] == pytest.approx(1 / 3)
    n, c = 5, 2
    true, pred = {"a": 2, "b": 2, "c": 1}, {"a": 2, "b": 2, "z": 1}
    cross = sum(true.get(k, 0) * pred.get(k, 0) for k in "abcz")
    want = (c * n - cross) / math.sqrt((n * n - sum(v * v for v in pred.values())) * (n * n - sum(v * v for v in true.values())))
    assert m["mcc"] == pytest.approx(want)


def test_best_matching_against_all_permutations():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5):
        g = rng.integers(0, 9, (n, n)).astype(float)
        best = max(sum(g[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert g[np.arange(n), Cl.best_matching(g)].sum() == best


@pytest.mark.parametrize(("a", "b", "t"), [(3, 4, 10), (1, 9, 10), (400, 300, 1000), (50_000, 7_000, 100_000), (3 * 10**11, 4 * 10**11, 10**12), (5, 10**11, 10**12)])
def test_hypergeometric_law_sums_to_one(spark, a, b, t):
    """Also at a million million rows, where differences of log factorials would be off by a hundredth."""
    sd = (a / t * (1 - a / t) * b * (t - b) / max(1, t - 1)) ** 0.5
    lo, hi = max(0, a + b - t, int(a / t * b - 14 * sd - 30)), min(a, b, int(a / t * b + 14 * sd + 30))
    step = max(1, int(sd // 32))
    law = spark.range(lo, hi + 1, step).select(log_hypergeometric(F.col("id"), F.lit(a), F.lit(b), F.lit(t)).alias("l"))
    assert law.agg(F.sum(F.exp("l")) * step).first()[0] == pytest.approx(1.0, abs=1e-9)
