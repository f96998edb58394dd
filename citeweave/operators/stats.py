"""Hypothesis tests, summaries and divergences.

Statistics are aggregates computed on executors; only a handful of scalars per
test (never per-row data) reach the driver, where p-values that need special
functions (t, chi-square tails) are evaluated with the stdlib.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.prefix import average_ranks, dense_index, prefix_sums
from citeweave.session import materialize

# ---- scalar distribution functions (driver, stdlib only) -------------------------


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def chi2_sf_df3(x: float) -> float:
    """Upper tail of chi-square with 3 degrees of freedom."""
    if x <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) (continued fraction)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


# ---- rank tests -------------------------------------------------------------------


def _tail(fn, *cols):
    """A distribution function of Python applied to columns in Arrow batches (a few rows a group)."""
    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else float(fn(*row)) for row in zip(*values)], dtype="float64")

    return run(*cols)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis test over the groups, tie-corrected: one row ``h, df, n, p``.
    Ranks are computed on the distinct-value histogram (distributed); p is the chi-square tail."""
    v = df.where(F.col(value).isNotNull()).select(group, value)
    ranks = average_ranks(v, value)
    per = v.join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("rank").alias("R"), F.count(F.lit(1)).cast("double").alias("m"))
    sums = per.agg(F.sum(F.col("R") * F.col("R") / F.col("m")).alias("sr"), F.sum("m").alias("N"), (F.count(F.lit(1)) - 1).alias("df"))
    ties = ranks.agg(F.coalesce(F.sum(F.pow("n", 3) - F.col("n")), F.lit(0.0)).alias("t")).first()["t"]  # a scalar
    N = F.col("N")
    h = (12.0 / (N * (N + 1)) * F.col("sr") - 3 * (N + 1)) / (1 - F.lit(float(ties)) / (F.pow(N, 3) - N))
    return sums.select(h.alias("h"), "df", N.cast("long").alias("n")).withColumn("p", _tail(_chi2_sf, F.col("h"), F.col("df")))


def _chi2_sf(x: float, k: int) -> float:
    # regularised upper incomplete gamma Q(k/2, x/2) by series/continued fraction
    a, xx = k / 2.0, x / 2.0
    if xx <= 0:
        return 1.0
    if xx < a + 1:
        s, term, n = 1.0 / a, 1.0 / a, 0
        while abs(term) > 1e-16 * abs(s) and n < 1000:
            n += 1
            term *= xx / (a + n)
            s += term
        return 1 - s * math.exp(-xx + a * math.log(xx) - math.lgamma(a))
    b, c, d = xx + 1 - a, 1e300, 1 / (xx + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / d if abs(d) > 1e-300 else 1e300
        c = b + an / c
        de = d * c
        h *= de
        if abs(de - 1) < 1e-16:
            break
    return math.exp(-xx + a * math.log(xx) - math.lgamma(a)) * h


def wilcoxon_less(df: DataFrame, group: str, value: str, mu: str) -> DataFrame:
    """One-sided (``less``) Wilcoxon signed-rank tests of ``value - mu`` (two columns) for all
    groups in one job: zero differences take no rank, tie-corrected normal approximation without
    continuity correction (E7).  ``group, n`` (all values), ``n_used, T`` (rank sum of the positive
    differences), ``z, p``."""
    d = df.select(group, (F.col(value) - F.col(mu)).alias("_d")).where(F.col("_d").isNotNull())
    hist = d.where(F.col("_d") != 0).groupBy(group, F.abs("_d").alias("_a")).agg(
        F.count(F.lit(1)).cast("double").alias("_c"), F.sum((F.col("_d") > 0).cast("double")).alias("_pos"))
    cum = prefix_sums(hist, [group, "_a"], ["_c"], inclusive=False)
    base = cum.groupBy(group).agg(F.min("cum__c").alias("_b"))
    ranked = cum.join(F.broadcast(base), group).withColumn("_rank", F.col("cum__c") - F.col("_b") + (F.col("_c") + 1) / 2)
    m = F.col("n_used")
    out = d.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(ranked.groupBy(group).agg(
        F.sum("_c").alias("n_used"), F.sum(F.col("_rank") * F.col("_pos")).alias("T"), F.sum(F.pow("_c", 3) - F.col("_c")).alias("_ties")), group, "left")
    z = (F.col("T") - m * (m + 1) / 4) / F.sqrt((m * (m + 1) * (2 * m + 1) - 0.5 * F.col("_ties")) / 24)
    return out.select(group, "n", F.coalesce(m, F.lit(0.0)).cast("long").alias("n_used"), "T", z.alias("z")).withColumn("p", _tail(norm_cdf, F.col("z")))


# ---- moment tests (fully in Spark expressions) ----------------------------------------


def normaltest(df: DataFrame, group: str, value: str) -> DataFrame:
    """D'Agostino-Pearson K^2 per group (E8): population skewness and kurtosis
    (as SciPy's defaults), the closed-form transforms, ``p = exp(-K^2/2)``."""
    a = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n, g1 = F.col("n"), F.col("g1")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    W2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(W2))
    alpha = F.sqrt(2.0 / (W2 - 1))
    yy = y / alpha
    Z1 = delta * F.log(yy + F.sqrt(yy * yy + 1))
    b2 = F.col("g2") + 3
    E = 3.0 * (n - 1) / (n + 1)
    V = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - E) / F.sqrt(V)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    A = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * A)
    denom = 1 + x * F.sqrt(2 / (A - 4.0))
    term2 = F.signum(denom) * F.pow((1 - 2.0 / A) / F.abs(denom), 1 / 3.0)
    Z2 = (term1 - term2) / F.sqrt(2 / (9.0 * A))
    K2 = Z1 * Z1 + Z2 * Z2
    return a.select(group, F.col("n").cast("long").alias("n"), F.col("g1").alias("skew"), F.col("g2").alias("kurt"),
                    Z1.alias("z_skew"), Z2.alias("z_kurt"), K2.alias("k2"), F.exp(-K2 / 2).alias("p"))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """``n, mean, sd`` (sample) per group: the inputs of t-tests and intervals."""
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def ttest_1samp(df: DataFrame, group: str, value: str, mu: float) -> DataFrame:
    """One-sample t-tests of every group's mean against ``mu`` (E9): ``group, n, mean, sd, T,
    p_two_sided, p_less``."""
    m = group_moments(df, group, value).withColumn("T", (F.col("mean") - F.lit(float(mu))) / (F.col("sd") / F.sqrt("n")))
    m = m.withColumn("p_less", _tail(t_cdf, F.col("T"), F.col("n") - 1))
    return m.withColumn("p_two_sided", 2 * F.least(F.col("p_less"), 1 - F.col("p_less")))


def mean_ci(df: DataFrame, group: str, value: str, confidence: float = 0.95) -> DataFrame:
    """Mean with a t-based confidence interval per group (E10, D16): ``group, n, mean, sd, lo, hi``."""
    m = group_moments(df, group, value)
    q = _tail(lambda n: t_ppf((1 + confidence) / 2, n - 1), F.col("n").cast("double"))
    half = F.col("_q") * F.col("sd") / F.sqrt("n")
    return m.withColumn("_q", q).select(group, "n", "mean", "sd", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


# ---- summaries ----------------------------------------------------------------------


def exact_quantiles(df: DataFrame, group: str, value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy's default) per group,
    without holding a group in one task: rows get their position inside the
    group from the distributed dense index, and each quantile is read off the
    two rows around ``q * (n - 1)``.  Returns ``group, n, q_<i>`` columns."""
    v = df.where(F.col(value).isNotNull()).select(group, value)
    idx = dense_index(v, [group, value], out="_i")
    meta = idx.groupBy(group).agg(F.min("_i").alias("_s"), F.count(F.lit(1)).alias("n"))
    pos = idx.join(F.broadcast(meta), group).select(group, "n", (F.col("_i") - F.col("_s")).alias("_p"), value)
    want = meta.select(group, "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), (F.lit(float(q)) * (F.col("n") - 1)).alias("h")) for i, q in enumerate(qs)])).alias("w")) \
        .select(group, "n", "w.qi", F.floor("w.h").cast("long").alias("_lo"), F.ceil("w.h").cast("long").alias("_hi"),
                (F.col("w.h") - F.floor("w.h")).alias("_f"))
    # the few rows at the wanted positions, before anything is joined to them
    want = materialize(want, "quantile-positions")
    needed = want.select(group, F.col("_lo").alias("_p")).union(want.select(group, F.col("_hi").alias("_p"))).distinct()
    pos = materialize(pos.join(F.broadcast(needed), [group, "_p"], "left_semi"), "quantile-values")
    lo = pos.select(group, F.col("_p").alias("_lo"), F.col(value).alias("_vlo"))
    hi = pos.select(group, F.col("_p").alias("_hi"), F.col(value).alias("_vhi"))
    qv = want.join(lo, [group, "_lo"]).join(hi, [group, "_hi"]).select(
        group, "n", "qi", (F.col("_vlo") + F.col("_f") * (F.col("_vhi") - F.col("_vlo"))).alias("qv"))
    wide = qv.groupBy(group, "n").pivot("qi", list(range(len(qs)))).agg(F.first("qv"))
    return wide.select(group, "n", *[F.col(str(i)).alias(f"q_{i}") for i in range(len(qs))])


def five_number(df: DataFrame, group: str, value: str) -> DataFrame:
    """Box-plot numbers per group (A5, A17): quartiles (linear interpolation),
    median, and whiskers = most extreme values within 1.5 IQR of the box."""
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75]).select(
        group, "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    j = df.join(q, group)
    iqr = F.col("q3") - F.col("q1")
    w = j.groupBy(group).agg(
        F.min(F.when(F.col(value) >= F.col("q1") - 1.5 * iqr, F.col(value))).alias("whisker_lo"),
        F.max(F.when(F.col(value) <= F.col("q3") + 1.5 * iqr, F.col(value))).alias("whisker_hi"))
    return q.join(w, group)


def kde_grid(df: DataFrame, group: str, value: str, start: float = 0.0, stop: float = 2.0, step: float = 0.01) -> DataFrame:
    """Gaussian kernel density on a fixed grid per group (A18): Scott bandwidth
    ``h = n^(-1/5) * sd``.  Each row adds its kernel to every grid point as an
    array expression; the per-point sums are a map-side-combined aggregate."""
    npts = int(round((stop - start) / step))
    grid = [start + i * step for i in range(npts)]
    mom = group_moments(df, group, value).select(group, "n", (F.pow(F.col("n"), -0.2) * F.col("sd")).alias("h"))
    j = df.where(F.col(value).isNotNull()).join(mom, group)
    g = F.array(*[F.lit(float(x)) for x in grid])
    contrib = F.transform(g, lambda x: F.exp(-F.pow(x - F.col(value), 2) / (2 * F.col("h") * F.col("h"))))
    ex = j.select(group, "n", "h", F.posexplode(contrib).alias("i", "k"))
    s = ex.groupBy(group, "i").agg(F.sum("k").alias("s"), F.first("n").alias("n"), F.first("h").alias("h"))
    return s.select(group, (F.lit(start) + F.col("i") * F.lit(step)).alias("x"),
                    (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def positional_divergence(df: DataFrame, group: str, value: str, pairs_of: Sequence[str] | None = None) -> DataFrame:
    """KL divergence and Jensen-Shannon distance between every ordered pair of
    groups (E11-E13).  Each sample is normalised to sum 1 and compared by
    position in ascending value order (the declared order, D: positions in the
    reference are arbitrary).  Returns ``a, b, kl, js``."""
    v = df.where(F.col(value).isNotNull()).select(group, value)
    idx = dense_index(v, [group, value], out="_i")
    start = idx.groupBy(group).agg(F.min("_i").alias("_s"), F.sum(value).alias("_tot"))
    pos = idx.join(F.broadcast(start), group).select(
        group, (F.col("_i") - F.col("_s")).alias("pos"), (F.col(value) / F.col("_tot")).alias("p"))
    a = pos.select(F.col(group).alias("a"), "pos", F.col("p").alias("pa"))
    b = pos.select(F.col(group).alias("b"), "pos", F.col("p").alias("pb"))
    j = a.join(b, "pos").where(F.col("a") != F.col("b"))
    m = (F.col("pa") + F.col("pb")) / 2
    kl_t = F.when(F.col("pa") > 0, F.col("pa") * F.log(F.col("pa") / F.col("pb"))).otherwise(0.0)
    js_a = F.when(F.col("pa") > 0, F.col("pa") * F.log(F.col("pa") / m)).otherwise(0.0)
    js_b = F.when(F.col("pb") > 0, F.col("pb") * F.log(F.col("pb") / m)).otherwise(0.0)
    r = j.groupBy("a", "b").agg(F.sum(kl_t).alias("kl"), F.sum(js_a).alias("_ja"), F.sum(js_b).alias("_jb"))
    return r.select("a", "b", "kl", F.sqrt(F.greatest(F.lit(0.0), (F.col("_ja") + F.col("_jb")) / 2)).alias("js"))
