"""Linear and generalised linear models: sums over the cluster, k by k algebra on the driver.

No pass sends more than k squared numbers to the driver: normal equations, score products and cluster sums are
aggregated where the rows are. Series models (position-lagged errors) work on one row per period.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.models.stats import Z95, chi2_tail, normal_p
from strandwork.session import cut

#: longest series that position-lagged estimators take: they need its order and work on one row per period
MAX_PERIODS = 200_000


@dataclass
class Fit:
    """Coefficients with their covariance; ``singular`` fits have no numbers."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    extra: dict = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def rows(self, model: str) -> list[tuple]:
        out = []
        for name, b, s in zip(self.names, self.beta, self.se):
            z = b / s if s > 0 else math.nan
            out.append((model, name, float(b), float(s), float(z), float(normal_p(b, s)), float(b - Z95 * s), float(b + Z95 * s), int(self.n)))
        return out

    def f_statistic(self) -> float:
        """Classical F of all terms but the intercept."""
        r2, k = self.extra["r2"], len(self.names)
        return r2 / (1 - r2) * (self.n - k) / (k - 1)

    def combine(self, weights: dict[str, float]) -> tuple[float, float]:
        """Estimate and error of a linear combination."""
        w = np.array([weights.get(n, 0.0) for n in self.names])
        return float(w @ self.beta), float(math.sqrt(max(0.0, w @ self.cov @ w)))

    def wald(self, names: list[str]) -> tuple[float, int, float]:
        """Statistic, degrees of freedom and p of the hypothesis that all of ``names`` are 0."""
        i = [self.names.index(n) for n in names]
        b, v = self.beta[i], self.cov[np.ix_(i, i)]
        w = float(b @ np.linalg.solve(v, b))
        return w, len(i), chi2_tail(w, len(i))


RESULT = "model string, term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double, n_obs bigint"


def results(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    return spark.createDataFrame([r for name, f in fits.items() for r in f.rows(name)], RESULT)


def invert(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric matrix; raises where it is singular to working precision."""
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    scaled = a / np.outer(scale, scale)
    if not np.isfinite(scaled).all() or np.linalg.matrix_rank(scaled, tol=1e-10) < len(a):
        raise np.linalg.LinAlgError("the design is singular")
    return np.linalg.inv(scaled) / np.outer(scale, scale)


def moments(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """Weighted cross products of the columns over all rows without nulls among them, and how many rows those are.

    Each task adds up one k by k matrix over its Arrow batches; the matrices are summed by one small aggregation.
    """
    k = len(columns)
    used = [*columns, *([weight] if weight else [])]
    source = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(used)]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, len(used)))
            w = x[:, k:] if weight else 1.0
            total += (x[:, :k] * w).T @ x[:, :k]
            n += len(x)
        cells = [(i, j, float(total[i, j])) for i in range(k) for j in range(i, k)] + [(-1, -1, float(n))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], names=["i", "j", "v"])

    sums = source.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out, n = np.zeros((k, k)), 0
    for r in sums:
        if r["i"] < 0:
            n = int(r["v"])
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out, n


def _linear(names: list[str], beta: np.ndarray) -> Column:
    return sum(F.col(c).cast("double") * float(b) for c, b in zip(names, beta))


def ols(df: DataFrame, y: str, xs: list[str], robust: str = "hc1", cluster: str | None = None) -> Fit:
    """Least squares with an intercept and HC1, classical or (``cluster``) CR1 errors; rows with nulls are left out.

    HC1 scales by n/(n-k), CR1 by g/(g-1) (n-1)/(n-k); a null cluster is left out as any null.
    """
    names = ["intercept", *xs]
    data = df.select(F.lit(1.0).alias("intercept"), *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("__y"), *([F.col(cluster).alias("__g")] if cluster else [])).dropna()
    cross, n = moments(data, [*names, "__y"])
    k = len(names)
    bread = invert(cross[:k, :k])
    beta = bread @ cross[:k, k]
    resid = data.withColumn("__e", F.col("__y") - _linear(names, beta))
    extra = {"rss": float(cross[k, k] - beta @ cross[:k, k]), "tss": float(cross[k, k] - cross[0, k] ** 2 / n)}
    extra["r2"] = 1 - extra["rss"] / extra["tss"] if extra["tss"] > 0 else math.nan
    if cluster:
        sums = resid.groupBy("__g").agg(*[F.sum(F.col(c) * F.col("__e")).alias(c) for c in names])
        meat, g = moments(sums, names)
        cov = bread @ meat @ bread * (g / (g - 1)) * ((n - 1) / (n - k)) if g > 1 else np.full((k, k), math.nan)
        extra["clusters"] = g
    elif robust == "hc1":
        meat, _ = moments(resid.withColumn("__w", F.col("__e") ** 2), names, "__w")
        cov = bread @ meat @ bread * n / (n - k)
    else:
        cov = bread * extra["rss"] / (n - k)
    return Fit(names, beta, cov, n, extra)


def series(df: DataFrame, order: str, columns: list[str]) -> np.ndarray:
    """The rows of a series in order, as an array; it must have one row per period and no more than ``MAX_PERIODS``."""
    rows = df.select(order, *columns).orderBy(order).limit(MAX_PERIODS + 1).toPandas()
    if len(rows) > MAX_PERIODS:
        raise ValueError(f"a series of more than {MAX_PERIODS} periods; aggregate it first")
    return rows[columns].to_numpy(float)


def bartlett(scores: np.ndarray, lag: int) -> np.ndarray:
    """Score products with weights 1 - l/(lag+1) at l positions apart."""
    meat = scores.T @ scores
    for step in range(1, lag + 1):
        if step < len(scores):
            cross = scores[step:].T @ scores[:-step]
            meat += (1 - step / (lag + 1)) * (cross + cross.T)
    return meat


def automatic_lag(n: int) -> int:
    return max(1, int(4 * (n / 100) ** (2 / 9)))


def ols_hac(x: np.ndarray, y: np.ndarray, names: list[str], lag: int | None = None) -> Fit:
    """Least squares on a series with position-lagged (Bartlett) errors, no small-sample factor."""
    bread = invert(x.T @ x)
    beta = bread @ (x.T @ y)
    e = y - x @ beta
    lag = automatic_lag(len(y)) if lag is None else lag
    return Fit(names, beta, bread @ bartlett(x * e[:, None], lag) @ bread, len(y), {"resid": e, "lag": lag, "fitted": x @ beta})


def its_design(months: int, at: int, first: int = 1, after_at_break: int = 0) -> tuple[np.ndarray, list[str]]:
    """Intercept, time from ``first``, post from position ``at`` on, and time after, ``after_at_break`` in the break's period."""
    t = np.arange(months)
    post = (t >= at).astype(float)
    return np.column_stack([np.ones(months), t + first, post, post * (t - at + after_at_break)]), ["intercept", "time", "post", "time_after"]


def prais_winsten(x: np.ndarray, y: np.ndarray, names: list[str]) -> Fit:
    """One step of autoregressive errors of order one, rho within 0.95 of 0."""
    e = ols_hac(x, y, names, 0).extra["resid"]
    rho = float(np.clip((e[1:] @ e[:-1]) / (e[:-1] @ e[:-1]), -0.95, 0.95))
    first = math.sqrt(1 - rho * rho)
    xs = np.vstack([x[:1] * first, x[1:] - rho * x[:-1]])
    ys = np.concatenate([y[:1] * first, y[1:] - rho * y[:-1]])
    bread = invert(xs.T @ xs)
    beta = bread @ (xs.T @ ys)
    u = ys - xs @ beta
    return Fit(names, beta, bread * (u @ u) / (len(y) - x.shape[1]), len(y), {"rho": rho})


def autocorrelations(e: np.ndarray, lags: int) -> np.ndarray:
    d = e - e.mean()
    return np.array([(d[k:] @ d[: len(d) - k]) / (d @ d) for k in range(1, lags + 1)])


def partial_autocorrelations(e: np.ndarray, lags: int) -> np.ndarray:
    """The last coefficient of an autoregression of each order, from the autocorrelations (Durbin's recursion)."""
    r = np.concatenate([[1.0], autocorrelations(e, lags)])
    out, phi = [], np.zeros(0)
    for k in range(1, lags + 1):
        last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k])
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


def durbin_watson(e: np.ndarray) -> float:
    return float(np.sum(np.diff(e) ** 2) / np.sum(e**2))


def ljung_box(e: np.ndarray, lags: int) -> tuple[float, float]:
    r, n = autocorrelations(e, lags), len(e)
    q = float(n * (n + 2) * np.sum(r**2 / (n - np.arange(1, lags + 1))))
    return q, chi2_tail(q, lags)


#: distinct designs up to which their sums are brought to the driver instead of making a pass for each step
LOCAL_DESIGNS = 20_000


def newton(df: DataFrame, y: str, xs: list[str], family: str, offset: str | None = None, weight: str | None = None, tol: float = 1e-9, rounds: int = 100) -> Fit:
    """Poisson (log link) or logit by Newton steps, each one aggregation over the cluster.

    Rows with equal designs are collapsed to their sums first (``weight`` counts them), which leaves the estimates as they
    are and every later pass as small as the number of distinct designs; up to ``LOCAL_DESIGNS`` of them are counted and then
    summed on the driver, with the same result. Linear predictors are kept within 30 of 0 (logit: 35). Errors are HC0 scores
    for Poisson, the information matrix for the logit. Raises if the steps don't settle in ``rounds``.
    """
    names = ["intercept", *xs]
    w = F.col(weight) if weight else F.lit(1.0)
    off = F.col(offset).cast("double") if offset else F.lit(0.0)
    keys = [F.col(x).cast("double").alias(x) for x in xs]
    rows = df.select(*keys, off.alias("__o"), F.col(y).cast("double").alias("__y"), w.cast("double").alias("__w")).dropna()
    data = cut(rows.groupBy(*xs, "__o").agg(F.sum("__w").alias("__n"), F.sum(F.col("__y") * F.col("__w")).alias("__s"), F.sum(F.col("__y") * F.col("__y") * F.col("__w")).alias("__ss")).withColumn("intercept", F.lit(1.0)))
    n, total, exposure, designs = data.agg(F.sum("__n"), F.sum("__s"), F.sum(F.col("__n") * F.exp("__o")), F.count("*")).first()
    if not n:
        raise ValueError("no complete rows")
    if total <= 0 or (family == "logit" and total >= n):
        raise ValueError("the outcome does not vary")
    limit = 30.0 if family == "poisson" else 35.0
    k = len(names)
    local = data.select(*names, "__o", "__n", "__s", "__ss").toPandas().to_numpy(float) if designs <= LOCAL_DESIGNS else None

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Information, score, squared residuals by design, and the Pearson sum at ``beta``."""
        if local is not None:
            x, (o, c, s, ss) = local[:, :k], local[:, k:].T
            eta = np.clip(x @ beta + o, -limit, limit)
            mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
            curve = c * (mu if family == "poisson" else np.maximum(mu * (1 - mu), 1e-10))
            squared = ss - 2 * mu * s + c * mu**2
            return (x * curve[:, None]).T @ x, x.T @ (s - c * mu), (x * squared[:, None]).T @ x, float((squared / mu).sum())
        eta = F.greatest(F.lit(-limit), F.least(F.lit(limit), _linear(names, beta) + F.col("__o")))
        mu = F.exp(eta) if family == "poisson" else 1 / (1 + F.exp(-eta))
        curve = F.col("__n") * (F.col("__mu") if family == "poisson" else F.greatest(F.col("__mu") * (1 - F.col("__mu")), F.lit(1e-10)))
        squared = F.col("__ss") - 2 * F.col("__mu") * F.col("__s") + F.col("__n") * F.col("__mu") ** 2
        # residuals and squared ones over the curve, so that one weighted pass adds up everything; each x times the root of its share
        step = data.withColumn("__mu", mu).withColumn("__c", curve).withColumn("__r", (F.col("__s") - F.col("__n") * F.col("__mu")) / F.col("__c")).withColumn("__q", squared)
        step = step.withColumns({f"__h{i}": F.col(c) * F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__c"))) for i, c in enumerate(names)}).withColumn("__p", F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("__mu") / F.col("__c"))))
        cross, _ = moments(step, [*names, "__r", *[f"__h{i}" for i in range(k)], "__p"], "__c")
        return cross[:k, :k], cross[:k, k], cross[k + 1 : 2 * k + 1, k + 1 : 2 * k + 1], float(cross[-1, -1])

    beta = np.zeros(k)
    beta[0] = math.log(total / exposure) if family == "poisson" else math.log(total / (n - total))
    for _ in range(rounds):
        info, score, meat, pearson = sums(beta)
        step = np.linalg.solve(info + 1e-12 * np.eye(k), score)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    else:
        raise RuntimeError(f"the steps don't settle in {rounds} rounds")
    bread = invert(info)
    if family == "logit":
        return Fit(names, beta, bread, int(n))
    return Fit(names, beta, bread @ meat @ bread, int(n), {"dispersion": pearson / max(1, n - k)})


def within(df: DataFrame, columns: list[str], effects: list[str], sweeps: int = 200, tol: float = 1e-8) -> DataFrame:
    """``columns`` with the means of each of ``effects`` taken out, by alternating sweeps until they change by less than ``tol`` of the columns' spread.

    Group means are aggregated and joined back. Raises if they haven't settled after ``sweeps``.
    """
    data = cut(df)
    spread = [v or 1.0 for v in data.agg(*[F.stddev_pop(c) for c in columns]).first()]
    for _ in range(sweeps):
        change = 0.0
        for e in effects:
            means = cut(data.groupBy(e).agg(*[F.avg(c).alias(f"__{c}") for c in columns]))
            joined = data.join(means, e)
            top = means.agg(*[F.max(F.abs(f"__{c}")) for c in columns]).first()
            change = max([change, *[abs(v) / s for v, s in zip(top, spread) if v is not None]])
            data = joined.select(*[c for c in data.columns if c not in columns], *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in columns])
        data = cut(data)
        if change < tol:
            return data
    raise RuntimeError(f"the means still change after {sweeps} sweeps")


def fixed_effects(df: DataFrame, y: str, xs: list[str], effects: list[str], cluster: str, max_levels: int = 200) -> Fit:
    """Within estimator of one or more effects with CR1 errors, exact: no sweeps where all effects but one have up to ``max_levels`` levels.

    The effect of many levels is taken out in one aggregation, whose groups also count the levels of the others; these are then
    dummies in the normal equations. More levels in more than one effect are taken out by sweeps (``within``). Rows with nulls are left out.
    """
    data = cut(df.select(*dict.fromkeys([*effects, cluster]), *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna())
    sizes = {e: data.select(e).distinct().limit(max_levels + 1).collect() for e in effects}
    small = [e for e in effects if len(sizes[e]) <= max_levels]
    large = [e for e in effects if e not in small] or small[:1]
    small = [e for e in small if e not in large]
    if len(large) > 1:
        swept = within(data, [y, *xs], effects)
        cross, n = moments(swept, [*xs, y])
        bread = invert(cross[:-1, :-1])
        beta = bread @ cross[:-1, -1]
        scores = swept.withColumn("__e", F.col(y) - _linear(xs, beta)).groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("__e")).alias(c) for c in xs])
        return _cr1(list(xs), beta, bread, scores, n)
    one = large[0]
    levels = [(e, r[0]) for e in small for r in sorted(sizes[e])[1:]]
    dummies = [(F.col(e) == F.lit(v)).cast("double") for e, v in levels]
    values = [F.col(c) for c in (*xs, y)]
    k, m = len(xs), len(values)
    sums = data.groupBy(one).agg(F.count("*").cast("double").alias("__n"), *[F.sum(v).alias(f"v{i}") for i, v in enumerate([*values, *dummies])])
    names = [f"v{i}" for i in range(m + len(dummies))]
    # cross products about the groups' means: those of the rows less those of the sums, a group's divided by its size
    between, _ = moments(sums.withColumn("__w", 1 / F.col("__n")), names, "__w")
    direct, n = moments(data, [*xs, y])
    total = np.zeros_like(between)
    total[:m, :m] = direct
    if levels:
        by_level = {}
        for e in small:
            by_level |= {(e, r[0]): r[1:] for r in data.groupBy(e).agg(*[F.sum(v) for v in values], F.count("*")).collect()}
        for j, level in enumerate(levels):
            *crossed, count = by_level[level]
            total[m + j, :m] = total[:m, m + j] = crossed
            total[m + j, m + j] = count
        for (e, f) in [(e, f) for i, e in enumerate(small) for f in small[i + 1 :]]:
            at = {level: m + j for j, level in enumerate(levels)}
            for r in data.groupBy(e, f).count().collect():  # the product of two small effects
                if (e, r[0]) in at and (f, r[1]) in at:
                    i, j = at[e, r[0]], at[f, r[1]]
                    total[i, j] = total[j, i] = r[2]
    centred = total - between
    # the dummies are partialled out of the regressors and the outcome
    d = centred[m:, m:]
    part = np.linalg.pinv(d, hermitian=True) @ centred[m:, :m] if levels else np.zeros((0, m))
    left = centred[:m, :m] - centred[:m, m:] @ part
    bread = invert(left[:k, :k])
    beta = bread @ left[:k, k]

    def cleared(i: int) -> Column:
        """A value less what the small effects explain of it, before the mean of the large one's group goes."""
        out = values[i]
        for e in small:
            at = [(v, float(part[j, i])) for j, (f, v) in enumerate(levels) if f == e]
            out = out - F.coalesce(F.create_map(*[F.lit(x) for p in at for x in p])[F.col(e)], F.lit(0.0)) if at else out
        return out

    kept = data.select(*dict.fromkeys([one, cluster]), *[cleared(i).alias(f"u{i}") for i in range(m)]).withColumn("__e", F.col(f"u{k}") - sum(float(b) * F.col(f"u{i}") for i, b in enumerate(beta)))
    if cluster == one:
        scores = kept.groupBy(one).agg(*[(F.sum(F.col(f"u{i}") * F.col("__e")) - F.sum(f"u{i}") * F.sum("__e") / F.count("*")).alias(c) for i, c in enumerate(xs)])
    else:
        means = kept.groupBy(one).agg(F.avg("__e").alias("__me"), *[F.avg(f"u{i}").alias(f"m{i}") for i in range(k)])
        scores = kept.join(means, one).groupBy(cluster).agg(*[F.sum((F.col(f"u{i}") - F.col(f"m{i}")) * (F.col("__e") - F.col("__me"))).alias(c) for i, c in enumerate(xs)])
    return _cr1(list(xs), beta, bread, scores, n)


def _cr1(names: list[str], beta: np.ndarray, bread: np.ndarray, scores: DataFrame, n: int) -> Fit:
    """Clustered errors of ``scores``, a row per cluster."""
    meat, g = moments(scores, names)
    k = len(names)
    return Fit(names, beta, bread @ meat @ bread * (g / (g - 1)) * ((n - 1) / (n - k)), n, {"clusters": g})


def cluster_bootstrap(df: DataFrame, cluster: str, statistic: Callable[[DataFrame], list[Column]], replicates: int = 120, seed: int = 20240901) -> DataFrame:
    """(replicate, ...) of weighted statistics: every cluster's Poisson(1) weight in a replicate comes from a hash of both.

    The hash makes a replicate the same on any number of tasks and after any loss of one.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(cluster)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight, mass, total = F.lit(0), math.exp(-1), 0.0
    for k in range(12):
        total += mass
        weight = weight + (u > total).cast("int")
        mass /= k + 1
    per = df.select("*", reps).withColumn("w", weight)
    return per.groupBy("replicate").agg(*statistic(per))


def month_dummies(first_month: int, months: int) -> tuple[np.ndarray, list[str]]:
    """Columns of the months of the year but January, for a series that begins in ``first_month``."""
    of_year = (np.arange(months) + first_month - 1) % 12 + 1
    return np.column_stack([(of_year == m).astype(float) for m in range(2, 13)]), [f"month{m:02d}" for m in range(2, 13)]


def ols_stacked_hac(x: np.ndarray, y: np.ndarray, periods: np.ndarray, names: list[str], lag: int) -> Fit:
    """Least squares on stacked series: scores are summed within a period before they are lagged over the periods."""
    bread = invert(x.T @ x)
    beta = bread @ (x.T @ y)
    scores = x * (y - x @ beta)[:, None]
    sums = np.array([scores[periods == p].sum(0) for p in np.unique(periods)])
    return Fit(names, beta, bread @ bartlett(sums, lag) @ bread, len(y))


def poisson_series(x: np.ndarray, y: np.ndarray, names: list[str], lag: int, offset: np.ndarray | None = None, tol: float = 1e-9, rounds: int = 100) -> Fit:
    """Poisson by Newton steps on a series with position-lagged errors and the Pearson dispersion."""
    off = np.zeros(len(y)) if offset is None else offset
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(y.sum() / np.exp(off).sum())
    for _ in range(rounds):
        mu = np.exp(np.clip(x @ beta + off, -30, 30))
        step = np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    else:
        raise RuntimeError(f"the steps don't settle in {rounds} rounds")
    mu = np.exp(np.clip(x @ beta + off, -30, 30))
    bread = invert((x * mu[:, None]).T @ x)
    cov = bread @ bartlett(x * (y - mu)[:, None], lag) @ bread
    return Fit(names, beta, cov, len(y), {"dispersion": float(((y - mu) ** 2 / mu).sum() / (len(y) - x.shape[1]))})
