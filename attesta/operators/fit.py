"""Models by (category, engine): L2 logistic yardstick, horseshoe logistic, empty stand-in, ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import keys

COEFFICIENTS = "category string, engine string, feature string, posterior_median double, ci_low double, ci_high double, noise_flag boolean, n_rows long, n_companies long, cv_auc double, cv_folds int, accuracy double"
PRIOR_SIGMA, SLAB_DF, SLAB_SCALE = 2.0, 4.0, 3.0
MIN_CATEGORIES, MIN_COMPANIES = 15, 300


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Sorted feature names and the rows' values; a missing one is 0."""
    rows = [dict(x) for x in pdf["features"]]
    names = sorted({k for r in rows for k in r})
    return names, np.array([[float(r.get(n, 0.0)) for n in names] for r in rows]).reshape(len(rows), len(names))


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(intercept, weights) minimising log loss + |w|^2 / 2c by Newton's steps; the intercept is free."""
    design = np.column_stack([np.ones(len(y)), x])
    ridge = np.diag([0.0] + [1 / c] * x.shape[1])
    beta = np.zeros(design.shape[1])

    def loss(b):
        z = design @ b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * b @ ridge @ b

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        g = design.T @ (p - y) + ridge @ beta
        if np.abs(g).max() < 1e-9:
            break
        step = np.linalg.pinv(design.T @ ((p * (1 - p))[:, None] * design) + ridge) @ g
        t = 1.0
        while t > 1e-6 and loss(beta - t * step) > loss(beta):
            t /= 2
        beta = beta - t * step
    return float(beta[0]), beta[1:]


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = pd.Series(score).rank().to_numpy()
    pos = int(y.sum())
    return float((order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def _rows(pdf: pd.DataFrame, names, med, low, high, cv=None, folds=None, accuracy=None) -> pd.DataFrame:
    n, companies = len(pdf), pdf["company_domain"].nunique()
    out = []
    for f, m, a, b in zip(names, med, low, high):
        m = float(m) if np.isfinite(m) else 0.0
        a, b = (float(v) if np.isfinite(v) else 0.0 for v in (a, b))
        out.append((pdf["category"].iloc[0], pdf["engine"].iloc[0], f, m, min(a, b), max(a, b), bool(min(a, b) <= 0 <= max(a, b)), n, companies, cv, folds, accuracy))
    return pd.DataFrame(out, columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])


def baseline(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's yardstick on p_cited >= 0.5: Wald bands, cross-validated AUC from eight rows on."""
    pdf = pdf.sort_values(["page_url", "company_domain"]).reset_index(drop=True)
    names, x = _matrix(pdf)
    y = (pdf["p_cited"].to_numpy(float) >= 0.5).astype(int)
    if not names or len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return _rows(pdf, names, [0.0] * len(names), [-1.0] * len(names), [1.0] * len(names), None, None, max(share, 1 - share))
    sd = x.std(axis=0)
    xs = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    b, w = logistic(xs, y)
    p = 1 / (1 + np.exp(-(b + xs @ w)))
    design = np.column_stack([np.ones(len(y)), xs])
    cov = np.linalg.pinv(design.T @ ((p * (1 - p))[:, None] * design))
    band = 1.96 * np.sqrt(np.clip(np.diag(cov), 0, None))[1:]
    cv, folds = None, None
    k = min(3, int(np.bincount(y, minlength=2).min()))
    if len(y) >= 8 and k >= 2:
        fold = np.empty(len(y), int)
        for c in (0, 1):
            fold[y == c] = np.arange((y == c).sum()) % k
        scores = []
        for f in range(k):
            b0, w0 = logistic(xs[fold != f], y[fold != f])
            scores.append(auc(b0 + xs[fold == f] @ w0, y[fold == f]))
        cv, folds = float(np.mean(scores)), k
    return _rows(pdf, names, w, w - band, w + band, cv, folds, float(((p >= 0.5) == (y == 1)).mean()))


def tau0(n: int, d: int) -> float:
    """The horseshoe's global scale, from the effective N and a tenth of the features."""
    few = 0.5 if d <= 1 else min(d - 0.5, max(1.0, d / 10))
    return few / (d - few) * PRIOR_SIGMA / np.sqrt(max(n, 1))


def horseshoe_samples(x: np.ndarray, y: np.ndarray, scale: float, draws: int, tune: int, chains: int, seed: int) -> np.ndarray:
    """Posterior draws of the weights under the regularized horseshoe.

    Elliptical slices move the standard normals and the intercept; slices along each logarithm move
    the local scales, the global one and the slab's.
    """
    n, d = x.shape
    out = []
    for chain in range(chains):
        rng = np.random.default_rng([seed, chain])
        f = rng.normal(size=d + 1) * 0.1  # d normals, then the intercept over 10
        logs = np.concatenate([np.zeros(d), [np.log(scale)], [np.log(SLAB_SCALE**2)]])

        def beta(f, logs):
            lam2, tau2, c2 = np.exp(2 * logs[:d]), np.exp(2 * logs[d]), np.exp(logs[d + 1])
            return f[:d] * np.sqrt(tau2 * c2 * lam2 / (c2 + tau2 * lam2))

        def like(f, logs):
            z = 10 * f[d] + x @ beta(f, logs)
            return float(y @ z - np.logaddexp(0, z).sum())

        def prior(logs):  # half-Cauchy, half-Cauchy(scale), inverse gamma, each with its Jacobian
            local, t, c = logs[:d], logs[d] - np.log(scale), logs[d + 1]
            a = SLAB_DF / 2
            return float((local - np.log1p(np.exp(2 * np.clip(local, -300, 300)))).sum() + t - np.log1p(np.exp(2 * np.clip(t, -300, 300))) - a * c - a * SLAB_SCALE**2 * np.exp(-c))

        now = like(f, logs)
        for it in range(tune + draws):
            nu = rng.normal(size=d + 1)
            level = now + np.log(rng.uniform())
            angle = rng.uniform(0, 2 * np.pi)
            lo, hi = angle - 2 * np.pi, angle
            while True:
                g = f * np.cos(angle) + nu * np.sin(angle)
                v = like(g, logs)
                if v > level:
                    f, now = g, v
                    break
                lo, hi = (angle, hi) if angle < 0 else (lo, angle)
                angle = rng.uniform(lo, hi)
            for j in range(d + 2):
                base = now + prior(logs)
                level = base + np.log(rng.uniform())
                left = logs[j] - 1.5 * rng.uniform()
                right = left + 1.5
                trial = logs.copy()

                def at(value, j=j, trial=trial):
                    trial[j] = value
                    return like(f, trial) + prior(trial)

                steps = 0
                while at(left) > level and steps < 20:
                    left, steps = left - 1.5, steps + 1
                steps = 0
                while at(right) > level and steps < 20:
                    right, steps = right + 1.5, steps + 1
                while True:
                    value = rng.uniform(left, right)
                    if at(value) > level:
                        logs = trial.copy()
                        now = like(f, logs)
                        break
                    left, right = (value, right) if value < logs[j] else (left, value)
                    if right - left < 1e-12:
                        break
            if it >= tune:
                out.append(beta(f, logs))
    return np.array(out)


def horseshoe(pdf: pd.DataFrame, seed: int = 0, chains: int = 2, tune: int = 500, draws: int = 500) -> pd.DataFrame:
    """One group's case-control fit: 5, 50 and 95 per cent points; noise if they span 0."""
    pdf = pdf.sort_values(["page_url", "company_domain"]).reset_index(drop=True)
    names, x = _matrix(pdf)
    y = (pdf["label"] == "winner").to_numpy(int)
    sd = x.std(axis=0) if len(names) else np.empty(0)
    keep = sd > 1e-12
    if len(pdf) < 2 or len(set(y)) < 2 or not keep.any():
        return _rows(pdf, names, [0.0] * len(names), [-1.0] * len(names), [1.0] * len(names))
    xs = (x[:, keep] - x[:, keep].mean(axis=0)) / sd[keep]
    s = horseshoe_samples(xs, y.astype(float), tau0(pdf["company_domain"].nunique(), int(keep.sum())), draws, tune, chains, seed)
    low, med, high = np.percentile(s, [5, 50, 95], axis=0)
    return _rows(pdf, [n for n, k in zip(names, keep) if k], med, low, high)


def fitted(rows: DataFrame, model: str = "baseline", **how) -> DataFrame:
    """Coefficients of every (category, engine): groups are fitted side by side, each whole in one task.

    rows: category, engine, page_url, company_domain, p_cited, label, features (map).
    """
    one = {"baseline": lambda pdf: baseline(pdf), "horseshoe": lambda pdf: horseshoe(pdf, **how)}[model]
    return rows.select("category", "engine", "page_url", "company_domain", "p_cited", "label", "features").groupBy("category", "engine").applyInPandas(one, COEFFICIENTS)


def dummy(rows: DataFrame) -> DataFrame:
    """The honestly empty stand-in: tiny numbers by name, all noise."""
    names = rows.select("category", "engine", F.explode(F.map_keys("features")).alias("feature")).distinct()
    m = keys.jitter(F.concat_ws(":", "engine", "category", "feature"))
    wide = F.abs(m) + 0.1
    return names.select("category", "engine", "feature", m.alias("posterior_median"), (m - wide).alias("ci_low"), (m + wide).alias("ci_high"), F.lit(True).alias("noise_flag"))


def ranked(coefficients: DataFrame, k: int = 3) -> DataFrame:
    """The k best surviving features of each fit: by the nearer end of the interval, then the median."""
    near = F.least(F.abs("ci_low"), F.abs("ci_high"))
    line = Window.partitionBy("category", "engine").orderBy(F.desc(near), F.desc(F.abs("posterior_median")), "feature")
    return coefficients.where(~F.col("noise_flag")).withColumn("place", F.row_number().over(line)).where(F.col("place") <= k)


def sentence(feature: Column, median: Column) -> Column:
    """A tentative hypothesis: association and direction, to be tested."""
    way = F.when(median >= 0, "more").otherwise("less")
    return F.concat(F.lit("Pages with higher `"), feature, F.lit("` may be cited "), way, F.lit(" often (hypothesis — test with an experiment)"))


def payload(coefficients: DataFrame, k: int = 3) -> DataFrame:
    """By fit: features tested, noise, survivors, effective N and the top hypotheses with a caveat."""
    g = coefficients.groupBy("category", "engine").agg(F.count("*").alias("n_features_total"), F.count_if("noise_flag").alias("n_features_noise"), F.count_if(~F.col("noise_flag")).alias("n_features_surviving"), F.max("n_companies").alias("n_companies"))
    top = ranked(coefficients, k).groupBy("category", "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", sentence(F.col("feature"), F.col("posterior_median")).alias("s")))), lambda x: x["s"]).alias("top_hypotheses"))
    out = g.join(top, ["category", "engine"], "left").withColumn("top_hypotheses", F.coalesce("top_hypotheses", F.array().cast("array<string>")))
    caveat = F.concat(F.lit("Associations to be tested by a randomized experiment, nothing more. Effective N = "), F.col("n_companies").cast("string"), F.lit(" companies."))
    return out.withColumn("caveat", caveat).withColumn("claim_rung", F.lit(1))


def gaps(coefficients: DataFrame) -> DataFrame:
    """Coefficients with ``survives``, judged by the interval as well as the flag, strongest first within each fit."""
    noise = F.col("noise_flag") | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    line = Window.partitionBy("category", "engine", noise).orderBy(F.desc(F.abs("posterior_median")), "feature")
    return coefficients.withColumn("survives", ~noise).withColumn("place", F.row_number().over(line))


def hierarchical_ready(rows: DataFrame) -> DataFrame:
    """One row: whether there are categories and companies enough to pool, and what is short."""
    g = rows.agg(F.count_distinct("category").alias("n_categories"), F.count_distinct("company_domain").alias("n_companies"))
    short = F.array(F.when(F.col("n_categories") < MIN_CATEGORIES, "too few categories"), F.when(F.col("n_companies") < MIN_COMPANIES, "too few companies"))
    return g.withColumn("reasons", F.filter(short, lambda x: x.isNotNull())).withColumn("ready", F.size("reasons") == 0)


def fit_hierarchical(rows: DataFrame) -> DataFrame:
    raise NotImplementedError("the pooled model across categories is not built")
