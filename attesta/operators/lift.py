"""Difference in differences on matched pairs: panel, guards, estimate with page-clustered errors."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, MIN_PAIRS, MIN_LIFT, MAX_WIDTH = 0.10, 4, 0.05, 1.0
RESULT = "experiment_id string, engine string, estimate double, ci_low double, ci_high double, p_value double, verdict string, claim_rung int, n_rows long, n_complete_pairs long"


def outcome(p_cited: Column, cited: Column) -> Column:
    """The rate, else the flag as 0 or 1; null if neither, or not finite."""
    y = F.coalesce(p_cited, cited.cast("double"))
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def period_key(window: Column, period: Column, ts: Column) -> Column:
    """window:period, the period being the one given, else the ISO week of a timestamp, else 0."""
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return F.concat(window, F.lit(":"), F.coalesce(period, F.when(ts.isNotNull(), week), F.lit("0")))


def as_timestamp(ts: Column, kind: str) -> Column:
    """Epoch milliseconds or ISO text as a timestamp; unreadable text gives null."""
    return F.timestamp_millis(ts) if kind in ("bigint", "long", "int") else F.try_to_timestamp(ts.cast("string"))


def placed(experiments: DataFrame) -> DataFrame:
    """experiment_id, page, treatment, places (pair, side) of the experiments' pages."""
    e = experiments.select(F.col("id").alias("experiment_id"), F.posexplode("pairs").alias("pair", "p"))
    pages = e.select("experiment_id", "pair", F.explode(F.array(F.struct(F.col("p.treatment_page").alias("page"), F.lit(1).alias("treatment")), F.struct(F.col("p.control_page").alias("page"), F.lit(0).alias("treatment")))).alias("x"))
    return pages.groupBy("experiment_id", "x.page").agg(F.max("x.treatment").alias("treatment"), F.collect_set(F.struct("pair", F.col("x.treatment").alias("side"))).alias("places"))


def panel(experiments: DataFrame, measurements: DataFrame) -> DataFrame:
    """experiment_id, engine, page, places, treatment, post, period, y: rows of the experiments' pages in either window.

    Addresses match exactly. measurements: page_url, engine, window_tag, p_cited, cited, period, ts (timestamp).
    """
    one = placed(experiments)
    m = measurements.where(F.col("window_tag").isin("baseline", "post")).withColumn("y", outcome(F.col("p_cited"), F.col("cited"))).where("y is not null")
    j = m.join(one, m["page_url"] == one["page"])
    return j.select("experiment_id", "engine", "page", "places", "treatment", (F.col("window_tag") == "post").cast("int").alias("post"), period_key(F.col("window_tag"), F.col("period"), F.col("ts")).alias("period"), "y")


def simple_did(p: DataFrame, by: list[str]) -> DataFrame:
    """The four cell means and their difference in differences."""
    cell = lambda t, q: F.avg(F.when((F.col("treatment") == t) & (F.col("post") == q), F.col("y")))
    g = p.groupBy(*by).agg(*[cell(t, q).alias(f"y{t}{q}") for t in (0, 1) for q in (0, 1)])
    return g.withColumn("did", (F.col("y11") - F.col("y10")) - (F.col("y01") - F.col("y00")))


def complete_pairs(p: DataFrame) -> DataFrame:
    """Pairs of which both pages were measured in both windows."""
    places = p.select("experiment_id", "engine", F.explode("places").alias("x"), "post").select("experiment_id", "engine", "x.pair", "x.side", "post").distinct()
    full = places.groupBy("experiment_id", "engine", "pair").agg(F.count("*").alias("n")).where("n = 4")
    return full.groupBy("experiment_id", "engine").agg(F.count("*").alias("n_complete_pairs"))


def cells(p: DataFrame) -> DataFrame:
    """The panel by experiment, engine, page and period: rows ``n``, their sum ``s``. Treatment and window are the same
    throughout a cell, so the fit needs no more, and its size is that of the design, however often a page is measured."""
    by = ["experiment_id", "engine", "page", "treatment", "post", "period"]
    return p.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def clustered(n: np.ndarray, s: np.ndarray, page: np.ndarray, period: np.ndarray, interaction: np.ndarray) -> tuple[float, float]:
    """(estimate, standard error) of the interaction with page and period effects, errors clustered by page.

    From the cells' rows and sums: rows of a cell have the same regressors, so least squares and the scores of the
    pages are those of the single rows.
    """
    dummies = [np.ones(len(n))]
    for codes in (page, period):
        dummies += [(codes == c).astype(float) for c in range(1, codes.max() + 1)]
    x = np.column_stack([*dummies, interaction])
    inverse = np.linalg.pinv(x.T @ (n[:, None] * x))
    beta = inverse @ x.T @ s
    scores = np.zeros((page.max() + 1, x.shape[1]))
    np.add.at(scores, page, x * (s - n * (x @ beta))[:, None])
    rows, k, g = n.sum(), np.linalg.matrix_rank(x), len(scores)
    small = g / max(1, g - 1) * (rows - 1) / max(1, rows - k)
    v = small * inverse @ (scores.T @ scores) @ inverse
    return float(beta[-1]), float(np.sqrt(max(0.0, v[-1, -1])))


def estimated(experiments: DataFrame, measurements: DataFrame, alpha: float = ALPHA, min_pairs: int = MIN_PAIRS, min_lift: float = MIN_LIFT, max_width: float = MAX_WIDTH) -> DataFrame:
    """A lift result for each experiment and engine measured; a panel too thin to tell is 'inconclusive', never an error.

    Measurements are summed to cells first, so each experiment is fitted in one task as large as its pages and periods.
    """
    p = cells(panel(experiments, measurements)).join(placed(experiments).select("experiment_id", "page", "places"), ["experiment_id", "page"])
    joined = p.join(complete_pairs(p), ["experiment_id", "engine"], "left").withColumn("n_complete_pairs", F.coalesce("n_complete_pairs", F.lit(0)).cast("long")).drop("places")
    z = NormalDist().inv_cdf(1 - alpha / 2)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = int(pdf["n_complete_pairs"].iloc[0])

        def result(estimate=0.0, low=-1.0, high=1.0, p_value=None, verdict="inconclusive"):
            return pd.DataFrame([(pdf["experiment_id"].iloc[0], pdf["engine"].iloc[0], estimate, low, high, p_value, verdict, 2, int(pdf["n"].sum()), pairs)], columns=[c.split()[0] for c in RESULT.split(", ")])

        if pdf["post"].nunique() < 2 or pdf["treatment"].nunique() < 2:
            return result()
        pdf = pdf.sort_values(["page", "period"]).reset_index(drop=True)
        sums = pdf.groupby(["treatment", "post"])[["s", "n"]].sum()
        mean = sums["s"] / sums["n"]
        point = (mean.get((1, 1), np.nan) - mean.get((1, 0), np.nan)) - (mean.get((0, 1), np.nan) - mean.get((0, 0), np.nan))
        point = float(point) if np.isfinite(point) else 0.0
        if pairs < min_pairs:
            return result(point)
        try:
            b, se = clustered(pdf["n"].to_numpy(float), pdf["s"].to_numpy(float), pd.factorize(pdf["page"])[0], pd.factorize(pdf["period"])[0], (pdf["treatment"] * pdf["post"]).to_numpy(float))
        except np.linalg.LinAlgError:
            return result(point)
        low, high = b - z * se, b + z * se
        if not np.isfinite([b, low, high]).all():
            return result(point)
        p_value = 2 * (1 - NormalDist().cdf(abs(b) / se)) if se > 0 else (0.0 if b else 1.0)
        if high - low > max_width:
            return result(b, low, high, p_value)
        return result(b, low, high, p_value, "worked" if low > 0 else "no_effect" if high <= min_lift else "inconclusive")

    return joined.groupBy("experiment_id", "engine").applyInPandas(fit, RESULT)


def unmeasured(experiments: DataFrame, results: DataFrame) -> DataFrame:
    """Experiments without a row in any window: inconclusive by absence, so that none goes missing."""
    return experiments.select(F.col("id").alias("experiment_id")).join(results.select("experiment_id").distinct(), "experiment_id", "left_anti").withColumn("verdict", F.lit("inconclusive"))


def interventions(results: DataFrame, experiments: DataFrame, category: str, recorded_at: int) -> DataFrame:
    """A record of every measured lift, the inconclusive too, with the feature that was changed."""
    feature = experiments.select(F.col("id").alias("experiment_id"), F.get(F.col("pairs"), 0)["match_covars"]["target_feature"].alias("feature_changed"))
    return results.join(feature, "experiment_id", "left").select(
        F.concat(F.lit("int-"), "experiment_id", F.lit("-"), "engine").alias("id"), "feature_changed", F.lit(category).alias("category"), "engine",
        F.col("estimate").alias("measured_lift"), "ci_low", "ci_high", "experiment_id", F.lit(recorded_at).cast("long").alias("recorded_at"),
    )
