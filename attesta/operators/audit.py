"""Audits that keep measured, hypothetical and causal claims apart, and the delivery tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.board import badge
from attesta.schemas import VERDICTS

#: Words that no hypothesis may use.
BANNED = ("because of", "causal", "cause", "causes", "drives", "guarantee", "increases", "will rank")
_OVERCLAIMS = (
    "\\byou'?ll win\\b", "\\badd\\b.+\\band you'?ll\\b", "\\bpro(ven|ves)\\b", "\\bguarantee",
    "\\bwill (get you|cite|rank|win)\\b", "\\bcauses?\\b",
)
_OUTREACH = "backlink|press|earned_media|pr_"


def _listed(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def banned_word(text: Column) -> Column:
    """The first banned word in a text, or null."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in BANNED]), lambda x: x.isNotNull()), 0)


def _causal_fields(df: DataFrame) -> list[Column]:
    out = []
    for f in ("estimate", "verdict"):
        if f in df.columns:
            out.append(F.when(F.col(f).isNotNull(), F.lit(f"causal_field:{f}")))
    if "claim_rung" in df.columns:
        out.append(F.when(F.col("claim_rung") >= 2, F.lit("causal_field:claim_rung")))
    return out


def audited_fits(fits: DataFrame) -> DataFrame:
    """Model fits with ``violations``: unflagged coefficients, banned words, causal fields."""
    unflagged = F.transform(F.filter("coefficients", lambda c: c["noise_flag"].isNull()), lambda c: F.concat(F.lit("no_noise_flag:"), c["feature"]))
    words = F.filter(F.transform("top_hypotheses", banned_word), lambda w: w.isNotNull())
    words = F.transform(words, lambda w: F.concat(F.lit("banned_word:"), w))
    empty = F.array().cast("array<string>")
    return fits.withColumn("violations", F.concat(F.coalesce(unflagged, empty), F.coalesce(words, empty), _listed(*_causal_fields(fits), F.lit(None).cast("string"))))


def audited_lifts(lifts: DataFrame) -> DataFrame:
    """Lift results with ``violations``: rung, verdict, order of the interval, and 'inconclusive' shown as 'worked'."""
    shown = F.col("claimed_verdict") if "claimed_verdict" in lifts.columns else F.lit(None).cast("string")
    return lifts.withColumn(
        "violations",
        _listed(
            F.when(F.coalesce(F.col("claim_rung"), F.lit(-1)) != 2, "rung"),
            F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict"),
            F.when(F.col("ci_low") > F.col("ci_high"), "ci_order"),
            F.when((F.col("verdict") == "inconclusive") & (shown == "worked"), "inconclusive_as_worked"),
        ),
    )


def unbacked_claims(fits: DataFrame, lifts: DataFrame, key: str) -> DataFrame:
    """Every fit with ``violations`` of the rule that only a worked, rung-2 lift result backs a causal claim.

    fits may carry claimed_verdict; lifts are tied to them by ``key``.
    """
    good = audited_lifts(lifts).where((F.size("violations") == 0) & (F.col("verdict") == "worked")).select(key).distinct().withColumn("_backed", F.lit(True))
    claimed = F.col("claimed_verdict") if "claimed_verdict" in fits.columns else F.lit(None).cast("string")
    j = fits.join(good, key, "left")
    return j.withColumn("violations", _listed(*_causal_fields(fits), F.when((claimed == "worked") & F.col("_backed").isNull(), "unbacked_claim"))).drop("_backed")


def strictly(df: DataFrame) -> DataFrame:
    """Fails on the first row with violations."""
    broken = F.raise_error(F.concat(F.lit("claim without experiment: "), F.array_join("violations", "; ")))
    return df.withColumn("violations", F.when(F.size("violations") > 0, broken.cast("array<string>")).otherwise(F.col("violations")))


def record_kind(df: DataFrame) -> Column:
    """What a record is by its shape, not by what it says of itself."""
    has = lambda f: F.col(f).isNotNull() if f in df.columns else F.lit(False)
    return (
        F.when(has("measured_lift") & has("experiment_id"), "intervention").when(has("estimate") & has("verdict"), "lift_result")
        .when(has("coefficients") | has("top_hypotheses"), "model_fit").otherwise("unknown")
    )


def audited_ladder(records: DataFrame) -> DataFrame:
    """Mixed records with ``kind`` and ``violations``: no shape, a rung above the kind's, causal fields on a fit."""
    d = records.withColumn("kind", record_kind(records))
    allowed = F.when(F.col("kind") == "model_fit", 1).otherwise(2)
    over = F.when((F.col("kind") != "unknown") & (F.col("claim_rung") > allowed), "rung_too_high")
    fit_only = [F.when(F.col("kind") == "model_fit", c) for c in _causal_fields(records)]
    return d.withColumn("violations", _listed(F.when(F.col("kind") == "unknown", "no_shape"), over, *fit_only))


def licensed_rung(has_fit: Column, has_lift: Column) -> Column:
    return F.when(has_lift, 2).when(has_fit, 1).otherwise(0)


def claim(requested: Column, has_fit: Column, has_lift: Column) -> Column:
    """(rung, badge), the rung no higher than licensed; a causal request without a lift result fails."""
    refused = (requested == 2) & ~F.coalesce(has_lift, F.lit(False))
    rung = F.when(refused, F.raise_error(F.lit("a causal claim needs a lift result")).cast("int")).otherwise(F.least(requested, licensed_rung(has_fit, has_lift)))
    return F.struct(rung.alias("rung"), badge(rung).alias("badge"))


def overclaims(text: Column) -> Column:
    """Whether a hypothesis's wording promises too much."""
    out = F.lit(False)
    for p in _OVERCLAIMS:
        out = out | text.rlike("(?i)" + p)
    return out


def crosses_zero(low: Column, high: Column) -> Column:
    return (low <= 0) & (high >= 0)


# --- delivery


def feature_in(text: Column) -> Column:
    """The first feature name in a text, or ''."""
    return F.regexp_extract(text, "(page__|company__)[a-z0-9_]+", 0)


def delivery_tier(feature: Column) -> Column:
    """Page features are edited, outreach features referred, other company features get a playbook; else it fails."""
    stem = F.regexp_replace(feature, "^company__", "")
    return (
        F.when(F.startswith(feature, F.lit("page__")), "tier1_page_edit")
        .when(F.startswith(feature, F.lit("company__")) & stem.rlike(_OUTREACH), "tier3_partner_referral")
        .when(F.startswith(feature, F.lit("company__")), "tier2_playbook")
        .otherwise(F.raise_error(F.concat(F.lit("unknown feature namespace: "), feature)).cast("string"))
    )


def deliveries(hypotheses: DataFrame, text: str) -> DataFrame:
    """Each hypothesis with its feature, tier and what is due: page edits wait for a writer; the rest is text from templates."""
    d = hypotheses.withColumn("feature", feature_in(F.col(text))).withColumn("tier", delivery_tier(F.col("feature")))
    gap = F.regexp_replace("feature", "^company__", "")
    steps = F.array(
        F.concat(F.lit("Look at where '"), gap, F.lit("' stands off the site.")),
        F.concat(F.lit("Plan own steps to improve '"), gap, F.lit("'.")),
        F.lit("Follow the signal through the next window."),
    )
    referral = F.array(F.concat(F.lit("Pass '"), gap, F.lit("' on to an earned-media partner.")))
    return d.withColumn("steps", F.when(F.col("tier") == "tier2_playbook", steps).when(F.col("tier") == "tier3_partner_referral", referral))


def page_assets(deliveries_: DataFrame, queries: list[str], write, publish) -> list[dict]:
    """Tier 1 at the edge: ``write(prompt)`` and ``publish(asset)`` are given; one call a distinct feature.

    The features are names from a model, a handful; they are gathered on the driver, where calls are made.
    """
    out = []
    for r in deliveries_.where(F.col("tier") == "tier1_page_edit").select("feature").distinct().orderBy("feature").toLocalIterator():
        asset = {"feature": r["feature"], "tier": "tier1_page_edit", "queries": list(queries), "content": write(f"A page section on {'; '.join(queries)} with more of {r['feature']}")}
        out.append(asset | {"publish": publish(asset)})
    return out
