"""Queries, candidate pools and the company layer: dedupe, precedence, caps, coverage and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import keys, stats
from attesta.schemas import DETERMINISTIC, OFFPAGE_FIELDS, SUBJECTIVE

POOL_CAP, COVERAGE, REAL_RATIO, PACK_QUERIES = 10, 0.5, 0.4, 50
REAL_SOURCES = ("serp", "reddit", "customer")
AGREED = tuple(sorted(SUBJECTIVE))


def candidate_pool(results: DataFrame, most: int = POOL_CAP) -> DataFrame:
    """The best ``most`` pages of each query: (query_id, page_url, rank, place).

    results: query_id, url, rank (or null), _seq. Given ranks hold if all of a query's results have
    one, else the place in the list as given, bad entries included. A page keeps its best rank; ties
    go to the one seen first. Entries without a page are passed over.
    """
    q = Window.partitionBy("query_id")
    given = F.min(F.col("rank").isNotNull().cast("int")).over(q) == 1
    place = F.row_number().over(q.orderBy("_seq"))
    r = results.withColumn("_r", F.when(given, F.col("rank").cast("double")).otherwise(place.cast("double"))).withColumn("page_url", keys.normalize_url(F.col("url")))
    best = r.where("page_url <> ''").groupBy("query_id", "page_url").agg(F.min("_r").alias("rank"), F.min("_seq").alias("_seq"))
    line = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "_seq"))
    return best.withColumn("place", line).where(F.col("place") <= most).drop("_seq")


def generated_queries(seeds: DataFrame, min_real_ratio: float = REAL_RATIO) -> DataFrame:
    """Distinct queries with at least ``min_real_ratio`` real ones: the written ones are capped."""
    f = min_real_ratio
    t = keys.normalize_text(F.col("text"))
    s = seeds.withColumn("_t", t).where("_t <> ''").withColumn("_p", F.when(F.col("seed_source") == "llm_expand", 1).otherwise(0))
    one = s.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy("_p", "_seq"))).where("_n = 1").drop("_n")
    if f <= 0:
        kept = one
    elif f >= 1:
        kept = one.where("_p = 0")
    else:
        counts = one.agg(F.count_if(F.col("_p") == 0).alias("_real"))
        cap = F.floor(F.col("_real") * F.lit((1 - f) / f) + F.lit(1e-9))
        line = F.row_number().over(Window.partitionBy("_p").orderBy("_seq"))
        kept = one.withColumn("_l", line).crossJoin(F.broadcast(counts)).where((F.col("_p") == 0) | (F.col("_l") <= cap))
    return kept.select(keys.query_id(F.col("text")).alias("id"), "text", "seed_source", "_seq")


def company_layer(customer: DataFrame, competitors: DataFrame, found: DataFrame) -> DataFrame:
    """Companies by domain: the customer, then named competitors, then those found; a missing name is filled in.

    Each frame: domain, name, _seq. A name equal to the domain counts as missing.
    """
    parts = [df.select(keys.normalize_domain(F.col("domain")).alias("domain"), "name", "_seq", F.lit(i).alias("_p"), F.lit(role).alias("role")) for i, (df, role) in enumerate(((customer, "customer"), (competitors, "competitor"), (found, "battlefield")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("domain <> ''")
    named = (F.coalesce(F.trim("name"), F.lit("")) != "") & (F.lower("name") != F.col("domain"))
    order = F.struct("_p", "_seq")
    g = rows.groupBy("domain").agg(F.min_by("role", order).alias("role"), F.min_by("name", F.when(named, order)).alias("_n"), F.min(order).alias("_o"))
    return g.select("domain", F.coalesce("_n", "domain").alias("name"), "role", F.col("_o._p").alias("priority"), F.col("_o._seq").alias("_seq"))


def role_for(domain: Column, customer: str, competitors: list[str]) -> Column:
    d = keys.normalize_domain(domain)
    return F.when(d == customer, "customer").when(d.isin(*competitors) if competitors else F.lit(False), "competitor").otherwise("battlefield")


def battlefield(found: DataFrame, seed: str) -> DataFrame:
    """Similar companies by domain, first seen first, without the seed itself and malformed entries."""
    d = found.withColumn("domain", keys.normalize_domain(F.col("domain"))).where((F.col("domain") != "") & (F.col("domain") != keys.normalize_domain(F.lit(seed))))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("_seq"))).where("_n = 1").drop("_n")


def merged_offpage(companies: DataFrame, vendor: DataFrame, serp: DataFrame, reddit: DataFrame) -> DataFrame:
    """``offpage`` of each company from three partial sources, each owning its fields; only finite numbers."""
    owners = {
        "v": (vendor, ("thirdparty_mentions", "g2_presence", "review_site_presence", "backlink_density")),
        "s": (serp, ("wikipedia_presence", "brand_search_volume", "entity_cooccurrence")),
        "r": (reddit, ("reddit_presence",)),
    }
    out = companies
    for name, (df, fields) in owners.items():
        out = out.join(df.select("domain", *[stats.finite(F.col(f)).alias(f"_{name}_{f}") for f in fields]), "domain", "left")
    at = {f: f"_{name}_{f}" for name, (_, fields) in owners.items() for f in fields}
    return out.withColumn("offpage", F.struct(*[F.col(at[f]).alias(f) for f in OFFPAGE_FIELDS])).drop(*at.values())


def toggled(flags: Column, flag: str, missing: Column) -> Column:
    """The flag added where something is missing, removed where not."""
    f = F.coalesce(flags, F.array().cast("array<string>"))
    add = F.when(F.array_contains(f, flag), f).otherwise(F.array_append(f, F.lit(flag)))
    return F.when(missing, add).otherwise(F.array_remove(f, flag))


def stamped(versions: Column, source: str, version: str, populated: Column) -> Column:
    """A source's version noted only where it gave something."""
    v = F.coalesce(versions, F.create_map().cast("map<string,string>"))
    other = F.map_filter(v, lambda k, _: k != source)
    return F.when(populated, F.map_concat(other, F.create_map(F.lit(source), F.lit(version)))).otherwise(v)


# --- coverage


def _text(c: str) -> Column:
    return keys.trimmed(F.col(c)) != ""


def _number(c: str) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def company_families() -> dict[str, Column]:
    """Whether a company has anything of each family."""
    stack = F.exists(F.coalesce("firmographics.tech_stack", F.array().cast("array<string>")), lambda t: keys.trimmed(t) != "")
    return {
        "firmographics": _any([_text("firmographics.size"), _text("firmographics.funding_stage"), _number("firmographics.headcount_growth"), _number("firmographics.hiring_velocity"), stack]),
        "offpage": _any([_number(f"offpage.{f}") for f in OFFPAGE_FIELDS]),
        "understanding": _any([_text(f"understanding.{f}") for f in ("category", "icp", "positioning")]),
    }


def page_families() -> dict[str, Column]:
    """Whether a page has all of each family."""

    def whole(fields: tuple[str, ...]) -> Column:
        flags = {"schema_markup", "comparison_table", "direct_answer_first"}
        return _all([F.col(f"content_features.{f}").isNotNull() if f in flags else _number(f"content_features.{f}") for f in fields])

    return {"deterministic_features": whole(DETERMINISTIC), "subjective_features": whole(SUBJECTIVE)}


def coverage(df: DataFrame, key: str, kind: str, threshold: float = COVERAGE) -> DataFrame:
    """kind, key, missing families, coverage_score and low_coverage of every company or page; none is dropped."""
    families = company_families() if kind == "company" else page_families()
    missing = F.filter(F.array(*[F.when(~has, F.lit(name)) for name, has in families.items()]), lambda x: x.isNotNull())
    score = 1 - F.size("missing") / F.lit(float(len(families)))
    return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), missing.alias("missing")).withColumn("coverage_score", score).withColumn("low_coverage", score < threshold)


def reconciled_flags(companies: DataFrame) -> DataFrame:
    """Flags as the data has it, whatever was stored."""
    flags = F.array(*[F.when(~has, F.lit(f"{name}_missing")) for name, has in company_families().items()])
    return companies.withColumn("coverage_flags", F.filter(flags, lambda x: x.isNotNull()))


def coverage_sweep(companies: DataFrame, pages: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """Both assessments in one table, with the text of each gap."""
    both = coverage(companies, "domain", "company", threshold).unionByName(coverage(pages, "url", "page", threshold))
    return both.withColumn("gap", F.when(F.col("low_coverage"), F.concat("key", F.lit(": "), F.array_join("missing", ", "), F.lit(" missing"))))


def coverage_passed(report: DataFrame, companies: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: whether nothing was silently dropped."""
    n = companies.agg(F.count("*").alias("a")).crossJoin(pages.agg(F.count("*").alias("b")))
    return report.agg(F.count("*").alias("n"), F.count_if("low_coverage").alias("n_low")).crossJoin(n).select("n", "n_low", (F.col("n") == F.col("a") + F.col("b")).alias("passed"))


def seed_ratio(queries: DataFrame, by: list[str]) -> DataFrame:
    """Counts by source and the shares of real and of written queries; above half written is too high."""
    real = F.count_if(F.col("seed_source").isin(*REAL_SOURCES))
    llm = F.count_if(F.col("seed_source") == "llm_expand")
    g = queries.groupBy(*by).agg(F.count("*").alias("n"), real.alias("n_real"), llm.alias("n_llm"), *[F.count_if(F.col("seed_source") == s).alias(f"n_{s}") for s in REAL_SOURCES])
    return g.withColumn("real_ratio", stats.rate(F.col("n_real"), F.col("n"))).withColumn("llm_ratio", stats.rate(F.col("n_llm"), F.col("n"))).withColumn("llm_too_high", F.col("llm_ratio") > 0.5)


def offpage_coverage(companies: DataFrame) -> DataFrame:
    """Share of the eight off-page fields that each company has."""
    n = sum((F.coalesce(F.col(f"offpage.{f}").isNotNull(), F.lit(False)).cast("int") for f in OFFPAGE_FIELDS), F.lit(0))
    return companies.select("domain", n.alias("n_present"), (n / F.lit(float(len(OFFPAGE_FIELDS)))).alias("coverage"))


def feature_vector(companies: DataFrame) -> DataFrame:
    """(domain, feature, value): one row for each off-page field, nulls included."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"offpage.{f}").alias("value")) for f in OFFPAGE_FIELDS])
    return companies.select("domain", F.explode(pairs).alias("x")).select("domain", "x.feature", "x.value")


def vertical_pack(queries: DataFrame, targets: DataFrame, vertical: str, min_queries: int = PACK_QUERIES, min_real: float = REAL_RATIO) -> DataFrame:
    """One row: counts of a vertical's distinct queries and publishing targets, and the issues with them."""
    own = queries.where(F.col("vertical") == vertical).withColumn("_t", keys.normalize_text(F.col("text"))).where("_t <> ''")
    one = own.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy("_seq"))).where("_n = 1")
    q = one.agg(F.count("*").alias("n_queries"), F.count_if(F.col("seed_source") != "llm_expand").alias("n_real"))
    whole = queries.agg(F.count_if(F.col("vertical") != vertical).alias("n_foreign"))
    t = targets.where(F.col("vertical") == vertical).agg(F.count("*").alias("n_targets"))
    r = q.crossJoin(whole).crossJoin(t).withColumn("real_ratio", stats.rate(F.col("n_real"), F.col("n_queries")))
    rules = {
        "foreign_vertical": F.col("n_foreign") > 0, "too_few_queries": F.col("n_queries") < min_queries,
        "too_few_real": F.col("real_ratio") < min_real, "no_target": F.col("n_targets") < 1,
    }
    return r.withColumn("issues", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull()))


# --- agreement


def kappa(rated: DataFrame, by: list[str], predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Cohen's kappa by group: agreement beyond chance, within [-1, 1].

    Where chance alone agrees fully, kappa is 1 if all agree, else 0.
    """
    both = rated.where(F.col(predicted).isNotNull() & F.col(gold).isNotNull())
    cells = both.groupBy(*by, F.col(predicted).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p") == F.col("g"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*by, F.col("p").alias("v")).agg(F.sum("n").alias("a"))
    cols = cells.groupBy(*by, F.col("g").alias("v")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    j = total.join(chance, by, "left") if by else total.crossJoin(chance)
    po, pe = stats.rate(F.col("same"), F.col("n")), stats.rate(F.coalesce("ab", F.lit(0)), F.col("n") * F.col("n"))
    k = F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (po - pe) / (1 - pe))))
    return j.select(*by, "n", po.alias("agreement"), F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(k).alias("kappa"))


def within_tolerance(rated: DataFrame, by: list[str], tolerance: float = 1.0) -> DataFrame:
    ok = F.abs(F.col("predicted") - F.col("gold")) <= tolerance
    return rated.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("within"))


def agreement_report(items: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(feature, n, kappa, within) for the five judged features, with how many items were tried and skipped.

    items: item_id, predicted (struct or null), gold (struct), each with the five features.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"predicted.{f}").cast("double").alias("predicted"), F.col(f"gold.{f}").cast("double").alias("gold")) for f in AGREED])
    long = items.select("item_id", F.explode(pairs).alias("x")).select("item_id", "x.*").where("predicted is not null and gold is not null")
    tried = items.agg(F.count("*").alias("attempted"), F.count_if(F.col("predicted").isNull()).alias("skipped"))
    k = kappa(long, ["feature"]).select("feature", "n", "kappa")
    return k.join(within_tolerance(long, ["feature"], tolerance).drop("n"), "feature").crossJoin(F.broadcast(tried))


def enriched_pages(raw: DataFrame, extractor: str, now: Column) -> DataFrame:
    """Pages with features from their HTML: keyed, first seen of equal addresses, blank ones passed over."""
    from attesta.functions import html

    d = raw.withColumn("url", keys.normalize_url(F.col("url"))).where((F.col("url") != "") & (keys.trimmed(F.col("html")) != ""))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("_seq"))).where("_n = 1").drop("_n")
    return d.withColumns(
        {
            "role": F.coalesce("role", F.lit("candidate")),
            "company_domain": keys.normalize_domain(F.col("url")),
            "content_features": html.features(F.col("html"), now, F.col("terms")),
            "extractor_version": F.lit(extractor),
            "cache_key": keys.cache_key(F.col("url"), F.col("html"), F.col("terms"), F.lit(extractor)),
        }
    )


def firmographics(raw: dict[str, Column]) -> Column:
    """A struct from vendor fields: texts trimmed, numbers finite or null, the stack from a list or a comma text."""
    from attesta.sources.responses import tech_stack

    blank = lambda c: F.nullif(keys.trimmed(c), F.lit(""))
    none = F.lit(None)
    get = lambda name: raw.get(name, none.cast("string"))
    return F.struct(
        blank(get("size")).alias("size"), blank(get("funding_stage")).alias("funding_stage"), stats.finite(get("headcount_growth")).alias("headcount_growth"),
        stats.finite(get("hiring_velocity")).alias("hiring_velocity"), tech_stack(raw.get("tech_list", none.cast("array<string>")), get("tech_text")).alias("tech_stack"),
    )


def enriched_companies(companies: DataFrame, family: str, values: DataFrame, version: str) -> DataFrame:
    """Companies with a family's struct from ``values`` (domain, value), its flag kept in step, and its version
    noted where the family now holds anything; companies without a value keep what they had.
    """
    v = values.select("domain", F.col("value").alias("_v"))
    d = companies.join(v, "domain", "left").withColumn(family, F.coalesce("_v", family)).drop("_v")
    has = company_families()[family]
    return d.withColumns({"coverage_flags": toggled(F.col("coverage_flags"), f"{family}_missing", ~has), "source_versions": stamped(F.col("source_versions"), family, version, has)})


def extractor_stamp(base: str, asked: Column, parsed: Column) -> Column:
    """The extractor's version with '+subj' where judged features were read, '+subj-err' where that failed."""
    return F.concat(F.lit(base), F.when(~asked, "").when(parsed, "+subj").otherwise("+subj-err"))
