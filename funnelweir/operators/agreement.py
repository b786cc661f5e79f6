"""Agreement between raters and models on graded scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.operators.ordering import average_ranks, exact_quantiles, melt
from funnelweir.operators.ranks import tertile_labels
from funnelweir.operators.resampling import permuted_products
from funnelweir.session import cut
from funnelweir.operators.sampling import stratified_sample

LEVELS = 11
LARGE_ERROR = 2.5
# fixed values: texts that mark a usable reply
VALID_TEXTS = ["true", "1", "yes", "y", "valid"]


def wide_to_long(
    df: DataFrame, codes: Sequence[str], ids: Sequence[str] = ("dataset", "item_id", "model_id"), suffix="_0_10",
    out: str = "score",
) -> DataFrame:
    """One row per construct with the validity flag as a boolean."""
    valid = F.lower(F.col("schema_valid").cast("string")).isin(VALID_TEXTS) if "schema_valid" in df.columns else F.lit(True)
    named = df.select(
        *ids,
        F.coalesce(valid, F.lit(False)).alias("schema_valid"),
        *[F.col(f"{c}{suffix}").cast("string").try_cast("double").alias(c) for c in codes],
    )
    return melt(named, codes, [*ids, "schema_valid"], "construct_code", out)


def json_to_long(lines: DataFrame, codes: Sequence[str], text: str = "value", out: str = "score") -> DataFrame:
    """Same shape from line JSON with a nested score object."""
    schema = (
        "dataset string, item_id string, model_id string, schema_valid boolean, "
        "scores map<string,string>, mcre_scores map<string,string>"
    )
    parsed = lines.filter(F.trim(text) != "").select(F.from_json(text, schema).alias("_j")).select("_j.*")
    given = F.coalesce("scores", "mcre_scores", F.create_map().cast("map<string,string>"))
    wanted = F.array(*[F.lit(c) for c in codes])
    long = parsed.withColumn("_s", given).select(
        "dataset", "item_id", F.coalesce("model_id", F.lit("")).alias("model_id"),
        F.coalesce("schema_valid", F.lit(True)).alias("schema_valid"), "_s", F.explode(wanted).alias("construct_code"),
    )
    value = F.try_element_at("_s", F.col("construct_code")).try_cast("double")
    return long.withColumn(out, value).drop("_s")


def consensus(ratings: DataFrame, keys=("dataset", "item_id", "construct_code"), score: str = "score") -> DataFrame:
    """Median score per item and construct."""
    usable = ratings.filter(F.col(score).isNotNull())
    medians = exact_quantiles(usable, [score], [0.5], list(keys))
    return medians.select(*keys, F.col("p0").alias("median_score"))


def complete_cases(ratings: DataFrame, raters: Sequence[str], keys=("dataset", "construct_code", "item_id"), score="score"):
    """One column per rater, rows rated by all."""
    wide = ratings.groupBy(*keys).pivot("rater_id", list(raters)).agg(F.first(score))
    return wide.dropna(subset=list(raters))


def graded(c: Column, levels: int = LEVELS) -> Column:
    """Nearest level (half to even), clipped to the scale."""
    return F.least(F.lit(levels - 1.0), F.greatest(F.lit(0.0), F.rint(c)))


def weighted_kappa(left: Column, right: Column, levels: int = LEVELS) -> Column:
    """Quadratic weighted kappa as one aggregate expression.

    Squared weights factor: the expected disagreement needs only the marginal
    first and second moments, so no level-by-level table is built.
    """
    both = left.isNotNull() & right.isNotNull()
    a, b = F.when(both, graded(left, levels)), F.when(both, graded(right, levels))
    observed = F.avg((a - b) * (a - b))
    expected = F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)
    return F.when(expected > 0, 1 - F.try_divide(observed, expected))


def binary_kappa(left: Column, right: Column) -> Column:
    both = left.isNotNull() & right.isNotNull()
    a, b = F.when(both, left.cast("double")), F.when(both, right.cast("double"))
    observed = F.avg(F.when(both, (left == right).cast("double")))
    pa, pb = F.avg(a), F.avg(b)
    expected = pa * pb + (1 - pa) * (1 - pb)
    return F.when(expected < 1, F.try_divide(observed - expected, 1 - expected))


def spearman(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks: by, spearman (NULL below three pairs or two values)."""
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*by, left, right)
    # pairs collapse to distinct (left, right) cells, weighted by their count
    cells = pairs.groupBy(*by, left, right).agg(F.count("*").alias("_w"))
    ranked = cells
    for column, name in ((left, "_a"), (right, "_b")):
        ranks = average_ranks(pairs, column, by).select(*by, column, F.col("avg_rank").alias(name))
        ranked = ranked.join(ranks, [*by, column])
    w = F.col("_w").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(w).alias("n"),
        *[F.sum(w * e).alias(n) for n, e in (
            ("sa", F.col("_a")), ("sb", F.col("_b")), ("saa", F.col("_a") * F.col("_a")),
            ("sbb", F.col("_b") * F.col("_b")), ("sab", F.col("_a") * F.col("_b")),
        )],
    )
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    value = F.when((F.col("n") >= 3) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    return sums.select(*by, value.alias("spearman"))


def bundle(df: DataFrame, left: str, right: str, by: Sequence[str]) -> DataFrame:
    """All agreement figures of two score columns per group."""
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    labelled = tertile_labels(pairs, left, "_tl", by)
    labelled = tertile_labels(labelled, right, "_tr", by)
    a, b = F.col(left), F.col(right)
    gap = F.abs(a - b)
    same_tertile = F.coalesce((F.col("_tl") == F.col("_tr")).cast("double"), F.lit(0.0))
    table = labelled.groupBy(*by).agg(
        F.count("*").alias("n_compared"),
        F.when(
            (F.count("*") >= 3) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b)
        ).alias("pearson"),
        F.avg(gap).alias("mae"),
        weighted_kappa(a, b).alias("weighted_kappa"),
        F.avg(same_tertile).alias("tertile_agreement"),
        F.avg((gap >= LARGE_ERROR).cast("double")).alias("large_error_rate"),
        F.avg(((a > 0) == (b > 0)).cast("double")).alias("presence_agreement"),
        binary_kappa(a > 0, b > 0).alias("presence_kappa"),
        F.avg((a > 0).cast("double")).alias("left_nonzero_rate"),
        F.avg((b > 0).cast("double")).alias("right_nonzero_rate"),
    )
    return table.join(spearman(pairs, left, right, by), list(by), "left")


def icc2k(ratings: DataFrame, by: Sequence[str], item: str = "item_id", rater: str = "rater_id", score: str = "score"):
    """Two-way random-effects absolute-agreement reliability of the mean rating, on complete items.

    ``ratings`` is long with every item rated once by every rater.
    """
    # sums of squares from item means and rater means; the interaction is what remains
    overall = ratings.groupBy(*by).agg(
        F.avg(score).alias("_g"), F.sum(F.col(score) * F.col(score)).alias("_ss"), F.count("*").alias("_m")
    )
    per_item = ratings.groupBy(*by, item).agg(F.avg(score).alias("_x"))
    per_rater = ratings.groupBy(*by, rater).agg(F.avg(score).alias("_x"))
    square = F.sum(F.col("_x") * F.col("_x"))
    rows = per_item.groupBy(*by).agg(square.alias("_rs"), F.count("*").alias("_n"))
    cols = per_rater.groupBy(*by).agg(square.alias("_cs"), F.count("*").alias("_k"))
    t = overall.join(rows, list(by)).join(cols, list(by))
    n, k, g = F.col("_n"), F.col("_k"), F.col("_g")
    between_items = k * F.col("_rs") - n * k * g * g
    between_raters = n * F.col("_cs") - n * k * g * g
    residual = F.col("_ss") - n * k * g * g - between_items - between_raters
    at_least_one = lambda c: F.greatest(F.lit(1), c)
    msr = between_items / at_least_one(n - 1)
    msc = between_raters / at_least_one(k - 1)
    mse = residual / at_least_one((n - 1) * (k - 1))
    denominator = msr + (msc - mse) / at_least_one(n)
    return t.select(*by, n.alias("complete_items"), F.try_divide(msr - mse, denominator).alias("icc_2k"))


def pairwise_kappa(complete: DataFrame, raters: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean quadratic kappa over rater pairs."""
    kappas = [
        weighted_kappa(F.col(a), F.col(b)).alias(f"_k{i}_{j}")
        for i, a in enumerate(raters)
        for j, b in enumerate(raters)
        if i < j
    ]
    names = [f"_k{i}_{j}" for i in range(len(raters)) for j in range(i + 1, len(raters))]
    table = complete.groupBy(*by).agg(*kappas)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return table.select(*by, F.try_divide(total, known).alias("mean_pairwise_kappa"))


def spearman_permutation(
    df: DataFrame,
    left: str,
    right: str,
    by: Sequence[str],
    item: str,
    permutations: int = 999,
    seed: int = 20260728,
) -> DataFrame:
    """Rank correlation with a two-sided plus-one permutation p per group."""
    keys = list(by)
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, item, left, right)
    ranked = pairs
    for column, name in ((left, "_a"), (right, "_b")):
        centred = F.col("avg_rank") - (F.col("n") + 1) / 2.0
        ranked = ranked.join(average_ranks(pairs, column, keys).select(*keys, column, centred.alias(name)), [*keys, column])
    ranked = cut(ranked)
    draws = permuted_products(ranked, ["_a"], ["_b"], [item], permutations, seed, keys)
    actual = ranked.groupBy(*keys).agg(
        F.count("*").alias("items"),
        F.sum(F.col("_a") * F.col("_b")).alias("_ab"),
        F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b"))).alias("_scale"),
    )
    # exact ties with the observed value must count, so rounding noise is allowed for
    exceeds = F.abs("v") >= F.abs("_ab") - 1e-9 * F.col("_scale")
    hits = draws.join(actual, keys).groupBy(*keys).agg(F.count_if(exceeds).alias("_hits"))
    known = F.col("_scale") > 0
    return actual.join(hits, keys, "left").select(
        *keys,
        "items",
        F.when(known, F.try_divide(F.col("_ab"), F.col("_scale"))).alias("spearman_rho"),
        F.when(known, (1 + F.col("_hits")) / (permutations + 1)).alias("spearman_p"),
    )


def availability(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observed share and exact-zero shares per construct column."""
    long = melt(df, columns, name="construct_code")
    present = F.col("value").isNotNull()
    return long.groupBy("construct_code").agg(
        F.count("*").alias("source_rows"),
        F.count("value").alias("observed_items"),
        F.avg(present.cast("double")).alias("available_rate"),
        F.count_if(F.col("value") == 0).alias("zero_items"),
        F.avg(F.coalesce((F.col("value") == 0).cast("double"), F.lit(0.0))).alias("exact_zero_rate"),
        F.avg((F.col("value") == 0).cast("double")).alias("zero_share_of_observed"),
    )


def failure_cases(df: DataFrame, left: str, right: str, threshold: float = LARGE_ERROR) -> DataFrame:
    error = F.abs(F.col(left) - F.col(right))
    return df.withColumn("absolute_error", error).filter(F.col("absolute_error") >= threshold)


def dataset_range(summary: DataFrame, columns: Mapping[str, str], by: str = "dataset") -> DataFrame:
    """Minimum and maximum of each figure over constructs."""
    aggregates = [F.countDistinct("construct_code").alias("validated_treatments")]
    for c, name in columns.items():
        aggregates += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return summary.groupBy(by).agg(*aggregates)


def combine_raters(frames: Sequence[DataFrame], raters: Sequence[str]) -> DataFrame:
    """Union of one finished file per rater; raises on wrong, repeated or incomplete files."""
    if len(frames) != len(raters):
        raise ValueError(f"expected {len(raters)} rater files")
    found, merged = [], None
    for frame in frames:
        ids = [r[0] for r in frame.select("rater_id").distinct().limit(2).collect()]
        if len(ids) != 1 or ids[0] not in raters or ids[0] in found:
            raise ValueError(f"unexpected or repeated rater ids: {ids}")
        found.append(ids[0])
        merged = frame if merged is None else merged.unionByName(frame)
    missing = merged.filter(F.col("score").cast("string").try_cast("double").isNull()).count()
    if missing:
        raise ValueError(f"{missing} scores are missing")
    return merged


def annotation_template(
    df: DataFrame, columns: Sequence[str], raters: Mapping[str, str], n: int, seed, key: str = "item_id"
) -> tuple[DataFrame, DataFrame]:
    """Blank rating rows for a stratified sample, and the blinded key with the model's scores x 10.

    The sample has ``n`` items, constructs and raters a handful each.
    """
    sample = stratified_sample(df, key, columns, n, seed)
    keys = melt(sample, columns, [key], "construct_code", "raw").select(
        key, "construct_code", (F.col("raw") * 10).alias("model_score_0_10")
    )
    people = F.array(*[F.struct(F.lit(r).alias("rater_id"), F.lit(role).alias("rater_role")) for r, role in raters.items()])
    blank = keys.select(key, "construct_code", F.inline(people)).withColumns(
        {"score_0_10": F.lit(None).cast("double"), "confidence_1_5": F.lit(None).cast("int"), "comment": F.lit("")}
    )
    return blank, keys


def reference_coverage(context: DataFrame, reference: DataFrame, keys: Sequence[str], score: str, constructs: int):
    """Number of reference scores missing for the wanted (item, construct) rows (one row)."""
    joined = context.join(reference, list(keys), "left")
    counts = joined.agg(F.count("*").alias("_rows"), F.count_if(F.col(score).isNull()).alias("_null"))
    wanted = context.agg((F.count("*") * constructs).alias("expected_rows"))
    both = wanted.crossJoin(F.broadcast(counts))
    absent = F.greatest(F.lit(0), F.col("expected_rows") - F.col("_rows"))
    return both.select("expected_rows", (absent + F.col("_null")).alias("missing_scores"))
