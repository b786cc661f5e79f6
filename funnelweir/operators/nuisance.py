"""Cross-split nuisance models and residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.functions import scalars as S
from funnelweir.functions.scalars import safe_double
from funnelweir.operators import boosting as BO
from funnelweir.operators.moments import ALL, CONST, Problem, linear, moments, solve
from funnelweir.operators.ordering import exact_quantiles, prefix_sums
from funnelweir.operators.ranking import multi_positive_metrics
from funnelweir.session import cut

RIDGE_PENALTY = 1e-12


def _features(df: DataFrame, x: Sequence[str]) -> DataFrame:
    filled = df.withColumns({f"_x_{c}": safe_double(c, 0.0) for c in x})
    return VectorAssembler(inputCols=[f"_x_{c}" for c in x], outputCol="_features").transform(filled)


def _constant(train: DataFrame, target: str):
    """The only observed value, or None when values differ; (False, None) when nothing is observed."""
    row = train.agg(F.min(target).alias("a"), F.max(target).alias("b")).first()
    return row["a"] is not None, row["a"] if row["a"] == row["b"] else None


def _logistic(train, test, target):
    learner = LogisticRegression(featuresCol="_features", labelCol=target, maxIter=50, regParam=1e-6)
    model = learner.fit(train.filter(F.col(target).isNotNull()).select("_features", target))
    scored = model.transform(test).withColumn("_hat", vector_to_array("probability")[1])
    return scored.drop("prediction", "rawPrediction", "probability")


def residualize(
    train: DataFrame,
    test: DataFrame,
    targets: Sequence[str],
    x: Sequence[str],
    kind: str = "treatment",
    learner: str = "ridge",
    settings: dict | None = None,
    seed: int = 20260717,
    clip: bool = True,
) -> DataFrame:
    """Fit each target on ``train``, predict on ``test``: ``test`` with raw/hat/res columns.

    ``kind`` is ``treatment`` (missing targets stay missing, prefix ``mhat_``)
    or ``outcome`` (missing reads 0, probabilities, prefix ``yhat_``).
    ``ridge`` solves all targets from one scan; ``boosted`` grows histogram trees for all
    targets at once (``settings`` are those of :class:`boosting.Settings`); ``logistic``
    trains a Spark ML model.
    """
    outcome = kind == "outcome"
    train, test = cleaned(train, targets, kind), cleaned(test, targets, kind)
    if learner == "boosted":
        models = BO.fit(train, [BO.Task(t, tuple(x), outcome) for t in targets], BO.Settings(**(settings or {})), seed + 100 * outcome)
        return boosted_residuals(test, targets, kind, dict(zip(targets, models, strict=True)), clip)
    train, test = _features(train, x), _features(test, x)
    design = [f"_x_{c}" for c in x]
    predicted: dict[str, Column] = {}
    if learner == "ridge":
        problems = [Problem(t, tuple(design), (t,)) for t in targets]
        found = moments(train, problems)
        for t in targets:
            cross = found[(ALL, t)]
            if cross.n == 0:
                predicted[t] = F.lit(None).cast("double")
            else:
                fit = solve(cross, [CONST, *design], t, RIDGE_PENALTY)
                predicted[t] = linear(fit.design, fit.beta)
    else:
        train = train.persist()
        for t in targets:
            observed, constant = _constant(train, t)
            if not observed or constant is not None:
                predicted[t] = F.lit(constant if observed else None).cast("double")
                continue
            if learner == "logistic" and outcome:
                test = _logistic(train, test, t)
            else:
                raise ValueError(f"{learner} for {kind}")
            test = test.withColumnRenamed("_hat", f"_hat_{t}")
            predicted[t] = F.col(f"_hat_{t}")
        train.unpersist()
    return with_residuals(test, targets, kind, predicted, clip).drop("_features", *design, *[f"_hat_{t}" for t in targets])


def cleaned(df: DataFrame, targets: Sequence[str], kind: str) -> DataFrame:
    """Targets as numbers; a missing outcome reads 0, a missing treatment stays missing."""
    return df.withColumns({t: safe_double(t, 0.0 if kind == "outcome" else None) for t in targets})


def with_residuals(test: DataFrame, targets: Sequence[str], kind: str, predicted: dict[str, Column], clip: bool = True) -> DataFrame:
    """raw, hat and res columns from the predictions."""
    hat = "yhat_" if kind == "outcome" else "mhat_"
    added = {}
    for t in targets:
        value = S.clip(predicted[t]) if clip else predicted[t]
        added[f"raw_{t}"] = F.col(t)
        added[f"{hat}{t}"] = F.when(F.col(t).isNotNull() & predicted[t].isNotNull(), value)
    out = test.withColumns(added)
    return out.withColumns({f"res_{t}": F.col(f"raw_{t}") - F.col(f"{hat}{t}") for t in targets})


def boosted_residuals(test: DataFrame, targets: Sequence[str], kind: str, models: dict[str, BO.Model | None], clip: bool = True) -> DataFrame:
    """Raw, hat and res columns of a cleaned test table from fitted models."""
    scored = BO.predict(test, {f"_hat_{t}": models[t] for t in targets})
    return with_residuals(scored, targets, kind, {t: F.col(f"_hat_{t}") for t in targets}, clip).drop(*[f"_hat_{t}" for t in targets])


def boosted_cross_fit(
    parts: dict[str, DataFrame],
    fits: Sequence[tuple[str, str, Sequence[str]]],
    x: Sequence[str],
    settings: dict | None = None,
    seed: int = 20260717,
) -> dict[tuple[str, str], BO.Model | None]:
    """Models {(part, target)} of every (part, kind, targets) in ``fits``, all grown in the same passes.

    The parts are stacked with a flag each, so a cross-split design costs the jobs of one model.
    """
    targets = {t: kind for _, kind, names in fits for t in names}
    columns = list(dict.fromkeys([*x, *targets]))
    stacked = None
    for name, df in parts.items():
        for kind in ("treatment", "outcome"):
            df = cleaned(df, [t for t, k in targets.items() if k == kind], kind)
        one = df.select(*columns, *[F.lit(other == name).alias(f"_in_{other}") for other in parts])
        stacked = one if stacked is None else stacked.unionByName(one)
    keys = [(name, t) for name, _, names in fits for t in names]
    tasks = [BO.Task(t, tuple(x), targets[t] == "outcome", f"_in_{name}") for name, t in keys]
    return dict(zip(keys, BO.fit(stacked, tasks, BO.Settings(**(settings or {})), seed), strict=True))


def fit_metrics(df: DataFrame, targets: Sequence[str], kind: str = "treatment") -> DataFrame:
    """target, n, rmse, r2 for treatments; target, n, brier, auc for outcomes."""
    outcome = kind == "outcome"
    hat = "yhat_" if outcome else "mhat_"
    pairs = [
        F.struct(F.lit(t).alias("target"), F.col(f"raw_{t}").alias("y"), F.col(f"{hat}{t}").alias("p")) for t in targets
    ]
    long = df.select(F.inline(F.array(*pairs))).filter("y IS NOT NULL AND p IS NOT NULL")
    error = F.col("y") - F.col("p")
    basic = long.groupBy("target").agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("y") * F.count("*"))).alias("r2"),
        F.avg(error * error).alias("brier"),
    )
    if not outcome:
        return basic.select("target", "n", "rmse", "r2")
    return basic.join(auc(long, "y", "p", ["target"]), "target", "left").select("target", "n", "brier", "auc")


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact rank-sum AUC with ties, from counts per distinct score: by, auc (NULL with one class)."""
    positive = (F.col(label) > 0).cast("long")
    cells = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg")
    )
    running = prefix_sums(cells, by, [score], {"_below": "_neg"})
    wins = F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2.0)
    totals = running.groupBy(*by).agg(
        F.sum(wins).alias("_w"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q")
    )
    return totals.select(*by, F.try_divide(F.col("_w"), F.col("_p") * F.col("_q")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision over distinct scores, highest first."""
    positive = (F.col(label) > 0).cast("long")
    cells = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, (-F.col(score)).alias("_s"))
        .agg(F.sum(positive).alias("_pos"), F.count("*").alias("_all"))
    )
    running = prefix_sums(cells, by, ["_s"], {"_pb": "_pos", "_ab": "_all"})
    precision = (F.col("_pb") + F.col("_pos")) / (F.col("_ab") + F.col("_all"))
    totals = running.groupBy(*by).agg(F.sum(F.col("_pos") * precision).alias("_w"), F.sum("_pos").alias("_p"))
    return totals.select(*by, F.try_divide(F.col("_w"), F.col("_p")).alias("average_precision"))


def classification_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """n, prevalence, brier, log_loss, auc, average_precision."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(score)))
    y = F.col(label)
    basic = df.filter(y.isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("prevalence"),
        F.avg((y - F.col(score)) * (y - F.col(score))).alias("brier"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
    )
    parts = [auc(df, label, score, by), average_precision(df, label, score, by)]
    for part in parts:
        basic = basic.join(part, list(by)) if by else basic.crossJoin(F.broadcast(part))
    return basic


def median_fill(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train-median fill plus a missing indicator where either split has gaps: (train, test, features)."""
    clean = lambda df: df.withColumns({c: safe_double(c) for c in columns})
    train, test = clean(train), clean(test)
    medians = {r["name"]: r["p0"] for r in exact_quantiles(train, columns, [0.5]).collect()}
    gap = [F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns]
    gaps = [df.agg(*gap).first() for df in (train, test)]
    flagged = [c for c in columns if any(g[c] for g in gaps)]

    def prepare(df):
        added = {f"{c}__missing": F.col(c).isNull().cast("int") for c in flagged}
        filled = {c: F.coalesce(F.col(c), F.lit(float(medians.get(c) or 0.0))) for c in columns}
        return df.withColumns(added).withColumns(filled)

    return prepare(train), prepare(test), [*columns, *[f"{c}__missing" for c in flagged]]


def feature_ablation(
    train: DataFrame,
    test: DataFrame,
    labels: Sequence[str],
    feature_sets: dict[str, Sequence[str]],
    settings: dict | None = None,
    seed: int = 20260717,
) -> DataFrame:
    """Classification metrics of boosted models for every feature set and label: feature_set, label, ...

    Features are binned once; a set is a choice of the store's columns, and the models of
    all sets and labels grow in the same passes.
    """
    labels = list(labels)
    train, test = cleaned(train, labels, "outcome"), cleaned(test, labels, "outcome")
    union = list(dict.fromkeys(c for columns in feature_sets.values() for c in columns))
    a, b, features = median_fill(train, test, union)
    sets = {name: [f for f in features if f.removesuffix("__missing") in columns] for name, columns in feature_sets.items()}
    cells = [(name, label) for name in sets for label in labels]
    models = BO.fit(a, [BO.Task(label, tuple(sets[name]), True) for name, label in cells], BO.Settings(**(settings or {})), seed)
    scored = cut(BO.predict(b, {f"_p{i}": m for i, m in enumerate(models)}))
    sizes = a.agg(F.count("*")).first()[0]
    out = None
    for i, (name, label) in enumerate(cells):
        report = classification_metrics(scored, label, f"_p{i}").withColumnRenamed("n", "n_test")
        ranked = multi_positive_metrics(scored.withColumn("_order", F.struct("timestamp", "item_id")), "user_id", label, f"_p{i}", "_order")
        one = report.crossJoin(F.broadcast(ranked)).select(
            F.lit(name).alias("feature_set"), F.lit(label.removeprefix("y_")).alias("stage"), F.lit(len(sets[name])).alias("features"), F.lit(sizes).alias("n_train"), "*"
        )
        out = one if out is None else out.unionByName(one)
    return out
