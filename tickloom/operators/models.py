"""Model training, batch scoring, prediction tables and the model registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scores
from tickloom.functions.math import logistic, two_class_softmax
from tickloom.operators.features import SERIES_KEYS
from tickloom.session import cut_lineage

# Order of the token model's inputs.
TOKEN_FEATURES = (
    "recency", "social_score", "velocity", "marketcap", "liquidityusd", "volumeusd", "holders", "tradecount",
    "age_seconds", "buys_5m", "sells_5m", "buys_vs_sells_ratio", "pumpfun_score", "dex_score", "bitquery_score",
)


def numeric_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All features as doubles; missing columns and NULLs are 0."""
    return df.withColumns({
        f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features})


# A fit runs a job per tree level. A task of fewer rows or values than these takes longer to start, and to hand on its histograms of
# all features, than to read its rows.
TASK_ROWS, TASK_VALUES = 1 << 14, 1 << 20


def dealt(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Training rows of `width` features, in as many partitions as their number asks for.

    `df` should be cut from its plan, as it is read to be counted. Where it has too few partitions, place and order follow from the keys.
    """
    per_task = max(TASK_ROWS, TASK_VALUES // max(1, width))
    tasks = max(1, -(-df.count() // per_task))
    have = df.rdd.getNumPartitions()
    if tasks > have:
        return cut_lineage(df.repartition(tasks, *keys).sortWithinPartitions(*keys))
    return df.coalesce(tasks) if tasks < have else df


def gbt(label: str, features_col: str = "features", depth: int = 6, step: float = 0.05, rounds: int = 300,
        seed: int = 0, checkpoint_rounds: int = 10) -> GBTRegressor:
    return GBTRegressor(featuresCol=features_col, labelCol=label, predictionCol="raw", maxDepth=depth, stepSize=step,
                        maxIter=rounds, lossType="squared", seed=seed, checkpointInterval=checkpoint_rounds)


def train_tokens(df: DataFrame, label: str, features: Sequence[str] = TOKEN_FEATURES, **kw) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    data = dealt(numeric_inputs(df, features).select(*features, label), [*features, label], len(features))
    return Pipeline(stages=[assembler, gbt(label, **kw)]).fit(data)


def score_tokens(df: DataFrame, model: PipelineModel, features: Sequence[str] = TOKEN_FEATURES) -> DataFrame:
    """alpha = logistic(raw score); a score that is not finite gives NaN."""
    scored = model.transform(numeric_inputs(df, features))
    raw = scores.finite_or("raw", float("nan"))
    return scored.withColumn("alpha", logistic(raw)).drop("features", "raw")


def train_horizons(flat: DataFrame, horizons: Sequence[str], **kw) -> dict[str, object]:
    """One boosted-tree model per horizon over the flat window vectors; the fits run side by side."""
    width = flat.agg(F.max(F.size("features"))).first()[0] or 0
    keys = [*SERIES_KEYS, "ts"]
    data = dealt(flat.select(*keys, "features", *[f"y_{h}" for h in horizons]), keys, width) \
        .withColumn("features", array_to_vector("features"))
    fit = inheritable_thread_target(flat.sparkSession)(lambda h: gbt(f"y_{h}", **kw).fit(data))
    with ThreadPoolExecutor(len(horizons)) as pool:
        return dict(zip(horizons, pool.map(fit, horizons), strict=True))


def score_horizons(flat: DataFrame, models: Mapping[str, object]) -> DataFrame:
    data = flat.withColumn("vector", array_to_vector("features"))
    for h, model in models.items():
        data = model.copy({model.featuresCol: "vector", model.predictionCol: f"mu_{h}"}).transform(data)
    return data.drop("vector")


def prediction_rows(outputs: DataFrame, keep: Sequence[str], horizons: Sequence[str]) -> DataFrame:
    """Wide model outputs (mu_h, log_sigma_h, logit_h) to one row per horizon."""
    items = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"mu_{h}").alias("mu"), F.col(f"log_sigma_{h}").alias("log_sigma"),
                 F.col(f"logit_{h}").alias("logit")) for h in horizons])
    return outputs.withColumn("_p", F.explode(items)).select(*keep, "_p.*")


def decode_predictions(rows: DataFrame, cut: float = 0.55) -> DataFrame:
    """sigma, probabilities, direction and confidence of long prediction rows."""
    p = logistic("logit")
    sigma = F.exp("log_sigma")
    return rows.withColumns({
        "sigma": sigma,
        "p_up": p,
        "p_down": F.lit(1.0) - p,
        "direction": scores.decode_direction(p, cut),
        "confidence": F.greatest(p, F.lit(1.0) - p),
        "prob_softmax": two_class_softmax("logit"),
        "prob_heuristic": scores.heuristic_probability(F.col("mu"), sigma),
    })


def fall_back(preferred: DataFrame, other: DataFrame, keys: Sequence[str], value: str = "prediction",
              names: tuple[str, str] = ("v2", "v1")) -> DataFrame:
    """Preferred prediction where there is one, else the other model's."""
    first = preferred.select(*keys, F.col(value).alias("_first"))
    return other.join(first, list(keys), "left").select(
        *keys,
        F.coalesce("_first", value).alias(value),
        F.when(F.col("_first").isNotNull(), names[0]).otherwise(names[1]).alias("model"))


def register_models(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry with appended entries (missing fields NULL)."""
    return registry.unionByName(entries, allowMissingColumns=True)


def newest_models(registry: DataFrame, limit: int = 50) -> DataFrame:
    return registry.orderBy(F.desc_nulls_last("created_at"), "name", "version_tag").limit(limit)
