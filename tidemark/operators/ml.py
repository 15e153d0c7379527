"""Scaling, encoding, splitting, training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_int
from tidemark.operators import clean, evaluation
from tidemark.plans.ordered import block_count, row_ranks


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column, as a savable table of one row per column."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in cols]
    )
    return df.agg(rows.alias("_r")).select(F.inline("_r"))


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std with a zero deviation treated as 1. The statistics enter as one scalar value."""
    if not cols:
        return df
    table = stats.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std"))))).scalar()
    out = {}
    for c in cols:
        s = F.element_at(table, F.lit(c))
        out[c] = (F.col(c) - s["mean"]) / F.when(s["std"] == 0, F.lit(1.0)).otherwise(s["std"])
    return df.withColumns(out)


def standard_scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise; statistics come from ``fit_on`` (for example the train part), by default the same rows."""
    return apply_scaler(df, fit_scaler(df if fit_on is None else fit_on, cols), cols) if cols else df


def fit_one_hot(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> dict[str, list]:
    """Sorted distinct values per column, each a column to be; with ``limit`` a column with more is refused."""
    found: dict[str, list] = {}
    for c in cols:
        distinct = df.select(c).where(F.col(c).isNotNull()).distinct()
        values = [r[0] for r in (distinct if limit is None else distinct.limit(limit + 1)).collect()]
        if limit is not None and len(values) > limit:
            raise ValueError(f"{c} has more than {limit} categories; use one_hot_vector")
        found[c] = sorted(values)
    return found


def apply_one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """Each column replaced by one 0.0/1.0 column per fitted value; an unseen value gives all zeros."""
    kept = [F.col(c) for c in df.columns if c not in categories]
    flags = [
        F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, values in categories.items() for v in values
    ]
    return df.select(*kept, *flags)


def one_hot(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return apply_one_hot(df, fit_one_hot(df if fit_on is None else fit_on, cols)) if cols else df


def one_hot_vector(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sparse vector form for columns with many categories."""
    stages = [
        StringIndexer(inputCols=list(cols), outputCols=[f"_i_{c}" for c in cols], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"_i_{c}" for c in cols], outputCols=[f"{c}_vector" for c in cols], handleInvalid="keep"),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop(*cols, *[f"_i_{c}" for c in cols])


def _share(key: Column, seed: int) -> Column:
    return hash_int(F.lit(seed), key)


def split_flag(key: Column, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for the test part, decided from the key alone, so any partitioning or retry agrees."""
    return _share(key, seed) % 10_000 < int(round(test_size * 10_000))


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Disjoint and exhaustive parts by hashed key. ``exact`` makes the test part ceil(n * test_size) rows
    by ranking the hash; its values are uniform, so equal ranges of them are balanced blocks."""
    if not exact:
        flag = split_flag(F.col(key), test_size, seed)
        return df.where(~flag), df.where(flag)
    blocks = block_count(df)
    h = df.withColumn("_h", _share(F.col(key), seed)).withColumn("_blk", F.floor(F.col("_h") * blocks / float(2**32)))
    ranked = row_ranks(h, ["_h", key], "_blk")
    flag = F.col("_rank") < F.ceil(F.col("_rows") * test_size)
    cols = df.columns
    return ranked.where(~flag).select(*cols), ranked.where(flag).select(*cols)


def fit_forest(train: DataFrame, features: Sequence[str], target: str = "target", trees: int = 100, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Random forest on the named features, in that order."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
        RandomForestClassifier(labelCol=target, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, df: DataFrame, model_name: str = "baseline-v1") -> DataFrame:
    """Rows with an integer prediction, class probabilities and the model name."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
        F.lit(model_name).alias("model_name"),
    )


def valid_requests(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Requests with every feature present, and the rejected ones."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f))
    return df.where(ok), df.where(~ok)


def assemble_request(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as one array in the fixed training order."""
    return df.withColumn("instances", F.array(*[F.col(f).cast("double") for f in features]))


def format_response(df: DataFrame) -> DataFrame:
    """``{"prediction": p, "label": "class-p"}`` per row."""
    label = F.concat(F.lit("class-"), F.col("prediction").cast("string"))
    return df.withColumn("response", F.to_json(F.struct("prediction", label.alias("label"))))


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Importance by feature name, largest first (one row per feature)."""
    names, weights = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """The fitted model; a clear error when nothing was trained yet."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        if "Input path does not exist" in str(error) or "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no model at {path}; train one first") from error
        raise


def hooked_score(model: PipelineModel, df: DataFrame, before=None, after=None, **more) -> DataFrame:
    """Scoring between a user pre-processing and a user post-processing step (table in, table out)."""
    ready = df.transform(before) if before else df
    out = score(model, ready, **more)
    return out.transform(after) if after else out


def baseline(df: DataFrame, target: str, key: str, trees: int = 100) -> DataFrame:
    """Quick look: drop nulls, numeric columns only, split, forest, report."""
    numeric = clean.select_numeric(clean.drop_null_rows(df))
    features = [c for c in numeric.columns if c not in (target, key)]
    train, test = train_test_split(numeric, key)
    scored = score(fit_forest(train, features, target, trees=trees), test)
    return evaluation.classification_report(scored, target, "prediction")
