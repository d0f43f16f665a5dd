"""Random forests on feature tables: preparation, metrics, scoring, importance."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.nulls import clean
from assayloom.operators.relational import hashed_unit, split_train


def informative(df: DataFrame, cols: list[str], ratio: float = 19.0, unique: float = 10.0) -> list[str]:
    """Columns without near-zero variance: those whose commonest value isn't too common, or that have enough values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
    sizes = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    # The two largest counts of each column: the largest, and the largest of the rest.
    tops = sizes.groupBy("c").agg(F.max(F.struct("n", F.coalesce("v", F.lit("")), F.col("v").isNull())).alias("_t"), F.count("v").alias("distinct"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"), F.max("n").alias("first"))
    second = sizes.join(tops.select("c", "first"), "c").groupBy("c").agg(F.max(F.when(F.col("n") < F.col("first"), F.col("n"))).alias("less"), F.sum((F.col("n") == F.col("first")).cast("int")).alias("ties"))
    good = []
    for r in tops.join(second, "c").collect():  # a row for each column
        next_ = r["first"] if r["ties"] > 1 else r["less"]
        if next_ is not None and not (r["first"] / next_ > ratio and 100.0 * r["distinct"] / max(1, r["rows"]) <= unique):
            good.append(r["c"])
    return [c for c in cols if c in good]


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """z scores over all rows, from one aggregation (a row)."""
    m = df.agg(*[F.avg(clean(c)).alias(f"_m{i}") for i, c in enumerate(cols)], *[F.stddev_samp(clean(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    z = {c: F.coalesce(F.try_divide(clean(c) - F.col(f"_m{i}"), F.col(f"_s{i}")), F.lit(0.0)) for i, c in enumerate(cols)}
    return df.crossJoin(F.broadcast(m)).withColumns(z).select(df.columns)


def downsample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has, about: by hash against each class's share."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    least, share = min(n.values(), default=0), F.lit(1.0)
    for value, count in n.items():
        share = F.when(F.col(label) == value, least / count).otherwise(share)
    return df.where(hashed_unit(F.col(key), seed) < share)


def classify(df: DataFrame, key: str, label: str, cols: list[str], trees: int = 50, seed: int = 1) -> tuple[DataFrame, dict[str, float], DataFrame]:
    """Scores of all rows (class, probabilities), metrics on a held-back quarter, its confusion table."""
    indexer: StringIndexerModel = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    rows = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(indexer.transform(standardise(df, cols)))
    rows = split_train(rows, key, 0.75, seed)
    model = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="_x", labelCol="_y", predictionCol="_p").fit(downsample(rows.where("set = 'train'"), label, key, seed))
    scored = model.transform(rows)
    test = scored.where("set = 'test'")
    metrics = {m: MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName=m).evaluate(test) for m in ("accuracy", "weightedRecall", "weightedPrecision", "f1")}
    if len(indexer.labels) == 2:
        metrics["roc_auc"] = BinaryClassificationEvaluator(labelCol="_y", rawPredictionCol="rawPrediction").evaluate(test)
    names = F.array(*[F.lit(x) for x in indexer.labels])
    predicted = F.element_at(names, F.col("_p").cast("int") + 1)
    confusion = test.groupBy(label, predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return scored.select(*df.columns, "set", predicted.alias("predicted"), vector_to_array("probability").alias("probability")), metrics, confusion


def dummies(df: DataFrame, cols: list[str], most: int = 100) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the levels of text columns (without the first level of each), and their names; raises beyond so many
    levels."""
    names = []
    for c in cols:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if len(levels) > most:
            raise ValueError(f"{c} has more than {most} levels")
        new = {f"{c}_{level}": F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)) for level in levels[1:]}
        df, names = df.withColumns(new) if new else df, [*names, *new]
    return df, names


def negative_log10(df: DataFrame, response: str) -> DataFrame:
    """The response as -log10; rows without a positive one go."""
    return df.where(F.col(response) > 0).withColumn(response, -F.log10(response))


def metric_table(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(metrics.items()), "metric string, value double")


def regress(df: DataFrame, key: str, response: str, cols: list[str], trees: int = 50, seed: int = 1) -> tuple[DataFrame, dict[str, float], DataFrame]:
    """Predictions, rmse, r2 and mae on a held-back quarter, and importances by shuffled columns there."""
    rows = split_train(VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(df), key, 0.75, seed)
    model = RandomForestRegressor(numTrees=trees, seed=seed, featuresCol="_x", labelCol=response, predictionCol="prediction").fit(rows.where("set = 'train'"))
    test = rows.where("set = 'test'").cache()
    score = lambda d, m: RegressionEvaluator(labelCol=response, predictionCol="prediction", metricName=m).evaluate(d)
    base = model.transform(test)
    metrics = {m: score(base, m) for m in ("rmse", "r2", "mae")}
    out = []
    for c in cols:  # neighbours by hash swap the column's values
        order = hashed_unit(F.concat(F.col(key).cast("string"), F.lit(c)), seed)
        k = test.select(key, c, F.row_number().over(_order(order, key)).alias("_k"))
        other = k.select((F.col("_k") % F.lit(max(1, test.count())) + 1).alias("_k"), F.col(c).alias("_v"))
        moved = test.drop(c, "_x").join(k.select(key, "_k"), key).join(other, "_k").withColumnRenamed("_v", c)
        moved = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(moved)
        out.append((c, score(model.transform(moved), "rmse") - metrics["rmse"]))
    importance = df.sparkSession.createDataFrame(out, "feature string, importance double")
    return model.transform(rows).select(*df.columns, "set", "prediction"), metrics, importance


def _order(order, key: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(order, key)
