"""Window classifiers with Spark ML: folds, training, scoring, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

from strideframe.operators.sequence import index_rows
from strideframe.operators.trees import Boosted, Forest
from strideframe.session import written


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinite values become 0."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({f: F.when(bad(F.col(f).cast("double")), 0.0).otherwise(F.col(f).cast("double")) for f in features})


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weight n / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy(F.lit(1))
    weights = sizes.withColumn(out, F.sum("_n").over(total) / (F.count(F.lit(1)).over(total) * F.col("_n"))).drop("_n")
    return df.join(weights, label)


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int, out: str = "fold") -> DataFrame:
    """Fold 0..k-1 that splits each class evenly, in an order fixed by a hash of the keys."""
    hashed = df.withColumn("_h", F.xxhash64(*keys).cast("double") / F.lit(float(2**48)))
    return index_rows(hashed, [label], ["_h", *keys], width=1000.0).withColumn(out, F.pmod(F.col("pos") - 1, F.lit(k)).cast("int")).drop("_h", "pos")


def fold_count(df: DataFrame, label: str, most: int = 5) -> int:
    """min(most, size of the smallest class)."""
    return int(df.groupBy(label).count().agg(F.least(F.lit(most), F.min("count"))).first()[0])


def forest(trees: int = 200, depth: int = 12, seed: int = 42) -> Estimator:
    return Forest(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featuresCol="features", labelCol="label_idx", weightCol="weight", seed=seed)


def boosted(rounds: int = 200, depth: int = 8, seed: int = 42) -> Estimator:
    """One boosted tree ensemble per class."""
    return Boosted(rounds, depth, seed)


def training_pipeline(features: Sequence[str], label: str, estimator: Estimator, classes: Sequence[str]) -> Pipeline:
    index = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*classes, "?"])
    return Pipeline(stages=[index, VectorAssembler(inputCols=list(features), outputCol="features"), estimator, names])


def train(df: DataFrame, features: Sequence[str], label: str, estimator: Estimator | None = None) -> Model:
    """Fit on cleaned, class-weighted rows.  The class list is small and read to the driver."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    rows = balanced_weights(clean_features(df, features), label)
    return training_pipeline(features, label, estimator or forest(), classes).fit(rows)


def score(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predicted label and, where the model gives probabilities, the largest one."""
    out = model.transform(clean_features(df, features).withColumn("weight", F.lit(1.0)))
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.drop("features", "rawPrediction", "probability", "label_idx", "weight", "prediction")


def _parts(estimator: Estimator, rows: int, nodes: int) -> list[Estimator]:
    """A forest as smaller forests of at most about ``nodes`` tree nodes, which is what the driver holds at once; anything else as it is."""
    if not isinstance(estimator, RandomForestClassifier):
        return [estimator]
    trees, per_tree = estimator.getNumTrees(), max(1, min(2 ** (estimator.getMaxDepth() + 1), rows))
    size = max(1, min(trees, nodes // per_tree))
    return [estimator.copy({estimator.numTrees: min(size, trees - at), estimator.seed: estimator.getSeed() + at}) for at in range(0, trees, size)]


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], estimator: Estimator | None = None, k: int = 5, nodes: int = 1_000_000) -> DataFrame:
    """Every row scored by a model that was fitted without its fold.

    A forest too large for ``nodes`` is fitted in parts, whose trees vote together; only as many folds are fitted side by side
    as stay within ``nodes``, and each part's votes are written before the next part is fitted, so the driver holds no fitted model longer than that.
    """
    rows = written(stratified_folds(df, label, keys, k))
    n = rows.count()
    parts = _parts(estimator or forest(), n, nodes)
    largest = parts[0].getNumTrees() * min(2 ** (parts[0].getMaxDepth() + 1), max(1, n)) if isinstance(parts[0], RandomForestClassifier) else nodes

    def one(fold: int) -> DataFrame:
        known, asked = rows.filter(F.col("fold") != fold).drop("fold"), rows.filter(F.col("fold") == fold)
        if len(parts) == 1:
            return written(score(train(known, features, label, parts[0].copy()), asked, features))
        votes = clean_features(asked, features).withColumn("_votes", F.array().cast("array<double>"))
        for part in parts:
            model = train(known, features, label, part)
            out = model.transform(votes.withColumn("weight", F.lit(1.0)))
            voted = F.zip_with("_votes", vector_to_array("rawPrediction"), lambda x, y: F.coalesce(x, F.lit(0.0)) + y)
            votes = written(out.select(*[c for c in votes.columns if c != "_votes"], voted.alias("_votes")))
        names = F.array(*[F.lit(c) for c in model.stages[-1].getLabels()])
        top = F.array_max("_votes")
        share = top / F.aggregate("_votes", F.lit(0.0), lambda s, x: s + x)
        return votes.withColumns({"predicted": F.get(names, (F.array_position("_votes", top) - 1).cast("int")), "confidence": share}).drop("_votes")

    with ThreadPool(max(1, min(k, nodes // max(1, largest)))) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(one), range(k)))


class _Folds(CrossValidator):
    """Cross-validation for its figures only: no model is fitted to all rows at the end."""

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        fold, estimator, judge = F.col(self.getFoldCol()), self.getEstimator(), self.getEvaluator()

        def one(i: int) -> float:
            return judge.evaluate(estimator.copy().fit(dataset.filter(fold != i)).transform(dataset.filter(fold == i)))

        with ThreadPool(min(self.getParallelism(), self.getNumFolds())) as pool:
            found = pool.map(inheritable_thread_target(dataset.sparkSession)(one), range(self.getNumFolds()))
        return CrossValidatorModel(None, avgMetrics=[sum(found) / len(found)])


def cross_validate(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], estimator: Estimator | None = None, most: int = 5) -> float:
    """Mean accuracy over stratified folds; 0 when a class has a single row."""
    k = fold_count(df, label, most)
    if k < 2:
        return 0.0
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    # every tree level of every fold is a job of its own: all read one narrow table in as many parts as its size asks for
    rows = written(stratified_folds(balanced_weights(clean_features(df, features), label), label, keys, k).select(*features, label, "weight", "fold"))
    pipeline = training_pipeline(features, label, estimator or forest(), classes)
    judge = MulticlassClassificationEvaluator(labelCol="label_idx", metricName="accuracy")
    cv = _Folds(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=k, foldCol="fold", parallelism=k)
    return float(cv.fit(rows).avgMetrics[0])


def compare(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], estimators: dict[str, Estimator], most: int = 5) -> DataFrame:
    """One row per estimator with its cross-validated accuracy."""
    df = written(df.select(*features, label, *keys))
    found = [(name, cross_validate(df, features, label, keys, est, most)) for name, est in estimators.items()]
    return df.sparkSession.createDataFrame(found, "model string, accuracy double")
