"""Models (M1-M9) and model persistence.

Fitted models are Spark ML estimators; their parameters are small by construction, while
every scoring and evaluation pass is a distributed transform.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.rules import safe_div
from kestrel.operators import prep as P


def majority_class(train: DataFrame, label: str) -> int:
    """M1 fit: the most frequent label (lowest label on ties)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label)))).first()[0]


def baseline_majority(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """M1: predict the train majority for every test row; accuracy and class-1 F1 (0/0 = 0)."""
    m = majority_class(train, label)
    pred = F.lit(int(m))
    y = (F.col(label) == 1).cast("long")
    p = (pred == 1).cast("long")
    c = test.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(label) == pred).cast("long")).alias("correct"),
        F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"),
    )
    return c.select(
        F.lit(int(m)).alias("majority_label"),
        F.round(safe_div(F.col("correct"), F.col("n")), 4).alias("accuracy"),
        F.round(safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 4).alias("f1_class1"),
    )


# ------------------------------------------------------------------ preparation + fitted models


class Prepared:
    """P4-P8 fitted on train, as stages of one Spark ML pipeline that takes raw rows.

    Medians, modes and scaling are literals of an SQL stage, categories are indexed and encoded, and all slots are
    assembled to ``features``; so the stages can be saved with a classifier behind them and score raw rows.
    """

    def __init__(self, train: DataFrame, numeric: list[str], categorical: list[str]):
        self.numeric, self.categorical = numeric, categorical
        cast = train.select("*", *[F.col(c).cast("double").alias(f"__{c}") for c in numeric])
        cast = cast.drop(*numeric).withColumnsRenamed({f"__{c}": c for c in numeric})
        self.medians = P.exact_medians(cast, numeric)
        self.modes = P._as_dict(P.modes(train, categorical), "column", "mode")
        self.scaling = P.scaling_stats(P.impute(cast, self.medians), numeric)
        onehot = P.one_hot_model(P.impute(train, self.modes), categorical)
        self.slot_names = list(numeric) + P.one_hot_names(onehot, categorical)
        text = lambda v: "'" + str(v).replace("'", "''") + "'"
        exprs = [f"(coalesce(cast({c} as double), {self.medians[c]!r}D) - {self.scaling[c][0]!r}D) / {float(self.scaling[c][1])!r}D AS {c}__z" for c in numeric]
        exprs += [f"coalesce({c}, {text(self.modes[c])}) AS {c}__c" for c in categorical]
        renamed = []
        for c, stage in zip(categorical, onehot.stages):
            renamed.append(stage.copy().setInputCol(f"{c}__c"))
        assembled = [f"{c}__z" for c in numeric] + [f"{c}__oh" for c in categorical]
        self.stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"), *renamed, onehot.stages[-1],
                       VectorAssembler(inputCols=assembled, outputCol="features")]

    def apply(self, df: DataFrame) -> DataFrame:
        return PipelineModel(stages=self.stages).transform(df)


def weighted(train: DataFrame, label: str) -> DataFrame:
    return P.with_class_weight(train, label, P.class_weights(train, label))


def fit_logistic(train_prepared: DataFrame, label: str, max_iter: int = 1000):
    """M2: class-weighted L2 logistic regression; C=1 on a weight sum of n is regParam 1/n."""
    n = train_prepared.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter,
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-8)
    return lr.fit(weighted(train_prepared, label))


def positive_score(df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of class 1 from an ML model's ``probability`` vector."""
    return df.withColumn(out, vector_to_array(F.col("probability"))[1])


def bounded_sample(train: DataFrame, label: str, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows, stratified by label (for callers that look at a few; no model is fitted on it)."""
    n = train.count()
    if n <= rows:
        return train
    return P.stratified_split(train, label, id_col, rows, names=("rest", "fit"), tag="fit").where("split = 'fit'").drop("split")


def forest_grid_search(train_prepared: DataFrame, label: str, id_col: str, fold_col: str = "fold", n_folds: int = 5,
                       n_trees=(100, 200), depths=(6, 10, 30), seed: int = 42):
    """M3 + M4: class-weighted random forest, grid x k folds by ROC-AUC, refit of the best point, all of it on all given rows.

    Returns (model, results of the grid, rows it was fitted on); see ``operators.forest``.
    """
    from kestrel.operators import forest

    return forest.grid_search(train_prepared, label, id_col, fold_col, n_folds, n_trees, depths, seed)


def importance_rows(spark, model, slot_names: list[str]) -> DataFrame:
    """Impurity importances, one row per slot, descending."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(slot_names, imp)), "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")


def _published(spark, path: str) -> list[dict]:
    """The manifest entries of the versions that were published at ``path``, oldest first (one small row for each)."""
    try:
        rows = spark.read.text(f"{path}/manifest").collect()
    except AnalysisException:
        return []
    return sorted((json.loads(r[0]) for r in rows), key=lambda m: m["number"])


def _checksum(spark, folder: str) -> str:
    """One checksum over the names and contents of an artefact's files, which tasks read (a model's files are few and bounded)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/versions/", -1)
    held = files.where(~F.substring_index("path", "/", -1).rlike("^[._]")).select(name.alias("name"), F.sha2("content", 256).alias("sum")).collect()
    return hashlib.sha256("\n".join(f"{n} {s}" for n, s in sorted(map(tuple, held))).encode()).hexdigest()


def _publish(spark, path: str, entry: dict) -> None:
    """The last step of a save: one manifest line names the version; before it, nobody reads the version."""
    spark.createDataFrame([(json.dumps(entry),)], "entry string").coalesce(1).write.mode("append").text(f"{path}/manifest")


def save_model(model, meta: dict, path: str) -> None:
    """The fitted model and its JSON metadata as a new version below ``path``, published by a manifest line that is written last.

    A save that stops on its way leaves a folder that no manifest names, and readers go on with the older version.
    """
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    number = max((m["number"] for m in _published(s, path)), default=0) + 1
    version = f"v{number:06d}-{uuid.uuid4().hex}"
    folder = f"{path}/versions/{version}"
    model.write().overwrite().save(f"{folder}/model")
    s.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{folder}/meta")
    _publish(s, path, {"number": number, "version": version, "checksum": _checksum(s, folder)})


def load_model(path: str, loader=PipelineModel):
    """The newest published version's model and metadata; a clear error when there is none or its files were changed."""
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    found = _published(s, path)
    if not found:
        raise FileNotFoundError(f"no saved model at {path}: train and save it first")
    folder = f"{path}/versions/{found[-1]['version']}"
    if _checksum(s, folder) != found[-1]["checksum"]:
        raise ValueError(f"the files of {found[-1]['version']} at {path} are not those that were published")
    return loader.load(f"{folder}/model"), json.loads(s.read.text(f"{folder}/meta").first()[0])


def permutation_importance(test: DataFrame, id_col: str, label: str, columns: list[str], scorer,
                           n_repeats: int = 20, seed: int = 42, buckets: int = 1) -> DataFrame:
    """Mean and population std over repeats of the ROC-AUC drop when one column is shuffled.

    Repeat r orders the rows by a seeded hash of (id, r), in ``buckets`` parts by the hash's size so that no part is
    sorted in one task, and shifts the order by one: each row's donor is the next row of its part (the first one for the
    last).  That one window brings the donor's columns to the row; no ranking and no join is needed.  All columns
    are then scored as columns of the same row (``scorer`` maps a dict of feature columns to a score), and
    ``roc_auc_of_scores`` takes the scores as they stand, without a row for each.
    """
    from kestrel.functions.hashing import hash32
    from kestrel.operators.evaluate import roc_auc, roc_auc_of_scores

    rows = test.select(id_col, F.col(label).alias("_y"), F.struct(*columns).alias("_own"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("r"))
    key = F.concat(F.col(id_col).cast("string"), F.lit("|"), F.col("r").cast("string"))
    rows = rows.withColumn("_h", hash32(key, "perm", seed)).withColumn("_part", F.pmod("_h", F.lit(buckets)))
    part = Window.partitionBy("r", "_part").orderBy("_h", id_col)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.coalesce(F.lead("_own").over(part), F.first("_own").over(whole))
    rows = rows.withColumn("_donor", donor)
    own = {c: F.col(f"_own.{c}") for c in columns}
    variants = [scorer({**own, c: F.col(f"_donor.{c}")}) for c in columns]
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("s") + 1)
    per = roc_auc_of_scores(rows, "_y", variants, "r", test.count()).select(name.alias("c"), F.col("g").alias("r"), "roc_auc")
    base = test.select(F.col(label).alias("label"), scorer({c: F.col(c) for c in columns}).alias("score"))
    ref = roc_auc(base, "label", "score").first()["roc_auc"]
    drops = per.select("c", "r", (F.lit(ref) - F.col("roc_auc")).alias("drop"))
    return drops.groupBy(F.col("c").alias("feature")).agg(
        F.avg("drop").alias("perm_importance_mean"), F.stddev_pop("drop").alias("perm_importance_std"))
