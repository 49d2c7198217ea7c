"""Tree ensembles with MLlib: training, scoring, training on parts of the data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, shared_dir
from .curves import average_precision
from .metrics import classification_metrics, confusion_matrix, fixed_threshold_metrics
from .prepare import weight_column

# Forest and boosting settings.
RF_PARAMS: dict[str, Any] = {
    "numTrees": 300,
    "maxDepth": 15,
    "minInstancesPerNode": 100,
    "featureSubsetStrategy": "sqrt",
    "seed": 42,
}
GB_PARAMS: dict[str, Any] = {
    "maxIter": 1000,
    "stepSize": 0.05,
    "maxDepth": 6,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
GB_PATIENCE = 50
GB_PART_ROUNDS = 200
PARTS = 5
BUCKET_ROWS, MIN_BUCKETS = 1 << 20, 64  # of the hash buckets rows are numbered in

FITS_AT_ONCE = 5  # fits that run side by side

# Training detail: room for node statistics of a task, which the full forest fills, and node ids kept between levels.
_FIT = {"maxMemoryInMB": 256, "cacheNodeIds": True, "checkpointInterval": 10}


def side_by_side(spark: SparkSession, fits: Sequence[Callable[[], Any]]) -> list[Any]:
    """The fits' results, in order. A level of a small tree is a short job that leaves most cores idle."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(fit) for fit in fits]))


def _weighted(train: DataFrame, weight: Column) -> DataFrame:
    return train.select("features", F.col("label").cast("double").alias("label"), weight.alias("weight"))


def train_rf(train: DataFrame, **params: Any) -> RandomForestClassificationModel:
    """Balanced random forest on (label, features) rows.

    The fitted model is saved and loaded: a training summary holds the session, which cannot travel to tasks once it has observed anything.
    """
    path = scratch_path(train.sparkSession, "forest")
    forest = RandomForestClassifier(weightCol="weight", **_FIT, **{**RF_PARAMS, **params})
    forest.fit(_weighted(train, weight_column(train))).write().save(path)
    return RandomForestClassificationModel.load(path)


def fit_gb(train: DataFrame, weight: Column | None = None, **params: Any) -> GBTClassificationModel:
    """Boosted trees with positives weighted neg / pos, for a given number of rounds."""
    shared_dir(train.sparkSession)
    booster = GBTClassifier(weightCol="weight", **_FIT, **{**GB_PARAMS, **params})
    return booster.fit(_weighted(train, weight_column(train, balanced=False) if weight is None else weight))


def tree_nodes(model: Any, spark: SparkSession) -> DataFrame:
    """The model's trees as a table, one row per node.

    ``cover`` is the weighted number of training rows that reached the node,
    ``value`` the node's output: positive share in a forest, margin in boosting.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    boosted = isinstance(model, GBTClassificationModel)
    weights = [float(w) for w in model.treeWeights]
    share = 1.0 if boosted else 1.0 / len(weights)
    node = F.col("nodeData")
    stats = node["impurityStats"]
    cover = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value = node["prediction"] if boosted else stats[1] / F.nullif(cover, F.lit(0.0))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        cover.alias("cover"),
        value.alias("value"),
        (F.get(F.array(*[F.lit(w) for w in weights]), F.col("treeID")) * F.lit(share)).alias("tree_weight"),
    )


def leaf_values(model: Any, spark: SparkSession) -> DataFrame:
    """(tree, leaf, value): what each leaf adds to the model's output.

    ``leaf`` is the index MLlib gives in its leaf column: the place among the tree's leaves by node number.
    """
    leaves = tree_nodes(model, spark).where("left < 0")
    place = F.row_number().over(Window.partitionBy("tree").orderBy("node")) - 1
    return leaves.select("tree", place.alias("leaf"), (F.col("value") * F.col("tree_weight")).alias("value"))


def staged_leaves(model: Any, rows: DataFrame, keep: Sequence[str] = ("label",)) -> DataFrame:
    """``keep`` and ``leaves``: the leaf each row reaches in every tree, written once for all stages."""
    kept = [c for c in keep if c in rows.columns]
    found = model.copy({model.leafCol: "leaf_of"}).transform(rows.select(*kept, "features"))
    return materialize(found.select(*kept, vector_to_array("leaf_of").cast("array<smallint>").alias("leaves")), "leaves")


def staged_margins(leaves: DataFrame, values: DataFrame, first: int, last: int) -> DataFrame:
    """The columns of ``leaves``, ``rounds`` and ``margin``: each row's margin after ``first``, ..., ``last`` trees.

    The leaf values become one array of arrays, fetched by a scalar subquery; its size is set by the number and depth of the trees.
    """
    by_tree = values.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("leaf", "value")))["value"].alias("values"))
    table = by_tree.agg(F.sort_array(F.collect_list(F.struct("tree", "values")))["values"].alias("values"))
    keep = [c for c in leaves.columns if c != "leaves"]
    with_values = leaves.withColumn("values", table.scalar())

    def added(first: int, last: int) -> Column:
        trees = F.sequence(F.lit(first), F.lit(last))
        return F.transform(trees, lambda t: F.get(F.get("values", t - 1), F.get("leaves", t - 1).cast("int")))

    before = F.aggregate(added(1, first - 1), F.lit(0.0), lambda a, x: a + x) if first > 1 else F.lit(0.0)
    start = F.struct(before.alias("sum"), F.array().cast("array<double>").alias("all"))
    running = F.aggregate(
        added(first, last), start,
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"] + x).alias("all")),
        lambda a: a["all"],
    )
    out = with_values.select(*keep, F.posexplode(running).alias("at", "margin"))
    return out.select(*keep, (F.col("at") + first).alias("rounds"), "margin")


def prefix_model(model: GBTClassificationModel, rounds: int, spark: SparkSession) -> GBTClassificationModel:
    """The model's first ``rounds`` trees, as a model: saved, cut and loaded, not fitted again."""
    if rounds == model.getNumTrees:
        return model
    whole, cut = scratch_path(spark, "model"), scratch_path(spark, "model")
    model.write().save(whole)
    about = json.loads(spark.read.text(f"{whole}/metadata").first()[0])
    about["numTrees"] = rounds
    about["paramMap"]["maxIter"] = rounds
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{cut}/metadata")
    for part in ("data", "treesMetadata"):
        table = spark.read.parquet(f"{whole}/{part}")  # a tree's number is in the first column
        table.where(F.col(table.columns[0]) < rounds).write.parquet(f"{cut}/{part}")
    return GBTClassificationModel.load(cut)


def choose_rounds(history: Sequence[tuple[int, float]], patience: int = GB_PATIENCE) -> int:
    """Round with the best score, stopping once ``patience`` rounds brought no gain."""
    best_round, best = 0, float("-inf")
    for rounds, score in sorted(history):
        if score is not None and score > best:
            best_round, best = rounds, score
        elif rounds - best_round >= patience:
            break
    return best_round


def train_gb(
    train: DataFrame, validation: DataFrame, patience: int = GB_PATIENCE, **params: Any
) -> tuple[GBTClassificationModel, DataFrame]:
    """Boosting whose number of rounds maximises average precision on validation rows.

    Twice ``patience`` rounds are fitted first, and twice as many again, up to ``maxIter``, as long as the last ones may
    still bring a gain. Validation rows are sent down the trees of a fit once; then its rounds are judged, ``patience`` of
    them in one distributed job, until that many brought no gain. The winner is the fitted model's prefix, the same as
    if all rounds had been fitted. Returns the model and the (rounds, pr_auc) table of the rounds judged.
    """
    spark = train.sparkSession
    most = {**GB_PARAMS, **params}["maxIter"]
    weight = weight_column(train, balanced=False)
    total = min(most, 2 * patience)
    while True:
        full = fit_gb(train, weight, **{**params, "maxIter": total})
        leaves, values = staged_leaves(full, validation), materialize(leaf_values(full, spark), "leaf-values")
        judged, history, settled = [], [], total == most
        for first in range(1, total + 1, patience):
            margins = staged_margins(leaves, values, first, min(first + patience - 1, total))
            judged.append(materialize(average_precision(margins, ["rounds"], score="margin"), "rounds"))
            history += [(r.rounds, r.pr_auc) for r in judged[-1].collect()]  # a row per round
            best = choose_rounds(history, patience)
            if best and max(r for r, _ in history) - best >= patience:
                settled = True
                break
        if settled:
            return prefix_model(full, best or total, spark), reduce(DataFrame.union, judged)
        total = min(most, 2 * total)


def score(model: Any, prepared: DataFrame, name: str = "y_prob") -> DataFrame:
    """Probability of the positive class beside each row."""
    out = model.transform(prepared)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def score_all(models: dict[str, Any], prepared: DataFrame, keep: Sequence[str], name: str = "model") -> DataFrame:
    """Long scored table: one row per (row, model); rows are scanned once for all models."""
    wide = prepared
    for i, model in enumerate(models.values()):
        wide = score(model, wide, f"p{i}")
    pairs = [F.struct(F.lit(m).alias(name), F.col(f"p{i}").alias("y_prob")) for i, m in enumerate(models)]
    return wide.select(*keep, F.inline(F.array(*pairs)))


def store_path(path: str, settings: dict[str, Any], version: str) -> str:
    """Where a model with these settings, fitted on this version of the input, is kept under ``path``."""
    text = json.dumps({"settings": settings, "version": version}, sort_keys=True, default=str)
    return f"{path}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"


def model_store(
    path: str, loader: Any, fit: Callable[[], Any], retrain: bool = False, settings: dict[str, Any] | None = None, version: str = ""
) -> Any:
    """The model kept under ``path`` for these settings and input version, or a new one fitted and saved there."""
    spark = SparkSession.active()
    place = store_path(path, settings or {}, version)
    if not retrain:
        try:
            spark.read.text(f"{place}/metadata")
            return loader.load(place)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    model = fit()
    model.write().overwrite().save(place)
    return model


def evaluate_splits(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, confusion matrices and threshold tables per (target, model, split)."""
    by = ["target", "model", "split"]
    held_out = scored.where(F.col("split").isin("validation", "test"))
    return (
        classification_metrics(held_out, by),
        confusion_matrix(held_out, by),
        fixed_threshold_metrics(held_out, by),
    )


# --- training on parts -----------------------------------------------------


def stratified_partition(
    df: DataFrame, parts: int = PARTS, id_col: str = "snapshot_id", label: str = "label",
    seed: int = 42, buckets: int | None = None,
) -> DataFrame:
    """Add ``part``: a random split whose sizes differ by at most one per class.

    Rows are numbered within each class in hash order. The numbering is done
    per (class, hash bucket) and shifted by the sizes of the earlier buckets,
    so the large class is not numbered in one task. There is a bucket for every
    ``BUCKET_ROWS`` rows, counted first, unless ``buckets`` says how many.
    """
    if buckets is None:
        buckets = max(MIN_BUCKETS, -(-df.count() // BUCKET_ROWS))
    mix = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = df.withColumn("_mix", mix).withColumn("_bucket", F.pmod("_mix", F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(label, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(label, "_bucket").orderBy("_mix", id_col)
    # the window has laid the rows out by the keys of this join already
    numbered = rows.withColumn("_rn", F.row_number().over(inside) - 1).join(shift, [label, "_bucket"])
    return numbered.withColumn("part", F.pmod(F.col("_shift") + F.col("_rn"), F.lit(parts)).cast("int")).drop(
        "_mix", "_bucket", "_rn", "_shift"
    )


def fit_per_partition(train: DataFrame, fit: Callable[[DataFrame], Any], parts: int = PARTS) -> list[Any]:
    """One model per part. Each fit runs distributed jobs of its own, beside those of other parts."""
    return side_by_side(train.sparkSession, [lambda k=k: fit(train.where(F.col("part") == k)) for k in range(parts)])


def train_parts_rf(train: DataFrame, parts: int = PARTS, **params: Any) -> list[RandomForestClassificationModel]:
    """Forests with an equal share of the trees each."""
    trees = max(1, {**RF_PARAMS, **params}["numTrees"] // parts)
    return fit_per_partition(train, lambda df: train_rf(df, **{**params, "numTrees": trees}), parts)


def train_parts_gb(train: DataFrame, parts: int = PARTS, **params: Any) -> list[GBTClassificationModel]:
    """Boosted trees per part, all with the positive weight of the pooled rows."""
    weight = weight_column(train, balanced=False)
    settings = {"maxIter": GB_PART_ROUNDS, **params}
    return fit_per_partition(train, lambda df: fit_gb(df, weight, **settings), parts)


def ensemble_average(scored: DataFrame, keys: Sequence[str], score: str = "y_prob") -> DataFrame:
    """Mean score per row over models. For forests with equal tree counts this
    equals the score of the joined forest."""
    return scored.groupBy(*keys).agg(F.avg(score).alias(score))


def federated_scores(pooled: Any, local: Sequence[Any], prepared: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(federation, client, y_prob) rows for the pooled model, the average and each part.

    The average is taken across columns of the same row, so it needs no shuffle.
    """
    wide = score(pooled, prepared, "pooled")
    for k, model in enumerate(local):
        wide = score(model, wide, f"part{k}")
    names = [f"part{k}" for k in range(len(local))]
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.lit(float(len(names)))

    def row(kind: str, client: str, prob: Column) -> Column:
        return F.struct(F.lit(kind).alias("federation"), F.lit(client).alias("client"), prob.alias("y_prob"))

    rows = [row("centralized", "all", F.col("pooled")), row("federated", "all", mean)]
    rows += [row("local", f"client_{k + 1}", F.col(n)) for k, n in enumerate(names)]
    return wide.select(*keep, F.inline(F.array(*rows)))


def federated_comparison(scored: DataFrame) -> DataFrame:
    """Metrics of every variant on the same rows at the same threshold.

    ``threshold`` must already be a column, see ``threshold_lookup``.
    """
    by = ["target", "model", "federation", "client", "threshold"]
    return classification_metrics(scored, by, F.col("threshold")).withColumnRenamed("n_samples", "n")
