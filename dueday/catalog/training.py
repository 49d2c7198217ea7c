"""Preparation, training and scoring queries on the model table.

Models are trained for both targets, on the whole train split and with the operators' full settings,
and scored on the whole held-out splits.
"""

from functools import lru_cache, reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain, metrics, models, prepare, reports
from ..operators.assemble import FEATURES, target_rows
from ..operators.skew import lookup
from ..operators.splits import chronological_split, join_split_map
from ..plans.stages import TARGETS, Trained, diagnose, train_target, tuned_thresholds
from ..schemas import ENTITY, SLICE_COLS
from ..session import materialize
from .base import SINGLE, Data, query

TARGET = TARGETS[0]

NUMERIC = [c for c in FEATURES if c not in SLICE_COLS]


@lru_cache(maxsize=4)
def _model(app_id: str, sf_dir: str, spark) -> tuple[DataFrame, DataFrame]:
    model = materialize(Data(spark, sf_dir).model, "model")
    return model, materialize(chronological_split(target_rows(model, TARGET)), "split-map")


def model_rows(d, target: str = TARGET) -> DataFrame:
    """The model rows of a target with their split. The model table holds both labels and is written once for all queries
    of a session that read it; days of its first label decide the split."""
    model, split_map = _model(d.spark.sparkContext.applicationId, d.sf_dir, d.spark)
    return join_split_map(target_rows(model, target), split_map)


def train_categories(d) -> DataFrame:
    """The category columns of the first target's train rows, without the features."""
    rows = join_split_map(d.missed_rows.select("snapshot_id", ENTITY, "snapshot_day"), d.split_map)
    slices = d.application_features.select(ENTITY, *SLICE_COLS)
    return lookup(rows.where("split = 'train'"), slices, ENTITY, ["snapshot_id"], d.hot).select(*SLICE_COLS)


# Model rows of the first target with their split.
ROWS_SQL = "(SELECT f.*, m.split FROM ov_base f JOIN ov_missed_split m ON f.snapshot_id = m.snapshot_id)"
TRAIN_SQL = f"(SELECT * FROM {ROWS_SQL} r WHERE split = 'train')"


@query(
    "impute_median",
    f"""SELECT names.column_name, median FROM (SELECT unnest({NUMERIC}) AS column_name) names LEFT JOIN (
        SELECT column_name, median(v) AS median FROM (
          UNPIVOT (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)} FROM {TRAIN_SQL} t) ON {", ".join(NUMERIC)} INTO NAME column_name VALUE v) u
        GROUP BY 1) m ON m.column_name = names.column_name""",
    median=SINGLE,
)
def impute_median(d):
    """Medians of all numeric features over the train rows."""
    return prepare.impute_median(model_rows(d).where("split = 'train'"), NUMERIC)


@query(
    "impute_mode",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS mode FROM (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM {TRAIN_SQL} WHERE {c} IS NOT NULL GROUP BY 1) x WHERE r = 1"
        for c in SLICE_COLS
    ),
)
def impute_mode(d):
    return prepare.impute_mode(train_categories(d), SLICE_COLS)


def codes_sql(c: str) -> str:
    return f"(SELECT {c} AS category, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INT) AS code FROM (SELECT DISTINCT {c} FROM t WHERE {c} IS NOT NULL) x)"


@query(
    "ordinal_encode",
    f"SELECT * FROM (WITH t AS MATERIALIZED (SELECT {', '.join(SLICE_COLS)} FROM {TRAIN_SQL} r) SELECT p.model, p.SK_ID_CURR, p.ord, "
    + ", ".join(f"coalesce(e{i}.code, -1) AS {c}_code" for i, c in enumerate(SLICE_COLS))
    + " FROM fx_pred p "
    + " ".join(f"LEFT JOIN {codes_sql(c)} e{i} ON p.{c} = e{i}.category" for i, c in enumerate(SLICE_COLS))
    + ") q",
)
def ordinal_encode(d):
    """Codes of all category columns learned on the train split, joined to every scored row."""
    codes = materialize(prepare.ordinal_codes(train_categories(d), SLICE_COLS), "codes")
    sizes = {r.column_name: r["count"] for r in codes.groupBy("column_name").count().collect()}
    names = {c: f"{c}_code" for c in SLICE_COLS}
    out = prepare.encode(d("fx_pred"), codes, names, sizes, ["model", "SK_ID_CURR", "ord"])
    return out.select("model", "SK_ID_CURR", "ord", *names.values())


@lru_cache(maxsize=4)
def _trained(app_id: str, sf_dir: str, spark, target: str) -> Trained:
    return train_target(model_rows(Data(spark, sf_dir), target))


def trained(d, target: str = TARGET) -> Trained:
    """Models of this session, folder and target, each trained once, when a query below first asks for it."""
    return _trained(d.spark.sparkContext.applicationId, d.sf_dir, d.spark, target)


def for_targets(d, run) -> DataFrame:
    """Results of both targets, one under the other."""
    tables = [run(trained(d, t)).withColumn("target", F.lit(t)) for t in TARGETS]
    return reduce(DataFrame.unionByName, tables)


def scored(d) -> DataFrame:
    """Scores of both models for both targets on the held-out rows."""
    return reduce(DataFrame.unionByName, [trained(d, t).scored(t) for t in TARGETS])


_FILLED = ", ".join(f"CAST(CAST(coalesce(CAST(r.{c} AS DOUBLE), med.{c}, 0) AS FLOAT) AS DOUBLE) AS x_{c}" for c in NUMERIC)
_CODED = ", ".join(f"CAST(coalesce(e{i}.code, -1) AS DOUBLE) AS x_{c}" for i, c in enumerate(SLICE_COLS))
_MODE = "(SELECT {c} AS m FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_JOINED = " ".join(
    f"LEFT JOIN {codes_sql(c)} e{i} ON coalesce(r.{c}, {_MODE.format(c=c)}) = e{i}.category" for i, c in enumerate(SLICE_COLS)
)


@query(
    "fit_preprocessor",
    f"""SELECT * FROM (WITH r AS MATERIALIZED (SELECT * FROM {ROWS_SQL} a), t AS MATERIALIZED (SELECT * FROM r WHERE split = 'train'),
        med AS MATERIALIZED (SELECT {", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in NUMERIC)} FROM t)
        SELECT r.snapshot_id, {_FILLED}, {_CODED} FROM r CROSS JOIN med {_JOINED}) q""",
    **{f"x_{c}": SINGLE for c in NUMERIC},
)
def fit_preprocessor(d):
    """Every model row with its features filled and coded by what the train rows taught."""
    return trained(d).preprocessor.filled(model_rows(d), ["snapshot_id"])


# --- rows-only: MLlib results have no SQL twin ------------------------------


@query("train_rf")
def train_rf(d):
    return for_targets(d, lambda t: models.tree_nodes(t.rf, d.spark))


@query("train_gb")
def train_gb(d):
    return for_targets(d, lambda t: t.rounds)


@query("score")
def score(d):
    return for_targets(d, lambda t: models.score(t.rf, t.split("test")).select("snapshot_id", "label", "y_prob"))


@query("scored_table")
def scored_table(d):
    """Held-out rows with the predictions at 0.5 and at each model's threshold of the validation split."""
    rows = materialize(scored(d), "scored")
    return metrics.scored_table(rows, tuned_thresholds(rows))


@query("evaluate_splits")
def evaluate_splits(d):
    by_split, confusion, thresholds = models.evaluate_splits(materialize(scored(d), "scored"))
    at_half = by_split.join(confusion, ["target", "model", "split"])
    return thresholds.join(at_half.drop("f1", "precision", "recall", "threshold"), ["target", "model", "split"])


@query("model_diagnosis")
def model_diagnosis(d):
    """Errors per slice of the trained models, at thresholds tuned on the validation split."""
    return diagnose(scored(d))["fp_fn"]


@query(
    "model_store",
    "SELECT snapshot_id, CAST(0 AS DOUBLE) AS difference FROM ov_missed_split WHERE split = 'validation'",
    difference=12,
)
def model_store(d):
    """Scores of the loaded model minus those of the saved one, per validation row."""
    t, path = trained(d), d.scratch("store")

    def must_not_run():
        raise AssertionError("the model was saved already")

    models.model_store(path, RandomForestClassificationModel, lambda: t.rf, settings=models.RF_PARAMS, version=d.sf_dir)
    again = models.model_store(path, RandomForestClassificationModel, must_not_run, settings=models.RF_PARAMS, version=d.sf_dir)
    both = models.score(again, models.score(t.rf, t.split("validation"), "saved"), "loaded")
    return both.select("snapshot_id", (F.col("loaded") - F.col("saved")).alias("difference"))


@query("fit_per_partition")
def fit_per_partition(d):
    """Pooled, averaged and per-part forests and boosted trees on the same test rows, for both targets."""
    found = []
    for target in TARGETS:
        t = trained(d, target)
        parted = materialize(models.stratified_partition(t.split("train")), "parts")
        forests, boosted = models.train_parts_rf(parted), models.train_parts_gb(parted)
        for name, pooled, local in (("rf", t.rf, forests), ("gb", t.gb, boosted)):
            scores = models.federated_scores(pooled, local, t.split("test"), ["snapshot_id", "label"])
            found.append(scores.withColumns({"target": F.lit(target), "model": F.lit(name), "threshold": F.lit(0.5)}))
    return models.federated_comparison(reduce(DataFrame.unionByName, found))


@query("tree_attribution")
def tree_attribution(d):
    return for_targets(d, lambda t: explain.tree_attribution(t.rf, t.split("test")))


def importance(d):
    """Mean absolute attributions over all test rows."""
    rows = []
    for target in TARGETS:
        t = trained(d, target)
        for name, model in (("rf", t.rf), ("gb", t.gb)):
            shares = explain.tree_attribution(model, t.split("test"), n_rows=None)
            mean = explain.mean_abs_attribution(shares, t.preprocessor.feature_names)
            rows.append(explain.attribution_ranking(mean, target, name))
    return reduce(DataFrame.unionByName, rows)


@query("mean_abs_attribution")
def mean_abs_attribution(d):
    return importance(d)


@query("top_features")
def top_features(d):
    return reports.top_features(importance(d))
