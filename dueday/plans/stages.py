"""The stages end to end: raw tables in, model table, scores and reports out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assemble, clean, curves, entity, labels, metrics, models, prepare, splits, timeline
from ..operators.skew import HOT_ROWS, HotKeys, hot_keys
from ..schemas import ENTITY, SLICE_COLS, SNAPSHOT_KEYS
from ..session import materialize
from ..sources.tables import column_roles

TARGETS = ["missed_upcoming_emi", "future_dpd30"]


@dataclass
class Stages:
    """Every stage as a lazy DataFrame over the six raw tables.

    Only the count of hot borrowers runs ahead of the first read. On a cluster write the stage tables
    (``sources.sinks``) and pass them on, instead of recomputing the lineage.
    """

    raw: Mapping[str, DataFrame]
    window_days: int = timeline.WINDOW_DAYS
    hot_rows: int = HOT_ROWS

    @cached_property
    def application(self) -> DataFrame:
        return clean.clean_application(self.raw["application_train"])

    @cached_property
    def events(self) -> DataFrame:
        return clean.collapse_events(self.raw["installments_payments"])

    @cached_property
    def hot(self) -> HotKeys:
        # raw payments have at least as many rows per borrower as events
        return hot_keys(self.raw["installments_payments"], ENTITY, self.hot_rows)

    @cached_property
    def pos(self) -> DataFrame:
        return clean.pos_dpd_flags(self.raw["POS_CASH_balance"])

    @cached_property
    def previous(self) -> DataFrame:
        return clean.clean_previous(self.raw["previous_application"])

    @cached_property
    def balance(self) -> DataFrame:
        return clean.clean_bureau_balance(self.raw["bureau_balance"])

    @cached_property
    def snapshots(self) -> DataFrame:
        return timeline.build_snapshots(self.events, self.hot, window_days=self.window_days)

    @cached_property
    def missed(self) -> DataFrame:
        return labels.missed_upcoming_emi(self.snapshots)

    @cached_property
    def missed_rows(self) -> DataFrame:
        """Key, day and value of the first label, written once.

        The split map needs all days before any row gets its split; reading
        these narrow rows twice is cheaper than ordering all events twice.
        """
        rows = self.missed.select("snapshot_id", ENTITY, "snapshot_day", F.col("missed_upcoming_emi").alias("label"))
        return materialize(rows, "missed")

    @cached_property
    def dpd30(self) -> DataFrame:
        return labels.future_dpd30(self.snapshots, self.pos, self.window_days, hot=self.hot)

    @cached_property
    def history(self) -> DataFrame:
        return timeline.installment_history(self.events, self.hot)

    @cached_property
    def application_features(self) -> DataFrame:
        return entity.application_features(self.application)

    @cached_property
    def previous_features(self) -> DataFrame:
        return entity.previous_app_features(self.previous)

    @cached_property
    def bureau_features(self) -> DataFrame:
        return entity.bureau_features(self.raw["bureau"], self.balance, self.hot_rows)

    @cached_property
    def entity(self) -> DataFrame:
        return entity.entity_features(self.application_features, self.previous_features, self.bureau_features)

    @cached_property
    def model(self) -> DataFrame:
        return assemble.model_table(self.events, self.pos, self.entity, self.hot, self.window_days)

    @cached_property
    def split_map(self) -> DataFrame:
        """Days of the first label decide the split of both targets."""
        return splits.chronological_split(self.missed_rows)

    def rows(self, target: str) -> DataFrame:
        """Model rows of one target with their split."""
        return splits.join_split_map(assemble.target_rows(self.model, target), self.split_map)


@dataclass
class Trained:
    """Preprocessor, pooled models and scores of one target; rows are prepared and models fitted when they are first asked for."""

    preprocessor: prepare.Preprocessor
    rows: DataFrame
    rf_params: dict
    gb_params: dict

    KEEP = [*SNAPSHOT_KEYS[:2], "snapshot_day", "label", "split", *SLICE_COLS]

    @cached_property
    def prepared(self) -> DataFrame:
        """Written once: every model reads the rows several times. Numbers of many features share no dictionary."""
        plain = {"parquet.enable.dictionary": "false", "compression": "zstd"}
        return materialize(self.preprocessor.transform(self.rows, self.KEEP), "prepared", **plain)

    @cached_property
    def rf(self) -> RandomForestClassificationModel:
        return models.train_rf(self.split("train"), **self.rf_params)

    @cached_property
    def boosted(self) -> tuple[GBTClassificationModel, DataFrame]:
        return models.train_gb(self.split("train"), self.split("validation"), **self.gb_params)

    @property
    def gb(self) -> GBTClassificationModel:
        return self.boosted[0]

    @property
    def rounds(self) -> DataFrame:
        return self.boosted[1]

    def split(self, name: str) -> DataFrame:
        return self.prepared.where(F.col("split") == name)

    def scored(self, target: str) -> DataFrame:
        """Long scored table of the held-out rows for both models."""
        held_out = self.prepared.where(F.col("split") != "train")
        out = models.score_all({"rf": self.rf, "gb": self.gb}, held_out, self.KEEP)
        return out.withColumn("target", F.lit(target))


def train_target(rows: DataFrame, rf: dict | None = None, gb: dict | None = None, accuracy: int | None = None) -> Trained:
    """Fit the preprocessor on train rows now, and either model when it is first asked for.

    ``rows`` are read a few times: write them before, if they are dear to compute.
    """
    roles = column_roles(rows)
    train = rows.where(F.col("split") == "train")
    pre = prepare.fit_preprocessor(train, roles["numeric"], roles["categorical"], accuracy)
    return Trained(pre, rows, rf or {}, gb or {})


def tuned_thresholds(scored: DataFrame, tune_split: str = "validation") -> DataFrame:
    """The threshold of the best F1 per model, written."""
    tuned = curves.best_f1_threshold(scored.where(F.col("split") == tune_split), metrics.MODEL_KEYS)
    return materialize(tuned, "thresholds")


def diagnose(scored: DataFrame, tune_split: str = "validation") -> dict[str, DataFrame]:
    """All evaluation tables from one scored table with splits."""
    scored = materialize(scored, "scored")
    tuned = tuned_thresholds(scored, tune_split)
    test = metrics.scored_table(scored.where(F.col("split") == "test"), tuned)
    by_split, confusion, thresholds = models.evaluate_splits(scored)
    return {
        "metrics": by_split,
        "confusion": confusion,
        "thresholds": thresholds,
        "optimal_thresholds": tuned,
        "fp_fn": metrics.fp_fn_by_slice(test),
        "slices": metrics.slice_performance(test),
        "calibration": metrics.calibration_curve(test),
        "fairness": metrics.fairness_metrics(test),
        "harm": metrics.harm_analysis(test),
        "calibration_fairness": metrics.calibration_fairness(test),
    }
