"""Train-only imputation and encoding for tree models."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize
from .curves import running_totals
from .metrics import class_balance
from .skew import lookup

SKETCH = 64  # buckets of the medians' first scan for every doubling of a value
MOST_BUCKET = 1 << 40  # the bucket of NaN
MOST_BRACKET = 1_000_000  # distinct values of a column that one task ranks
SMALL_CODES = 100_000  # categories of a column whose code table is broadcast
FEW_CODES = 64  # categories of a column whose codes are part of the expression


def impute_median(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(column_name, median) per numeric column; NULL for a column without values.

    Exact by default, see :func:`exact_medians`. With ``accuracy`` one scan keeps a bounded sketch per column
    instead, with rank error at most rows / accuracy.
    """
    if accuracy is not None:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in columns])
        return row.unpivot([], list(columns), "column_name", "median")
    return exact_medians(df, columns)


def exact_medians(df: DataFrame, columns: Sequence[str], sketch: int = SKETCH) -> DataFrame:
    """Exact medians in two scans, by bracket.

    The first scan counts the values of each column by bucket, ``sketch`` buckets for every doubling of 1 + |value|; the running
    counts say in which bucket the middle lies, and at which place. The second counts each value of that bucket, or of the two around the middle.
    Both count before the shuffle. Buckets never fall as values rise, so the result is exact. NaN is a value above all others.
    Write ``df`` before, if it is dear to compute.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column_name string")
    if not columns:
        return names.withColumn("median", F.lit(None).cast("double"))
    numbered = df.select(*[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)])
    size = F.least(F.floor(F.log2(F.lit(1.0) + F.abs("value")) * sketch), F.lit(MOST_BUCKET - 1))
    bucket = F.when(F.isnan("value"), F.lit(MOST_BUCKET)).otherwise(F.when(F.col("value") < 0, -size).otherwise(size))
    long = numbered.unpivot([], list(numbered.columns), "k", "value").where("value IS NOT NULL")
    long = long.select(F.col("k").cast("int").alias("k"), "value").withColumn("bucket", bucket)

    sizes = long.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.sum("rows").over(Window.partitionBy("k"))
    upto = F.sum("rows").over(Window.partitionBy("k").orderBy("bucket"))  # buckets of one column: bounded by the exponents of a double
    placed = sizes.select("k", "bucket", "rows", rows.alias("n"), upto.alias("upto")).withColumns(
        {"low": F.floor((F.col("n") + 1) / 2), "high": F.floor(F.col("n") / 2) + 1}
    )
    reach = lambda pos: F.col("upto") >= F.col(pos)
    found = placed.groupBy("k").agg(
        F.min(F.when(reach("low"), F.col("bucket"))).alias("first"), F.min(F.when(reach("high"), F.col("bucket"))).alias("last"),
        F.min(F.when(reach("low"), F.col("upto") - F.col("rows"))).alias("under"), F.first("low").alias("low"), F.first("high").alias("high"),
    )
    found = {r.k: r for r in found.collect()}  # one row per column
    if not found:
        return names.withColumn("median", F.lit(None).cast("double"))
    of = lambda values: F.get(F.array(*[F.lit(values.get(i)).cast("long") for i, _ in enumerate(columns)]), F.col("k"))
    inside = F.col("bucket").between(of({k: r.first for k, r in found.items()}), of({k: r.last for k, r in found.items()}))
    counts = materialize(long.where(inside).groupBy("k", "value").agg(F.count(F.lit(1)).alias("copies")), "bracket")
    if (counts.groupBy("k").count().agg(F.max("count")).first()[0] or 0) > MOST_BRACKET:
        ranked = running_totals(counts, ["k"], [F.col("value")], {"copies": "upto"})
    else:
        ranked = counts.withColumn("upto", F.sum("copies").over(Window.partitionBy("k").orderBy("value")))
    holds = lambda pos: (F.col("upto") - F.col("copies") < pos) & (pos <= F.col("upto"))
    low, high = (of({k: r[end] - r.under for k, r in found.items()}) for end in ("low", "high"))
    middle = (F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / F.lit(2.0)
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("k"))
    medians = ranked.groupBy("k").agg(middle.alias("median")).select(name.alias("column_name"), "median")
    return names.join(F.broadcast(medians), "column_name", "left")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = df.select(*columns).unpivot([], list(columns), "column_name", "category")
    return (
        long.where(F.col("category").isNotNull())
        .groupBy("column_name", "category")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mode): the most frequent category, the lowest one on ties."""
    best = F.min(F.struct((-F.col("rows")).alias("neg"), F.col("category")))
    return (
        category_counts(df, columns)
        .groupBy("column_name")
        .agg(best.alias("best"))
        .select("column_name", F.col("best.category").alias("mode"))
    )


def ordinal_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, category, code): categories in string order from 0.

    Distinct categories are numbered over even ranges, so a column may have any number of them.
    """
    counts = category_counts(df, columns).withColumn("one", F.lit(1))
    ranked = running_totals(counts, ["column_name"], [F.col("category")], {"one": "upto"})
    return ranked.select("column_name", "category", (F.col("upto") - 1).cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, columns: dict[str, str], sizes: dict[str, int], spread_by: Sequence[str]) -> DataFrame:
    """Add a code column for each category column (``columns``: name of either); -1 for a value not seen in training.

    ``sizes`` has the measured size of each code table. At most FEW_CODES categories become a literal array; a table of at most
    SMALL_CODES rows is broadcast. A larger one is joined by shuffle, with the rows of hot or missing categories spread over tasks.
    """
    few = [c for c in columns if sizes.get(c, 0) <= FEW_CODES]
    listed = codes.where(F.col("column_name").isin(few)).orderBy("column_name", "code").collect() if few else []
    for c, name in columns.items():
        if c in few:
            known = F.array(*[F.lit(r.category) for r in listed if r.column_name == c]).cast("array<string>")
            df = df.withColumn(name, F.coalesce(F.array_position(known, F.col(c)).cast("int") - 1, F.lit(-1)))
            continue
        own = codes.where(F.col("column_name") == c).select(F.col("category").alias("_category"), F.col("code").alias("_code"))
        keyed = df.withColumn("_category", F.col(c))
        if sizes.get(c, 0) <= SMALL_CODES:
            joined = keyed.join(F.broadcast(own), "_category", "left")
        else:
            joined = lookup(keyed, own, "_category", spread_by)
        df = joined.withColumn(name, F.coalesce("_code", F.lit(-1))).drop("_category", "_code")
    return df


@dataclass
class Preprocessor:
    """What training data taught: a median per number, a mode per category column, and the table of codes."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None]
    modes: dict[str, str | None]
    sizes: dict[str, int]  # categories of each column
    codes: DataFrame  # column_name, category, code; written

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def filled(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns and ``x_<feature>`` as numbers: missing values filled, categories as codes."""
        filled = [
            # a column without any training value has no median; 0 keeps its place
            F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians.get(c) or 0.0))).alias(f"x_{c}")
            for c in self.numeric
        ]
        out = self._coded(df.select(*keep, *filled, *[F.col(c).alias(f"c_{c}") for c in self.categorical]), keep)
        return out.select(*keep, *[F.col(f"x_{c}").cast("double").alias(f"x_{c}") for c in self.feature_names])

    def _coded(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``x_<feature>``, the code, for each category column ``c_<feature>``; a missing category counts as the mode."""
        with_mode = df.withColumns({f"c_{c}": F.coalesce(F.col(f"c_{c}"), F.lit(self.modes.get(c))) for c in self.categorical})
        codes = self.codes.withColumn("column_name", F.concat(F.lit("c_"), "column_name"))
        sizes = {f"c_{c}": n for c, n in self.sizes.items()}
        return encode(with_mode, codes, {f"c_{c}": f"x_{c}" for c in self.categorical}, sizes, list(keep))

    def transform(self, df: DataFrame, keep: Sequence[str], output: str = "features") -> DataFrame:
        """``keep`` columns and the feature vector; codes are plain numbers to the trees. A NaN fails the job.

        Missing numbers are filled by one function over the array of all of them: an expression for each of many columns
        makes a method so long that the JVM does not compile it. The array is a column of its own, read twice, so it is built
        by compiled code; inside the function's arguments it would be interpreted, number by number.
        """
        taught = [float(self.medians.get(c) or 0.0) for c in self.numeric]
        raw = F.array(*[F.col(c).cast("double") for c in self.numeric]).cast("array<double>")
        medians = F.array(*[F.lit(m) for m in taught]).cast("array<double>")
        wrong = F.array_contains("_raw", F.lit(float("nan")))
        for i, m in enumerate(taught):
            if math.isnan(m):
                wrong = wrong | F.get("_raw", F.lit(i)).isNull()
        failed = F.raise_error(F.lit("a feature is NaN")).cast("array<double>")
        filled = F.when(wrong, failed).otherwise(F.zip_with("_raw", medians, lambda v, m: F.coalesce(v, m)))
        apart = df.select(*keep, *[F.col(c).alias(f"c_{c}") for c in self.categorical], raw.alias("_raw"))
        out = self._coded(apart.select(*keep, *[f"c_{c}" for c in self.categorical], filled.alias("_filled")), keep)
        codes = F.array(*[F.col(f"x_{c}").cast("double") for c in self.categorical]).cast("array<double>")
        return out.select(*keep, array_to_vector(F.concat("_filled", codes)).alias(output))

    def save(self, path: str) -> None:
        settings = {k: getattr(self, k) for k in ("numeric", "categorical", "medians", "modes", "sizes")}
        text = self.codes.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        settings = json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
        return cls(**settings, codes=spark.read.parquet(f"{path}/codes"))


def fit_preprocessor(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], accuracy: int | None = None
) -> Preprocessor:
    """Medians, modes and codes from the training rows only.

    One row per column comes back to the driver; the codes stay a table. The rows are read
    several times: write them before, if they are dear to compute.
    """
    medians = {r.column_name: r.median for r in impute_median(train, numeric, accuracy).collect()}
    codes = materialize(ordinal_codes(train, categorical), "codes")
    sizes = {r.column_name: r.n for r in codes.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    modes = {r.column_name: r.mode for r in impute_mode(train, categorical).collect()}
    return Preprocessor(list(numeric), list(categorical), medians, modes, sizes, codes)


def weight_column(train: DataFrame, balanced: bool = True, label: str = "label") -> Column:
    """Row weight: n / (2 n_class), or neg / pos on the positives only."""
    row = class_balance(train, label=label).first()
    if not row.positives or not row.negatives:
        raise ValueError("training needs rows of both classes")
    total = row.positives + row.negatives
    if balanced:
        w0, w1 = total / (2.0 * row.negatives), total / (2.0 * row.positives)
    else:
        w0, w1 = 1.0, row.negatives / row.positives
    return F.when(F.col(label) == 1, F.lit(w1)).otherwise(F.lit(w0))


def sample_rows(df: DataFrame, n: int, id_col: str = "snapshot_id", seed: int = 42, label: str = "label") -> DataFrame:
    """The ``n`` rows with the smallest MD5 of id and seed, the same on any cluster layout and in any engine.

    Rows are counted by the first four digits of the digest (65,536 counts), which gives the digits up to which all rows
    belong to the sample. Only the rows of the one prefix in which the sample ends are ordered.
    """
    mixed = df.where(F.col(label).isNotNull()).withColumn("_mix", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))))
    prefix = F.substring("_mix", 1, 4)
    counts = sorted(mixed.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("rows")).collect())
    left = n
    for edge, rows in counts:
        if left <= rows:
            break
        left -= rows
    else:
        return mixed.drop("_mix")  # fewer rows than asked for
    last = mixed.where(prefix == edge).orderBy("_mix", id_col).limit(left)
    return mixed.where(prefix < edge).union(last).drop("_mix")


def strip_feature_prefix(df: DataFrame, col: str = "feature") -> DataFrame:
    return df.withColumn(col, S.strip_prefix(col))
