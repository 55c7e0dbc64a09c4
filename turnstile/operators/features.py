"""Feature engineering.

Everything is a DataFrame plan; the only values that reach the driver are
single-row statistics (quantile fences, means, deviations), each from one
aggregate job, and they return to the plans as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions import calendar, numeric
from turnstile.functions.text import slug
from turnstile.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES, SCALED_FEATURES, WEATHER_MEASURES
from turnstile.operators.stats import exact_quantiles
from turnstile.session import materialize

LAG_ORDER = ["ts", "fare_class_category", "payment_method", "ride_id"]
IQR_WIDTH = 1.5
# Categories that may become columns of one plan.
MAX_DENSE_COLUMNS = 5_000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# --- calendar (I1, I2, C2) -------------------------------------------------------------

def holidays_for(rides_ts: DataFrame) -> DataFrame:
    """Holiday table covering the data's years (padded by one on each side)."""
    return calendar.holiday_table(calendar.years_spanned(rides_ts))


# Calendar span of the generated holiday dimension; dates outside it use the
# per-row rule (``calendar.is_us_holiday``).
HOLIDAY_YEARS = (1900, 2100)


_HOLIDAY_DIMS: dict[str, DataFrame] = {}


def holiday_dimension(spark) -> DataFrame:
    """Holiday dates for ``HOLIDAY_YEARS``: ~16 rows per year, about 3,200 rows in all.

    Static, so it is generated and written once per application, then reused.
    The year after the span is generated too: its New Year may be observed
    on the span's last day.
    """
    key = spark.sparkContext.applicationId
    if key not in _HOLIDAY_DIMS:
        lo, hi = HOLIDAY_YEARS
        years = spark.range(lo, hi + 2).select(F.col("id").cast("int").alias("year"))
        _HOLIDAY_DIMS[key] = materialize(calendar.holiday_table(years).select("date").distinct(), "holidays")
    return _HOLIDAY_DIMS[key]


def calendar_features(rides_ts: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """hour, day_of_week (Mon=0), month, is_weekend, is_holiday.

    Holiday membership is a broadcast hash join to the generated holiday
    dimension (bounded by construction: a fixed calendar span, not the data),
    so it costs one hash probe per row and no pass over the data to find its
    years.  Dates outside the span fall back to the same rule evaluated per
    row.  A custom ``holidays`` table (``date`` column) replaces the dimension.
    """
    lo, hi = HOLIDAY_YEARS
    dim = holiday_dimension(rides_ts.sparkSession) if holidays is None else holidays
    hol = dim.select(F.col("date").alias("_hdate")).distinct().withColumn("_is_hol", F.lit(1))
    df = rides_ts.withColumns({
        "hour": F.hour("ts"), "day_of_week": calendar.day_of_week("ts"), "month": F.month("ts"),
        "is_weekend": calendar.is_weekend("ts"), "_date": F.to_date("ts")})
    df = df.join(F.broadcast(hol), F.col("_date") == F.col("_hdate"), "left")
    in_span = F.year("_date").between(lo, hi) | F.col("_date").isNull() | F.lit(holidays is not None)
    flag = F.when(in_span, F.coalesce(F.col("_is_hol"), F.lit(0))).otherwise(
        F.coalesce(calendar.is_us_holiday("_date"), F.lit(0)))
    return df.withColumn("is_holiday", flag).drop("_date", "_hdate", "_is_hol")


# --- lags (E1, E2) -----------------------------------------------------------------------

def lag_features(df: DataFrame, value: str = "ridership", lags: Sequence[int] = (1, 24),
                 partition: str = "station_complex", order: Sequence[str] = tuple(LAG_ORDER),
                 prefix: str = "ridership_lag") -> DataFrame:
    """``lag(value, k)`` over the rows of each station in a total order, k rows back.

    Equal to ``lag(value, k) OVER (PARTITION BY station ORDER BY order)``, but
    no task is keyed by a station, which may hold a third of all rows:

    1. the rows are laid out by range of (station, order) and written with
       their range and their place in the whole order; a range is a bounded
       share of all rows, whatever their stations;
    2. inside a range, a row's lag is the value k rows before if that row is
       of the same station;
    3. each station's last K = max(lags) rows of a range are carried over to
       its first K rows of later ranges: these two kinds of rows alone go
       through one more window, at most 2K per station and range.

    The written layout fixes ranges and places, so both kinds of rows agree
    on them and a lost executor only reads it again.
    """
    K = max(lags)
    p = F.col(partition)
    # Null-safe string key: null stations form their own group, as in a window.
    key = F.when(p.isNull(), F.lit("\u0000")).otherwise(F.concat(F.lit("\u0001"), p.cast("string")))
    laid = df.withColumn("_pk", key).repartitionByRange("_pk", *order).sortWithinPartitions("_pk", *order)
    laid = laid.withColumn("_at", F.monotonically_increasing_id())
    laid = materialize(laid.withColumn("_range", F.shiftright("_at", 33)), "lag_ranges")
    by_range = Window.partitionBy("_range").orderBy("_at")
    lag_cols = [f"{prefix}{k}" for k in lags]
    same = {k: F.lag("_pk", k).over(by_range).eqNullSafe(F.col("_pk")) for k in {*lags, K}}
    x = laid.withColumns({
        "_first": ~same[K],
        "_last": ~F.lead("_pk", K).over(by_range).eqNullSafe(F.col("_pk")),
        **{c: F.when(same[k], F.lag(value, k).over(by_range)) for k, c in zip(lags, lag_cols)}})
    body = x.filter(~F.col("_first"))
    edge = x.filter(F.col("_first") | F.col("_last"))
    carried = Window.partitionBy("_pk").orderBy("_at")
    edge = edge.withColumns({c: F.lag(value, k).over(carried) for k, c in zip(lags, lag_cols)})
    return body.unionByName(edge.filter("_first")).drop("_pk", "_at", "_range", "_first", "_last")


# --- weather flags and fill (H13-H15) ----------------------------------------------------

def weather_flags(df: DataFrame) -> DataFrame:
    """heavy_rain / high_temp from the raw measures (null -> 0), then measures null -> 0."""
    df = df.withColumns({"heavy_rain": numeric.heavy_rain("precipitation_mm"),
                         "high_temp": numeric.high_temp("temperature_C")})
    return fill_zero(df, WEATHER_MEASURES)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null -> 0 on numeric columns only (the reference also zero-filled text)."""
    return df.fillna(0, subset=list(cols))


# --- outliers (D11, B14) -----------------------------------------------------------------

def iqr_fences(df: DataFrame, col: str = "ridership") -> DataFrame:
    """One row: q1, q3, iqr, lower, upper (exact linear-interpolated quantiles)."""
    q1, q3 = exact_quantiles(df, col, [0.25, 0.75])
    s = df.sparkSession.range(1).select(F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"))
    s = s.withColumn("iqr", F.col("q3") - F.col("q1"))
    return s.select("q1", "q3", "iqr",
                    (F.col("q1") - IQR_WIDTH * F.col("iqr")).alias("lower"),
                    (F.col("q3") + IQR_WIDTH * F.col("iqr")).alias("upper"))


def drop_outliers(df: DataFrame, col: str = "ridership") -> DataFrame:
    """Keep rows not below lower and not above upper (fences kept).

    The fences are one aggregate job returning one row (two numbers); they
    enter the filter as literals.  (A scalar subquery would be re-planned for
    every reference and re-run per use.)
    """
    f = iqr_fences(df, col).first()
    v = _q(col)
    if f is None or f["lower"] is None:
        return df
    outside = (v < F.lit(f["lower"])) | (v > F.lit(f["upper"]))
    return df.filter(~F.coalesce(outside, F.lit(False)))


# --- one-hot (I3, I4, B6) ------------------------------------------------------------------

def category_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, category, category_index, feature_name) with categories sorted ascending.

    One scan: the distinct tuples of the columns come first, so that the
    per-column lists are cut from the few tuples and not from the fact rows.
    """
    tuples = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).distinct()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in cols])
    d = tuples.select(F.inline(pairs)).filter(F.col("category").isNotNull()).distinct()
    w = Window.partitionBy("column").orderBy("category")
    d = d.withColumn("category_index", (F.row_number().over(w) - 1).cast("double"))
    return d.withColumn("feature_name", feature_name_expr(F.col("column"), F.col("category")))


def feature_name_expr(column: Column, category: Column) -> Column:
    return slug(F.concat(column, F.lit("_"), category))


def one_hot_index(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Per row, each categorical's index and feature name; unknown -> null.

    The dictionary (one row per category) is written once, so the joins read
    a small table instead of re-deriving it from the fact rows per column;
    Spark picks the join from the written table's size.  The vector form is
    ``OneHotEncoder`` in ``turnstile.ml``, the dense form ``one_hot_dense``.
    """
    dictionary = materialize(dictionary, "category_dictionary")
    out = df.select(*keep, *cols)
    for c in cols:
        d = dictionary.filter(F.col("column") == c).select(
            F.col("category").alias(f"_{c}_cat"),
            F.col("category_index").alias(f"{c}_index"),
            F.col("feature_name").alias(f"{c}_feature"))
        out = out.join(d, F.col(c).cast("string") == F.col(f"_{c}_cat"), "left").drop(f"_{c}_cat")
    return out.drop(*cols)


def dense_columns(dictionary: DataFrame, most: int = MAX_DENSE_COLUMNS) -> list[tuple[str, str, str]]:
    """(column, category, name) of every dense 0/1 column, in column and category order.

    The names become the schema of a plan, so the dictionary is read to the
    driver; one of more than ``most`` categories is refused (the vector form
    has no such bound).  Categories whose names clash after slugging are told
    apart by ``__2``, ``__3``, ... in category order.
    """
    rows = dictionary.select("column", "category", "feature_name").orderBy("column", "category").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} categories; use the assembled vectors instead")
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        seen[r["feature_name"]] = n = seen.get(r["feature_name"], 0) + 1
        out.append((r["column"], r["category"], r["feature_name"] if n == 1 else f"{r['feature_name']}__{n}"))
    return out


def one_hot_dense(df: DataFrame, cols: Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """``df`` without ``cols``, with one 0/1 column per category of the data.

    Two steps: the dictionary of ``df`` (or the given one, for scoring rows
    with the training rows' columns) names the columns, then one projection
    fills them.  Null and unknown categories are 0 everywhere.
    """
    dictionary = materialize(category_dictionary(df, cols) if dictionary is None else dictionary, "category_dictionary")
    flags = [(F.coalesce(F.col(f"`{c}`").cast("string") == F.lit(v), F.lit(False))).cast("int").alias(n)
             for c, v, n in dense_columns(dictionary) if c in cols]
    return df.select(*[_q(c) for c in df.columns if c not in cols], *flags)


def unique_columns(df: DataFrame) -> DataFrame:
    """Keep the first of equally named columns (B6): positional rename, then select."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    tmp = [f"_c{i}" for i in range(len(names))]
    first: dict[str, int] = {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
    return df.toDF(*tmp).select(*[F.col(tmp[i]).alias(n) for n, i in first.items()])


# --- scaling (D15, I5) ------------------------------------------------------------------------

def scaler_stats(df: DataFrame, cols: Sequence[str] = tuple(SCALED_FEATURES)) -> DataFrame:
    """One row: mean and population deviation of every column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(_q(c)).alias(f"mean_{c}"), F.stddev_pop(_q(c)).alias(f"std_{c}")]
    return df.agg(*aggs)


def scale_columns(df: DataFrame, cols: Sequence[str] = tuple(SCALED_FEATURES), stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std with std = 0 -> 1.

    The moments are one aggregate job returning one row (2 x len(cols)
    numbers), applied as literals.
    """
    st = (scaler_stats(df, cols) if stats is None else stats).first()
    scaled = {}
    for c in cols:
        mean, std = st[f"mean_{c}"], st[f"std_{c}"]
        scaled[c] = (_q(c) - F.lit(mean)) / F.lit(1.0 if not std else std)
    return df.withColumns(scaled)


# --- whole feature frame ------------------------------------------------------------------------

def feature_frame(enriched_ts: DataFrame, holidays: DataFrame | None = None, scale: bool = True) -> DataFrame:
    """Calendar + lags + weather flags + fill + IQR cut (+ scaling), label ``log1p``.

    Same order as the reference: features, zero fill, outlier cut, then the
    scaler is fitted on the remaining rows.
    """
    df = calendar_features(enriched_ts, holidays)
    df = lag_features(df)
    df = weather_flags(df)
    df = fill_zero(df, ["ridership_lag1", "ridership_lag24"])
    # Read three times (quantiles, scaler statistics, output): compute once,
    # writing only the columns the model and the reports use.
    keep = ["ride_id", *CATEGORICAL_FEATURES, *NUMERIC_FEATURES, "ridership"]
    df = materialize(df.select(*[_q(c) for c in keep]), "feature_frame")
    df = drop_outliers(df)
    if scale:
        df = scale_columns(df)
    return df.withColumn("label", numeric.log_target("ridership"))
