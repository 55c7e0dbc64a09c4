"""Station ranking and fact-table reduction.

Rankings aggregate first (partial per task, then one shuffle of one row per
station and task), so every window or sort after it runs over one row per
station, never over the fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.timefmt import parse_transit_ts
from turnstile.session import materialize


def with_ts(rides: DataFrame, src: str = "transit_timestamp") -> DataFrame:
    """Add ``ts`` (parsed, 12-hour clock) and ``year``."""
    return rides.withColumn("ts", parse_transit_ts(src)).withColumn("year", F.year("ts"))


def in_years(rides: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """Year membership filter (B7); ``None`` keeps every year."""
    return rides if years is None else rides.filter(F.col("year").isin(list(years)))


def station_totals(rides: DataFrame, keys: Sequence[str] = ("station_complex",)) -> DataFrame:
    """``sum(ridership)`` per key set."""
    return rides.groupBy(*keys).agg(F.sum("ridership").cast("long").alias("total_ridership"))


def top_stations(rides: DataFrame, k: int = 10) -> DataFrame:
    """Global top-k by total, ties by name (F1): a ``TakeOrderedAndProject``."""
    return station_totals(rides).orderBy(F.desc("total_ridership"), F.asc("station_complex")).limit(k)


def top_per_borough(rides: DataFrame, k: int = 5, boroughs: Sequence[str] | None = None) -> DataFrame:
    """Top-k stations inside each borough in one pass.

    The borough filter is applied before the aggregate; on a
    ``borough``-partitioned layout it prunes directories.
    """
    if boroughs is not None:
        rides = rides.filter(F.col("borough").isin(list(boroughs)))
    totals = station_totals(rides, ("borough", "station_complex"))
    w = Window.partitionBy("borough").orderBy(F.desc("total_ridership"), F.asc("station_complex"))
    return totals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reduce_to_stations(rides: DataFrame, chosen: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Keep fact rows of the chosen stations (B8, J7) with a left-semi join.

    ``chosen`` is a ranking (one row per station).  When the caller knows its
    size bound by construction (``k`` per listed borough, or a global top-k)
    it passes ``max_rows`` and the list is broadcast; otherwise AQE decides
    from the measured size.
    """
    keys = chosen.select("station_complex").distinct()
    if max_rows is not None:
        keys = F.broadcast(keys)
    return rides.join(keys, "station_complex", "left_semi")


def set_bound(sets: dict[str, tuple[str, int, Sequence[str] | None]]) -> int | None:
    """Rows of ``reduction_sets`` by construction, or None when a set has no borough list."""
    total = 0
    for kind, k, boroughs in sets.values():
        if kind == "global":
            total += k
        elif boroughs is None:
            return None
        else:
            total += k * len(boroughs)
    return total


def reduction_sets(rides: DataFrame, sets: dict[str, tuple[str, int, Sequence[str] | None]],
                   totals: DataFrame | None = None) -> DataFrame:
    """Station lists for several reductions, as one (set_name, station_complex) frame.

    Each set is ``("global", k, None)`` or ``("borough", k, boroughs)``.  All
    rankings read one (borough, station) totals table, written once, instead
    of aggregating the fact rows again per set.
    """
    if totals is None:
        totals = materialize(station_totals(rides, ("borough", "station_complex")), "station_totals")
    frames = []
    for name, (kind, k, boroughs) in sets.items():
        if kind == "global":
            g = totals.groupBy("station_complex").agg(F.sum("total_ridership").alias("total_ridership"))
            ranked = g.orderBy(F.desc("total_ridership"), F.asc("station_complex")).limit(k)
        else:
            t = totals if boroughs is None else totals.filter(F.col("borough").isin(list(boroughs)))
            w = Window.partitionBy("borough").orderBy(F.desc("total_ridership"), F.asc("station_complex"))
            ranked = t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        frames.append(ranked.select(F.lit(name).alias("set_name"), "station_complex"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reduction_counts(rides: DataFrame, sets: dict[str, tuple[str, int, Sequence[str] | None]]) -> DataFrame:
    """Row count of the fact table reduced to each station set.

    One pass over the fact rows: per (borough, station) totals and row counts,
    written once (one row per station).  Rankings and counts are then joins of
    small tables; the fact rows are never duplicated per set.
    """
    per_station = materialize(rides.groupBy("borough", "station_complex").agg(
        F.sum("ridership").cast("long").alias("total_ridership"), F.count(F.lit(1)).alias("n")), "station_totals")
    chosen = reduction_sets(rides, sets, per_station.select("borough", "station_complex", "total_ridership"))
    bound = set_bound(sets)
    if bound is not None:
        chosen = F.broadcast(chosen)
    n_per_station = per_station.groupBy("station_complex").agg(F.sum("n").alias("n"))
    return (n_per_station.join(chosen, "station_complex")
            .groupBy("set_name")
            .agg(F.count(F.lit(1)).cast("long").alias("n_stations"), F.sum("n").cast("long").alias("n_rows")))
