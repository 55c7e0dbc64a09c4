"""turnstile: hourly transit-ridership analytics as Spark DataFrame jobs.

Layout
------
sources/    table readers, the ridership/weather adapters, file sources and sinks
functions/  column-expression helpers (time parsing, calendar, text slugs, numeric)
operators/  DataFrame -> DataFrame building blocks (ranking, daily series, profile,
            weather enrichment, features, request validation, statistics)
ml/         Spark ML pipeline: population scaler, boosted-tree model, tuning, scoring
plans/      the registered query catalogue and its SQL oracles
streaming/  incremental (Structured Streaming) form of the daily aggregate
"""

__all__ = ["session"]
