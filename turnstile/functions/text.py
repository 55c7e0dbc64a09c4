"""Text helpers: feature-name slugs (H19, H20), labels (H21), prefix test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters turned into "_" first, then any run of characters
# outside [A-Za-z0-9_] becomes a single "_".
SLUG_LITERAL_CHARS = " /"
SLUG_RUN_PATTERN = "[^A-Za-z0-9_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c) -> Column:
    """One slug rule for training and scoring (the reference used two)."""
    return F.regexp_replace(F.translate(_col(c), SLUG_LITERAL_CHARS, "__"), SLUG_RUN_PATTERN, "_")


def feature_name(column_name: str, value) -> Column:
    """``<column>_<category>`` slugged, e.g. ``fare_class_category_OMNY___Full_Fare``."""
    return slug(F.concat(F.lit(column_name + "_"), _col(value)))


def file_safe(c) -> Column:
    """Chart file stem of a station: "/" and " " -> "_"."""
    return F.translate(_col(c), SLUG_LITERAL_CHARS, "__")


def chart_file_name(station, year, month_name) -> Column:
    """``<station stem>_<year>[_<month>]_barchart.png`` (month in lower case)."""
    month_part = F.when(_col(month_name).isNotNull(), F.concat(F.lit("_"), F.lower(_col(month_name)))).otherwise(F.lit(""))
    return F.concat(file_safe(station), F.lit("_"), _col(year).cast("string"), month_part, F.lit("_barchart.png"))


def ridership_label(station, total) -> Column:
    """``<station> (Ridership: <n>)`` for the map feed."""
    return F.format_string("%s (Ridership: %d)", _col(station), _col(total))


def series_title(station, fare, payment, month_name, year) -> Column:
    """``Daily Ridership at <station>\\n<fare>, <payment>, [<Month> ]<year>``."""
    month_part = F.when(_col(month_name).isNotNull(), F.concat(_col(month_name), F.lit(" "))).otherwise(F.lit(""))
    return F.concat(F.lit("Daily Ridership at "), _col(station), F.lit("\n"), _col(fare), F.lit(", "),
                    _col(payment), F.lit(", "), month_part, _col(year).cast("string"))


def has_prefix(c, prefix: str) -> Column:
    return F.startswith(_col(c), F.lit(prefix))
