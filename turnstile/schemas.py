"""Fixed schemas: nothing is inferred at read time."""

from pyspark.sql import types as T

# Timestamp text formats used by the ridership and weather files.
TRANSIT_TS_FORMAT = "MM/dd/yyyy hh:mm:ss a"
WEATHER_TS_FORMAT = "yyyy-MM-dd'T'HH:mm"
DAY_FORMAT = "yyyy-MM-dd"
REQUEST_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Raw hourly ridership fact as it arrives in CSV (one row per station, hour,
# fare class and payment method).
RAW_RIDES = T.StructType([
    T.StructField("ride_id", T.LongType()),
    T.StructField("transit_timestamp", T.StringType()),
    T.StructField("transit_mode", T.StringType()),
    T.StructField("station_complex_id", T.StringType()),
    T.StructField("station_complex", T.StringType()),
    T.StructField("borough", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("fare_class_category", T.StringType()),
    T.StructField("ridership", T.LongType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

RIDE_COLUMNS = [f.name for f in RAW_RIDES.fields]

# Weather CSV: header only, every column is text (a measure may read "n/a").
WEATHER_TEXT = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("temperature_C", T.StringType()),
    T.StructField("precipitation_mm", T.StringType()),
    T.StructField("humidity_%", T.StringType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
])

WEATHER_MEASURES = ["temperature_C", "precipitation_mm", "humidity_%"]

# Body of one landed hourly-weather reply: parallel arrays under "hourly", or
# an error; its station, start date and status are in the folder names.
WEATHER_REPLY_BODY = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation", T.ArrayType(T.DoubleType())),
        T.StructField("relative_humidity_2m", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("unreadable", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("station_id", T.LongType()),
    T.StructField("start_date", T.StringType()),
])

# Scoring request, in the units a user types them.
REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("station", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("temp_f", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("precipitation_in", T.DoubleType()),
    T.StructField("fare_class", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])

# Feature row, in model order (categorical one-hots follow as a vector).
NUMERIC_FEATURES = [
    "hour", "day_of_week", "month", "is_weekend", "is_holiday",
    "ridership_lag1", "ridership_lag24", "heavy_rain", "high_temp",
    "temperature_C", "humidity_%", "precipitation_mm",
]
SCALED_FEATURES = [
    "hour", "day_of_week", "month", "ridership_lag1", "ridership_lag24",
    "temperature_C", "humidity_%", "precipitation_mm",
]
CATEGORICAL_FEATURES = ["station_complex", "station_complex_id", "fare_class_category", "payment_method"]
