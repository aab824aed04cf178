"""Declared schemas; no scan infers one."""

from pyspark.sql import types as T

RIDES = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("customer_email", T.StringType(), False),
        T.StructField("pickup_zone", T.StringType(), False),
        T.StructField("drop_off_zone", T.StringType(), False),
        T.StructField("price", T.DoubleType(), False),
        T.StructField("number_of_passengers", T.IntegerType(), False),
        T.StructField("request_ts", T.TimestampType(), False),
    ]
)

CAPTURED = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

TRAFFIC = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("window_time", T.TimestampType()),
        T.StructField("pickup_zone", T.StringType()),
        T.StructField("request_count", T.LongType()),
        T.StructField("total_passengers", T.LongType()),
        T.StructField("total_revenue", T.DecimalType(20, 2)),
    ]
)

CALENDAR = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("expected_attendance", T.IntegerType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("impact_level", T.StringType()),
        T.StructField("event_time_start_hour", T.IntegerType()),
        T.StructField("event_time_start_min", T.IntegerType()),
        T.StructField("event_time_end_hour", T.IntegerType()),
        T.StructField("event_time_end_min", T.IntegerType()),
    ]
)

VESSELS = T.StructType(
    [
        T.StructField("vessel_id", T.StringType()),
        T.StructField("vessel_name", T.StringType()),
        T.StructField("base_zone", T.StringType()),
        T.StructField("availability", T.StringType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("current_zone", T.StringType()),
    ]
)

BOATS = T.ArrayType(
    T.StructType(
        [
            T.StructField("vessel_id", T.StringType()),
            T.StructField("new_zone", T.StringType()),
            T.StructField("new_availability", T.StringType()),
        ]
    )
)
