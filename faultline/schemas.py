"""Table schemas."""

from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from faultline.fixed_values import RESULT_MTBF_KEY, RESULT_MTBF_KEY_ALTERNATIVE

_HEADERS = StructField("headers", MapType(StringType(), StringType()))
_DATE_PARTITIONS = [StructField(name, StringType()) for name in ("year", "month", "day")]

RAW_LOGS = StructType([_HEADERS, StructField("body", BinaryType()), *_DATE_PARTITIONS])

TYPED_LOGS = StructType(
    [
        _HEADERS,
        StructField("priority", StringType()),
        StructField("timestamp", TimestampType()),
        StructField("host", StringType()),
        StructField("partition", StringType()),
        StructField("Facility", StringType()),
        StructField("topic", StringType()),
        StructField("Severity", StringType()),
        StructField("msg", StringType()),
        *_DATE_PARTITIONS,
    ]
)

#: Column that typed logs carry for readers of memory errors: whether the message is one.
MEMORY_ERROR_MARK = "memory_error"
MARKED_LOGS = StructType(
    [*TYPED_LOGS.fields[:-3], StructField(MEMORY_ERROR_MARK, BooleanType()), *_DATE_PARTITIONS]
)

MEMORY_ERRORS = StructType(
    [
        StructField("timestamp", TimestampType()),
        StructField("msg", StringType()),
        *_DATE_PARTITIONS,
        StructField("host", StringType()),
    ]
)

FEATURES = StructType(
    [
        StructField("host", StringType()),
        StructField("feature_window_start", TimestampType()),
        StructField("num_logs", LongType()),
        StructField("num_errors", LongType()),
        StructField("avg_severity", DoubleType()),
        StructField("max_severity", IntegerType()),
        StructField("label_feature_window", IntegerType()),
        StructField("target_window_start", TimestampType()),
        StructField("label_next_hour", IntegerType()),
        StructField("error_ratio", DoubleType()),
        StructField("year", StringType()),
        StructField("month", StringType()),
    ]
)

# {period: {host: {percentile key: {counts and mtbf}}}}; the mtbf key has two spellings.
_RESULT = StructType(
    [
        StructField("count_before", LongType()),
        StructField("count_after", LongType()),
        StructField(RESULT_MTBF_KEY, DoubleType()),
        StructField(RESULT_MTBF_KEY_ALTERNATIVE, DoubleType()),
    ]
)
RESULT_DOCUMENT = MapType(
    StringType(), MapType(StringType(), MapType(StringType(), _RESULT))
)
