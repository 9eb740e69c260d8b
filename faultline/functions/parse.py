"""Columns cut out of raw log records and out of memory-error messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed


def whole_number(text: Column, type_name: str = "bigint") -> Column:
    """Number from text; a fraction is cut off, anything else that is no number is NULL."""
    return F.coalesce(
        text.try_cast(type_name), text.try_cast("decimal(38,6)").try_cast(type_name)
    )


def headers_to_columns(headers: Column | str = "headers") -> list[Column]:
    """One string column per known header; a missing key gives NULL."""
    headers = F.col(headers) if isinstance(headers, str) else headers
    return [headers.getItem(key).alias(key) for key in fixed.HEADER_KEYS]


def epoch_ms_to_ts(text: Column) -> Column:
    """Epoch milliseconds as text to a timestamp in whole seconds (cut, not rounded).

    Stays in epoch seconds throughout, so local clock changes cannot move a value.
    """
    return F.timestamp_seconds(
        F.call_function("div", whole_number(text), F.lit(1000).cast("bigint"))
    )


def decode_body(body: Column) -> Column:
    return F.decode(body, fixed.BODY_CHARSET)


def severity_int(severity: Column) -> Column:
    return whole_number(severity, "int")


def host_or_unknown(host: Column) -> Column:
    blank = host.isNull() | (F.trim(host) == "")
    return F.when(blank, F.lit(fixed.UNKNOWN_HOST)).otherwise(host)


def error_class_group(msg: Column, group: int) -> Column:
    """A group of the error class pattern, '' without a match, NULL for NULL.

    Only messages with the literal part of the pattern are given to it: where it fails,
    the pattern takes time that grows with the square of the message length.
    """
    can_match = msg.contains(fixed.ERROR_CLASS_LITERAL)
    value = F.regexp_extract(msg, fixed.ERROR_CLASS_PATTERN, group)
    return F.when(can_match, value).when(~can_match, F.lit(""))


def classify_error(msg: Column) -> Column:
    """Error class of a message that also locates a DIMM."""
    return error_class_group(msg, 1)


def parse_dimm_locator(msg: Column) -> list[Column]:
    names = ("socket", "controller", "channel", "dimm")
    return [
        error_class_group(msg, group).alias(name) for group, name in enumerate(names, start=2)
    ]


def error_flag(error_class: Column) -> Column:
    return (error_class != "").cast("int")


def error_field(name: str, msg: Column) -> Column:
    """One named field of a memory-error message, '' where the message lacks it."""
    value = F.regexp_extract(msg, fixed.ERROR_FIELD_PATTERNS[name], 1)
    return F.trim(value) if name == "cpu_info" else value


def number_ce_error(msg: Column) -> Column:
    return F.regexp_extract(error_field("ce_error", msg), fixed.CE_COUNT_PATTERN, 1)


def extract_error_fields(errors: DataFrame) -> DataFrame:
    """All named fields in one projection; fields a query does not use are pruned."""
    msg = F.col("msg")
    fields = [error_field(name, msg).alias(name) for name in fixed.ERROR_FIELD_PATTERNS]
    return errors.select("*", *fields, number_ce_error(msg).alias("number_ce_error"))


def normalize_logs(raw: DataFrame) -> DataFrame:
    """Raw log records to typed log records: headers as columns, body as text."""
    headers = {key: F.col("headers").getItem(key) for key in fixed.HEADER_KEYS}
    typed = {**headers, "timestamp": epoch_ms_to_ts(headers["timestamp"])}
    kept = [name for name in raw.columns if name != "body" and name not in typed]
    return raw.select(
        *kept,
        *[column.alias(name) for name, column in typed.items()],
        decode_body(F.col("body")).alias("msg"),
    )
