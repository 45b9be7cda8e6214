"""Messages as text: syslog lines, display fields, export lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DASHED = ("hostname", "app_name", "proc_id", "msg_id")
TIME = "yyyy-MM-dd HH:mm:ss"


def or_dash(name: str) -> Column:
    return F.when(F.col(name) == "", "-").otherwise(F.col(name))


def priority_number() -> Column:
    return (F.col("facility") * 8 + F.col("severity")).cast("string")


def rfc5424() -> Column:
    """A message's columns as an RFC 5424 line, in UTC to the microsecond."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(F.lit("<"), priority_number(), F.lit(">"), F.concat_ws(" ", F.lit("1"), stamp, *map(or_dash, _DASHED), or_dash("structured_data"), "message"))


def rfc3164() -> Column:
    """A message's columns as an RFC 3164 line; the day is padded with a blank."""
    day = F.lpad(F.dayofmonth("timestamp").cast("string"), 2, " ")
    stamp = F.concat_ws(" ", F.date_format("timestamp", "MMM"), day, F.date_format("timestamp", "HH:mm:ss"))
    return F.concat(F.lit("<"), priority_number(), F.lit(">"), stamp, F.lit(" "), F.col("hostname"), F.lit(" "), F.col("app_name"), F.lit("["), F.col("proc_id"), F.lit("]: "), F.col("message"))


def detail(messages: DataFrame) -> DataFrame:
    """What a message's page shows: local forms of time, dashes for absent fields, the format's name."""
    standard = F.when(F.col("version") == 1, "RFC 5424").otherwise("RFC 3164")
    return messages.select("id", F.date_format("timestamp", TIME).alias("time"), F.date_format("received_at", TIME).alias("received"), *[or_dash(c).alias(c) for c in _DASHED], standard.alias("standard"), "severity_label", "facility_label", "message")


def export_rows(messages: DataFrame) -> DataFrame:
    """The nine columns of a CSV export."""
    named = {"Severity": "severity_label", "Facility": "facility_label", "Hostname": "hostname", "AppName": "app_name", "ProcID": "proc_id", "Message": "message", "SourceIP": "source_ip", "Protocol": "protocol"}
    return messages.select(F.date_format("timestamp", TIME).alias("Timestamp"), *[F.col(c).alias(k) for k, c in named.items()])


def export_lines(messages: DataFrame) -> DataFrame:
    """One line of text for each message."""
    return messages.select(F.format_string("%s [%s] %s %s %s: %s", F.date_format("timestamp", TIME), "severity_label", "facility_label", "hostname", "app_name", "message").alias("value"))
