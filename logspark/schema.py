"""Schemas of messages, raw lines and alert rules. Absent strings are '', never null."""

from pyspark.sql import types as T

_STRINGS = ("severity_label", "facility_label", "hostname", "app_name", "proc_id", "msg_id", "message", "raw_message", "source_ip", "protocol", "structured_data")
COLUMNS = ["seq", "id", "timestamp", "received_at", "severity", "severity_label", "facility", "facility_label", "hostname", "app_name", "proc_id", "msg_id", "message", "raw_message", "source_ip", "protocol", "version", "structured_data"]
_KINDS = {"seq": T.LongType(), "timestamp": T.TimestampType(), "received_at": T.TimestampType(), "severity": T.IntegerType(), "facility": T.IntegerType(), "version": T.IntegerType()}
MESSAGE = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in COLUMNS])
RAW_LINE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("source_ip", T.StringType()), T.StructField("protocol", T.StringType()), T.StructField("received_at", T.TimestampType())])
RULE = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("pattern", T.StringType()), T.StructField("useRegex", T.BooleanType()), T.StructField("minSeverity", T.IntegerType()), T.StructField("hostname", T.StringType()), T.StructField("appName", T.StringType()), T.StructField("cooldown", T.IntegerType())])
