"""Names of severities and facilities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by code.
SEVERITIES = ("Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Info", "Debug")
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")


def _name(code: Column, names: tuple[str, ...], other: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code), F.lit(other))


def severity_label(code: Column) -> Column:
    return _name(code, SEVERITIES, "Unknown")


def facility_label(code: Column) -> Column:
    return _name(code, FACILITIES, "unknown")


def severity_code(label: Column) -> Column:
    """The code of a severity's name; -1 for any other text."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), label).cast("int"), F.lit(0)) - 1
