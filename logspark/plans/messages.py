"""Messages, raw lines and rules made of the given tables, and the same messages as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.labels import FACILITIES, SEVERITIES, facility_label, severity_label
from logspark.functions.render import rfc3164, rfc5424
from logspark.schema import COLUMNS


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each event; whole-number and text arithmetic only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("received_at", F.col("ts").cast("timestamp"))
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    severity = F.when(kind == "error", n % 4).when(kind == "signup", 4).when(kind == "purchase", 5).when(kind == "view", 6).otherwise(7).cast("int")
    d = e.select(
        n.alias("seq"), n.cast("string").alias("id"), (F.col("received_at") - F.make_dt_interval(secs=n % 7)).alias("timestamp"), "received_at",
        severity.alias("severity"), severity_label(severity).alias("severity_label"), (n % 24).cast("int").alias("facility"), facility_label((n % 24).cast("int")).alias("facility_label"),
        F.when(user % 10 == 0, "").otherwise(F.concat(F.lit("host-"), F.lpad((user % 20).cast("string"), 2, "0"))).alias("hostname"), F.when(n % 13 == 0, "").otherwise(kind).alias("app_name"),
        user.cast("string").alias("proc_id"), F.concat(F.lit("ID"), (n % 50).cast("string")).alias("msg_id"), F.concat(kind, F.lit(" by user "), user.cast("string"), F.lit(" props "), "props").alias("message"),
        F.concat(F.lit("10.0."), F.floor(user / 16).cast("string"), F.lit("."), (user % 256).cast("string")).alias("source_ip"), F.element_at(F.array(F.lit("UDP"), F.lit("TCP"), F.lit("TLS")), (n % 3 + 1).cast("int")).alias("protocol"),
        (n % 2).cast("int").alias("version"), F.when((n % 2 == 1) & (n % 3 == 0), F.concat(F.lit('[meta sequenceId="'), n.cast("string"), F.lit('"]'))).otherwise("").alias("structured_data"),
    )
    return d.withColumn("raw_message", F.when(F.col("version") == 1, rfc5424()).otherwise(rfc3164())).select(COLUMNS)


def lines_of(found: DataFrame) -> DataFrame:
    """The messages' raw lines, as they'd be received."""
    return found.select("seq", F.col("raw_message").alias("raw"), "source_ip", "protocol", "received_at", "id")


def _cases(names: tuple[str, ...], code: str) -> str:
    return f"list_extract([{', '.join(repr(x) for x in names)}], cast({code} as int) + 1)"


_SEVERITY = "case event_type when 'error' then event_id % 4 when 'signup' then 4 when 'purchase' then 5 when 'view' then 6 else 7 end"
_DASH = "case when {0} = '' then '-' else {0} end"
#: The same messages in SQL, as the table m.
MESSAGES_SQL = f"""with m0 as (select event_id as seq, cast(event_id as varchar) as id, ts - to_seconds(cast(event_id % 7 as int)) as "timestamp", ts as received_at,
  cast({_SEVERITY} as int) as severity, {_cases(SEVERITIES, _SEVERITY)} as severity_label, cast(event_id % 24 as int) as facility, {_cases(FACILITIES, 'event_id % 24')} as facility_label,
  case when user_id % 10 = 0 then '' else 'host-' || lpad(cast(user_id % 20 as varchar), 2, '0') end as hostname, case when event_id % 13 = 0 then '' else event_type end as app_name,
  cast(user_id as varchar) as proc_id, 'ID' || cast(event_id % 50 as varchar) as msg_id, event_type || ' by user ' || cast(user_id as varchar) || ' props ' || props as message,
  '10.0.' || cast(user_id // 16 as varchar) || '.' || cast(user_id % 256 as varchar) as source_ip, list_extract(['UDP', 'TCP', 'TLS'], cast(event_id % 3 + 1 as int)) as protocol,
  cast(event_id % 2 as int) as version, case when event_id % 2 = 1 and event_id % 3 = 0 then '[meta sequenceId="' || cast(event_id as varchar) || '"]' else '' end as structured_data from events),
 m as (select *, '<' || cast(facility * 8 + severity as varchar) || '>' || case when version = 1 then '1 ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || 'Z ' || {' '.join(f"{_DASH.format(c)} || ' ' ||" for c in ('hostname', 'app_name', 'proc_id', 'msg_id', 'structured_data'))} message
  else strftime("timestamp", '%b ') || lpad(cast(day("timestamp") as varchar), 2, ' ') || strftime("timestamp", ' %H:%M:%S ') || hostname || ' ' || app_name || '[' || proc_id || ']: ' || message end as raw_message from m0)
"""
#: Alert rules as a configuration would hold them: one off, one with a pattern that can't be run.
RULES = [
    {"id": "r1", "name": "errors", "pattern": "ERROR", "minSeverity": 3, "cooldown": 7200},
    {"id": "r2", "name": "some users", "pattern": r"user (1|2)\d? ", "useRegex": True, "hostname": "HOST-0", "cooldown": 0},
    {"id": "r3", "name": "off", "pattern": "error", "enabled": False},
    {"id": "r4", "name": "purchases", "appName": "purch", "cooldown": 86_400},
    {"id": "r5", "name": "broken", "pattern": "[invalid", "useRegex": True},
]
