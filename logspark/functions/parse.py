"""Syslog lines parsed with built-in expressions: RFC 5424, else RFC 3164, else the line as it is.

Each step adds columns that later steps refer to, so that nothing is worked out twice. Positions are
characters; all delimiters are ASCII, so cuts fall where they would by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.labels import facility_label, severity_label
from logspark.schema import COLUMNS

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"
_BSD = rf"(?i)^({'|'.join(_MONTHS)}) +(\d{{1,2}}) +(\d{{1,2}}):(\d\d):(\d\d(?:[.,]\d+)?)$"
#: Balanced elements side by side, quotes and escapes in them honoured; possessive, for long input.
_ELEMENTS = r'(?s)^((?:\[(?:[^"\[\]]++|"(?:\\.|[^"\\]++)*+")*+\])++)(?!\[)'


def priority(line: Column) -> Column:
    """The number between < and > at a line's start, 0 to 191; null if there is none."""
    number = F.regexp_extract(line, r"^<([+-]\d{1,2}|\d{1,3})>", 1).try_cast("int")
    return F.when(number.between(0, 191), number)


def rfc3339(text: Column) -> Column:
    """A timestamp, to the microsecond; null for any other text."""
    return F.when(text.rlike(_RFC3339), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def bsd_year(month: Column, day: Column, received: Column) -> Column:
    """The year of arrival; that before for a December line that arrives in January, that after for a line of Jan 1 that arrives on Dec 31."""
    late = (month == 12) & (F.month(received) == 1)
    early = (month == 1) & (day == 1) & (F.month(received) == 12) & (F.dayofmonth(received) == 31)
    return F.year(received) + F.when(late, -1).when(early, 1).otherwise(0)


def bsd_time(text: Column, received: Column) -> Column:
    """`Mmm d hh:mm:ss` in its year, UTC; Feb 29 is Mar 1 where the year has none; null for any other text."""
    part = lambda i: F.regexp_extract(text, _BSD, i)
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(1))).cast("int")
    day, hour, minute = (part(i).try_cast("int") for i in (2, 3, 4))
    year = bsd_year(month, day, received)
    second = F.replace(part(5), F.lit(","), F.lit(".")).try_cast("decimal(16,6)")
    made = lambda m, d: F.when(text.rlike(_BSD) & (second < 60), F.try_make_timestamp(year, m, d, hour, minute, second))
    return F.coalesce(made(month, day), F.when((month == 2) & (day == 29), made(F.lit(3), F.lit(1))))


def nested_end(text: Column, letters: Column) -> Column:
    """Length of the structured data at a text's start by counting depth, for what _ELEMENTS can't tell; -1 if it never ends."""
    quote, back = F.lit('"'), F.lit("\\")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(-1).alias("end"))

    def step(s: Column, i: Column) -> Column:
        c = F.element_at(letters, i)
        live = (s.end < 0) & ~s.escaped
        depth = s.depth + F.when(live & ~s.quoted & (c == "["), 1).when(live & ~s.quoted & (c == "]"), -1).otherwise(0)
        ends = live & ~s.quoted & (c == "]") & (depth == 0) & ~F.coalesce(F.get(letters, i) == "[", F.lit(False))
        return F.struct(depth.alias("depth"), (s.quoted != (live & (c == quote))).alias("quoted"), (live & s.quoted & (c == back)).alias("escaped"), F.when(ends, i).otherwise(s.end).alias("end"))

    return F.aggregate(F.sequence(F.lit(1), F.size(letters)), start, step, lambda s: s.end)


def with_structured_data(lines: DataFrame, rest: str) -> DataFrame:
    """Adds structured_data and text: what `rest`, all after the sixth blank, holds of each."""
    s = F.col(rest)
    lines = lines.withColumn("__sd", F.when(s.startswith("["), F.regexp_extract(s, _ELEMENTS, 1)))
    rare = s.startswith("[") & (F.col("__sd") == "")
    lines = lines.withColumn("__letters", F.when(rare, F.split(s, "")))
    lines = lines.withColumn("__n", F.when(rare, nested_end(s, F.col("__letters"))).otherwise(F.length("__sd")))
    found = s.startswith("[") & (F.col("__n") > 0)
    text = F.when(s.startswith("- "), F.substring(s, F.lit(3), F.length(s))).when(s.startswith("-"), "").when(found, F.substring(s, F.col("__n") + 2, F.length(s))).otherwise(s)
    return lines.withColumns({"structured_data": F.when(found, F.substring(s, F.lit(1), F.col("__n"))).otherwise(""), "text": F.regexp_replace(text, "^\ufeff", "")}).drop("__sd", "__letters", "__n")


def with_tag(lines: DataFrame, text: str) -> DataFrame:
    """Adds app, proc and said: `app[proc]:` or `app:` taken off a message's start."""
    s = F.col(text)
    tag = F.when(s.contains(":"), F.substring_index(s, ":", 1))
    lines = lines.withColumn("__tag", F.when(F.octet_length(tag) <= 48, tag))
    t, opens, closes = F.col("__tag"), F.locate("[", F.col("__tag")), F.locate("]", F.col("__tag"))
    bracketed = (opens > 0) & (closes > opens)
    app = F.when(bracketed, F.substring(t, F.lit(1), opens - 1)).when((opens == 0) & ~t.contains(" "), t).otherwise("")
    lines = lines.withColumns({"app": F.coalesce(app, F.lit("")), "proc": F.coalesce(F.when(bracketed, F.substring(t, opens + 1, closes - opens - 1)), F.lit(""))})
    rest = F.ltrim(F.substring(s, F.length("__tag") + 2, F.length(s)), F.lit(" "))
    return lines.withColumn("said", F.when(F.col("app") != "", rest).otherwise(s)).drop("__tag")


def parse(lines: DataFrame) -> DataFrame:
    """Messages of raw lines(seq, raw, source_ip, protocol, received_at[, id]).

    Without an id a line gets one from its content, so that a replay gives the same. Bad dates fall
    back to received_at; a line without a valid priority is a notice of facility user."""
    own = "id" in lines.columns
    d = lines.withColumn("raw_message", F.rtrim(F.coalesce("raw", F.lit("")), F.lit("\n\r\0")))
    d = d.withColumn("pri", priority(F.col("raw_message")))
    d = d.withColumn("rest", F.when(F.col("pri").isNotNull(), F.substring_index(F.substring("raw_message", F.lit(1), F.lit(5)), ">", 1)))
    d = d.withColumn("rest", F.substring("raw_message", F.length("rest") + 2, F.length("raw_message")))
    d = d.withColumn("parts", F.when(F.col("rest").rlike("^[1-9] "), F.split("rest", " ", 7)))
    d = d.withColumn("new", F.coalesce(F.size("parts") == 7, F.lit(False)) & F.col("parts").isNotNull())
    d = d.withColumn("sd_rest", F.when(F.col("new"), F.get("parts", F.lit(6))))
    d = with_structured_data(d, "sd_rest").withColumnRenamed("text", "new_text")
    long_enough = ~F.col("new") & (F.octet_length("rest") >= 15)
    d = d.withColumns({"t15": F.when(long_enough, bsd_time(F.substring("rest", 1, 15), F.col("received_at"))), "t14": F.when(long_enough, bsd_time(F.substring("rest", 1, 14), F.col("received_at")))})
    dated = F.col("t15").isNotNull() | F.col("t14").isNotNull()
    after = F.when(F.col("t15").isNotNull(), F.lit(16)).otherwise(F.lit(15))
    d = d.withColumn("tail", F.when(dated, F.ltrim(F.substring("rest", after, F.length("rest")), F.lit(" "))))
    parted = F.col("tail").contains(" ")
    old_text = F.when(parted, F.substring("tail", F.locate(" ", F.col("tail")) + 1, F.length("tail"))).when(dated, "").otherwise(F.col("rest"))
    d = with_tag(d.withColumns({"old_host": F.coalesce(F.substring_index("tail", " ", 1), F.lit("")), "old_text": old_text}), "old_text")
    field = lambda i: F.when(F.get("parts", F.lit(i)) != "-", F.get("parts", F.lit(i))).otherwise("")
    new, known = F.col("new"), F.col("pri").isNotNull()
    by_kind = lambda n, o, none: F.when(~known, none).when(new, n).otherwise(o)
    empty, received = F.lit(""), F.col("received_at")
    severity, facility = F.when(known, F.col("pri") % 8).otherwise(5), F.when(known, F.floor(F.col("pri") / 8).cast("int")).otherwise(1)
    content = F.sha2(F.concat_ws("\x1f", "source_ip", "protocol", F.unix_micros("received_at").cast("string"), "raw_message", F.col("seq").cast("string")), 256)
    columns = {
        "id": F.coalesce("id", content) if own else content,
        "timestamp": F.coalesce(by_kind(rfc3339(F.get("parts", F.lit(1))), F.coalesce("t15", "t14"), received), received),
        "severity": severity.cast("int"), "severity_label": severity_label(severity.cast("int")), "facility": facility.cast("int"), "facility_label": facility_label(facility.cast("int")),
        "hostname": by_kind(field(2), F.col("old_host"), empty), "app_name": by_kind(field(3), F.col("app"), empty), "proc_id": by_kind(field(4), F.col("proc"), empty), "msg_id": by_kind(field(5), empty, empty),
        "message": by_kind(F.col("new_text"), F.col("said"), F.col("raw_message")), "version": F.when(known & new, 1).otherwise(0), "structured_data": by_kind(F.col("structured_data"), empty, empty),
    }
    return d.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in COLUMNS])
