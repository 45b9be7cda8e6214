"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import labels, parse, render, search
from logspark.operators import alerts, dedup, filters, gramindex, groups, query, rank, retention, stats, textindex
from logspark.operators.filters import Filter
from logspark.operators.idindex import IdIndex
from logspark.plans.messages import MESSAGES_SQL, RULES, lines_of, messages
from logspark.session import exists, new_folder
from logspark.sources.cleanup import Limits, clean
from logspark.sources.lines import raw_lines, read_store, union_transports
from logspark.sources.sinks import append
from logspark.streaming import rollup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SHOWN = ["id", "severity", "severity_label", "hostname", "app_name", "source_ip", "protocol", "message"]
_SHOWN_SQL = """id, severity, severity_label, hostname, app_name, source_ip, protocol, message, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') as ts"""


def stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*SHOWN, stamp("timestamp").alias("ts"), *more)


def of_messages(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    """Register a function of the messages, with SQL over the table m."""

    def register(f: Callable[[DataFrame], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: f(messages(spark, sf_dir))
        ORACLE_SQL[name] = MESSAGES_SQL + sql

    return register


def of_documents(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    def register(f: Callable[[DataFrame], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        ORACLE_SQL[name] = sql

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_sources(parse.parse(lines_of(messages(spark, sf_dir))))


# Sources and exports

of_documents("src_raw_lines", "select doc_id as seq, text as raw, source as source_ip, 'TCP' as protocol from documents where length(text) > 0")(
    lambda d: raw_lines(d.withColumnRenamed("text", "value"), "TCP", F.col("source"), F.lit(NOW), F.col("doc_id")).drop("received_at")
)
of_messages("src_union_transports", "select protocol, raw_message as raw, source_ip from m")(
    lambda m: union_transports(*[raw_lines(m.where(F.col("protocol") == p).withColumn("value", F.col("raw_message")), p, F.col("source_ip")) for p in ("UDP", "TCP", "TLS")]).select("protocol", "raw", "source_ip")
)
of_messages("export_csv_rows", """select strftime("timestamp", '%Y-%m-%d %H:%M:%S') as "Timestamp", severity_label as "Severity", facility_label as "Facility", hostname as "Hostname", app_name as "AppName", proc_id as "ProcID", message as "Message", source_ip as "SourceIP", protocol as "Protocol" from m where severity <= 4""")(
    lambda m: render.export_rows(filters.filtered(m, Filter(severities=(0, 1, 2, 3, 4))))
)
of_messages("export_text_lines", """select strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' [' || severity_label || '] ' || facility_label || ' ' || hostname || ' ' || app_name || ': ' || message as value from m""")(render.export_lines)

# Parsing

_PARSED = ["seq", "severity", "severity_label", "facility", "hostname", "app_name", "proc_id", "msg_id", "message", "version", "structured_data"]
_BARE = """(hostname = '' and version = 0)"""
_PARSED_SQL = f"""select seq, severity, severity_label, facility, version, structured_data, strftime(case when version = 1 then "timestamp" else date_trunc('second', "timestamp") end, '%Y-%m-%d %H:%M:%S.%f') as ts,
 case when {_BARE} then app_name || '[' || proc_id || ']:' else hostname end as hostname, case when {_BARE} then '' else app_name end as app_name,
 case when {_BARE} then '' else proc_id end as proc_id, case when version = 1 then msg_id else '' end as msg_id,
 case when version = 0 and hostname <> '' and app_name = '' then '[' || proc_id || ']: ' || message else message end as message
 from (select * replace (case when version = 1 then structured_data else '' end as structured_data) from m)"""


def parsed(m: DataFrame) -> DataFrame:
    return parse.parse(lines_of(m)).select(*_PARSED, stamp("timestamp").alias("ts"))


of_messages("parse_all", _PARSED_SQL)(parsed)
of_messages("parse_rfc5424", _PARSED_SQL + " where version = 1")(lambda m: parsed(m.where("version = 1")))
of_messages("parse_rfc3164", _PARSED_SQL + " where version = 0")(lambda m: parsed(m.where("version = 0")))
of_messages("parse_priority", "select seq, facility * 8 + severity as pri, facility, severity from m")(
    lambda m: m.select("seq", parse.priority(F.col("raw_message")).alias("pri")).select("seq", "pri", F.floor(F.col("pri") / 8).cast("int").alias("facility"), (F.col("pri") % 8).alias("severity"))
)
_BROKEN = {1: "<abc>", 2: "<192>", 3: "<12345>"}
of_documents("parse_fallback", f"select doc_id as seq, 5 as severity, 1 as facility, 0 as version, '' as hostname, case doc_id % 4 {' '.join(f'when {k} then {v!r}' for k, v in _BROKEN.items())} else '' end || rtrim(text, chr(10) || chr(13)) as message from documents where length(text) > 0")(
    lambda d: parse.parse(
        raw_lines(d.withColumn("value", F.concat(F.when(F.col("doc_id") % 4 == 1, _BROKEN[1]).when(F.col("doc_id") % 4 == 2, _BROKEN[2]).when(F.col("doc_id") % 4 == 3, _BROKEN[3]).otherwise(""), "text")).where(F.length("text") > 0), "UDP", F.col("source"), F.lit(NOW), F.col("doc_id"))
    ).select("seq", "severity", "facility", "version", "hostname", "message")
)
_SD = {0: '[a k="v"]', 1: r'[a k="v\"]"][b]', 2: "[a[b]c]"}
of_messages("parse_structured_data", f"select seq, case seq % 4 {' '.join(f"when {k} then '{v}'" for k, v in _SD.items())} else '' end as structured_data, message as text from m")(
    lambda m: parse.with_structured_data(m.select("seq", F.concat(F.when(F.col("seq") % 4 == 0, _SD[0]).when(F.col("seq") % 4 == 1, _SD[1]).when(F.col("seq") % 4 == 2, _SD[2]).otherwise("-"), F.lit(" "), "message").alias("rest")), "rest").drop("rest")
)
of_messages("parse_tag", "select seq, case when seq % 3 = 2 then '' else app_name end as app, case when seq % 3 = 0 then proc_id else '' end as proc, case when seq % 3 = 2 then app_name || ' ' || message when app_name = '' and seq % 3 = 0 then '[' || proc_id || ']: ' || message when app_name = '' then ': ' || message else message end as said from m")(
    lambda m: parse.with_tag(m.select("seq", F.concat("app_name", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("["), "proc_id", F.lit("]: "))).when(F.col("seq") % 3 == 1, F.lit(": ")).otherwise(F.lit(" ")), "message").alias("text")), "text").drop("text")
)
of_messages("label_severity", "select seq, case when seq % 9 = 8 then 'Unknown' else list_extract(['Emergency', 'Alert', 'Critical', 'Error', 'Warning', 'Notice', 'Info', 'Debug'], cast(seq % 9 + 1 as int)) end as label from m")(
    lambda m: m.select("seq", labels.severity_label((F.col("seq") % 9).cast("int")).alias("label"))
)
of_messages("label_facility", "select facility, facility_label as label, count(*) as n from m group by all")(lambda m: m.groupBy("facility", labels.facility_label(F.col("facility")).alias("label")).agg(F.count("*").alias("n")))
of_messages("severity_from_label", "select seq, case when seq % 5 = 0 then -1 else severity end as code from m")(
    lambda m: m.select("seq", labels.severity_code(F.when(F.col("seq") % 5 == 0, F.lower("severity_label")).otherwise(F.col("severity_label"))).alias("code"))
)
of_messages("message_detail", """select id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') as "time", strftime(received_at, '%Y-%m-%d %H:%M:%S') as received, coalesce(nullif(hostname, ''), '-') as hostname, coalesce(nullif(app_name, ''), '-') as app_name, proc_id, msg_id, case when version = 1 then 'RFC 5424' else 'RFC 3164' end as standard, severity_label, facility_label, message from m""")(render.detail)
of_messages("render_syslog", "select seq, raw_message as line from m")(lambda m: m.select("seq", F.when(F.col("version") == 1, render.rfc5424()).otherwise(render.rfc3164()).alias("line")))

# Filters and search


def filtering(name: str, f: Filter, where: str) -> None:
    of_messages(name, f"select {_SHOWN_SQL} from m where {where}")(lambda m: shown(filters.filtered(m, f)))


filtering("filter_severity", Filter(severities=(0, 3)), "severity in (0, 3)")
filtering("filter_facility", Filter(facilities=(4, 10, 23)), "facility in (4, 10, 23)")
filtering("filter_substring", Filter(hostname="HOST-0", app_name="ck", source_ip="0.1."), "contains(lower(hostname), 'host-0') and contains(lower(app_name), 'ck') and contains(source_ip, '0.1.')")
filtering("filter_date_range", Filter(date_from="2024-01-05T12:30", date_to="2024-01-07"), """ "timestamp" >= timestamp '2024-01-05 12:30:00' and "timestamp" < timestamp '2024-01-08'""")
filtering("search_text", Filter(search="USER 12"), "contains(lower(message), 'user 12') or contains(lower(raw_message), 'user 12')")
filtering("search_regex", Filter(search=r"user \d{3} .*: 9\d\}", mode="regex"), r"regexp_matches(message, '(?i)user \d{3} .*: 9\d\}') or regexp_matches(raw_message, '(?i)user \d{3} .*: 9\d\}')")
filtering("search_any_of", Filter(search="user 99 OR 'signup'", mode="any"), "contains(lower(raw_message), 'user 99') or contains(lower(raw_message), 'signup') or contains(lower(message), 'user 99') or contains(lower(message), 'signup')")
filtering("filter_combined", Filter(severities=(0, 1, 2, 3), hostname="host", search="by user", date_from="2024-01-03", date_to="2024-01-20"), """severity <= 3 and contains(hostname, 'host') and contains(message, 'by user') and "timestamp" >= timestamp '2024-01-03' and "timestamp" < timestamp '2024-01-21'""")
_TOK = r"' ' || trim(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
_WORDS = " and ".join(f"(contains({_TOK.format('message')}, ' {w}') or contains({_TOK.format('raw_message')}, ' {w}'))" for w in ("purch", "user 1"))
filtering("search_words", Filter(search='purch* "user-1"', mode="words"), _WORDS)


FULL_TEXTS: dict[str, str] = {}


def full_text(name: str, text: str, where: str) -> None:
    FULL_TEXTS[name] = text
    of_documents(name, f"select doc_id, lang from (select doc_id, lang, {_TOK.format('text')} as tok from documents) where {where}")(lambda d: d.where(search.boolean_match(text, ("text",))).select("doc_id", "lang"))


full_text("search_fts_or", "idiot AND the OR élle worthless", "(contains(tok, ' idiot ') and contains(tok, ' the ')) or (contains(tok, ' elle ') and contains(tok, ' worthless '))")
full_text("search_fts_not", "of the NOT was", "contains(tok, ' of ') and contains(tok, ' the ') and not contains(tok, ' was ')")
full_text("search_fts_phrase", '"of the"', "contains(tok, ' of the ')")
full_text("search_fts_prefix", "wort* OR CIÓN*", "contains(tok, ' wort') or contains(tok, ' cion')")
full_text("search_fts_near", "NEAR(this was, 3)", r"regexp_matches(tok, ' this (?:\S+ ){0,3}was | was (?:\S+ ){0,3}this ')")
_PLACES = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i] = '{x}') as p{k}" for k, x in enumerate(("the", "of", "was")))
_CLOSE = " and ".join(f"len(list_filter(p{k}, lambda s: s between x - 5 and x)) > 0" for k in range(3))
full_text("search_fts_near3", "NEAR(the of was, 4)", f"doc_id in (select doc_id from (select doc_id, {_PLACES} from (select doc_id, string_split(trim({_TOK.format('text')}), ' ') as w from documents)) where len(list_filter(list_concat(list_concat(p0, p1), p2), lambda x: {_CLOSE})) > 0)")
of_documents("search_fts_accents", "select doc_id, lang from documents where text is not null and doc_id % 3 = 0")(
    lambda d: d.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Tiếng Việt").otherwise(" Ting"))).where(search.boolean_match("tieng AND VIÊ*", ("text",))).select("doc_id", "lang")
)

# The same searches by a stored index, which the first of them in a session makes of the table

_INDEXES: dict[tuple[str, str, str], str] = {}


def indexed(rows: DataFrame, name: str, sf_dir: str, columns: tuple[str, ...], key: str, day: Column | None = None) -> DataFrame:
    """Postings of rows; kept in the shared folder for the session's next searches."""
    spark = rows.sparkSession
    of = (spark.sparkContext.applicationId, name, sf_dir)
    if of not in _INDEXES or not exists(spark, _INDEXES[of]):
        path = new_folder(spark, f"postings-{name}")
        textindex.append(rows, path, columns, key, day)
        _INDEXES[of] = path
    return textindex.postings(spark, _INDEXES[of])


def full_text_indexed(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return textindex.found_by(docs, indexed(docs, "documents", sf_dir, ("text",), "doc_id"), text, "fts", "doc_id", 1).select("doc_id", "lang")

    QUERIES[f"{name}_indexed"], ORACLE_SQL[f"{name}_indexed"] = run, ORACLE_SQL[name]


for _name, _text in FULL_TEXTS.items():
    full_text_indexed(_name, _text)


def of_message_index(name: str, same: str) -> Callable[[Callable[[DataFrame, DataFrame], DataFrame]], None]:
    """Register a function of the messages and their postings, with the SQL of another query."""

    def register(f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            m = messages(spark, sf_dir)
            return f(m, indexed(m, "messages", sf_dir, search.BOTH, "id", F.to_date("timestamp")))

        QUERIES[name], ORACLE_SQL[name] = run, ORACLE_SQL[same]

    return register


of_message_index("search_words_indexed", "search_words")(lambda m, index: shown(textindex.found_by(m, index, 'purch* "user-1"', "words")))

# Joins, sorting, paging

of_messages("semi_join_hits", f"select {_SHOWN_SQL} from m where regexp_matches(message, 'user 7 ')")(lambda m: shown(query.with_hits(m, m.where(F.col("message").contains("user 7 ")).select("id"))))
of_messages("insert_or_ignore", f"select {_SHOWN_SQL} from m where seq % 3 <> 0")(lambda m: shown(dedup.not_yet(m.union(m.where("seq % 4 = 0")), m.where("seq % 3 = 0"))))


def by_files(m: DataFrame, search_for: str, mode: str) -> DataFrame:
    """A search that reads only those files of a store which can match."""
    spark = m.sparkSession
    path, summary = new_folder(spark, "store"), new_folder(spark, "grams")
    append(m, path)
    gramindex.update(spark, path, summary)
    return gramindex.matching(spark, path, summary, search_for, mode)


of_messages("search_regex_by_files", ORACLE_SQL["search_regex"].removeprefix(MESSAGES_SQL))(lambda m: shown(by_files(m, r"user \d{3} .*: 9\d\}", "regex")))
of_messages("search_text_by_files", ORACLE_SQL["search_text"].removeprefix(MESSAGES_SQL))(lambda m: shown(by_files(m, "USER 12", "text")))
of_message_index("semi_join_hits_indexed", "semi_join_hits")(lambda m, index: shown(query.with_hits(m, textindex.hits(index, search.boolean_query('"user 7"')))))


def appended(m: DataFrame) -> DataFrame:
    """What a second append to a store adds: ids of the first, and repeated ones, are left out by the index."""
    spark = m.sparkSession
    path, index = new_folder(spark, "store"), IdIndex(spark, new_folder(spark, "ids"), 8)
    append(m.where("seq % 3 = 0"), path, index=index)
    append(m.union(m.where("seq % 4 = 0")), path, index=index)
    return read_store(spark, path).where("seq % 3 <> 0")


of_messages("insert_or_ignore_indexed", ORACLE_SQL["insert_or_ignore"].removeprefix(MESSAGES_SQL))(lambda m: shown(appended(m)))
of_messages("dedup_by_id", f"select {_SHOWN_SQL}, seq from m")(lambda m: shown(dedup.first_by_id(m.union(m.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))), "seq"))
of_messages("count_filtered", "select count(*) as total from m where severity <= 4 and contains(hostname, 'host-1')")(lambda m: query.count_filtered(m, Filter(severities=(0, 1, 2, 3, 4), hostname="host-1")))


def paging(name: str, by: str, offset: int, size: int, f: Callable[[DataFrame], DataFrame], where: str = "true") -> None:
    of_messages(name, f"select {_SHOWN_SQL}, row_number() over (order by {by}) as pos from (select * from m where {where} order by {by} limit {size} offset {offset})")(lambda m: shown(f(m), "pos"))


paging("sort_by_severity", "severity, id", 0, 200, lambda m: query.query_page(m, size=200, sort_field="severity", direction="asc"))
paging("sort_by_hostname", "hostname desc, id desc", 0, 200, lambda m: query.query_page(m, size=200, sort_field="hostname", direction="down"))
paging("sort_by_message", "message, id", 0, 200, lambda m: query.query_page(m, size=200, sort_field="message", direction="asc"))
paging("page_messages", '"timestamp" desc, id desc', 400, 100, lambda m: query.query_page(m, Filter(search="user"), page=5, size=5000), "contains(message, 'user')")
paging("page_deep", '"timestamp" desc, id desc', 5000, 1000, lambda m: query.query_page(m, page=6, size=1000, deep=0))
paging("page_deep_hostname", "hostname, id", 3000, 1000, lambda m: query.query_page(m, page=4, size=1000, sort_field="hostname", direction="asc", deep=0))
paging("page_deep_message", "message desc, id desc", 2000, 500, lambda m: query.query_page(m, page=5, size=500, sort_field="message", deep=0))
paging("page_regex", "hostname, id", 50, 50, lambda m: query.regex_page(m, Filter(search=r"^\w+ by user 1\d ", mode="regex"), page=2, size=50, sort_field="hostname", direction="asc"), r"regexp_matches(message, '^\w+ by user 1\d ')")
of_messages("recent_buffer", f"select {_SHOWN_SQL}, row_number() over (order by received_at, seq) as pos from (select * from m order by received_at desc, seq desc limit 3000) where severity <= 4")(lambda m: shown(query.recent(m, Filter(severities=(0, 1, 2, 3, 4)), 3000), "pos"))

# Groups and statistics


def grouping(name: str, field: str, key: str) -> None:
    of_messages(name, f"select {key} as key, count(*) as count from m group by 1")(lambda m: groups.summary(m, field))


grouping("group_by_severity", "severity", "severity_label")
grouping("group_by_hostname", "hostname", "case when hostname = '' then 'unknown' else hostname end")
grouping("group_by_app", "appName", "case when app_name = '' then 'unknown' else app_name end")
grouping("group_by_source_ip", "sourceIP", "source_ip")
of_messages("group_share", "select case when hostname = '' then 'unknown' else hostname end as key, count(*) as count, round(least(100.0, count(*) * 100.0 / max(count(*)) over ()), 6)::double as width, cast(sum(count(*)) over () as bigint) as total from m group by 1")(lambda m: groups.shares(groups.summary(m, "hostname")))
of_messages("group_top_k", f"""select {_SHOWN_SQL}, case when app_name = '' then 'unknown' else app_name end as key, row_number() over (partition by app_name order by "timestamp" desc, id desc) as pos from m qualify pos <= 500""")(lambda m: shown(groups.top_of_each(m, "appName"), "key", "pos"))
of_messages("stats_total_by_level", "select severity_label, count(*) as count from m group by rollup (severity_label)")(stats.totals)
of_messages("severity_distribution", "select severity as pos, severity_label, count(*) as count, round(count(*) / greatest(1, max(count(*)) over ()), 6)::double as share from m group by 1, 2")(stats.severity_distribution)
of_messages("top_sources", "select coalesce(nullif(hostname, ''), source_ip) as hostname, count(*) as count from m group by 1 order by 2 desc, 1 limit 10")(stats.top_sources)
_TEXT_BYTES = " + ".join(f"strlen({c})" for c in stats.TEXTS)
of_messages("storage_stats", f"""select count(*) as message_count, cast(sum({_TEXT_BYTES}) as bigint) as text_bytes, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') as oldest from m""")(lambda m: stats.storage(m).withColumn("oldest", stamp("oldest")))
of_messages("storage_size_text", f"select hostname, case when b < 1048576 then printf('%.0f KB', b / 1024.0) when b < 1073741824 then printf('%.1f MB', b / 1048576.0) else printf('%.1f GB', b / 1073741824.0) end as size from (select hostname, sum({_TEXT_BYTES})::double as b from m group by 1 union all select 'all x 1024', sum({_TEXT_BYTES})::double * 1024 from m)")(
    lambda m: m.groupBy("hostname").agg(stats.text_bytes().alias("b")).unionByName(m.agg((stats.text_bytes() * 1024).alias("b")).withColumn("hostname", F.lit("all x 1024"))).select("hostname", stats.size_text(F.col("b") / (1 << 20)).alias("size"))
)
of_messages("capacity_estimate", f"select round(each, 6) as measured_bytes, 560 as fixed_bytes, cast(floor(1000000 * 560 / 1048576.0 + 0.5) as bigint) as fixed_mb, cast(floor(1000000 * each / 1048576 + 0.5) as bigint) as measured_mb, cast(500 * 1048576 // 560 as bigint) as fixed_fit, cast(floor(500 * 1048576 / each) as bigint) as measured_fit, cast(6048000 as bigint) as at_10_a_second, cast(60480000 as bigint) as at_100_a_second from (select sum({_TEXT_BYTES})::double / count(*) as each from m)")(stats.capacity)
of_messages("buffer_usage", "select least(count(*), 10000) as used, cast(10000 as bigint) as size, cast(floor(least(count(*), 10000) * 100.0 / 10000 + 0.5) as bigint) as percent from m")(stats.buffer_usage)
of_messages("rate_sliding", "select strftime(w, '%Y-%m-%d %H:%M:%S') as start, count(*) as count, count(*) / 10.0::double as rate from (select unnest(range(date_trunc('second', received_at) - interval 9 second, date_trunc('second', received_at) + interval 1 second, interval 1 second)) as w from m) group by 1")(
    lambda m: stats.rate(m).select(F.date_format("w.start", render.TIME).alias("start"), "count", "rate")
)
of_messages("rate_tumbling", "select strftime(date_trunc('hour', received_at), '%Y-%m-%d %H:%M:%S') as start, severity_label, count(*) as count from m group by 1, 2")(
    lambda m: stats.tumbling(m).select(F.date_format("w.start", render.TIME).alias("start"), "severity_label", "count")
)



def kept_counts(m: DataFrame) -> DataFrame:
    """The counts that a dashboard keeps, as batches of three parts of the messages leave them."""
    return reduce(DataFrame.unionByName, [rollup.counted(m.where(F.col("seq") % 3 == k)) for k in range(3)])


of_messages("rollup_by_minute", "select strftime(date_trunc('minute', received_at), '%Y-%m-%d %H:%M') as minute, severity_label, coalesce(nullif(hostname, ''), source_ip) as source, count(*) as count from m group by 1, 2, 3")(
    lambda m: kept_counts(m).groupBy(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "severity_label", "source").agg(F.sum("count").alias("count"))
)
of_messages("rollup_top_sources", ORACLE_SQL["top_sources"].removeprefix(MESSAGES_SQL))(lambda m: rollup.top_sources(kept_counts(m)))

# Retention

of_messages("retention_age", f"""select {_SHOWN_SQL} from m where "timestamp" >= timestamp '2024-01-24'""")(lambda m: shown(retention.by_age(m, NOW, 7)))
of_messages("retention_count", f"""select {_SHOWN_SQL} from m order by "timestamp" desc, id desc limit 2500""")(lambda m: shown(retention.by_count(m, 2500)))
_FITS = f"select count(*) as n, sum({_TEXT_BYTES}) as b from m"
of_messages("retention_size", f"""select {_SHOWN_SQL} from (select *, row_number() over (order by "timestamp" desc, id desc) as rn from m) r, ({_FITS}) t where t.b <= 1048576 or rn <= greatest(0, t.n - greatest(t.n // 10, 1000))""")(lambda m: shown(retention.by_size(m, 1)))
_KEPT = f"""k as (select *, row_number() over (order by "timestamp" desc, id desc) as rn, count(*) over () as n, sum({_TEXT_BYTES}) over () as b from (select * from m where "timestamp" >= timestamp '2024-01-11' order by "timestamp" desc, id desc limit 4000))"""
_POLICY_SQL = f"select {_SHOWN_SQL} from k where b <= 524288 or rn <= greatest(0, n - greatest(n // 10, 1000))"
of_messages("retention_policy", f", {_KEPT} {_POLICY_SQL}")(lambda m: shown(retention.apply(m, NOW, 20, 4000, 0.5)))


def cleaned(m: DataFrame) -> DataFrame:
    """What a store of these messages shows after a clean-up."""
    path = new_folder(m.sparkSession, "store")
    append(m, path)
    clean(m.sparkSession, path, NOW, Limits(20, 4000, 0.5, "text"))
    return read_store(m.sparkSession, path)


of_messages("retention_in_store", f", {_KEPT} {_POLICY_SQL}")(lambda m: shown(cleaned(m)))

# Alerts

_MATCHES_SQL = r""", h as (
 select m.*, 'r1' as rule_id, 'errors' as rule_name, 0 as rule_pos, 7200 as cooldown from m where severity <= 3 and (contains(lower(message), 'error') or contains(lower(raw_message), 'error'))
 union all select m.*, 'r2', 'some users', 1, 0 from m where contains(hostname, 'host-0') and (regexp_matches(message, '(?i)user (1|2)\d? ') or regexp_matches(raw_message, '(?i)user (1|2)\d? '))
 union all select m.*, 'r4', 'purchases', 3, 86400 from m where contains(lower(app_name), 'purch'))
"""
_FIRES_SQL = MESSAGES_SQL.replace("with m0", "with recursive m0", 1) + _MATCHES_SQL + """, n as (select rule_id, seq, received_at as t, cooldown, row_number() over (partition by rule_id order by received_at, seq) as k from h where cooldown > 0),
 g as (select a.rule_id, a.k, min(b.k) as nk from n a left join n b on b.rule_id = a.rule_id and b.t >= a.t + to_seconds(a.cooldown) group by 1, 2),
 f as (select rule_id, cast(1 as bigint) as k from n where k = 1 union all select g.rule_id, g.nk from f join g on g.rule_id = f.rule_id and g.k = f.k where g.nk is not null),
 fired as (select h.* from h join n on n.rule_id = h.rule_id and n.seq = h.seq join f on f.rule_id = n.rule_id and f.k = n.k union all select * from h where cooldown = 0),
 ev as (select rule_id || ':' || cast(seq as varchar) as id, rule_id as "ruleId", rule_name as "ruleName", message, severity_label as severity, hostname, received_at as t, seq, rule_pos from fired)
"""


def hits(m: DataFrame) -> DataFrame:
    return alerts.matches(m, alerts.rules_frame(m.sparkSession, RULES))


def told(m: DataFrame) -> DataFrame:
    return alerts.events(alerts.fired(hits(m)))


def of_fires(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    def register(f: Callable[[DataFrame], DataFrame]) -> None:
        of_messages(name, "")(f)
        ORACLE_SQL[name] = _FIRES_SQL + sql

    return register


of_messages("alert_matches", _MATCHES_SQL + "select seq, rule_id, rule_name, rule_pos from h")(lambda m: hits(m).select("seq", "rule_id", "rule_name", "rule_pos"))
_MANY = [{"id": f"u{k}", "name": "user", "pattern": f"USER {k} ", "minSeverity": k % 8, "hostname": "host" if k % 2 else ""} for k in range(100)]
of_messages("alert_matches_many", """ select seq, 'u' || k as rule_id, cast(k as int) as rule_pos from m, range(100) r(k) where severity <= k % 8 and (k % 2 = 0 or contains(hostname, 'host')) and (contains(lower(message), 'user ' || k || ' ') or contains(lower(raw_message), 'user ' || k || ' '))""")(
    lambda m: alerts.matches(m, alerts.rules_frame(m.sparkSession, _MANY)).select("seq", "rule_id", "rule_pos")
)
of_fires("alert_cooldown", "select rule_id, seq from fired where cooldown > 0")(lambda m: alerts.fired(hits(m)).where("cooldown > 0").select("rule_id", "seq"))
of_fires("alert_no_cooldown", "select rule_id, seq from fired where cooldown = 0")(lambda m: alerts.fired(hits(m)).where("cooldown = 0").select("rule_id", "seq"))
_TRANSPORTS = ("UDP", "TCP", "TLS")


def received(m: DataFrame) -> DataFrame:
    """The messages as the lines of three transports bring them."""
    lines = lines_of(m)
    return parse.parse(union_transports(*[lines.where(F.col("protocol") == p).drop("id") for p in _TRANSPORTS]))


of_fires("alert_cooldown_union", f"select rule_id, seq * 3 + case protocol {' '.join(f"when '{p}' then {k}" for k, p in enumerate(_TRANSPORTS))} end as seq from fired where rule_id = 'r1'")(lambda m: alerts.fired(hits(received(m)).where("rule_id = 'r1'")).select("rule_id", "seq"))
_EVENT = """id, "ruleId", "ruleName", message, severity, hostname, strftime(t, '%Y-%m-%d %H:%M:%S.%f') as t"""
_event = ["id", "ruleId", "ruleName", "message", "severity", "hostname"]
of_fires("alert_events", f"select {_EVENT} from ev")(lambda m: told(m).select(*_event, stamp("timestamp").alias("t")))
of_fires("alert_history", f"select {_EVENT.replace('(t,', '(l.t,')}, row_number() over (order by l.t, seq, rule_pos) as pos from (select * from ev order by t desc, seq desc, rule_pos desc limit 500) l")(lambda m: alerts.history(told(m)).select(*_event, stamp("timestamp").alias("t"), "pos"))
_SIGNS = " ".join(f"when {k!r} then {v!r}" for k, v in alerts.ICONS.items())
of_fires("alert_notification", f"""select id, case severity {_SIGNS} else '{alerts.BELL}' end || ' ' || "ruleName" as title, severity || ' on ' || coalesce(nullif(hostname, ''), 'unknown host') || chr(10) || case when length(message) > 120 then substr(message, 1, 117) || '...' else message end as body from ev""")(lambda m: alerts.notifications(told(m)))
