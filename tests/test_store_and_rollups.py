"""Clean-up in the store, counts by minute, chained rates, many rules, the file summary: each against the plain operator."""

import random
import re
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.operators import alerts, gramindex, retention, stats, textindex
from logspark.operators.filters import Filter, filtered
from logspark.operators.idindex import IdIndex
from logspark.plans.messages import RULES, messages
from logspark.sources import cleanup, lines, sinks
from logspark.sources.cleanup import Limits
from logspark.streaming import live, rollup
from tests.conftest import SF_DIR
from tests.test_io_and_streams import NOW, parts, ran

AT = datetime(2024, 1, 31, tzinfo=timezone.utc)


def ids(d):
    return sorted(r.id for r in d.select("id").collect())


@pytest.mark.parametrize("limits", [Limits(20, 0, 0), Limits(0, 137, 0), Limits(0, 0, 0.1, "text"), Limits(20, 400, 0.05, "text"), Limits(0, 0, 1e-6, "text"), Limits(400, 10**6, 10**6), Limits(0, 0, 0), Limits(0, 10**6, 0.01)], ids=str)
def test_clean_is_the_plain_policy(spark, tmp_path, limits):
    m, path = messages(spark, SF_DIR), str(tmp_path / "store")
    sinks.append(m.where("seq % 2 = 0"), path)
    sinks.append(m.where("seq % 2 = 1"), path)
    cleanup.clean(spark, path, AT, limits)
    if limits.measure == "text" or limits.most_mb in (0, 10**6):
        assert ids(lines.read_store(spark, path)) == ids(retention.apply(m, AT, limits.days, limits.most, limits.most_mb))
    else:  # the files are larger than that
        assert lines.read_store(spark, path).count() == max(0, m.count() - 1000)


def test_clean_deletes_whole_days_and_hides_the_rest(spark, tmp_path):
    m, path = messages(spark, SF_DIR), str(tmp_path / "store")
    index = IdIndex(spark, str(tmp_path / "ids"), 4)
    sinks.append(m, path, index=index)
    textindex.append(m, str(tmp_path / "text"), day=F.to_date("timestamp"))
    cut = cleanup.clean(spark, path, AT, Limits(0, 300, 0), index, str(tmp_path / "text"))
    kept = ids(retention.by_count(m, 300))
    left = [p.name.removeprefix("event_date=") for p in (tmp_path / "store").glob("event_date=*")]
    assert min(left) == cut.day and ids(lines.read_store(spark, path)) == kept and index.ids().where(F.col("event_date") < cut.day).count() == 0
    assert {p.name for p in (tmp_path / "text").glob("event_date=*")} == {f"event_date={d}" for d in left}
    raw = spark.read.parquet(path).count()
    assert raw > 300
    cleanup.rewrite_cut_day(spark, path)
    assert spark.read.parquet(path).count() == 300 and ids(lines.read_store(spark, path)) == kept
    cleanup.clean(spark, path, AT, Limits(0, 100, 0))  # a second one goes on from there
    assert ids(lines.read_store(spark, path)) == ids(retention.by_count(m, 100))
    assert cleanup.clean(spark, path, AT, Limits(0, 200, 0)) == lines.cut_of(spark, path) and lines.read_store(spark, path).count() == 100


@pytest.mark.parametrize("broken", ["put_json", "remove"])
def test_clean_that_breaks_off_leaves_a_store_to_read(spark, tmp_path, monkeypatch, broken):
    m, path = messages(spark, SF_DIR), str(tmp_path / "store")
    sinks.append(m, path)
    with monkeypatch.context() as p:
        p.setattr(cleanup, broken, lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            cleanup.clean(spark, path, AT, Limits(0, 300, 0))
    assert ids(lines.read_store(spark, path)) == ids(m if broken == "put_json" else retention.by_count(m, 300))
    cleanup.clean(spark, path, AT, Limits(0, 300, 0))
    assert ids(lines.read_store(spark, path)) == ids(retention.by_count(m, 300))


def test_rewrite_that_breaks_off(spark, tmp_path, monkeypatch):
    m, path = messages(spark, SF_DIR), str(tmp_path / "store")
    sinks.append(m, path)
    cut = cleanup.clean(spark, path, AT, Limits(0, 300, 0))
    real, day = cleanup.remove, tmp_path / "store" / f"event_date={cut.day}"
    with monkeypatch.context() as p:
        p.setattr(cleanup, "remove", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            cleanup.rewrite_cut_day(spark, path)
    real(spark, str(day))  # as if the folder had been taken away and not yet put back
    assert ids(lines.read_store(spark, path)) == ids(retention.by_count(m, 300))
    cleanup.rewrite_cut_day(spark, path)
    assert ids(lines.read_store(spark, path)) == ids(retention.by_count(m, 300)) and not (tmp_path / "store" / "_retention" / "day.rewrite").exists()


def test_rate_counts_seconds_first(spark):
    m = messages(spark, SF_DIR)
    for seconds, step in ((10, 1), (10, 4), (6, 6)):
        chained, direct = (stats.rate(m, seconds, step, c) for c in (True, False))
        assert chained.exceptAll(direct).count() == 0 and direct.exceptAll(chained).count() == 0 and chained.count() == direct.count()


def test_chained_rates_in_a_stream(spark, tmp_path):
    m = messages(spark, SF_DIR)
    end = m.agg(F.max("received_at").alias("t")).first().t
    last = m.limit(1).withColumn("received_at", F.lit(end) + F.expr("interval 10 days"))  # moves the clock on
    for k, d in enumerate((m.where("seq % 2 = 0"), m.where("seq % 2 = 1"), last)):
        d.coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for p in (tmp_path / f"s{k}").glob("part-*"):
            p.rename(tmp_path / "in" / f"{k}-{p.name}")
        stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
        out = live.rates(stream, delay="100 days" if k < 2 else "1 minute", chained=True)
        ran(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(**NOW).start())
    got, want = spark.read.parquet(str(tmp_path / "out")), stats.rate(m)
    assert got.count() == want.count() and got.select("w.start", "count").exceptAll(want.select("w.start", "count")).count() == 0


def test_rollups_over_restarts(spark, tmp_path):
    m, _ = parts(spark, tmp_path)
    path, seen = str(tmp_path / "counts"), []
    for k in range(3):
        for p in list((tmp_path / "in").glob("part-*"))[:1]:
            (tmp_path / "now").mkdir(exist_ok=True)
            p.rename(tmp_path / "now" / p.name)
        stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "now"))
        ran(rollup.keep(stream, path, str(tmp_path / "cp"), lambda a, b: seen.append((a.collect(), b.collect())), NOW))
        if k == 1:
            rollup.merge(spark, path)
            for p in (tmp_path / "cp" / "commits").glob("*1*"):  # the batch before runs again, although it's merged
                p.unlink()
    every = rollup.read(spark, path)
    assert sorted(map(str, rollup.totals(every).collect())) == sorted(map(str, stats.totals(m).collect()))
    assert rollup.top_sources(every).collect() == stats.top_sources(m).collect() == seen[-1][1]
    rollup.merge(spark, path)
    rollup.merge(spark, path)
    assert rollup.read(spark, path).exceptAll(rollup.counted(m)).count() == 0 and rollup.read(spark, path).count() == rollup.counted(m).count()
    some = rollup.between(rollup.read(spark, path), "2024-01-10", "2024-01-12")
    assert rollup.totals(some).where("severity_label is null").first()["count"] == m.where("received_at >= '2024-01-10' and received_at < '2024-01-12'").count()
    assert rollup.totals(rollup.read(spark, str(tmp_path / "none"))).count() == 0


def test_many_rules_are_looked_for_together(spark):
    m, draw = messages(spark, SF_DIR), random.Random(3)
    rules = [{"id": f"x{k}", "name": str(k), "pattern": draw.choice(["user {}", "USER {} ", "props", "{}", "none {}"]).format(k % 170), "minSeverity": draw.choice([-1, 3, 7]), "hostname": draw.choice(["", "HOST-1"]), "appName": draw.choice(["", "", "Click"])} for k in range(300)]
    frame = alerts.rules_frame(spark, rules + RULES)
    order = ["seq", "rule_id", "rule_name", "rule_pos", "cooldown"]
    together, alone = (alerts.matches(m, frame, many).select(order) for many in (24, 10**6))
    assert together.count() == alone.count() > 1000 and together.exceptAll(alone).count() == 0


def test_literal_runs():
    for pattern, want in ((r"user \d{3} .*: 9\d\}", ["user ", ": 9"]), (r"\p{L}abc", []), (r"\x41abc", []), (r"\\xabc", ["\\xabc"]), (r"\Qa.c\E", []), (r"\babc\b", ["abc"]), ("abc|def", []), ("(abc)def", ["def"]), ("abcd?e", ["abc"]), ("abcd+efg", ["abcd", "efg"]), (r"a\.bc", ["a.bc"]), ("^Error$", ["error"]), ("[abc]def", ["def"]), ("ab", []), ("abc{2}d", []), (r"x\wabc", ["abc"]), ("[]x]abc", ["abc"]), ("(?s)abc", [])):
        assert [r for r in gramindex.literal_runs(pattern)] == want, pattern


@settings(max_examples=400, deadline=None)
@given(st.text("abc.d ", max_size=12), st.lists(st.sampled_from(["a", "b", "c", "d", r"\.", ".", " ", "ab", "abc", "[ab]", "[^c]", "a?", "b*", "c+", "a{2}", "(ab)", "(a)?", r"\w", r"\s*", "d{1,2}"]), max_size=7))
def test_runs_stand_in_every_match(text, items):
    pattern = "".join(items)
    if re.search(pattern, text, re.I):
        assert all(r in text.lower() for r in gramindex.literal_runs(pattern))


def test_file_summary(spark, tmp_path):
    m, store, path = messages(spark, SF_DIR), str(tmp_path / "store"), str(tmp_path / "grams")
    sinks.append(m.where("seq % 2 = 0"), store)
    gramindex.update(spark, store, path)
    gramindex.update(spark, store, path)
    sinks.append(m.where("seq % 2 = 1"), store)
    for known in (False, True):
        for search, mode in (("USER 12", "text"), ("us", "text"), ("no such text", "text"), (r"user 1\d .*: 9\d\}", "regex"), (r"^signup by user 7 ", "regex"), ("[invalid", "regex")):
            got = gramindex.matching(spark, store, path, search, mode)
            assert ids(got) == ids(filtered(m, Filter(search=search, mode=mode))), search
        gramindex.update(spark, store, path)
    one = m.limit(1).withColumns({"id": F.lit("zebra"), "message": F.lit("a quite unusual Zebra")})
    sinks.append(one, store)
    gramindex.update(spark, store, path)
    every = gramindex.possible_files(spark, store, path, [])
    some = gramindex.possible_files(spark, store, path, ["unusual zebra"])
    assert len(every) > 10 and len(some) == 1 and gramindex.possible_files(spark, store, path, ["no such text"]) == []
    found = gramindex.matching(spark, store, path, "unusual z.bra$", "regex")
    assert {gramindex._plain(f) for f in found.inputFiles()} == set(some) and ids(found) == ["zebra"]
