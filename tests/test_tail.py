"""Lines of growing files: every one arrives once, whatever the pieces, and a replay adds none."""

import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logspark.functions import search
from logspark.functions.parse import parse
from logspark.operators import textindex
from logspark.operators.idindex import IdIndex
from logspark.sources import lines, tail
from logspark.streaming import live
from tests.test_io_and_streams import NOW, ran


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"a\n\nb", b"\n\n\n", b"same\nsame\nsame\n", "ü\n文字\n🙂".encode(), b"x" * 50 + b"\ny\n" + b"z" * 70])
def test_pieces_give_every_line_once(text, monkeypatch):
    monkeypatch.setattr(tail, "_BLOCK", 7)
    want, at = [], 0
    for line in text.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    if not want[-1][1]:
        want.pop()
    for size in (1, 2, 3, 5, 8, 1000):
        got = [r for first in range(0, len(text), size) for r in tail.lines_of(io.BytesIO(text), tail.Piece("f", 0, first, min(first + size, len(text)), len(text), 0))]
        assert got == want, size


def test_pieces_of_a_later_range():
    draw = random.Random(2)
    text = b"\n".join(bytes(draw.choices(b"ab ", k=draw.randint(0, 9))) for _ in range(300)) + b"\n"
    start = text.index(b"\n", 500) + 1
    for size in (1, 4, 64, 5000):
        got = [line for first in range(start, len(text), size) for _, line in tail.lines_of(io.BytesIO(text), tail.Piece("f", start, first, min(first + size, len(text)), len(text), 0))]
        assert got == text[start:].split(b"\n")[:-1]


def put(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def test_equal_lines_all_arrive_and_a_replay_adds_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.log", "<13>same\n" * 3 + "\n<13>other\n")
    put(tmp_path / "in" / "b.log", "<13>same\n<13>same")
    os.utime(tmp_path / "in" / "a.log", (10**9, 10**9))
    os.utime(tmp_path / "in" / "b.log", (10**9, 10**9))
    store, ids = str(tmp_path / "store"), IdIndex(spark, str(tmp_path / "ids"), 4)
    for k, options in enumerate(({"ignore_known": True}, {"ids": ids}, {"ids": ids})):
        where = store if not k else f"{store}-indexed"
        for _ in range(2):  # the second time from the start, without the first one's checkpoint
            ran(live.ingest(lines.stream_lines(spark, str(tmp_path / "in"), "TCP"), where, str(tmp_path / f"cp{k}{_}"), NOW, **options))
            got = [r.message for r in lines.read_store(spark, where).collect()]
            assert sorted(got) == ["other"] + ["same"] * 5
    stream = live.deduplicated(parse(lines.stream_lines(spark, str(tmp_path / "in"), "TCP")), "1 day")
    ran(stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cpd")).trigger(**NOW).start())
    assert spark.table("deduped").count() == 6


def test_files_that_grow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, store, cp = tmp_path / "in" / "a.log", str(tmp_path / "store"), str(tmp_path / "cp")
    run = lambda settle: ran(live.ingest(lines.stream_lines(spark, str(tmp_path / "in"), "TCP", settle=settle), store, cp, NOW))
    said = lambda: [r.message for r in lines.read_store(spark, store).orderBy("seq").collect()]
    put(log, "<13>one\n<13>tw")
    run(3600)
    assert said() == ["one"]
    put(log, "o\n<13>one\n", "a")
    put(tmp_path / "in" / ".hidden", "<13>no\n")
    run(3600)
    assert said() == ["one", "two", "one"]
    put(log, "<13>last", "a")
    run(3600)
    assert len(said()) == 3
    os.utime(log, (time.time() - 7200,) * 2)
    run(3600)
    assert said() == ["one", "two", "one", "last"]
    seqs = [r.seq for r in lines.read_store(spark, store).orderBy("seq").collect()]
    assert seqs == [0, 8, 16, 24]


def test_ingest_keeps_the_text_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        put(tmp_path / "in" / f"{k}.log", f"<13>disk {k} full\n<13>all well\n")
        ran(live.ingest(lines.stream_lines(spark, str(tmp_path / "in"), "TCP"), str(tmp_path / "store"), str(tmp_path / "cp"), NOW, ids=IdIndex(spark, str(tmp_path / "ids"), 2), postings=str(tmp_path / "text")))
    stored = lines.read_store(spark, str(tmp_path / "store"))
    found = textindex.found_by(stored, textindex.postings(spark, str(tmp_path / "text")), '"disk 1" OR well')
    assert sorted(r.message for r in found.collect()) == sorted(r.message for r in stored.where(search.boolean_match('"disk 1" OR well')).collect()) == ["all well", "all well", "disk 1 full"]


def test_kafka_lines_have_one_order(spark):
    rows = [(b"10.0.0.1", b"<13>same", "t", p, o) for p in (0, 1, 5000, (1 << 20) - 1) for o in (0, 1, 1 << 40)]
    records = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    got = parse(lines.kafka_lines(records)).collect()
    assert len({r.seq for r in got}) == len({r.id for r in got}) == len(rows) and all(r.seq >= 0 and r.source_ip == "10.0.0.1" for r in got)
    with pytest.raises(Exception, match="too many partitions"):
        lines.kafka_lines(records.withColumn("partition", F.lit(1 << 20))).collect()


def test_transports_with_and_without_ids(spark):
    texts = spark.createDataFrame([("<13>a",), ("<13>b",)], "value string")
    both = parse(lines.union_transports(lines.raw_lines(texts, "UDP", id=F.concat(F.lit("own-"), "value")), lines.raw_lines(texts, "TCP"))).collect()
    assert len({r.id for r in both}) == 4 and sum(r.id.startswith("own-") for r in both) == 2
