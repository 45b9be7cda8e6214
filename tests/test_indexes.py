"""The text index and the id index against plain evaluation, after several appends."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from logspark.functions import search
from logspark.operators import textindex
from logspark.operators.idindex import IdIndex
from logspark.plans.messages import messages
from logspark.session import get_json, put_json
from logspark.sources import lines, sinks
from tests.conftest import SF_DIR


def plan(df, kind="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(kind)
    return out.getvalue()


TEXTS = [
    (1, "error on disk; disk full", "a b"), (2, "Élan vital du café", ""), (3, None, None), (4, "", " \t "), (5, "no error", "disk of error error on"), (6, "on error on disk", None),
    (7, "the " * 3000 + "end", "x"), (8, "error on disk; disk full", "a b"), (8, "error on disk; disk full", "a b"), (9, "erro rs dis k", "errors"),
]
ASKED = ["error", "erro*", '"error on"', '"error on dis"*', "error NOT full", "disk AND (full OR elan)", "NEAR(error full, 2)", "NEAR(error full, 1)", 'NEAR("error on" disk, 0)', "cafe vital", "nothing OR end", "nothing end", '"on error"', '"---"', '"the the end"', "a b"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, message string, raw_message string").withColumn("day", F.when(F.col("id") % 2 == 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("date"))


@pytest.mark.parametrize("rare", [0, 10**6])
def test_text_index(spark, texts, tmp_path, rare):
    path = str(tmp_path / "index")
    textindex.append(texts.where("id < 5"), path, day=F.col("day"), bytes_a_file=20)
    textindex.append(texts.where("id >= 5"), path, day=F.col("day"), bytes_a_file=4000)
    textindex.append(texts.where("id >= 5"), path, day=F.col("day"))  # a batch that ran again
    for merged in (False, True):
        for q in ASKED:
            got = sorted(r.id for r in textindex.hits(textindex.postings(spark, path), search.boolean_query(q), rare=rare).collect())
            assert got == sorted({r.id for r in texts.where(search.boolean_match(q)).collect()}), q
        textindex.merge_day(spark, path, "2024-01-02")
    assert {r[0] for r in textindex.postings(spark, path).groupBy("id", "token", "field", "place").count().where("count > 1 and id % 2 = 0").collect()} == set()


def test_text_index_append_leaves_the_old_files(spark, texts, tmp_path):
    path = tmp_path / "index"
    textindex.append(texts.where("id < 5"), str(path))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("part-*")}
    textindex.append(texts.where("id >= 5"), str(path))
    assert before.items() <= {p: p.stat().st_mtime_ns for p in path.rglob("part-*")}.items()


def test_text_index_reads_its_tokens_only(spark, texts, tmp_path):
    path = str(tmp_path / "index")
    textindex.append(texts, path, day=F.col("day"))
    found = textindex.hits(textindex.postings(spark, path).where("event_date = date'2024-01-01'"), search.boolean_query("error OR erro*"))
    told = plan(found)
    assert "EqualTo(token,error)" in told and "StringStartsWith(token,erro)" in told and "PartitionFilters: [isnotnull(event_date" in told and "message" not in told
    words = textindex.found_by(texts, textindex.postings(spark, path), "err di", "words")
    assert sorted(r.id for r in words.collect()) == sorted(r.id for r in texts.where(search.words_match("err di")).collect())
    assert textindex.found_by(texts, textindex.postings(spark, path), " ", "words").count() == len(TEXTS)
    assert textindex.hits(textindex.postings(spark, path), search.boolean_query('"---"')).count() == 0


def ids(spark, first, last):
    return spark.range(first, last).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("event_date"))


def test_id_index(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), 8)
    assert index.known(ids(spark, 0, 10)).count() == 0
    for k in range(3):
        new = ids(spark, k * 100, k * 100 + 150)
        index.add(new.join(index.known(new), "id", "left_anti"))
    assert index.ids().count() == 350 == index.ids().select("id").distinct().count()
    index = IdIndex(spark, str(tmp_path / "ids"), 99)
    assert index.buckets == 8 and index.known(ids(spark, 340, 700)).count() == 10 and index.known(ids(spark, 1000, 1400)).count() == 0
    assert index.passed(ids(spark, 1000, 3000)).count() < 400  # of 2000 strange ids, 20 days and several filters
    index.merge_day("2024-01-03")
    assert index.ids().count() == 350 and index.known(ids(spark, 0, 500)).count() == 350
    index.drop_before("2024-01-11")
    assert index.known(ids(spark, 0, 500)).count() == index.ids().count() == 170
    assert index.known(ids(spark, 0, 0)).count() == 0


def test_id_index_does_not_shuffle_what_is_stored(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), 8)
    index.add(ids(spark, 0, 2000))
    many = index.known(ids(spark, 0, 300))
    told = plan(many, "simple").split("Batched")[0]
    assert "ShuffledHashJoin" in told and "Exchange" not in told  # nothing between the join and the stored ids
    few = index.known(ids(spark, 0, 2))
    assert few.count() == 2 and "SelectedBucketsCount: 2 out of 8" in plan(few) or "SelectedBucketsCount: 1 out of 8" in plan(few)


def test_append_writes_cells_of_new_ids_only(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), 8)
    index.add(ids(spark, 0, 200))
    before = set((tmp_path / "ids").rglob("part-*"))
    index.add(ids(spark, 200, 201))
    added = set((tmp_path / "ids").rglob("part-*")) - before
    assert len(added) == 2 and {p.parent.name for p in added} == {"event_date=2024-01-01"}  # one file of ids, one of filters


def test_store_with_index(spark, tmp_path):
    m, path = messages(spark, SF_DIR).where("seq < 400"), str(tmp_path / "store")
    index = IdIndex(spark, str(tmp_path / "ids"), 4)
    for a, b in ((0, 200), (100, 300), (0, 400), (0, 400)):
        sinks.append(m.where(f"seq >= {a} and seq < {b}").unionByName(m.where(f"seq = {a}")), path, index=index)
        assert lines.read_store(spark, path).count() == index.ids().count() == b if b > a else True
    stored = lines.read_store(spark, path)
    assert stored.drop("event_date").exceptAll(m).count() == 0 and stored.count() == 400


def test_append_that_broke_between_store_and_index(spark, tmp_path, monkeypatch):
    m, path = messages(spark, SF_DIR).where("seq < 60"), str(tmp_path / "store")
    index = IdIndex(spark, str(tmp_path / "ids"), 4)
    sinks.append(m.where("seq < 20"), path, index=index)
    with monkeypatch.context() as p:
        p.setattr(IdIndex, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.append(m.where("seq < 40"), path, index=index)
    sinks.append(m, path, index=index)  # the batch again, and more
    assert lines.read_store(spark, path).count() == 60 == index.ids().count()


def test_small_files_appear_whole(spark, tmp_path):
    put_json(spark, str(tmp_path / "x" / "a.json"), {"k": ["ü", 1]})
    assert get_json(spark, str(tmp_path / "x" / "a.json")) == {"k": ["ü", 1]}
    with pytest.raises(FileExistsError):
        put_json(spark, str(tmp_path / "x" / "a.json"), 1)
    assert get_json(spark, str(tmp_path / "x" / "a.json")) == {"k": ["ü", 1]}
