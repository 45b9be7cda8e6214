"""Each pipeline stage on odd rows: nulls in every column, empty and very long texts, ties, repeats, no rows, names that clash."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

PLAIN = (
    "In the morning the old baker went down to the river with his two dogs, and he sat for an hour on a stone that the water had worn smooth. "
    "It was not a day for work, as he had said to you the night before; this was the time of year when the people of the town have their feast, "
    "and by noon all the bells would be heard from the hill at the far end of the valley."
)
ROWS = [
    (1, None, "en", "s"), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, "one", "xx", "s"), (5, PLAIN, "en", "s"), (6, PLAIN, "en", "s"), (7, PLAIN + " And more.", None, None),
    (8, "Mail anna.weber@example.org or call. " + PLAIN.replace("morning", "night"), "en", "s"), (8, "Mail anna.weber@example.org or call. " + PLAIN.replace("morning", "night"), "en", "s"),
    (8, "another text with the same id " + PLAIN.replace("morning", "dark").replace("people", "crowd").replace("river with", "mill without").replace("stone that", "bench where").replace("bells", "drums"), "en", "s"), (None, PLAIN, "en", "s"), (None, None, None, None),
    (9, "long words here " * 30_000, "en", "s"), (10, "y" * 60_000, "de", "s"),
]
ADDED = "row int, bucket int, node long, kept string, removed string, entities int, size string, sequence_id int, lot int, __row string, keys int"


@pytest.fixture(scope="module")
def odd(spark):
    plain = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    clash = [F.lit(1).cast(t).alias(n) for n, t in (x.split() for x in ADDED.split(", "))]
    return plain.select("*", *clash)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, name, stage):
    found = stage(spark, odd, "")
    rows = found.collect()
    assert stage(spark, odd.limit(0), "").count() == 0
    if name == "packed_sequences":
        assert {r.doc_id for r in rows} == {r[0] for r in ROWS} and sum(r.piece == 0 for r in rows) == len(ROWS)
        return
    assert found.columns == odd.columns
    texts = [(r.doc_id, r.text) for r in rows]
    if name == "quality_rules":  # too short, or nothing but repeats: gone; plain English stays, with every row of it
        assert {d for d, _ in texts} == {5, 6, 7, 8, None} and sum(d == 8 for d, _ in texts) == 3
    elif name == "near_dedup":
        assert sorted(str(d) for d, _ in texts) == sorted(map(str, [1, 4, 5, 9, 10, None, None]))  # 8 is near 5
    else:
        assert sorted(str(d) for d, _ in texts) == sorted(str(r[0]) for r in ROWS)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "private_data":
            assert not any("anna.weber@example.org" in (t or "") for _, t in texts) and sum("@" in (t or "") for _, t in texts) == 2
            assert sorted(t or "" for d, t in texts if d in (5, 6)) == [PLAIN, PLAIN]


def test_stages_one_after_the_other(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), odd.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} == {5, None}
