"""The pipeline's near copies: recall on planted copies, precision by brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_of_every_size_go(spark):
    import corpus_pipeline

    pick, rows, near = random.Random(6), [], set()
    for k in range(150):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(pick.choice([50, 80, 200, 600]))]
        copy = list(words)
        for at in pick.sample(range(len(copy)), pick.randint(1, max(1, len(copy) // 40))):
            copy[at] = f"x{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            near.add(2 * k + 1)
    assert 50 < len(near) < 150  # copies that stay are there too
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == [i for i, _ in rows if i not in near]


def test_odd_texts(spark):
    from logspark.llm import near_copies

    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "x y z " * 9000), (7, "q"), (7, "r"), (None, "a b"), (None, "a b")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 6, 7, None, None]))
    assert near_copies.drop_near_copies(kept.limit(0)).count() == 0


def test_groups_found_otherwise_join(spark):
    """A text linked to one copy by shingles and to another by a given group goes with both."""
    from logspark.llm import near_copies

    words = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(words)), (3, " ".join([*words, "more"])), (1, "something else altogether"), (2, "and another text"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(5, 1), (1, 1), (3, 3), (2, 2), (None, 2)], "doc_id long, component_id long")
    assert sorted(str(r.doc_id) for r in near_copies.drop_near_copies(docs, groups=groups).collect()) == ["1", "2", "None"]
