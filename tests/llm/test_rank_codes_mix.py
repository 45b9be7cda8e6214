"""Ranked search, vector codes and mixing against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from logspark.llm import lexical_rank, mixing, queries, vector_codes
from logspark.llm.common import importable
from tests.conftest import SF_DIR

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, size int, term string, item string"


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["Élan", "ÉLAN", "straße", "文字", "x1"]
    line = lambda n: draw.choice([" ", "-", ", "]).join(draw.choice(words) for _ in range(n))
    texts = [line(draw.randint(1, 40)) for _ in range(60)] + [None, "", " \t\n", "...", "w1", "W1 w1", "W1 w1", line(30_000), "y" * 40_000, "w1w2 w1_w2 w1\x00w3 w1\x7f w1é"]
    rows = [(None if i % 23 == 5 else i // 2 if i > 66 else i, t, "en", "ab" if i % 3 else None if i % 2 else "Zeta" if i % 5 else "é" if i % 4 else "", None, 1, 2, "t", "u") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3] + rows[:1], DOCS)


def terms(text):
    return [m.translate(str.maketrans(lexical_rank.UPPER, lexical_rank.LOWER)) for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_rank(docs, items, top):
    held = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n, length, df = len(held), sum(k for _, _, k in held), Counter(t for _, c, _ in held for t in c)
    out = []
    wanted = {}
    for i, t in dict.fromkeys(items):
        wanted.setdefault(i, Counter()).update(terms(t))
    for i, q in wanted.items():
        scores = []
        for d, c, k in held:
            m = 100 - 25 + 25 * k * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


ITEMS = [(1, "w1 w2 W2"), (2, "élan Straße"), (2, "文字"), (2, "文字"), (3, None), (4, "!!"), (5, "none such"), (None, "w3"), (None, "w4 w3"), (6, "w1w2 x1 w1")]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_rank(spark, docs, block):
    items = spark.createDataFrame([(i, t, 1, "b") for i, t in ITEMS], "item_id long, text string, doc_id int, term string")
    got = lexical_rank.ranked(docs, items, top=4, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_rank([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS, 4)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_rank_cuts_candidates(spark, docs, monkeypatch):
    """A task that keeps few candidates loses none of the best."""
    monkeypatch.setattr(lexical_rank, "KEPT_ROWS", 1)
    best = lexical_rank._Best(3, 2)
    draw, every = random.Random(1), []
    for key in range(400):
        import numpy as np

        scores = np.array([draw.randint(0, 6) for _ in range(3)])
        best.offer(key if key % 9 else None, scores)
        every += [(i, -s, not key % 9, key if key % 9 else 0) for i, s in enumerate(scores.tolist()) if s > 0]
    items, scores, absent, keys = best.cut()
    for i in range(3):
        want = sorted(x[1:] for x in every if x[0] == i)[:2]
        assert [(-s, a, k) for j, s, a, k in zip(items, scores, absent, keys) if j == i] == want


def test_rank_empty(spark, docs):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_rank.ranked(docs.limit(0), items).count() == 0
    assert lexical_rank.ranked(docs, items.limit(0)).count() == 0
    assert lexical_rank.ranked(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def brute_codes(rows, parts, entries, rounds):
    """All comparisons in every round."""
    ok = [(k, lab, [math.floor(4096 * x) for x in v]) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted([r for r in ok if r[2]], key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(first[0][2])
    width = -(-length // parts)
    fit = [r for r in ok if len(r[2]) == length]
    cut = lambda v: [(v + [0] * (parts * width - length))[p * width : (p + 1) * width] for p in range(parts)]
    xs = [cut(v) for _, _, v in fit]
    books = [[cut(v)[p] for _, _, v in [r for r in first if len(r[2]) == length][:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(x[p], books[p])[1] for x in xs]
            for k in range(len(books[p])):
                mine = [x[p] for x, a in zip(xs, at) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in xs]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(fit, errors):
        by_label[r[1]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    digits = 2 if entries <= 256 else 3
    out = [(r[0], "".join(f"{k:0{digits}x}" for _, k in f), e, by_label[r[1]], sha) for r, f, e in zip(fit, found, errors)]
    return sorted(out + [(r[0], None, None, by_label.get(r[1]), sha) for r in ok if len(r[2]) != length], key=str)


VECTORS = "vec_id long, embedding array<float>, label int, error string, code int, far int"


def vectors(spark, n=150, dims=16):
    draw = random.Random(5)
    rows = [(i if i % 31 else None, [draw.choice([-1, 0, 1]) * draw.randint(0, 6) / 4 + draw.randint(0, 3) / 4096 for _ in range(dims)], None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += rows[:20] + [(900, None, 1), (901, [1.0] * (dims - 1) + [None], 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] + [0.0] * (dims - 1), 2), (904, [], 1), (905, [1.0] * 3, 77)]
    return [(r[0], r[1], r[2]) for r in rows], spark.createDataFrame([(*r, "e", 1, 2) for r in rows], VECTORS)


@pytest.mark.parametrize("dims,parts,entries,rounds", [(16, 8, 16, 6), (16, 8, 5, 9), (10, 4, 3, 2), (16, 8, 400, 1)])
def test_codes(spark, dims, parts, entries, rounds):
    importable(spark)
    rows, table = vectors(spark, 150 if entries < 100 else 40, dims)
    got = vector_codes.coded(table.repartition(5), parts=parts, entries=entries, rounds=rounds)
    got = got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    want = brute_codes(rows, parts, entries, rounds)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_codes_empty_and_too_large(spark):
    importable(spark)
    _, table = vectors(spark, 4)
    assert vector_codes.coded(table.limit(0)).count() == 0
    assert vector_codes.coded(table.where("vec_id in (900, 904)")).select("code").collect() == [(None,)]
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.coded(spark.createDataFrame([(1, [1e6] * 8, 0)], "vec_id long, embedding array<float>, label int"))


def test_codes_labels_beyond_broadcast(spark, monkeypatch):
    importable(spark)
    _, table = vectors(spark)
    want = sorted(vector_codes.coded(table).collect(), key=str)
    monkeypatch.setattr(vector_codes, "MOST_BROADCAST", 0)
    assert sorted(vector_codes.coded(table).collect(), key=str) == want


def brute_targets(sizes, share=Fraction(3, 2), most=2):
    """Clamp and deal again, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(names)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(most * sizes[s] for s in clamped), [s for s in names if s not in clamped]
        give = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if give[s] > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in clamped else give[s] for s in names}
        clamped |= above


def test_mix(spark, docs):
    got = mixing.planned(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows) and sorted(((r.doc_id, r.size, r.source) for r in got), key=str) == sorted(((d, size(t), s) for d, t, s in rows), key=str)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(targets[r.source])) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r["size"] * r.copies + r.part
        taken[r.source] += r.taken
    for s, want in targets.items():
        copies = max(Counter((d, t) for d, t, x in rows if x == s).values())
        assert abs(taken[s] - want) <= copies
    again = mixing.planned(docs.repartition(7)).collect()
    assert sorted(again, key=str) == sorted(got, key=str)
    assert sorted(mixing.planned(docs, seed=14).collect(), key=str) != sorted(got, key=str)


def test_mix_rows(spark, docs):
    plan = mixing.planned(docs)
    rows = mixing.repeated(plan)
    words = rows.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]
    short = plan.where("part > 0 and part < size").select("text", "part").collect()
    assert short and all(r.text.split()[: r.part] in [(x.text or '').split() for x in rows.select("text").collect()] for r in short)


def test_mix_small_and_many(spark, docs, monkeypatch):
    assert mixing.planned(docs.limit(0)).count() == 0
    blank = mixing.planned(docs.where("doc_id is not null").where(F.trim("text") == "")).collect()
    assert blank and all((r.taken, r.target) == (0, 0.0) for r in blank)
    one = mixing.planned(spark.createDataFrame([(1, "a b c", "x"), (2, None, "x")], "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in one) == 5 and one[0].target == 4.5  # half a word is rounded up
    want = sorted(mixing.planned(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(mixing.planned(docs).collect(), key=str) == want


@pytest.mark.parametrize("name", ["op11_lexical_rank", "op12_vector_codes", "op13_source_mixing"])
def test_queries_have_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    found = queries.queries()[name](spark, SF_DIR)
    plain = lambda rows: sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(found.collect()) == plain(c.sql(f"select {', '.join(found.columns)} from ({queries.oracle_sql()[name]})").fetchall())
