"""Operators held against brute force or an exact round trip, on small tables with odd rows."""

import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logspark.llm import bpe, components, external_shuffle, packing, queries, simhash, unit_dedup
from tests.conftest import SF_DIR

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, flags string, h int"  # clashing names too


@pytest.fixture(scope="module")
def odd(spark):
    word = random.Random(1)
    long = " ".join(word.choice("alpha beta gamma delta".split()) + str(word.randint(0, 900)) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One two"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, long), (9, "x" * 50_000), (None, "a b c d e"), (10, "Ünïcödé 文字 🙂 İ")]
    return spark.createDataFrame([(i, t, None, "s", None, "f", 1) for i, t in rows], SCHEMA)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_odd(spark, odd):
    got = simhash.near_groups(odd).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert simhash.near_groups(odd.limit(0)).count() == 0
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 8, 9, None, 10]))


def test_simhash_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op10_simhash(spark, SF_DIR).collect()), key=str) == brute_groups(docs)


@pytest.mark.parametrize("tile,radius", [(4096, 3), (8, 3), (8, 5)])
def test_near_links_connect_what_is_near(spark, tile, radius):
    """Clumped fingerprints, in buckets that are whole and that are dealt out by tile pairs."""
    pick = random.Random(tile + radius)
    base = [pick.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in pick.sample(range(64), pick.randint(0, 5))) for b in base[:5] for _ in range(60)} | set(base))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near_links(spark.createDataFrame([(signed(x),) for x in fps], "fingerprint long"), radius, tile)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components.component_roots(links).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    same = lambda f: {frozenset(x for x in fps if f(x) == r) for r in map(f, fps)}
    assert same(find) == same(lambda x: roots.get(x, x))


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.component_roots(links).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def test_bpe(spark, odd):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(path).ids, special_tokens={})
    pick = random.Random(2)
    letters = "ab eéíß  \n\t\x1c\x85\xa0 'sdtre19.,!日本🙂　"
    rows = [(1000 + i, "".join(pick.choice(letters) for _ in range(pick.randint(0, 80)))) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in bpe.encoded(d, path, P.PATTERN, True).join(d.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        want = np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) == (want, len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 5}, {k: 1 + k % 5 for k in range(30, 2000, 3)}, {3000: 4, 1096: 2, 500: 3, 596: 3, 200: 9}, {7: 1000, 4089: 3}])
def test_plan_places_every_piece_once(counts):
    placed = {}
    for length, first, sequence, offset in packing.plan(counts):
        placed.setdefault(length, []).append((first, sequence, offset))
    spans = {}
    for length, n in counts.items():
        runs = sorted(placed[length])
        for rank in range(n):
            first, sequence, offset = [x for x in runs if x[0] <= rank][-1]
            spans.setdefault(sequence + rank - first, []).append((offset, offset + length))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert len(spans) <= -(-sum(k * n for k, n in counts.items()) // 4096) + 1


def test_plan_finds_the_only_triple():
    """A length and three others that fill a sequence are found, however many other pairs come before."""
    for decoys in (0, 400):
        counts = {2000: 1, 1: 1, 1500: 1, 595: 1, **{1000 + 2 * k: 1 for k in range(decoys // 2)}, **{500 + k: 0 for k in range(3)}}
        made = packing._Plan({k: n for k, n in counts.items() if n}, 4096)
        made.index_pairs()
        assert made.triple(2096, 2000) and sum(made.left) == len([n for n in counts.values() if n]) - 4


def test_words_kept_are_bounded_by_bytes():
    ids = packing.WordIds(P.path("word_bpe_49k.json"), most=100_000)
    once = packing.WordIds(P.path("word_bpe_49k.json"))
    pick = random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(pick.choice("abcdeé") for _ in range(pick.choice([3, 5, 900]))) for _ in range(30)).encode() for _ in range(8)]
        assert ids(texts) == once(texts) and ids.seen.size < 100_000 + 2_000_000 and sum(map(len, ids.seen.old)) < 2_000_000


def test_words_are_learnt_without_case_and_signs_at_the_end(monkeypatch):
    """The tokenizer gets what differs in these alone once."""
    tokenizer, asked = packing._tokenizer(P.path("word_bpe_49k.json")), []

    class Asked:
        def encode(self, text, **how):
            asked.append(text)
            return tokenizer.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    monkeypatch.setattr(packing, "_tokenizer", lambda path: Asked())
    ids = packing.WordIds(P.path("word_bpe_49k.json"))
    for texts in ([b"wortel Wortel, WORTEL?! wortel", "été, ÉTÉ".encode()], [b"Wortel? (wortel wortel!?!", "Été".encode()]):
        for text, found in zip(texts, ids(texts)):
            assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert sorted(w for text in asked for w in text.split("\n") if w) == sorted(["wortel", ",", "?!", "été", "ÉtÉ", "?", "(wortel", "!?!", "Été"])


@pytest.mark.parametrize("lowers", [True, False])
def test_ids_of_words_are_those_of_whole_texts(tmp_path, lowers):
    """Also where marks join letters of one case only, at tokens of their own, and under other rules than those words are cut by."""
    path = P.path("word_bpe_49k.json")
    if not lowers:
        with open(path, encoding="utf-8") as lines:
            made = json.load(lines)
        made["normalizer"]["normalizers"].pop()
        path = str(tmp_path / "cased.json")
        with open(path, "w", encoding="utf-8") as lines:
            json.dump(made, lines)
    tokenizer, pick = packing._tokenizer(path), random.Random(5)
    parts = [*"abEJTWHhÉéß×÷ÿÀ09.,;'\"<|>$-日🙂\x1c\x7f\x00\xa0ﬁΣ²…İıſK", "\u030c", "\u0331", "\u0308", "\u0301", "'s", "'Re", "<|endoftext|>", "<|EndOfText|>"]
    words = ["".join(pick.choices(parts, k=pick.choice([1, 2, 3, 5]))) + pick.choice(["", ".", ",,", "?!'", "s."]) for _ in range(4000)]
    texts, ids = [" ".join(words[at : at + 20]) for at in range(0, 4000, 20)], packing.WordIds(path)
    for _ in range(2):
        for text, found in zip(texts, ids([t.encode() for t in texts])):
            assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = packing.packed(packing.token_pieces(odd, path, with_ids=True)).collect()
    tok, by_doc = Tokenizer.from_file(path), {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 4096 and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 4096 * r.piece
        by_doc.setdefault((r.doc_id, r.piece), []).append(ids)
    for doc, text in odd.select("doc_id", "text").collect():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            assert ids[k : k + 4096] in by_doc[doc, k // 4096]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for s in map(sorted, sequences.values()):
        assert s[0][0] == 0 and s[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert packing.packed(packing.token_pieces(odd.limit(0), path)).count() == 0


def fisher_yates(n, seed):
    """The shuffle of 0 .. n - 1 from the front, drawn from a Mersenne twister with a 64-bit seed, 31 bits a draw."""
    twister = np.random.RandomState([seed >> 32, seed & 0xFFFFFFFF])

    def below(k):
        while True:
            bits = int(twister.randint(0, 1 << 32, dtype=np.uint32)) >> 1
            if k & (k - 1) == 0:
                return k * bits >> 31
            if bits - bits % k + k - 1 < 1 << 31:
                return bits % k

    out = []
    for i in range(n):
        j = below(i + 1)
        out.append(i)
        out[i], out[j] = out[j], i
    return out


def brute_shuffle(rows, columns, shards=16, seed=7, bucket_bytes=64 << 20):
    """Slots of (doc_id, text, ...) rows, worked out bucket by bucket from the hashes alone."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def spark_hash(*parts):
        h = 42
        for p in parts:
            if p is not None:
                h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, h)
        return h

    in_int, in_long = (lambda x: struct.pack("<i", x)), lambda x: None if x is None else struct.pack("<q", x)
    shard = lambda key, n: max((signed(spark_hash(in_long(key), in_int(seed), in_int(s))), s) for s in range(n))[1]
    packed = [[p if isinstance(p, (str, type(None))) else in_long(p) if c in ("doc_id", "n_chars", "size") else in_int(p) for c, p in zip(columns, r)] for r in rows]
    total, seen, held, out = sum(r[columns.index("size")] for r in rows), {}, {}, []
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    for r, p in zip(rows, packed):
        lot = signed(spark_hash(in_int(seed), *p))
        k = seen[r] = seen.get(r, -1) + 1
        bucket, copy = (lot % buckets + k % buckets) % buckets, k // buckets + 1
        held.setdefault((shard(r[0], shards), bucket), []).append((lot, copy, r))
    for s in range(shards):
        slot = 0
        for b in range(buckets):
            of = sorted(held.get((s, b), []), key=lambda x: x[:2])
            for i in fisher_yates(len(of), seed + s * buckets + b):
                out.append((*of[i][2], s, slot, shard(of[i][2][0], shards + 1)))
                slot += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 4000])
def test_external_shuffle(spark, odd, bucket_bytes):
    """Every slot is the one worked out by hand, under plans of different kinds."""
    records = odd.withColumn("size", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")).withColumnsRenamed({"flags": "lot", "h": "row", "lang": "at", "source": "copy"}).withColumn("slot", F.lit(9))
    columns = [c for c in records.columns if c != "slot"]
    want = brute_shuffle([tuple(r) for r in records.select(columns).collect()], columns, bucket_bytes=bucket_bytes)
    place = lambda d: sorted((tuple(r) for r in external_shuffle.shuffled(d, "doc_id", "size", bucket_bytes=bucket_bytes).drop("bucket").collect()), key=str)
    assert place(records) == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "7")):
            spark.conf.set(k, v)
        assert place(records.repartition(5)) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert external_shuffle.shuffled(records.limit(0), "doc_id", "size").count() == 0


def test_external_shuffle_mixes(spark):
    found = queries.op6_external_shuffle(spark, SF_DIR)
    rows = found.where("shard = 3").orderBy("slot").collect()
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows) and found.count() == 200


def brute_units(docs, line_words=4, run_words=24, window=12):
    """The rule again from its definition: (doc, text, spans) of ranked documents, with the units seen so far in a set."""
    seen, out = set(), []
    for doc, text in docs:
        at, flat = 0, []  # of each segment: words, spans, repeated, line number
        whole_lines, gone = [], set()
        for number, line in enumerate((text or "").split("\n")):
            words = [(m.group().lower(), m.start() + at, m.end() + at) for m in re.finditer(r"\S+", line)]
            h = [xxhash.xxh3_64_intdigest(w) >> 32 for w, _, _ in words]
            starts = {max(range(i, i + window), key=lambda j: (-h[j], j)) for i in range(len(words) - window + 1)} | {0}
            ends = [*sorted(starts - {0}), len(words)]
            parts = [words[a:b] for a, b in zip([0, *ends], ends)] if words else []
            units = [("line", *(w for w, _, _ in words))] if len(words) >= line_words else []
            repeated = bool(units) and units[0] in seen
            seen.update(units)
            if repeated:
                whole_lines.append((number, words))
            if words and not (len(parts) == 1 and units):
                for part in parts:
                    unit = ("part", *(w for w, _, _ in part))
                    flat.append((part, unit in seen or repeated, number))
                    seen.add(unit)
            elif words:
                flat.append((words, repeated, number))
            at += len(line) + 1
        runs, run = [], []
        for part, repeated, _ in [*flat, ([], False, None)]:
            if repeated:
                run.append(part)
            else:
                runs += run if sum(map(len, run)) >= run_words else []
                run = []
        for words in [*runs, *(w for _, w in whole_lines)]:
            gone.update(range(words[0][1], words[-1][2]))
        # blanks: to the next word, or at the line's end back to the last one; lines without a word left go whole
        at = 0
        for line in (text or "").split("\n"):
            own, end = range(at, at + len(line)), at + len(line)
            if gone.intersection(own):
                if not "".join(text[i] for i in own if i not in gone).strip():
                    gone.update(range(at, min(end + 1, len(text))))
                else:
                    for i in own:
                        if text[i] in " \t" and i - 1 in gone and i > at:
                            gone.add(i)
                    i = end - 1
                    if i in gone:
                        while i in gone:
                            i -= 1
                        while text[i] in " \t":
                            gone.add(i)
                            i -= 1
            at = end + 1
        starts, ends = (sorted(i + (k > 0) for i in gone if i + (1 if k else -1) not in gone) for k in (0, 1))
        out.append((doc, None if text is None else "".join(c for i, c in enumerate(text) if i not in gone), list(zip(starts, ends))))
    return out


def test_unit_dedup_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in queries.op4_unit_dedup(spark, SF_DIR).collect()}
    for doc, text, gone in brute_units(docs):
        assert got[doc] == (text, gone)


def test_unit_dedup_of_odd_texts(spark):
    """What is left and the spans make up the original, whatever the characters; repeated ids rank by their texts' hashes."""
    pick, words = random.Random(8), [f"w{i}" for i in range(12)]
    texts = ["".join(pick.choice([*words, "\x00", "é"]) + pick.choice([" ", "  ", "\t", "\n", "\n\n", " \r\n", " "]) for _ in range(pick.randint(0, 90))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0] + texts[1], "  " + texts[2], "", None, " \n "])]
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run_words=6).collect()}
    assert got == {d: (t, g) for d, t, g in brute_units(rows, run_words=6)} and any(g for _, g in got.values())
    twice = spark.createDataFrame([*rows, *[(d, (t or "") + " more of it here") for d, t in rows], (None, texts[0]), (None, texts[3])], "doc_id long, text string").withColumnRenamed("doc_id", "i")
    ranked = twice.select(F.coalesce("i", F.lit(-1)).alias("i"), F.xxhash64("text").alias("h"), "text").orderBy("i", "h").collect()
    want = sorted(((t, g) for _, t, g in brute_units([(k, r.text) for k, r in enumerate(ranked)], run_words=6)), key=str)
    found = unit_dedup.without_repeats(twice.withColumnsRenamed({"i": "doc_id"}).withColumns({"__own": F.lit(1), "__places": F.lit(2)}), run_words=6)
    assert sorted(((r.text, [tuple(x) for x in r.removed]) for r in found.collect()), key=str) == want and found.columns == ["doc_id", "__own", "__places", "text", "removed"]


def test_unit_dedup_passages(spark, odd):
    say = random.Random(4)
    passage = " ".join(f"w{say.randint(0, 10**6)}" for _ in range(60))
    mine = lambda i: " ".join(f"d{i}x{k}" for k in range(40))
    rows = [(i, f"{mine(i)} {passage} {mine(i + 50)}\nshared boiler plate line\n{mine(i + 99)}") for i in range(3)]
    got = {r.doc_id: r for r in unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].removed == []
    for i in (1, 2):
        assert "boiler" not in got[i].text and sum(w in got[i].text.split() for w in passage.split()) <= 24
        assert mine(i + 99) in got[i].text and all(rows[i][1][s.start : s.end].split() for s in got[i].removed)
    out = unit_dedup.without_repeats(odd)
    assert out.count() == odd.count() and out.where("doc_id = 1").first().text is None and unit_dedup.without_repeats(odd.limit(0)).count() == 0
    assert {"lang", "source", "flags", "h"} <= set(out.columns)


def test_unit_dedup_finds_every_passage_of_51_words(spark):
    """Random windows of real texts in every language, between other words: none may stay whole, and only their ends may."""
    pick, rows, planted = random.Random(5), [], []
    texts = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").where("text is not null").select("lang", "text").orderBy("doc_id").collect()
    mine = lambda k: " ".join(f"u{k}x{j}" for j in range(30))
    for lang in sorted({r.lang for r in texts if r.lang}):
        long = [w for r in texts if r.lang == lang for line in r.text.split("\n") if len(w := line.split()) >= 51]
        assert long
        for _ in range(100):
            words = pick.choice(long)
            at = pick.randrange(len(words) - 50)
            planted.append(words[at : at + 51])
    for k, words in enumerate(planted):
        for copy in range(2):
            rows.append((2 * k + copy, f"{mine(2 * k + copy)} {' '.join(words)} {mine(-2 * k - copy - 1)}"))
    got = {r.doc_id: r.text for r in unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(len(planted)):
        left = [w for w in got[2 * k + 1].split() if not w.startswith("u")]
        assert len(left) <= 23 and mine(2 * k + 1) in got[2 * k + 1]


def test_external_shuffle_deals_identical_rows(spark):
    """Copies of one row are spread over its shard, not in one bucket, and every run places them alike."""
    rows = [(7, "same " * 20)] * 400 + [(7, f"other {i} " * 10) for i in range(400)]
    records = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.octet_length("text") + 1)
    place = lambda d: sorted((r.slot, r.text) for r in external_shuffle.shuffled(d, "doc_id", "size", shards=1, bucket_bytes=4000).collect())
    got = place(records)
    assert [s for s, _ in got] == list(range(800)) and sorted(t for _, t in got) == sorted(t for _, t in rows)
    assert all(20 <= sum(t.startswith("same") for _, t in got[at : at + 100]) <= 80 for at in range(0, 800, 100))
    assert place(records.repartition(7)) == got


def test_external_shuffle_carries_documents(spark, monkeypatch, tmp_path):
    """The query sends whole documents through the operator and writes them in shards."""
    taken, written = [], []
    shuffled, write = external_shuffle.shuffled, external_shuffle.write_shards
    monkeypatch.setattr(external_shuffle, "shuffled", lambda d, *a, **k: taken.append(d.columns) or shuffled(d, *a, **k))
    monkeypatch.setattr(external_shuffle, "write_shards", lambda d, p: written.append(p) or write(d, p))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = sorted((r.doc_id, r["size"], r.text_crc32) for r in queries.op6_external_shuffle(spark, SF_DIR).collect())
    assert set(docs.columns) <= set(taken[0])
    stored = spark.read.parquet(written[0])
    assert stored.select(docs.columns).exceptAll(docs).count() == 0 and stored.count() == docs.count()
    for name in stored.inputFiles():  # a bucket is one file, in the order of its slots
        slots = [r.slot for r in spark.read.parquet(name).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
    assert found == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
