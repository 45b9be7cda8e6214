import random
from itertools import product

import pytest

from logspark.functions.search import QuerySyntaxError, boolean_match, words_match
from logspark.operators.filters import Filter, any_of, filtered, parse_date, valid_pattern

TEXTS = ["connection refused by 10.0.0.1", "Café déjà vu ERROR", "error a b c d e f timeout", "errors happen; un-done", "refused connection", "timeout then error", "Tiếng Việt, नमस्ते दुनिया Ёлка", "b x x a c; a b x c"]
CASES = [
    ("cafe", {2}), ("CAFÉ", {2}), ("error OR fail", {2, 3, 6}), ("error NOT timeout", {2}), ("error timeout OR refused", {1, 3, 5, 6}), ("error or fail", set()),
    ('"connection refused"', {1}), ("err*", {2, 3, 4, 6}), ("NEAR(error timeout, 5)", {6}), ("NEAR(error timeout, 6)", {3, 6}), ("NEAR(error timeout)", {3, 6}),
    ("error AND timeout", {3, 6}), ('"10.0.0.1"*', {1}), ("(error OR refused) NOT timeout", {1, 2, 5}), ("NEAR(a c f, 4)", {3}), ("NEAR(a c f, 3)", set()), ("tieng", {7}), ("TIẾNG", {7}), ("viê*", {7}), ("नमस्ते", {7}), ("नम", set()), ('NEAR("b x" a, 1)', {8}), ('NEAR("a b" c, 0)', {3, 8}), ('NEAR("a c" b, 1)', {8}), ('NEAR("b a" c, 9)', set()), ("NEAR(a b c d e f, 9)", {3}), ("NEAR(timeout error b d, 6)", {3}), ("NEAR(timeout error b d, 5)", set()), ('"---"*', set()),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "i int, message string").cache()


@pytest.mark.parametrize("query,want", CASES)
def test_boolean(texts, query, want):
    assert {r.i for r in texts.where(boolean_match(query, ("message",))).collect()} == want


def test_near_is_what_every_choice_of_places_gives(spark):
    pick = random.Random(1)
    texts = [" ".join(pick.choice("abcdef") for _ in range(pick.randint(2, 12))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, message string").cache()
    for _ in range(12):
        phrases, n = [[pick.choice("abcdef") for _ in range(pick.choice([1, 1, 2]))] for _ in range(pick.randint(2, 4))], pick.randint(0, 5)
        want = set()
        for i, words in enumerate(map(str.split, texts)):
            places = [[k for k in range(len(words)) if words[k : k + len(p)] == p] for p in phrases]
            if any(max(s) - min(a + len(p) for a, p in zip(s, phrases)) <= n for s in product(*places)):
                want.add(i)
        query = " ".join(f'"{" ".join(p)}"' for p in phrases)
        assert {r.i for r in d.where(boolean_match(f"NEAR({query}, {n})", ("message",))).collect()} == want, query


@pytest.mark.parametrize("query", ["error AND", "un-done", "10.0.0.1", "NOT x", "(a", "NEAR(a b, c)"])
def test_syntax_error(spark, query):
    with pytest.raises(QuerySyntaxError):
        boolean_match(query)


@pytest.mark.parametrize("query,want", [("connection refused", {1, 5}), ("10.0.0.1", {1}), ("error ---", set()), ("err", {2, 3, 4, 6})])
def test_words(texts, query, want):
    assert {r.i for r in texts.where(words_match(query, ("message",))).collect()} == want


MESSAGE = (3, 4, "webserver", "sshd", "10.0.0.5", "Failed password for root", "<35>Oct 11 22:14:15 webserver sshd: Failed password for root")


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([MESSAGE], "severity int, facility int, hostname string, app_name string, source_ip string, message string, raw_message string").selectExpr("*", "timestamp '2024-01-02 15:00:00' as timestamp")


@pytest.mark.parametrize(
    "f,want",
    [
        (Filter(), 1), (Filter(severities=(3,), facilities=(4,), hostname="WEB", app_name="ssh", source_ip="10.0", search="PASSWORD"), 1), (Filter(severities=(1,)), 0), (Filter(facilities=(3,)), 0), (Filter(hostname="db"), 0),
        (Filter(search="accepted"), 0), (Filter(search="<35>Oct"), 1), (Filter(search="pass.*root", mode="regex"), 1), (Filter(search="[bad", mode="regex"), 1), (Filter(search="[bad", mode="regex", on_invalid="literal"), 0),
        (Filter(search="x" * 201, mode="regex", on_invalid="never"), 0), (Filter(search="un-done", mode="fts"), 0), (Filter(search="failed AND root", mode="fts"), 1), (Filter(search="zzz OR 'root'", mode="any"), 1), (Filter(search="zz", mode="any"), 0),
        (Filter(date_from="2024-01-02T15:00", date_to="2024-01-02"), 1), (Filter(date_to="2024-01-01"), 0), (Filter(date_to="2024-01-02T15:00:00Z"), 1), (Filter(date_to="2024-01-02T14:59:59Z"), 0), (Filter(date_from="nonsense"), 1),
    ],
)
def test_filter(one, f, want):
    assert filtered(one, f).count() == want


def test_patterns(spark):
    assert valid_pattern(spark, "err(or|eur)") and not any(valid_pattern(spark, p) for p in ("[x", r"(a)\1", "(?=a)", "(?<!a)b", "é" * 101))


def test_dates():
    assert parse_date("2024-13-01") is None and parse_date("") is None and parse_date("2024-01-02T10:00:00+02:00").hour == 8


def test_any_of_nothing(one):
    assert one.where(any_of("'*\"")).count() == 1
