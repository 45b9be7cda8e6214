"""Personal data replaced by keyed surrogates of the same kind and format, with built-in functions only.

Entities are found by one pattern; names that stand after a title or a cue like `Name:` once are found without it
too, in the same text. An entity's canonical form (lower case, without separators or title) and a secret key
decide its surrogate, so the same entity gets the same surrogate wherever it stands, in the format of that
place. Given names and surnames are entities of their own: who is `Anna Weber`, `Dr. Weber` and
`Mrs. Anna Weber` in turn keeps one surname. A given name's gender is what the titles of all its mentions
tell. Surrogates of all distinct entities are checked for collisions, with one another and with real
entities; whoever collides takes its next surrogate, and late ones grow longer, so that no format runs out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed, spare_prefix

#: Titles by the gender they tell, given names and their endings by gender and script, syllables by script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа"), "n": ("Dr", "Prof")}
GIVEN = {
    "latin": {"m": "adam bruno carl david erik felix george henry ivan jonas".split(), "f": "anna bella clara diana emma flora greta helen irene julia".split(), "n": "alex robin sasha kim noel".split()},
    "cyrillic": {"m": "антон борис виктор георгий денис".split(), "f": "анна вера галина дарья елена".split(), "n": "саша женя валя".split()},
}
ENDINGS = {"latin": {"m": "o an er us".split(), "f": "a ia ina ella".split(), "n": "i en is y".split()}, "cyrillic": {"m": "ан ей ор ий".split(), "f": "а ия ина ея".split(), "n": "и ю е о".split()}}
SYLLABLES = {"latin": "bar den fol gar hin jor kel lam mor nad pel rin sol tav ver wim".split(), "cyrillic": "бар ден фол гар лин мор над пел рин сол тав вер ким дор жан зим".split()}
#: Alphabets a letter, mark or digit is drawn from, by what it is; what is none of these is drawn from the last.
ALPHABETS = (
    ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[à-ÿ]", "àáâäçèéêëìíîïñòóôöùúûü"), (r"[Ͱ-Ͽ]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[Ѐ-ӿ]", "абвгдежзиклмнопрстуфхцчшщэюя"),
    (r"[֐-׿]", "אבגדהוזחטיכלמנסעפצקרשת"), (r"[؀-ۿ]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"[ऀ-ॿ]", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"), (r"[฀-๿]", "กขคงจชซดตถทนบปผพฟมยรลวสหอ"),
    (r"[぀-ゟ]", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも"), (r"[゠-ヿ]", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ"),
    (r"[一-鿿]", "一二三上下大小中山川田木林水火土金石天地人口目手心日月白青花"), (r"[가-힯]", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"), (r"\p{N}", "0123456789"), (r"[\p{L}\p{M}]", "abcdefghijklmnopqrstuvwxyz"),
)
LONGER = 8  # attempts after which surrogates grow by a letter each time
_C = r"[\p{L}\p{N}\p{M}]"
_B, _N = rf"(?<!{_C})", rf"(?!{_C})"
_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))
#: Words before a colon that a person's name follows.
CUES = ("name", "full name", "contact", "contact person", "patient", "customer", "employee", "signed", "nom", "nombre", "kontakt", "имя")
_CUE = "|".join(sorted(CUES, key=len, reverse=True))
_LED = rf"(?iu:(?:(?:{_TITLE})\.?|(?:{_CUE}):)) "
_NAME = r"[\p{Lu}\p{Lo}](?:[\p{L}\p{M}]+|(?=['’]))(?:['’-]\p{L}[\p{L}\p{M}]+)*"
_H = "[0-9a-fA-F]{1,4}"
#: Kind and pattern, tried in this order.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}\p{M}._%+-])[\p{L}\p{N}\p{M}._%+-]++@[\p{L}\p{N}\p{M}-]++(?:\.[\p{L}\p{N}\p{M}-]++)++"),
    ("secret", rf"{_B}[0-9a-fA-F]{{32,}}+{_N}"),
    ("key", rf"{_B}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36,}}+|sk-[0-9A-Za-z]{{20,}}+){_N}"),
    ("ipv6", rf"(?<![\p{{L}}\p{{N}}\p{{M}}:.])(?=[a-fA-F:]*+[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|:(?::{_H}){{1,7}}|(?:{_H}:){{1,7}}:)(?![\p{{L}}\p{{N}}\p{{M}}:])"),
    ("iban", rf"{_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_N}"),
    ("phone", rf"{_B}\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}{_N}|{_B}\(\d{{3}}\) ?\d{{3}}[.-]\d{{4}}{_N}|{_B}\d{{3}}[.-]\d{{3}}[.-]\d{{4}}{_N}|{_B}0\d{{2,4}}[ /-]\d{{3,4}}[ -]?\d{{3,5}}{_N}"),
    ("ip", r"(?<![\p{L}\p{N}\p{M}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}\p{M}])"),
    ("ssn", rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_N}"),
    ("card", rf"{_B}\d(?:[ -]?\d){{12,18}}{_N}"),
    ("name", rf"{_B}{_LED}{_NAME}(?: {_NAME})?"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: No entity without one of these.
HINT = rf"[0-9@]|gh[pousr]_|sk-|AKIA|ASIA|{_LED}[\p{{Lu}}\p{{Lo}}]"


def kind_of(match: Column) -> Column:
    """The first kind whose pattern is the whole match; a name without its title is of none of them."""
    return reduce(lambda rest, k: F.when(match.rlike(f"^(?:{k[1]})$"), F.lit(k[0])).otherwise(rest), reversed(KINDS), F.lit("name"))


def untitled(match: Column) -> Column:
    return F.regexp_replace(match, f"^{_LED}", "")


def _gender(match: Column) -> Column:
    title = F.lower(F.regexp_extract(match, rf"^((?iu:{_TITLE}))\.? ", 1))  # a cue tells none
    return F.when(title.isin(*[t.lower() for t in TITLES["m"]]), "m").when(title.isin(*[t.lower() for t in TITLES["f"]]), "f").otherwise("n")


def parts_of(match: Column, kind: Column, surnames: Column) -> Column:
    """Array of (part, kind, what): the entities of a mention. Names have a given name and a surname, or one of them."""
    part = lambda i, k, what: F.struct(F.lit(i).alias("part"), (F.lit(k) if isinstance(k, str) else k).alias("kind"), what.alias("what"))
    bare = F.lower(match)
    plain = F.when(kind.isin("email", "ip", "ipv6"), bare).otherwise(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{M}]", ""))
    name = F.split(untitled(match), " ")
    one = F.when((name[0] != match) | F.array_contains(surnames, name[0]), "surname").otherwise("given")
    of_name = F.when(F.size(name) > 1, F.array(part(0, "given", F.lower(name[0])), part(1, "surname", F.lower(name[1])))).otherwise(F.array(part(1, one, F.lower(name[0]))))
    return F.when(kind == "name", of_name).otherwise(F.array(part(0, kind, plain)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, though f uses it often or in lambda functions of its own."""
    return F.transform(F.array(value), f)[0]


def _stream(key: str, kind: Column, what: Column, attempt: Column) -> Column:
    """Blocks of 64 hexadecimal digits, of more bytes than `what` has characters."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), what), 256)
    return _let(seed, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.length(what) / 32).cast("int") + 1), lambda k: F.sha2(F.concat(k.cast("string"), x), 256)))


def _byte(stream: Column, i: Column) -> Column:
    block = F.get(stream, F.floor(i / 32).cast("int"))
    return F.conv(F.substring(block, F.pmod(i, F.lit(32)).cast("int") * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _pick(found: list[str], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, found)), F.pmod(b, F.lit(len(found))) + 1)


def _drawn(what: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """what with every letter, mark and digit redrawn from an alphabet of its script."""

    def one(blocks: Column, c: Column, i: Column) -> Column:
        b = _byte(blocks, i)
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), F.pmod(b, F.lit(16)) + 1, F.lit(1))
        return reduce(lambda rest, a: F.when(c.rlike(a[0]), F.substring(F.lit(a[1]), F.pmod(b, F.lit(len(a[1]))) + 1, F.lit(1))).otherwise(rest), reversed(ALPHABETS), c)

    return _let(stream, lambda blocks: F.array_join(F.transform(F.split(what, ""), lambda c, i: one(blocks, c, i)), ""))


def _luhn(digits: Column, n: Column) -> Column:
    """Sum of the digits of a card number by Luhn's rule; n is its whole length, the check digit's place included."""

    def add(held: Column, total: Column, i: Column) -> Column:
        d = F.substring(held, i, F.lit(1)).cast("int") * (F.pmod(n - i, F.lit(2)) + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return _let(digits, lambda held: F.aggregate(F.sequence(F.lit(1), F.length(held)), F.lit(0), lambda total, i: add(held, total, i)))


def _named(kind: Column, what: Column, gender: Column, attempt: Column, stream: Column) -> Column:
    """A given name of the gender, or a surname of syllables, in the script of the name; later ones have more syllables."""

    def of(script: str, stream: Column) -> Column:
        row = F.transform(F.sequence(F.lit(0), attempt + F.when(kind == "surname", 2).otherwise(0)), lambda k: _pick(SYLLABLES[script], _byte(stream, F.pmod(k, F.lit(31)))))
        by_gender = lambda held: F.when(gender == "m", _pick(held["m"], _byte(stream, F.lit(31)))).when(gender == "f", _pick(held["f"], _byte(stream, F.lit(31)))).otherwise(_pick(held["n"], _byte(stream, F.lit(31))))
        made = F.concat(F.array_join(row, ""), by_gender(ENDINGS[script]))
        return F.when(kind == "surname", F.array_join(row, "")).when(attempt == 0, by_gender(GIVEN[script])).otherwise(made)

    other = F.concat(_drawn(what, stream), F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda k: F.substring(_drawn(what, stream), F.lit(1), F.lit(1))), ""))
    return F.when(what.rlike(r"[Ѐ-ӿ]"), _let(stream, lambda x: of("cyrillic", x))).when(what.rlike(r"[a-zÀ-ɏ]"), _let(stream, lambda x: of("latin", x))).otherwise(F.when(attempt > 0, other).otherwise(_drawn(what, stream)))


def surrogate(kind: Column, what: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity's canonical form."""
    more = F.when(attempt >= LONGER, F.repeat(F.lit("0"), attempt - (LONGER - 1))).otherwise("")
    stream = _stream(key, kind, F.concat(what, more), attempt)
    held = F.concat(what, more)
    drawn = _drawn(held, stream)
    local, domain = F.concat(F.substring_index(what, "@", 1), more), F.regexp_extract(what, r"@([\p{L}\p{N}\p{M}-]+)", 1)
    top = F.element_at(F.array(F.lit("com"), F.lit("org"), F.lit("net")), F.pmod(_byte(stream, F.lit(31)), F.lit(3)) + 1)
    email = F.concat(_drawn(local, stream), F.lit("@"), _drawn(domain, _stream(key, F.lit("domain"), F.substring_index(what, "@", -1), F.lit(0))), F.lit(".example."), top)
    group = lambda i: F.lower(F.hex(_byte(stream, F.lit(2 * i)) * 256 + _byte(stream, F.lit(2 * i + 1))))
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[group(i) for i in range(6)])
    ip = F.concat_ws(".", F.pmod(_byte(stream, F.lit(0)), F.lit(223)) + 1, _byte(stream, F.lit(1)), _byte(stream, F.lit(2)), F.pmod(_byte(stream, F.lit(3)), F.lit(254)) + 1)
    n = F.length(held)
    body = F.concat(F.substring(what, 1, 1), F.substring(drawn, F.lit(2), n - 2))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(body, n), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(what, F.length(what)), F.lit(10)) == 0, F.concat(body, check)).otherwise(F.concat(body, F.substring(drawn, n, F.lit(1))))
    led = lambda k: F.concat(F.substring(what, 1, k), F.substring(drawn, F.lit(k + 1), n))
    return (
        F.when(kind == "email", email).when((kind == "ip") & (attempt < LONGER), ip).when(kind.isin("ip", "ipv6"), ipv6).when(kind == "card", card).when(kind == "phone", led(1)).when(kind == "iban", led(2))
        .when(kind == "secret", _drawn(held, stream, True)).when(kind == "ssn", F.concat(F.lit("9"), F.substring(drawn, F.lit(2), n))).when(kind.isin("given", "surname"), _named(kind, what, gender, attempt, stream))
        .otherwise(drawn)
    )


def dressed(new: Column, match: Column, kind: Column) -> Column:
    """A canonical surrogate in the format of this mention: its separators and case; names get theirs here, their title later."""
    upper = (match == F.upper(match)) & (match != F.lower(match))

    def cased(c: Column, drawn: Column, upper: Column) -> Column:
        return F.when(upper | (c != F.lower(c)), F.upper(drawn)).otherwise(drawn)

    def put(i: Column) -> Column:
        c = F.substring(match, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(match, F.lit(1), i), r"[^\p{L}\p{N}\p{M}]", ""))
        return F.when(c.rlike(_C), cased(c, F.substring(new, at, F.lit(1)), upper)).otherwise(c)

    letters = F.length(F.regexp_replace(match, r"[^\p{L}\p{N}\p{M}]", ""))
    rest = F.substring(new, letters + 1, F.length(new))
    each = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(match)), put), ""), rest)
    plain = F.concat(_let(upper, lambda u: F.array_join(F.zip_with(F.split(match, ""), F.split(F.substring(new, F.lit(1), F.length(match)), ""), lambda c, d: cased(c, d, u)), "")), rest)
    whole = F.when(upper, F.upper(new)).otherwise(new)
    name = untitled(match)
    called = F.when((name == F.upper(name)) & (name != F.lower(name)), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind.isin("email", "ip", "ipv6"), whole).when(kind.isin("given", "surname"), called).when(kind == "secret", plain).otherwise(each)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, extra, at, match, gender, part, kind, what): the entities of every text, mention by mention.

    extra: pattern of the names known from their titles in this text, null if there are none."""
    first = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", first.alias("first"))
    names = F.transform(F.filter("first", lambda m: m.rlike(f"^{_LED}")), untitled)
    found = found.withColumn("names", F.array_distinct(names))
    words = F.transform("names", lambda x: F.split(x, " "))
    found = found.withColumn("surnames", F.transform(words, lambda w: F.element_at(w, -1)))
    single = F.concat("surnames", F.transform(F.filter(words, lambda w: F.size(w) > 1), lambda w: w[0]))
    every = F.array_distinct(F.concat(F.filter("names", lambda x: x.contains(" ")), single))
    quoted = F.flatten(F.transform(every, lambda x: F.array(x, F.upper(x))))
    extra = F.concat(F.lit(f"|(?:{_B}(?:"), F.array_join(F.transform(quoted, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "|"), F.lit(f"){_N})"))
    found = found.withColumn("extra", F.when(F.size("names") > 0, extra))
    second = F.regexp_extract_all("text", F.concat(F.lit(PATTERN), F.col("extra")), F.lit(0))
    found = found.select("doc_id", "text_hash", "extra", F.transform("surnames", F.lower).alias("surnames"), F.posexplode(F.when(F.col("extra").isNull(), F.col("first")).otherwise(second)).alias("at", "match"))
    found = found.withColumn("kind", kind_of(F.col("match"))).withColumn("surnames", F.transform("surnames", lambda x: x))
    known = F.when(F.array_contains("surnames", F.lower("match")), F.array("match")).otherwise(F.array().cast("array<string>"))
    gender = F.when(F.col("kind") == "name", _gender(F.col("match"))).otherwise("n")
    return found.select("doc_id", "text_hash", "extra", "at", "match", gender.alias("gender"), F.inline(parts_of(F.col("match"), F.col("kind"), known)))


def entity_surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, what, attempt, new): the distinct entities of mentions and their canonical surrogates, no two alike within a kind.

    Of entities that draw the same surrogate one keeps it, and none keeps one that is the canonical form
    of a real entity of its kind; the others draw again. Late draws are longer, so the rounds end."""
    told = lambda g: F.max(F.when(F.col("gender") == g, 1).otherwise(0))
    every = found.groupBy("kind", "what").agg(told("m").alias("m"), told("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    # Few bytes, much work: spread by number, not by size.
    spread = every.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "what")
    draw = surrogate(F.col("kind"), F.col("what"), F.col("gender"), F.col("attempt"), key)
    state = checkpointed(spread.select("kind", "what", gender.alias("gender"), F.lit(0).alias("attempt")).withColumn("new", draw))
    real = state.select(F.col("kind").alias("k"), F.col("what").alias("w"))
    order = F.row_number().over(Window.partitionBy("kind", "new").orderBy("attempt", "what"))
    while True:
        checked = state.withColumn("nth", order).join(real, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("w")), "left")
        bad = (F.col("nth") > 1) | F.col("w").isNotNull()
        state = checkpointed(checked.select("kind", "what", "gender", (F.col("attempt") + bad.cast("int")).alias("attempt"), "new", bad.alias("bad")))
        if not state.where("bad").limit(1).count():
            return state.select("kind", "what", "attempt", "new")
        state = state.withColumn("new", F.when(F.col("bad"), draw).otherwise(F.col("new")))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with entities of `text` replaced, and `entities`: array of (kind, chars, surrogate) in order.

    chars is the length of what was replaced; what it was is not told. Every row is returned; a null text
    stays null, without entities. Own columns named `entities` are replaced. Rows that repeat doc_id and
    text get the same result; a null doc_id is one like any other."""
    own, p = [c for c in docs.columns if c not in ("text", "entities")], spare_prefix(docs)
    found = checkpointed(mentions(docs.select("doc_id", "text").where("text is not null")).dropDuplicates(["doc_id", "text_hash", "at", "part"]))
    made = found.join(entity_surrogates(found, key).select("kind", "what", "new"), ["kind", "what"])
    worn = made.select("doc_id", "text_hash", "extra", "at", "match", "kind", "part", dressed(F.col("new"), F.col("match"), F.col("kind")).alias("worn"))
    whole = worn.groupBy("doc_id", "text_hash", "at").agg(F.sort_array(F.collect_list(F.struct("part", "worn"))).alias("parts"), F.first("match").alias("match"), F.first("kind").alias("kind"), F.first("extra").alias("extra"))
    is_name = F.col("kind").isin("given", "surname")
    title = F.when(is_name, F.regexp_extract("match", f"^({_LED})", 1)).otherwise("")
    entity = F.struct("at", F.when(is_name, "name").otherwise(F.col("kind")).alias("kind"), F.length("match").alias("chars"), F.concat(title, F.array_join(F.transform("parts", lambda x: x["worn"]), " ")).alias("surrogate"))
    gathered = whole.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(entity)).alias(p + "every"), F.max("extra").alias(p + "extra")).withColumnsRenamed({"doc_id": p + "id", "text_hash": p + "of"})
    keyed = docs.select(*own, "text", F.xxhash64("text").alias(p + "hash"))
    joined = keyed.join(gathered, keyed.doc_id.eqNullSafe(gathered[p + "id"]) & (keyed[p + "hash"] == gathered[p + "of"]), "left")
    every, text = F.col(p + "every"), F.col("text")
    pieces = F.split(text, F.concat(F.lit(PATTERN), F.coalesce(F.col(p + "extra"), F.lit(""))))
    filled = F.zip_with(pieces, F.transform(every, lambda e: e["surrogate"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    none = F.array().cast("array<struct<kind:string,chars:int,surrogate:string>>")
    entities = F.coalesce(F.transform(every, lambda e: F.struct(e["kind"].alias("kind"), e["chars"].alias("chars"), e["surrogate"].alias("surrogate"))), none)
    return joined.select(*own, F.when(every.isNull(), text).otherwise(F.array_join(filled, "")).alias("text"), entities.alias("entities"))
