"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms are compared with the language's reference by Jensen-Shannon distance (base 2, 0 to
1): character classes, and the language's commonest function words. References are pooled over all
documents of the language that have enough words. Guards: a distance counts only for documents
long enough to estimate it. Built-in functions only, row by row; the references, one row for each
known language and one for all others, are the only rows that are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import words

#: Frequent function words by language code.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or from at an have you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ne pas ce plus il".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como más no".split(),
}
#: Character classes: name and the Java class that matches it, tried in this order.
CLASSES = (("lower", "[a-z]"), ("blank", r"[\x20\x09-\x0D]"), ("upper", "[A-Z]"), ("letter", r"\p{L}"), ("digit", r"\p{N}"), ("stop", "[.,;:?'\"()-]"))
SYMBOLS, BLANK = "[^#*$%&|<>]+", 1
MIN_WORDS, MAX_REPEATED = 50, 50


def language(lang: Column) -> Column:
    """The language whose reference holds: a known code, or 'other' for all else and null."""
    code = F.lower(lang)
    return F.when(code.isin(*COMMON_WORDS), code).otherwise(F.lit("other"))


def _class_counts(docs: DataFrame, out: str) -> DataFrame:
    """Adds array<long> out: characters of each class, at the end those of none; and __odd, these themselves."""
    text, counts = "__left", []
    docs = docs.withColumn(text, F.coalesce("text", F.lit("")))
    for name, kind in CLASSES:
        less = f"__{name}"
        docs = docs.withColumn(less, F.regexp_replace(text, f"{kind}+", ""))
        counts.append(F.length(text) - F.length(less))
        text = less
    counts.append(F.length(text))
    left = ["__left", *(f"__{x}" for x, _ in CLASSES)]
    return docs.withColumns({out: F.array(*counts).cast("array<long>"), "__odd": F.col(text)}).drop(*left)


def _common_counts(docs: DataFrame, out: str) -> DataFrame:
    """Adds array<long> out: occurrences of each common word of the language, at the end all other words.

    Needs __words and __lang; null for languages without a list."""
    every = sorted({x for v in COMMON_WORDS.values() for x in v})
    common = F.create_map(*[y for k, v in COMMON_WORDS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    docs = docs.withColumn("__common", F.filter(words(F.lower("text")), lambda w: w.isin(*every))).withColumn("__list", common[F.col("__lang")])
    counts = F.transform("__list", lambda w: (F.size("__common") - F.size(F.array_remove(F.col("__common"), w))).cast("long"))
    docs = docs.withColumn("__counts", counts)
    total = F.aggregate("__counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn(out, F.concat("__counts", F.array(F.size("__words") - total))).drop("__common", "__list", "__counts")


def with_histograms(docs: DataFrame) -> DataFrame:
    """docs(text, lang, ...) with __words, __lang, __classes, __odd and __commons, counted over whole texts."""
    docs = docs.withColumn("__words", words(F.col("text"))).withColumn("__lang", language(F.col("lang")))
    return _common_counts(_class_counts(docs, "__classes"), "__commons")


def language_references(docs: DataFrame, min_words: int = MIN_WORDS, max_odd: float = 0.05) -> DataFrame:
    """(__lang, __ref_classes, __ref_commons): shares in the counts pooled over all documents that look like running text.

    Those have min_words words or more, letters mostly, more small ones than capitals, and at most a
    share of max_odd of characters that belong to no class: else text of symbols, which has many
    characters, would shift the references towards itself.

    At most one row for each list of COMMON_WORDS and one more, whatever the input."""
    c = {name: F.col("__classes")[i] for i, (name, _) in enumerate(CLASSES)}
    odd, letters = F.col("__classes")[len(CLASSES)], c["lower"] + c["upper"] + c["letter"]
    # Counted in the sums, as a filter would be pushed below the counting and repeat it.
    usual = (F.size("__words") >= min_words) & (c["upper"] <= c["lower"] + c["letter"]) & (odd <= max_odd * (letters + odd))
    full = with_histograms(docs.select("text", "lang")).select("__lang", "__classes", "__commons", usual.alias("__usual"))
    m = max(map(len, COMMON_WORDS.values())) + 1
    summed = full.groupBy("__lang").agg(
        F.array(*[F.sum(F.when(F.col("__usual"), F.col("__classes")[i])) for i in range(len(CLASSES) + 1)]).alias("__ref_classes"),
        F.array(*[F.sum(F.when(F.col("__usual"), F.get("__commons", F.lit(i)))) for i in range(m)]).alias("__ref_commons"),
    )
    summed = summed.withColumn("__ref_commons", F.filter("__ref_commons", lambda x: x.isNotNull()))
    for c in ("__ref_classes", "__ref_commons"):  # one is added to each count: what a language lacks weighs most
        summed = summed.withColumn("__n", F.aggregate(c, F.lit(0.0), lambda a, x: a + x + 1)).withColumn(c, F.transform(c, lambda x: (x + 1) / F.col("__n"))).drop("__n")
    return summed


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of the counts, which add up to total, from the reference's shares; null if total is 0 or either is missing."""

    def term(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def part(c: Column, q: Column) -> Column:
        return term(c / total, (c / total + q) / 2) + term(q, (c / total + q) / 2)

    summed = F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda a, x: a + x)
    # greatest() skips nulls: a missing histogram must not come out as 0.
    return F.when((total > 0) & summed.isNotNull(), F.sqrt(F.greatest(summed, F.lit(0.0)) / 2))


def with_base_rules(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed. Needs what with_histograms adds.

    n_repeat_words: words that lie in a window of three words which the text holds twice or more."""
    docs = docs.withColumn("__text", F.coalesce("text", F.lit(""))).withColumn("n_words", F.size("__words").cast("long"))
    docs = docs.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    m = F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))
    docs = docs.withColumn("__two", F.zip_with(F.slice("__words", F.lit(1), m), F.slice("__words", F.lit(2), m), lambda a, b: F.xxhash64(a, b)))
    docs = docs.withColumn("__window", F.zip_with("__two", F.slice("__words", F.lit(3), m), lambda h, c: F.xxhash64(h, c)))
    placed = F.sort_array(F.zip_with("__window", F.sequence(F.lit(1), F.size("__window")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("__again", F.size("__window") > F.size(F.array_distinct("__window"))).withColumn("__placed", F.when(F.col("__again"), placed))
    k = F.size("__placed") - 1
    same = F.zip_with(F.slice("__placed", F.lit(1), k), F.slice("__placed", F.lit(2), k), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    docs = docs.withColumn("__at", F.when(F.col("__again"), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    gaps = F.zip_with("__at", F.slice("__at", F.lit(2), F.greatest(F.size("__at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    docs = docs.withColumn("n_repeat_words", F.when(F.col("__again"), covered).otherwise(0).cast("long"))
    return docs.withColumns(
        {
            "word_chars": F.length("__text").cast("long") - F.col("__classes")[BLANK],  # all but the blanks is in words
            "n_symbols": F.length(F.regexp_replace("__odd", SYMBOLS, "")).cast("long"),  # symbols are of no class
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED),
        }
    ).drop("__text", "__lines", "__two", "__window", "__placed", "__again", "__at")


def judged(docs: DataFrame, references: DataFrame | None = None, max_classes: float = 0.16, max_commons: float = 0.24, min_chars: int = 200, min_common: int = 50, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs(text, lang, ...) with base counts, class_distance, word_distance and kept.

    kept is false if base_failed, if both distances lie beyond their maxima, or if class_distance
    lies beyond twice its own. class_distance counts from min_chars characters in words on,
    word_distance from min_common words on; a distance that doesn't count decides nothing, but where
    there is no word_distance class_distance decides alone. A null text has no words and fails the base rule; a
    null or unknown language is held against the pool of such documents, without word_distance; a language none
    of whose documents is fit for a reference has neither distance. Repeated rows are each judged. Own columns
    named like the added ones are replaced, any other name is kept. references: see language_references, best
    a kept set that was drawn from documents known as good; None: pooled over docs itself."""
    references = language_references(docs) if references is None else references
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    own = [c for c in docs.columns if c not in added]
    others = [c for c in own if c not in ("text", "lang")]
    packed = docs.select("text", "lang", F.struct(*others, F.lit(0).alias("__none")).alias("__row"))  # out of the way of helper names
    counted = ("__lang", "__classes", "__commons", "__chars", *added[:6])
    # The length is a pass over the text too: once here, not for each class and term of a distance.
    found = with_base_rules(with_histograms(packed), min_words).withColumn("__chars", F.length("text"))
    # One row in, one row out: filters on the result stop here, else they'd be pushed below the counting and repeat it.
    found = found.select("text", "lang", "__row", F.inline(F.array(F.struct(*counted)))).join(F.broadcast(references), "__lang", "left")
    found = found.withColumn("class_distance", F.when(F.col("word_chars") >= min_chars, distance(F.col("__classes"), F.col("__chars"), F.col("__ref_classes"))))
    found = found.withColumn("word_distance", F.when(F.col("n_words") >= min_common, distance(F.col("__commons"), F.col("n_words"), F.col("__ref_commons"))))
    classes, commons = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(1.0))
    far = ((classes > max_classes) & (commons > max_commons)) | (classes > 2 * max_classes)
    found = found.withColumn("kept", ~F.col("base_failed") & ~far)
    return found.select(*[F.col(c) if c in ("text", "lang") else F.col("__row")[c].alias(c) for c in own], *added)


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; limits: see judged."""
    return judged(docs, **limits).where("kept").select(docs.columns)
