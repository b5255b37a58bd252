"""Quality rules: base counts and divergence from language references, in DataFrame functions only.

A document's character classes and its most common function words are two
histograms. The references are the same histograms of each language, summed
over all its documents that pass the base rules (``references``): one row of a few dozen
numbers per language in ``COMMON``, so they may be broadcast whatever the
corpus's size. A document is measured against its nearest language by
Jensen-Shannon distance (base two), texts under the guard lengths not at all,
and fails where a distance exceeds its threshold.

Defined results: null and empty text has no words and fails the base rules;
null or unlisted lang does not feed any reference, and is judged like any
other; a language without documents has no reference, and without any reference
the divergence verdict is to keep; repeated rows get a row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import cut, table

#: Common function words of each language.
COMMON = {
    "en": "the of and to a in is that it was for on with as be by this are or from at an not you have".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas plus au il elle ou avec ce".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Character classes in order: the pattern of what each removes.
CLASSES = (("lower", r"\p{Ll}"), ("upper", r"\p{Lu}"), ("digit", r"\p{Nd}"), ("space", r"[\x20\x09-\x0D]"), ("stop", r"[.,;:!?'\"()\-]"))
SPACE = 3
#: Largest distance from the nearest reference that is kept, and the least characters or words to judge.
MOST_CLASS, LEAST_CHARS = 0.30, 200
MOST_WORD, LEAST_WORDS = 0.33, 100
MIN_WORDS = 50

WORDS = tuple(dict.fromkeys(w for ws in COMMON.values() for w in ws))
#: As they are met in texts.
SPELT = tuple(dict.fromkeys(x for w in WORDS for x in (w, w.capitalize(), w.upper())))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bound(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def repeated_words(ws: Column, n: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Windows are sorted by hash with their place; those with an equal neighbour
    are repeats, and each covers up to three words not covered by the next.
    """
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def places(g: Column) -> Column:
        again = F.filter(g, lambda x, k: (x["h"] == F.get(g, k - 1)["h"]) | (x["h"] == F.get(g, k + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bound(placed, lambda g: bound(places(g), covered))).otherwise(F.lit(0).cast("long"))

    return F.when(n >= 3, bound(hashes, counted)).otherwise(F.lit(0).cast("long"))


def class_counts(text: Column) -> Column:
    """struct<classes (characters of each class, and the rest), n_symbols>.

    Each class is taken out of what the ones before have left, so that only the
    first pass reads the whole text; symbols are in none of the classes.
    """

    def level(t: Column, own: list[Column], rest: tuple) -> Column:
        if not rest:
            left = F.length(t)
            return F.struct(F.array(*own, left.cast("double")).alias("classes"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
        return bound(F.regexp_replace(t, f"(?:{rest[0][1]})+", ""), lambda r: level(r, [*own, (F.length(t) - F.length(r)).cast("double")], rest[1:]))

    return bound(text, lambda t: level(t, [], CLASSES))


def common_counts(ws: Column) -> Column:
    """array<struct<word, count>> of the words in WORDS, by word."""
    found = F.sort_array(F.transform(F.filter(ws, lambda w: w.isin(*SPELT)), lambda w: F.struct(F.lower(w).alias("w"))))

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, k: F.struct(x["w"].alias("w"), k.alias("k"))), lambda x: (x["k"] == 0) | (x["w"] != F.get(s, x["k"] - 1)["w"]))
        return bound(heads, lambda h: F.transform(h, lambda x, k: F.struct(x["w"].alias("w"), (F.coalesce(F.get(h, k + 1)["k"], F.size(s)) - x["k"]).cast("double").alias("n"))))

    return bound(found, runs)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and every count of a document; one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"), text.alias("text"))

    def fields(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            repeated_words(ws, F.size(ws)).alias("n_repeat_words"),
            common_counts(ws).alias("common"),
        )

    base = own.select("doc_id", "lang", bound(words(F.col("text")), fields).alias("w"), duplicate_lines(F.col("text")).alias("n_dup_lines"), class_counts(F.col("text")).alias("c"))
    # Words are what lies between white space.
    word_chars = sum((F.get("c.classes", F.lit(i)) for i in range(len(CLASSES) + 1) if i != SPACE), F.lit(0.0)).cast("long")
    return base.select("doc_id", "lang", "w.n_words", word_chars.alias("word_chars"), "c.n_symbols", "n_dup_lines", "w.n_repeat_words", "w.common", "c.classes")


def references(counted: DataFrame) -> DataFrame:
    """One row of all languages' references: array<struct<lang, classes, words>>, shares that sum to one.

    words has a share for each of WORDS, in order, and one for all other words.
    """
    known = counted.filter(F.col("lang").isin(*COMMON))
    classes = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    by_lang = known.groupBy("lang").agg(F.sum("n_words").cast("double").alias("all"), *classes)
    by_word = known.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.w").agg(F.sum("x.n").alias("n"))
    per_lang = by_word.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("m"))  # at most len(WORDS) entries
    shares = lambda xs: bound(xs, lambda a: bound(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(0.0))))
    both = by_lang.join(per_lang, "lang", "left")
    common = F.transform(F.array(*(F.lit(w) for w in WORDS)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0.0)))
    row = F.struct(
        "lang",
        shares(F.array(*(F.col(f"c{i}") for i in range(len(CLASSES) + 1)))).alias("classes"),
        shares(F.concat(common, F.array(F.col("all") - total(common)))).alias("words"),
    )
    return both.agg(F.sort_array(F.collect_list(row)).alias("refs"))


def _term(p: Column, q: Column) -> Column:
    """Twice the share of one bin in the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of one length."""
    return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, _term)) / 2))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame) -> DataFrame:
    counted = cut(measured(docs), "op8-counts")
    refs = references(counted.filter(~_base_failed()))
    joined = counted.crossJoin(F.broadcast(refs))  # a single row

    def class_distance(counts: Column) -> Column:
        return bound(total(counts), lambda t: F.when(t >= LEAST_CHARS, F.array_min(F.transform("refs", lambda r: divergence(F.transform(counts, lambda x: x / t), r["classes"])))))

    def word_distance(common: Column, n: Column) -> Column:
        names = F.array(*(F.lit(w) for w in WORDS))

        def one(r: Column) -> Column:
            # Listed words that the document lacks add their whole reference share.
            both = F.transform(common, lambda x: bound(F.get(r["words"], (F.array_position(names, x["w"]) - 1).cast("int")), lambda q: F.struct(_term(x["n"] / n, q).alias("d"), q.alias("q"), x["n"].alias("n"))))
            other = F.get(r["words"], F.lit(len(WORDS)))
            return bound(both, lambda b: F.sqrt(F.greatest(F.lit(0.0), (total(F.transform(b, lambda x: x["d"])) + 1 - other - total(F.transform(b, lambda x: x["q"])) + _term((n - total(F.transform(b, lambda x: x["n"]))) / n, other)) / 2)))

        return F.when(n >= LEAST_WORDS, F.array_min(F.transform("refs", one)))

    out = joined.withColumn("class_distance", class_distance(F.col("classes"))).withColumn("word_distance", word_distance(F.col("common"), F.col("n_words")))
    failed = _base_failed()
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
