"""Operator 4: line-first cleaning.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and
a document that loses more than `max_lost` of its word characters is rejected, as is one that fails
the base rules on its length and its repeated words.

Everything is computed inside the row, so nothing is shuffled and no document meets another one.
Repeated 8-word windows are found by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.llm.text import SPACE, free, let, space_words, whole

WINDOW = 8
#: Fixed patterns of the line rules.
SYMBOLS = r"[#*$%&|<>]"
ENDS = r"[.!?:;…。！？\"'”’»)\]][\x20\x09-\x0D]*$"
SHOUTS = r"!!+"
SEPARATORS = r"[|>»·•][\x20\x09-\x0D]|[\x20\x09-\x0D][|>»·•]"
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|use of cookies|"
    r"enable javascript|lorem ipsum|sign (in|up) (to|for|with)|log ?in to|subscribe to our|share on (facebook|twitter)|"
    r"click here to|skip to (main )?content|powered by [a-z]+$"
)
#: One of these stands in whatever BOILERPLATE matches.
BOILERPLATE_WORDS = ("rights", "terms", "policy", "cookie", "javascript", "lorem", "sign", "log", "subscribe", "share", "click", "skip", "powered", "settings")
WORD = r"[^\x20\x09-\x0D]"


def bare(c: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(c, SPACE, "")


def line_facts(line: Column, boilerplate: bool) -> Column:
    """What the rules ask of a line, each computed once. Regular expressions run only where a plainer test allows a match."""
    some = lambda test, value: F.when(test, value).otherwise(F.lit(0))
    return F.struct(
        line.alias("line"),
        F.size(space_words(line)).alias("n"),
        F.regexp_count(line, F.lit(f"{SYMBOLS}|{SHOUTS}")).alias("marks"),
        some(line.rlike("[|>»·•]"), F.regexp_count(line, F.lit(SEPARATORS))).alias("separators"),
        line.rlike(ENDS).alias("ends"),
        (line.rlike(BOILERPLATE) if boilerplate else F.lit(False)).alias("boilerplate"),
    )


def fails(x: Column, min_words: int, max_marks: float) -> Column:
    """Whether the line of these facts fails a rule; lines without a word never do."""
    punctuation = (~x["ends"] & (x["n"] < min_words)) | (x["marks"] > x["n"] * max_marks)
    navigation = (x["separators"] >= 3) & (x["separators"] > x["n"] * 0.3)
    return (x["n"] > 0) & (punctuation | navigation | x["boilerplate"])


def repeated_words(words: Column) -> Column:
    """Number of words in windows of WINDOW words that occur twice or more."""

    def grams(h: Column) -> Column:
        starts = F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(pairs: Column) -> Column:
        """From (hash, place) in order: places whose hash has a neighbour, and what their windows cover."""
        same = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        places = F.sort_array(F.transform(twice, lambda j: F.get(pairs, j)["i"]))
        return let(places, lambda at: F.aggregate(F.sequence(F.lit(0), F.size(at) - 2), F.lit(WINDOW), lambda a, j: a + F.least(F.lit(WINDOW), F.get(at, j + 1) - F.get(at, j))))

    def count(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(pairs, covered)).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), count))


def clean_lines(docs: DataFrame, *, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, min_line_words: int = 4, max_marks: float = 0.3, max_lost: float = 0.5) -> DataFrame:
    """All rows and columns of docs with a struct column `_rules`.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lost_chars are counts (long);
    base_failed and kept are the verdicts; clean_text is the text without the failing lines.
    A null text is an empty one: no words, so it fails the base rules. Lines without a word never fail
    and stay. Repeated rows are judged alike. All columns stay; if docs has a column `_rules`, the new one has one
    more underscore, and so on; it is the last column.
    """
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), whole(text).alias("_t"))
    d = d.withColumn("_words", space_words("_t")).withColumn("_lines", F.split("_t", "\n", -1))
    full = F.filter("_lines", lambda x: x.rlike(WORD))
    d = d.withColumns({"_n": F.size("_words"), "_full": full, "_repeat": repeated_words(F.col("_words"))})
    low = F.lower("_t")
    maybe = F.lit(False)
    for word in BOILERPLATE_WORDS:
        maybe = maybe | F.contains(low, F.lit(word))
    d = d.withColumn("_maybe", maybe)
    # outside the lambda: inside, Spark would work it out for every line
    searched = F.transform("_lines", lambda x: line_facts(x, True))
    plain = F.transform("_lines", lambda x: line_facts(x, False))
    d = d.withColumn("_facts", F.when(F.col("_maybe"), searched).otherwise(plain))
    failing = F.filter("_facts", lambda x: fails(x, min_line_words, max_marks))
    d = d.withColumn("_bad", F.transform(failing, lambda x: x["line"]))
    d = d.withColumns({"_chars": F.length(bare(F.col("_t"))), "_lost": F.length(bare(F.array_join("_bad", "")))})
    base = (F.col("_n") < min_words) | (100 * F.col("_repeat").cast("long") > max_repeat_percent * F.col("_n").cast("long"))
    rules = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").cast("long").alias("n_repeat_words"),
        F.col("_lost").cast("long").alias("lost_chars"),
        base.alias("base_failed"),
        (~base & (F.col("_lost") <= max_lost * F.col("_chars"))).alias("kept"),
        F.array_join(F.transform(F.filter("_facts", lambda x: ~fails(x, min_line_words, max_marks)), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    return d.select("_row.*", rules.alias(free("_rules", docs)))
