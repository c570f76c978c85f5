"""Line-first cleaning: lines are judged first, then documents by what they lose.

Only DataFrame functions; nothing leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import WORD

#: Wording of lines that a site repeats on its pages; a choice, to be replaced by the user's own.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
)
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Marks between the links of a navigation bar or a trail of pages.
BARS = "[|›»·]"


def _count(text: Column, part: str) -> Column:
    """How often a fixed string occurs."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def bad_line(line: Column) -> Column:
    """True where a line with words is shouting or symbols, a navigation bar, boilerplate or a crumb.

    Punctuation: three or more "!!" on at least half as many words, or as many symbols as words; or fewer than four
    words without a closing mark. Navigation: two or more marks of ``BARS`` among at most three times as many words. Boilerplate:
    a phrase of ``BOILERPLATE``.
    """
    line = F.coalesce(line, F.lit(""))
    n_words = F.regexp_count(line, F.lit(WORD))
    shouts, bars = _count(line, "!!"), F.regexp_count(line, F.lit(BARS))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&<>]"))
    crumb = (n_words < 4) & ~line.rlike(r"[.!?:;,)\]\"'”’»…。！？][\x20\x09-\x0D]*$")
    return (
        ((shouts >= 3) & (2 * shouts >= n_words))
        | ((symbols >= 3) & (symbols >= n_words))
        | crumb
        | ((bars >= 2) & (3 * bars >= n_words))
        | F.lower(line).rlike("|".join(BOILERPLATE))
    )


def _repeat_words(starts: Column) -> Column:
    """Words inside windows of three that occur twice or more, from the sorted window starts."""
    steps = F.transform(starts, lambda s, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), s - F.get(starts, k - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def quality_rules(docs: DataFrame, text: str = "text", out: str = "rules", max_lost: float = 0.5) -> DataFrame:
    """Adds a struct ``out``: base counts, ``cleaned`` text without the failed lines, and the verdict.

    A null text counts as empty, has no words and fails the base rule. Lines are parts between line feeds; those without
    words are neither good nor bad. ``kept`` is false if the base rule fails (under 50 words, or over half of them in
    repeated windows of three) or if the failed lines hold more than ``max_lost`` of the characters of all lines with
    words. Every row is judged by itself, so equal rows get equal values. A column of the name ``out`` is replaced;
    other columns stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.drop(out).withColumn(out, F.struct(F.split(whole, "\n").alias("lines"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("words"), whole.alias("whole")))
    c = lambda name: F.col(f"`{out}`.{name}")
    filled = F.filter(c("lines"), lambda x: x.rlike(WORD))
    grams = F.when(
        F.size(c("words")) >= 3,
        F.transform(F.slice(c("words"), 1, F.size(c("words")) - 2), lambda w, i: F.concat_ws(" ", w, F.get(c("words"), i + 1), F.get(c("words"), i + 2))),
    ).otherwise(F.array().cast("array<string>"))
    step = step.withColumn(out, F.struct(filled.alias("lines"), grams.alias("grams"), *(c(x).alias(x) for x in ("words", "whole"))))
    good = F.filter(c("lines"), lambda x: ~bad_line(x))
    ordered = F.when(
        F.size(F.array_distinct(c("grams"))) < F.size(c("grams")),
        F.sort_array(F.transform(c("grams"), lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    )
    step = step.withColumn(out, F.struct(good.alias("good"), ordered.alias("ordered"), *(c(x).alias(x) for x in ("lines", "words", "whole"))))
    starts = F.sort_array(
        F.transform(
            F.filter(c("ordered"), lambda x, k: (k > 0) & F.coalesce(F.get(c("ordered"), k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(c("ordered"), k + 1)["g"] == x["g"], F.lit(False))),
            lambda x: x["i"],
        )
    )
    step = step.withColumn(out, F.struct(starts.alias("starts"), *(c(x).alias(x) for x in ("good", "lines", "words", "whole"))))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    n_words = F.size(c("words")).cast("long")
    step = step.withColumn(
        out,
        F.struct(
            n_words.alias("n_words"),
            F.length(F.regexp_replace(c("whole"), BLANK, "")).cast("long").alias("word_chars"),
            F.regexp_count(c("whole"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias("n_dup_lines"),
            F.coalesce(_repeat_words(c("starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
            total(c("lines")).alias("line_chars"),
            total(c("good")).alias("good_chars"),
            F.array_join(c("good"), "\n").alias("cleaned"),
        ),
    )
    base_failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    lost = (c("line_chars") - c("good_chars")) > max_lost * c("line_chars")
    kept = ~base_failed & ~lost
    judged = F.col(f"`{out}`").withField("base_failed", base_failed).withField("lost_too_much", lost).withField("kept", kept)
    # As the one element of an array that is exploded, the struct is made once: a later filter on it isn't pushed down,
    # where its whole expression, steps and all, would be repeated for each use.
    return step.withColumn(out, F.explode(F.array(judged)))
