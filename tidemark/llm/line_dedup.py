"""Lines found in many documents: hashes in ranges, first occurrences streamed, a keep bitmap per document.

Only DataFrame functions; nothing leaves the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import materialize

BLANKS = " \t\n\x0b\x0c\r"
#: Columns that name a line's key and a document: two 64-bit hashes each.
KEY, DOC = ["_h1", "_h2"], ["_d1", "_d2"]


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _pair(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash: the same values under two seeds."""
    return F.xxhash64(F.lit("a"), *columns), F.xxhash64(F.lit("b"), *columns)


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _named(docs: DataFrame, text: str, key: str) -> list[Column]:
    """Hashes of a row's key and text; rows equal in both are the same document as far as bitmaps go."""
    # a null leaves a hash as it is, so null keys are marked
    return [h.alias(name) for h, name in zip(_pair(F.col(key).isNull(), F.col(key), _text(text)), DOC, strict=True)]


def line_table(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 1) -> DataFrame:
    """The stored lines whose key has ``least_chars`` code points or more: hashes, document, ``_row``, ``_pos``, ``_first``.

    Lines are dealt into ranges of (hash, key, document, row) and sorted there by position, so a line that a third of
    all documents share takes many ranges, and so do copies of one document, as every row has a number of its own.
    ``_first`` marks the first line of its key in its row: the sorted range is read once, in order.
    """
    lines = docs.select(F.col(key).alias("_key"), *_named(docs, text, key), F.monotonically_increasing_id().alias("_row"), _text(text).alias("_text"))
    lines = lines.select("_key", *DOC, "_row", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_line", line_key(F.col("_line"))).filter(F.length("_line") >= max(1, least_chars))
    lines = lines.select(*(h.alias(name) for h, name in zip(_pair(F.col("_line")), KEY, strict=True)), "_key", *DOC, "_row", "_pos")
    spot = [*KEY, "_key", *DOC, "_row"]
    ranges = lines.repartitionByRange(*spot).sortWithinPartitions(*spot, "_pos")
    first = F.row_number().over(Window.partitionBy(*spot).orderBy("_pos")) == 1
    return materialize(ranges.withColumn("_first", first), "lines")


def _losses(lines: DataFrame, least_docs: int, keep_first: bool) -> DataFrame:
    """One row per document that loses lines: its hashes and the sorted positions it loses."""
    order = F.struct(F.col("_key").isNull(), "_key", *DOC, "_pos")
    common = lines.filter("_first").groupBy(*KEY).agg(F.count("*").alias("_docs"), F.min(order).alias("_least")).filter(F.col("_docs") >= least_docs)
    # stored, so that its size is known before the join: sent to all tasks if small, else merged, where a hot line's rows can be split
    lost = lines.join(materialize(common.drop("_docs"), "common-lines"), KEY)
    if keep_first:
        lost = lost.filter(order != F.col("_least"))
    return lost.groupBy(*DOC).agg(F.array_sort(F.collect_set("_pos")).alias("_lost"))


def keep_bitmap(lost: Column, n_lines: Column) -> Column:
    """Runs (start, length) of the lines that stay, from the sorted positions of those that go."""
    before = F.concat(F.array(F.lit(-1)), lost)
    after = F.concat(lost, F.array(n_lines.cast("int")))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines in the runs of a keep bitmap, joined again; a null text is an empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, out: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct ``out``: n_lines, n_dropped and ``keep``, the bitmap of lines that stay.

    A line's key is the line without blanks at its ends, A-Z in lower case. Lines of a key found in ``least_docs``
    rows or more go everywhere, or, with ``keep_first``, everywhere but at its first place, by key (null last), then
    text, then position. The bitmap is compressed to runs (start, length) of lines that stay; ``kept_text`` applies
    it, so a caller who stores bitmaps stores no text. Keys are told apart by 128 bits of hash.

    Null and empty texts are one empty line, which has no key and stays. Rows are documents, repeated rows too; rows equal
    in key and text get equal bitmaps. Null keys are keys like others. All columns of ``docs`` are kept, whatever their
    names, but one named ``out`` is replaced.
    """
    carried = [c for c in docs.columns if c != out]
    losses = _losses(line_table(docs, text, key, least_chars), least_docs, keep_first)
    rows = docs.select(F.struct(*(F.col(c) for c in carried)).alias("_doc"), *_named(docs, text, key))
    n_lines = F.size(F.split(F.coalesce(F.col("_doc").getField(text), F.lit("")), "\n", -1))
    lost = F.coalesce(F.col("_lost"), F.array().cast("array<int>"))
    found = F.struct(n_lines.cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_dropped"), keep_bitmap(lost, n_lines).alias("keep"))
    joined = rows.join(losses, DOC, "left").select("_doc", found.alias("_found"))
    return joined.select(*(F.col("_doc").getField(c).alias(c) for c in carried), F.col("_found").alias(out))
