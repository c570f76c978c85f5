"""How the sources of a language diverge: packed terms sorted and counted in tasks, exact arithmetic on the sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import materialize
from tidemark.llm.text import by_bytes

#: A term packed into two words of eight bytes, or, if it has over 16 bytes, as it is (else empty).
TERM = ["w0", "w1", "long_term"]
SCALE = 1_000_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.array([b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows of uint64 words, the first word leading: a counting sort for each 16 bits that vary."""
    order = None
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order


def pack(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """The first 8 * ``words`` bytes from each start as big-endian uint64 words, zeros after a term's end."""
    span = 8 * words
    at = np.arange(span)
    taken = np.concatenate([data, np.zeros(span, np.uint8)])[starts[:, None] + at]
    taken[at >= lengths[:, None]] = 0
    return [np.ascontiguousarray(taken[:, 8 * i : 8 * i + 8]).view(">u8").ravel().astype(np.uint64) for i in range(words)]


def term_runs(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
    """Counts of terms per group in texts that stand in order of their group.

    ``data`` are the bytes of all texts, text i from offsets[i] to offsets[i + 1], groups[i] its group. Yields, for each bucket of
    lengths (to 8 bytes, to 16, and then by doublings), (w0, w1, long terms, group, occurrences, texts).
    Stable sorting leaves equal terms in order of their texts, so groups and texts are runs within a run of a term.
    """
    inside = _IS_TERM[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    bounds = offsets[:-1][offsets[1:] > offsets[:-1]]
    fresh[bounds] = True
    last[bounds[1:] - 1] = True
    starts = np.flatnonzero(inside & fresh)
    lengths = np.flatnonzero(inside & last) + 1 - starts
    texts = np.searchsorted(offsets, starts, side="right") - 1
    data = _LOWER[data]
    width, most = 8, int(lengths.max(initial=0))
    least = 0
    while least < most:
        here = np.flatnonzero((lengths > least) & (lengths <= width))
        least, width = width, 2 * width
        if not len(here):
            continue
        at, size, text = starts[here], lengths[here], texts[here]
        if least <= 16:
            words = pack(data, at, size, least // 8)
            order = radix_order(words)
            words = [w[order] for w in words]
            new = np.any([w[1:] != w[:-1] for w in words], axis=0)
        else:
            # a bucket by itself, sorted by bytes; its widest term is at most twice as long as its shortest
            span = int(size.max())
            terms = np.array([data[a : a + n].tobytes() for a, n in zip(at.tolist(), size.tolist(), strict=True)], f"S{span}")
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            new = terms[1:] != terms[:-1]
        text = text[order]
        group = groups[text]
        starts_run = np.concatenate([[True], new | (group[1:] != group[:-1])])
        starts_text = np.concatenate([[True], new | (text[1:] != text[:-1])])
        first = np.flatnonzero(starts_run)
        count = np.diff(np.append(first, len(text)))
        n_texts = np.add.reduceat(starts_text.astype(np.int64), first)
        if least <= 16:
            w1 = words[1][first] if len(words) > 1 else np.zeros(len(first), np.uint64)
            yield words[0][first], w1, [b""] * len(first), group[first], count, n_texts
        else:
            none = np.zeros(len(first), np.uint64)
            yield none, none, terms[first].tolist(), group[first], count, n_texts


def count_terms(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """lang, source, packed term, n, n_docs: occurrences and documents with it, one row per group and term."""
    columns = ["lang", "source", *TERM, "n", "n_docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", batch_bytes):
                names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
                pairs = factor(names)
                order = np.argsort(pairs[0], kind="stable")
                texts = batch.column("text").take(pa.array(order)).cast(pa.binary())
                offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                for w0, w1, long_terms, group, n, n_docs in term_runs(data, offsets - offsets[0], pairs[0][order]):
                    named = pairs[1].take(pa.array(group))
                    yield pa.RecordBatch.from_arrays([*named.flatten(), pa.array(w0.view(np.int64)), pa.array(w1.view(np.int64)), pa.array(long_terms, pa.binary()), pa.array(n.astype(np.int64)), pa.array(n_docs.astype(np.int64))], columns)

    parts = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, w0 long, w1 long, long_term binary, n long, n_docs long")
    return parts.groupBy("lang", "source", *TERM).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def factor(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values of an array of structs of two strings."""
    first, second = (pc.dictionary_encode(x) for x in values.flatten())
    codes = first.indices.to_numpy().astype(np.int64) * max(1, len(second.dictionary)) + second.indices.to_numpy()
    kept, inverse = np.unique(codes, return_inverse=True)
    wide = max(1, len(second.dictionary))
    distinct = pa.StructArray.from_arrays([first.dictionary.take(pa.array(kept // wide)), second.dictionary.take(pa.array(kept % wide))], ["lang", "source"])
    return inverse, distinct


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), by long division three digits at a time, so that totals to 9 * 10^15 fit; null without terms."""
    low = F.nullif((total + 2 * terms).cast("long"), F.lit(0).cast("long"))
    rest, found = (count + 2).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        found = found * 1000 + F.call_function("div", rest * 1000, low)
        rest = (rest * 1000) % low
    return found + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def term_string() -> Column:
    """The term of packed words: their bytes up to the first zero, or the long term."""
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    short = F.rtrim(F.decode(F.concat(word("w0"), word("w1")), "UTF-8"), F.lit("\0"))
    return F.when(F.length("long_term") == 0, short).otherwise(F.decode("long_term", "UTF-8"))


def _shared_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (lang, term, source, p, p0) in order of lang and term: per pair of sources the sum, over terms that both have, of
    distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)."""
    held: pa.Table | None = None

    def sums(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        sources = table.column("source").combine_chunks().dictionary_encode()
        s, lang = sources.indices.to_numpy().astype(np.int64), langs.indices.to_numpy().astype(np.int64)
        p, p0 = (table.column(c).to_numpy() for c in ("p", "p0"))
        run = np.cumsum(np.concatenate([[0], _changes(table)]))
        wide = len(sources.dictionary)
        keys, values = [], []
        left, step = np.arange(len(s)), 0
        while True:
            step += 1
            left = left[left + step < len(s)]
            left = left[run[left] == run[left + step]]
            if not len(left):
                break
            a, b = left, left + step
            value = _distance(p[a], p[b]) - _distance(p[a], p0[b]) - _distance(p0[a], p[b]) + _distance(p0[a], p0[b])
            code = (lang[a] * wide + s[a]) * wide + s[b]
            order = np.argsort(code, kind="stable")
            code, first = code[order], np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            keys.append(code[first])
            values.append(np.add.reduceat(value[order], first))
        keys, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, values))
        kept, inverse = np.unique(keys, return_inverse=True)
        total = np.zeros(len(kept), np.int64)
        np.add.at(total, inverse, values)
        pick = lambda d, i: d.dictionary.take(pa.array(i))
        return pa.RecordBatch.from_arrays([pick(langs, kept // (wide * wide)), pick(sources, kept // wide % wide), pick(sources, kept % wide), pa.array(total)], ["lang", "source", "item", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cut = np.flatnonzero(_changes(table))
        if len(cut):  # the last term may go on in the next batch
            yield sums(table.slice(0, int(cut[-1]) + 1))
            table = table.slice(int(cut[-1]) + 1)
        held = table
    if held is not None:
        yield sums(held)


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's language or term isn't that of the row before; one shorter than the table."""
    new = np.zeros(max(0, len(table) - 1), bool)
    for c in ("lang", *TERM):
        column = table.column(c)
        new |= pc.not_equal(column.slice(1), column.slice(0, len(table) - 1)).to_numpy().astype(bool) if len(table) > 1 else False
    return new


def source_audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of A-Z, a-z and all beyond ASCII, A-Z in lower case; a language keeps those in ``least_docs`` of its
    documents or more. A term's share p in a group is ``share`` of its count there, of all counts of kept terms there and of the number
    of kept terms, so terms that a group lacks have a share too; two shares differ by ``distance``. Part ``pair`` has, for every
    other source of the language, the sum over all kept terms; part ``term`` the ``top`` terms whose share in the group is
    above that in the language. Ranks fall by value, then rise by item in bytes. All numbers are exact.

    Terms are counted in tasks: those to 8 and to 16 bytes as one or two words by radix sort, longer ones in buckets by
    doubling lengths, sorted by bytes; only sums are shuffled, by term, so neither a hot source nor a hot term meets in one task. Of the pairs,
    terms that a source lacks are summed in closed form from the other one's histogram of shares; what two sources
    have in common is summed term by term, with all sources of a term in one task, which then has a row for each.

    Null and empty texts have no terms; a null language or source is ''. Every row is a document, repeated ones too. A
    language without kept terms gives pairs of value 0. Other columns of ``docs`` aren't read. No documents give no rows.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    # a row per source at most stands in a window
    of_term = Window.partitionBy("lang", *TERM)
    sums = {"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("n_docs").over(of_term), "lead": F.row_number().over(of_term.orderBy("source")) == 1}
    kept = materialize(count_terms(docs).withColumns(sums).filter(F.col("lang_docs") >= least_docs).drop("n_docs", "lang_docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("lead").cast("long")).alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")

    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    order = ["lang", *TERM]
    shared = rows.select("lang", *TERM, "source", "p", "p0").repartition(*order).sortWithinPartitions(*order, "source")
    shared = shared.mapInArrow(_shared_pairs, "lang string, source string, item string, value long")

    # what a source's own terms add over the share of terms that the other lacks, from how many terms have each share
    levels = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    own = levels.join(other, "lang").filter("source <> item")
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (distance(F.col("p"), F.col("q0")) - distance(F.col("p0"), F.col("q0")))).alias("value"))
    none = groups.select("lang", "source", "terms", "p0").join(other, "lang").filter("source <> item")
    none = none.select("lang", "source", "item", F.coalesce(F.col("terms") * distance(F.col("p0"), F.col("q0")), F.lit(0)).cast("long").alias("value"))
    # distances are symmetric, so both count for either order of the pair
    either = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = own.unionByName(shared).select("lang", either.alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")
    pairs = none.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    named = rows.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).filter("p > q")
    named = named.select("lang", "source", term_string().alias("item"), distance(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs).select(*columns).unionByName(ranked(named).filter(F.col("rank") <= top).select(*columns))
