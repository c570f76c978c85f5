"""Near-duplicates by SimHash and fuzzy hashing with the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.components import components
from tidemark.llm.storage import discard, materialize
from tidemark.llm.text import by_bytes, words

# ---------------------------------------------------------------- fingerprints


def simhash(text: str | None, shingle: int = 4) -> int:
    """64 bits of a text: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of its word shingles."""
    own = words(text)
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, batch_bytes: int = 1 << 20) -> DataFrame:
    """key, fp: the fingerprint of each whole text as a signed long; a null or blank text has 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                found = np.array([simhash(x, shingle) for x in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found)], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


# ---------------------------------------------------------------- Golay code

#: Fixed value: generator polynomial of the binary Golay code of length 23, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


class Golay:
    """Decodes 23-bit words: each is at most 3 bits from exactly one of 4096 codewords."""

    def __init__(self) -> None:
        power = [self._remainder(1 << i) for i in range(23)]
        place = np.arange(256)
        bits = [((place >> i) & 1) for i in range(8)]
        self.syndromes = []
        for byte in range(3):
            table = np.zeros(256, np.int64)
            for i in range(8):
                if 8 * byte + i < 23:
                    table ^= bits[i] * power[8 * byte + i]
            self.syndromes.append(table)
        self.errors = np.zeros(2048, np.int64)  # by syndrome, the error of at most three bits
        for n in (1, 2, 3):
            for at in combinations(range(23), n):
                syndrome = 0
                for i in at:
                    syndrome ^= power[i]
                self.errors[syndrome] = sum(1 << i for i in at)

    @staticmethod
    def _remainder(word: int) -> int:
        for i in range(word.bit_length() - 12, -1, -1):
            if word >> (i + 11) & 1:
                word ^= GENERATOR << i
        return word

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index, by its upper 12 bits, of each word's nearest codeword."""
        s = self.syndromes[0][words & 255] ^ self.syndromes[1][(words >> 8) & 255] ^ self.syndromes[2][words >> 16]
        return (words ^ self.errors[s]) >> 11

    def keys(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) codeword indices and which of them count: those of a word and of all words one bit away.

        Two words of ``width`` bits that differ in at most two bits share one of them, as there is a word at most one bit
        from both. A word within two bits of its codeword has one index, any other has up to six.
        """
        flips = np.array([0, *(1 << i for i in range(width))])
        found = np.sort(self.decode(words[:, None] ^ flips), axis=1)
        first = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], 1)
        order = np.argsort(~first, axis=1, kind="stable")[:, :6]
        return np.take_along_axis(found, order, 1), np.take_along_axis(first, order, 1)


GOLAY = Golay()
#: Segments of a fingerprint: first bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints (unsigned) and the row of each.

    Four differing bits leave at most two in the two segments that differ least, taken together: were there three, one of
    those segments would have two and the third as many. So some pair of segments, as one word, has a word at most one bit
    from both fingerprints: a pair's keys are its own two indices and those with one bit turned in either segment, about 10.
    """
    own, near = [], []
    for start, width in SEGMENTS:
        part = ((fps >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own.append(GOLAY.decode(part))
        near.append(GOLAY.keys(part, width))
    keys, rows = [], []
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (a, use_a), (b, use_b) = near[i], near[j]
        turned = use_a & (a != own[i][:, None])  # a pair's own two indices are among the others already
        key = np.concatenate([own[i][:, None] << 12 | b, a << 12 | own[j][:, None]], 1) | k << 24
        use = np.concatenate([use_b, turned], 1)
        keys.append(key[use])
        rows.append(np.nonzero(use)[0])
    return np.concatenate(keys), np.concatenate(rows)


def spanning_links(fps: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all members of a bucket which steps of at most ``most`` bits join; at most one per member.

    Members that are not reached yet are compared, as one vector, with one member at a time; those near enough are
    reached and leave the vector, so a large group of near copies is used up in a few steps.
    """
    left, right = [], []
    free = fps
    while len(free) > 1:
        wave, free = [free[0]], free[1:]
        while wave and len(free):
            one = wave.pop()
            near = np.bitwise_count(free ^ one) <= most
            if near.any():
                hit = free[near]
                left.append(np.full(len(hit), one))
                right.append(hit)
                wave.extend(hit)
                free = free[~near]
    return left, right


def _buckets(most: int, limit: int | None):
    """Visits sorted rows (key, fp) bucket by bucket: rows a, b of links; a bucket of over ``limit`` rows is handed on as
    rows (key, a) with no b, without being held."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            nulls = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([nulls if key is None else pa.array(key, pa.int64()), pa.array(a.view(np.int64)), nulls if b is None else pa.array(b.view(np.int64))], ["key", "a", "b"])

        def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            pairs = starts[sizes == 2]
            near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= most
            left, right = [fps[pairs][near]], [fps[pairs + 1][near]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if limit and size > limit:
                    yield rows(keys[start : start + size], fps[start : start + size], None)
                else:
                    more = spanning_links(fps[start : start + size], most)
                    left += more[0]
                    right += more[1]
            yield rows(None, np.concatenate(left), np.concatenate(right))

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last bucket so far
        size, passing = 0, None  # the key of a bucket that is handed on
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if passing is not None:
                end = int(np.searchsorted(keys, passing, side="right"))
                if end:
                    yield rows(keys[:end], fps[:end], None)
                keys, fps = keys[end:], fps[end:]
                if len(keys):
                    passing = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last or not held or held[-1][0][-1] != keys[0]:
                whole = [np.concatenate(x) for x in zip(*held, (keys[:last], fps[:last]), strict=True)]
                if len(whole[0]):
                    yield from found(*whole)
                held, size = [], 0
            held.append((keys[last:], fps[last:]))
            size += len(keys) - last
            if limit and size > limit:
                yield rows(*(np.concatenate(x) for x in zip(*held, strict=True)), None)
                held, size, passing = [], 0, keys[-1]
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return visit


def links(distinct: DataFrame, most: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) of at most ``most`` (up to 4) differing bits.

    Not all pairs, but enough to join everything that pairs would: in each bucket a spanning forest. Rows of a bucket
    come one after the other in a sorted partition. A bucket of over ``bucket_rows`` fingerprints isn't held: its rows are
    dealt into blocks of about half as many, and each pair of blocks is visited as a bucket of its own.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), 4096):
                some = fps[a : a + 4096]
                keys, rows = bucket_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(some[rows].view(np.int64))], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(emit, "key int, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    first = materialize(dealt.mapInArrow(_buckets(most, bucket_rows), "key long, a long, b long"), "bucket-links")
    large = first.filter("key is not null").select("key", F.col("a").alias("fp"))
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / bucket_rows).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    placed = large.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = placed.filter("n = 1 or own <> other").select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    again = paired.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_buckets(most, None), "key long, a long, b long")
    return first.filter("key is null").select("a", "b").unionByName(again.select("a", "b")).distinct()


def _roots(rows: DataFrame, most: int) -> DataFrame:
    """fp, root of all fingerprints of ``rows`` (key, fp): the component of each."""
    nodes = rows.select("fp").distinct()
    edges = materialize(links(nodes, most), "near")
    roots = components(edges)
    discard(edges)
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """One row per document: key, fp, component_id (the least key it reaches by links, its own included).

    Equal fingerprints are one node, so exact copies cost nothing; null and blank texts have fingerprint 0, which links
    like any other. A null key never is the least of several; a component of null keys only has a null id. Repeated rows
    stay rows of one component. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("key").alias("least"))
    named = _roots(rows, most).join(least, "fp")
    ids = named.select("fp", "root").join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(F.col("key").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = 4, most: int = 4, batch_bytes: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, whatever their columns, but of each group of near-duplicates only one: the first as stored.

    Rows are told apart by their place in a table that is stored with their fingerprints, so null and repeated keys don't
    matter; of wholly equal rows one stays.
    """
    schema = StructType([*docs.schema.fields, StructField("_fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text, batch_bytes):
                found = np.array([simhash(x, shingle) for x in part.column(text).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "_fp"])

    stored = materialize(docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "fingerprinted")
    rows = stored.select(F.col("_fp").alias("fp"), F.col("_row").alias("key"))
    first = rows.groupBy("fp").agg(F.min("key").alias("key"))
    kept = _roots(rows, most).join(first, "fp").groupBy("root").agg(F.min("key").alias("_row")).select("_row")
    return stored.join(kept, "_row", "left_semi").select(*docs.columns)
