"""Document fingerprints from content-defined chunks."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Chunk sizes in bytes: none is shorter (but the last) or longer, and boundaries are rarer before NORMAL than after it.
LEAST, NORMAL, MOST = 16, 48, 192
#: A boundary needs so many zero bits at the top of the rolling hash before and after NORMAL.
HARD, EASY = 6, 4
WINDOW = 32
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


def _rolling(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Gear hashes of the last 32 bytes at each byte, and where each text starts; gaps keep texts apart."""
    gap = bytes(WINDOW - 1)
    flat = np.frombuffer(gap.join(texts) if texts else b"", np.uint8)
    starts = np.cumsum([0, *(len(x) + WINDOW - 1 for x in texts[:-1])]).tolist()
    h = GEAR[flat]
    for start, text in zip(starts, texts, strict=True):
        h[start + len(text) : start + len(text) + WINDOW - 1] = 0
    for m in (1, 2, 4, 8, 16):
        h[m:] += h[:-m] << np.uint32(m)
    return h, starts


def cuts(n: int, hard: list[int], easy: list[int]) -> list[int]:
    """Ends of the chunks of a text of n bytes, from its sorted candidate ends."""
    found, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST, i)
        if i < len(hard) and hard[i] < start + NORMAL:
            end = hard[i]
        else:
            j = bisect_left(easy, start + NORMAL, j)
            end = min(n, easy[j] if j < len(easy) and easy[j] < start + MOST else start + MOST)
        found.append(end)
        start = end
    if start < n:
        found.append(n)
    return found


def chunk_sets(texts: list[bytes]) -> list[set[int]]:
    """For each text the set of its chunks as digest (40 bits) and length less one (8 bits)."""
    h, starts = _rolling(texts)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY)))
    hard = easy[h[easy] < np.uint32(1 << (32 - HARD))]
    digest = xxhash.xxh64_intdigest
    out = []
    for start, text in zip(starts, texts, strict=True):
        own = [(x[np.searchsorted(x, start) : np.searchsorted(x, start + len(text))] - start + 1).tolist() for x in (hard, easy)]
        ends = cuts(len(text), *own)
        out.append({(digest(text[a:b]) >> 24) << 8 | (b - a - 1) for a, b in zip([0, *ends], ends, strict=False)})
    return out


def to_string(chunks: set[int]) -> str:
    """Chunks in order, 12 hexadecimal digits each: ten of the digest, two of the length less one."""
    return b"".join(x.to_bytes(6, "big") for x in sorted(chunks)).hex()


def containment(a: set[int], b: set[int]) -> float:
    """Bytes in shared chunks as a share of the lighter set's; 1 for two empty texts."""
    if not a or not b:
        return float(not a and not b)
    weight = lambda chunks: sum(x & 255 for x in chunks) + len(chunks)
    return weight(a & b) / min(weight(a), weight(b))


def _places(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers that grow along the order of documents: the complement of a key, the largest number for null."""
    null = keys.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, np.iinfo(np.int64).max, ~keys.fill_null(0).to_numpy(zero_copy_only=False))


class Bounds:
    """Starts of parts, (place, hash) in order; a key that takes several parts is cut by the hashes of its texts."""

    def __init__(self, splits: list[int]):
        found, times = np.unique(np.array(splits, np.int64), return_counts=True)
        self.place = np.repeat(found, times)
        turn = np.arange(len(self.place)) - np.repeat(np.cumsum(times) - times, times)
        step = np.repeat((1 << 64) // times.astype(object), times) if len(times) else np.array([], object)
        self.hash = np.array([int(a) * int(b) - (1 << 63) for a, b in zip(turn, step, strict=True)], np.int64)

    def part(self, place: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """The part of each row: how many starts are not after it."""
        low, high = (np.searchsorted(self.place, place, side=s) for s in ("left", "right"))
        part = high.copy()
        for start in np.unique(low[high - low > 1]):
            rows = np.flatnonzero((low == start) & (high - low > 1))
            part[rows] = start + np.searchsorted(self.hash[start : high[rows[0]]], digest[rows], side="right")
        return part


def _in_order(docs: DataFrame, key: str, text: str, part_bytes: int) -> DataFrame:
    """key, text, extra, in partitions sorted by part and order; in each part a row with ``extra`` comes last.

    There are as many parts as ``part_bytes`` go into the bytes of all texts. They start at approximate quantiles of the
    key. The first document of each part (found in a pass over keys and hashes) is also sent, as extra row, to the part
    before; after the last part comes the first document.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, n_null, size = rows.agg(F.count("*"), F.count(F.when(F.col("key").isNull(), 1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_parts = max(1, -(-size // part_bytes))
    n_cuts = (n_parts - 1) * (n - n_null) // max(n, 1)
    splits: list[int] = []
    if n_cuts:
        odds = F.array(*(F.lit(i / (n_cuts + 1)) for i in range(1, n_cuts + 1)))
        # The sketch has about 20 entries a part.
        splits = [~x for x in rows.agg(F.percentile_approx("key", odds, max(10_000, 20 * n_parts))).first()[0]]
    bounds = Bounds(splits + [np.iinfo(np.int64).max] * (n_parts - 1 - n_cuts))
    hashed = rows.withColumn("digest", F.xxhash64("text"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        for batch in batches:
            place, digest = _places(batch.column("key")), batch.column("digest").to_numpy()
            part = bounds.part(place, digest)
            order = np.lexsort((digest, place, part))
            for i in order[np.flatnonzero(np.diff(part[order], prepend=-1))].tolist():
                own = (int(place[i]), int(digest[i]))
                first[int(part[i])] = min(own, first.get(int(part[i]), own))
        columns = [list(first), *zip(*first.values())] if first else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["part", "place", "digest"])

    least = F.min(F.struct("place", "digest")).alias("s")
    found = sorted(hashed.select("key", "digest").mapInArrow(starts, "part long, place long, digest long").groupBy("part").agg(least).collect())
    part_of, place_of, digest_of = (np.array([f(r) for r in found], np.int64) for f in (lambda r: r.part, lambda r: r.s.place, lambda r: r.s.digest))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, digest = _places(batch.column("key")), batch.column("digest").to_numpy()
            part = bounds.part(place, digest)
            at = np.searchsorted(part_of, part)
            first = np.flatnonzero((place_of[at] == place) & (digest_of[at] == digest))
            take = pa.array(np.concatenate([np.arange(len(part)), first]))
            parts = np.concatenate([part, part_of[at[first] - 1]])  # before the first part comes the last
            extra = np.arange(len(take)) >= len(part)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("key", "digest", "text")), pa.array(parts, pa.int64()), pa.array(extra)], ["key", "digest", "text", "part", "extra"])

    dealt = hashed.select("key", "digest", "text").mapInArrow(deal, "key long, digest long, text string, part long, extra boolean")
    return dealt.repartitionById(n_parts, F.col("part").cast("int")).sortWithinPartitions("part", "extra", F.col("key").desc_nulls_last(), "digest", "text").drop("digest")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 3, part_bytes: int = 64 << 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per document, with the fingerprints of its text and of an edited text.

    Edited: the last n_chars // ``share`` code points give way to the first as many (or all) of the next document by
    falling key, after the last the first one. Columns: key (long), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (containment of fingerprints). Texts are shuffled once; a task holds a
    batch of them. A part of about ``part_bytes`` is a task (pass more where there are many terabytes, as all parts are of one
    shuffle); a key with more rows than that takes several parts. Null texts are
    empty, null keys come last; equal keys go by the XXH64 of their text. An empty text has an empty fingerprint. Repeated
    rows follow each other. Other columns are not read.
    """

    def results(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        """Of (key, text, next text); each next text but the last is the next row's text, or else comes extra."""
        texts, at, after = [], [], []
        for i, (_, text, following) in enumerate(rows):
            at.append(len(texts))
            texts.append(text.encode("utf-8", "surrogatepass"))
            if i + 1 < len(rows) and rows[i + 1][1] is following:
                after.append(len(texts))
            else:
                after.append(len(texts))
                texts.append(following.encode("utf-8", "surrogatepass"))
        edited = []
        for _, text, following in rows:
            n = len(text) // share
            edited.append((text[: len(text) - n] + following[:n]).encode("utf-8", "surrogatepass"))
        sets = chunk_sets(texts)
        changed = chunk_sets(edited)
        own = [sets[i] for i in at]
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([to_string(x) for x in own], pa.string()),
            pa.array([to_string(x) for x in changed], pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
            pa.array([containment(a, sets[i]) for a, i in zip(own, after, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int | None, str] | None = None
        rows, size = [], 0
        for batch in batches:
            for k, text, extra in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "extra")), strict=True):
                if waiting is not None:
                    rows.append((*waiting, text))
                    size += len(waiting[1])
                waiting = None if extra else (k, text)
                if size >= batch_bytes:
                    yield results(rows)
                    rows, size = [], 0
        if rows:
            yield results(rows)

    found = _in_order(docs, key, text, part_bytes).mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("key", key)
