"""Best-fit packing of token sequences, with lower bounds that certify each partition."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize
from tidemark.llm.text import Memo, by_bytes, hold

# ---------------------------------------------------------------- token ids


#: Fixed value: how a byte-level BPE file without a pattern of its own cuts texts into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str):
    """The same encoding for tiktoken, which is faster on rare words; None unless the file says that it is the same:
    its words are cut by ``PATTERN``, and each merge has the next id, so that ids order merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model.get("merges", ())]
    ids = [model["vocab"].get(x) for x in merges]
    same = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and whole.get("normalizer") is None and None not in ids
    if not same or any(b - a != 1 for a, b in zip(ids, ids[1:], strict=False)) or ids and ids[0] < 256:
        return None
    ranks = {bytes(sign[c] for c in x): i for x, i in model["vocab"].items() if i <= ids[-1] and all(c in sign for c in x)}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == ids[-1] + 1 else None


class ByteEncoder:
    """Token ids of texts for a byte-level BPE file of ``tokenizers``, as little-endian unsigned 32-bit bytes.

    Its pattern never joins a character to a later single space or line feed: a text may be cut before one that stands
    between two characters that are not white space. The parts are encoded for themselves, each distinct part once in a
    while.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ranked = Tokenizer.from_file(path), _ranked(path)
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.spaced = np.zeros(names[-1][1] + 1, bool)
        self.spaced[[i for name, i in names if name.startswith("Ġ")]] = True
        self.feed = np.frombuffer(self._encode_each(["\n"])[0], "<u4")[0]
        self.words, self.others = Memo(self._encode_words, 400_000), Memo(self._encode_each)

    def _encode_each(self, parts: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in parts]

    def _encode_joined(self, words: list[str], fed: bool) -> Iterator[tuple[str, bytes]]:
        """Ids of words without white space, each with the space before it, or (``fed``) the line feed that it begins with.

        They go together in a few calls; of each one, only the first id has a space, or is the line feed.
        """
        for a in range(0, len(words), 2000):
            some = words[a : a + 2000]
            text = "".join(some) if fed else " " + " ".join(some)
            ids = np.array(self.ranked.encode_ordinary(text) if self.ranked else self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(ids == self.feed if fed else self.spaced[ids])
            if len(starts) == len(some):
                ends, raw = [*starts[1:].tolist(), len(ids)], ids.tobytes()
                yield from ((w, raw[4 * i : 4 * j]) for w, i, j in zip(some, starts.tolist(), ends, strict=True))

    def _encode_words(self, words: list[str]) -> Iterator[bytes | None]:
        """Ids of parts that follow a space, with that space, or that begin with a line feed; None for a part with other
        white space at an end, or empty."""
        special = self.tokenizer.get_added_tokens_decoder().values() if self.ranked else ()
        marks = [t.content for t in special]
        plain, fed = [], []
        for w in words:
            core = w[1:] if w[:1] == "\n" else w
            if core and len(core.split()) == 1 and not core[0].isspace() and not core[-1].isspace() and not any(m in core for m in marks):
                (plain if core is w else fed).append(w)
        found = dict(self._encode_joined(plain, False)) | dict(self._encode_joined(fed, True))
        for w in words:
            if w in found:
                yield found[w]
            elif not w or w == "\n" or w[-1].isspace() or w[0] != "\n" and w[0].isspace() or w[0] == "\n" and w[1].isspace():
                yield None
            else:
                yield self._encode_each([w if w[0] == "\n" else " " + w])[0]

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts that begin with their space, cut where a single space has no white space beside it."""
        parts = text.split(" ")
        whole = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace() and whole[-1] and not whole[-1][-1].isspace():
                whole.append(" " + part)
            else:
                whole[-1] += " " + part
        return whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # A line feed goes with what follows it; parts that stood at other white space are None below.
        parts = [(x or "").replace("\n", " \n").split(" ") for x in texts]
        heads = [x.pop(0) for x in parts]
        firsts = self.others(heads)
        found = self.words([p for x in parts for p in x])
        out, at = [], 0
        for text, head, first, own in zip(texts, heads, firsts, parts, strict=True):
            ids = found[at : at + len(own)]
            at += len(own)
            if own and (None in ids or not head or head[-1].isspace()):
                out.append(b"".join(self.others(self.split(text))))
            else:
                out.append(first + b"".join(ids))
        return out


def encoder(path: str) -> ByteEncoder:
    return hold(("bytes", path), lambda: ByteEncoder(path))


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024, batch_bytes: int = 1 << 20) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: key, piece, start, length, ids (binary), ids_crc32.

    A document is its ids, then ``end_id``; a null text is just ``end_id``. Longer ones are cut so that only the first
    piece may be short.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                rows, out = [], ([], [], [], [])
                for row, ids in enumerate(coder.encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    start, stop, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        rows.append(row)
                        for column, value in zip(out, (piece, start, stop - start, ids[4 * start : 4 * stop]), strict=True):
                            column.append(value)
                        start, stop, piece = stop, stop + capacity, piece + 1
                piece, start, length, ids = out
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                keys = part.column("key").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), crc], ["key", "piece", "start", "length", "ids", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary, ids_crc32 long").withColumnRenamed("key", key)


# ---------------------------------------------------------------- packing


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, largest first, each into the fullest bin that has room."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0  # rooms: bit r is set if a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions over the histogram of sizes.

    For each split point e up to half a bin: items over capacity - e count as whole bins, items under e as nothing. For
    each k: an item counts as floor((k + 1) x) / k bins, or as x itself where (k + 1) x is whole (x: its share of a bin).
    """
    return bound_of_counts(*np.unique(sizes, return_counts=True), capacity) if len(sizes) else 0


def bound_of_counts(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """:func:`lower_bound` from the distinct lengths and how often each comes."""
    count = np.zeros(capacity + 1, np.int64)
    count[lengths] = counts
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    mass, number = np.concatenate([[0], np.cumsum(count * size)]), np.concatenate([[0], np.cumsum(count)])
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity) bins, to stay with whole numbers
        value = np.where(exact, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        """Packs one group anew; bins that came in are kept where that takes no fewer. ``gap``: bins over the bound."""
        group = group.sort_values("row", kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(sizes, capacity)
        before = group["bin"].nunique() if group["bin"].notna().all() else None
        if before is not None and before <= len(np.unique(bins)):
            bins, offsets = pd.factorize(group["bin"])[0].astype(np.int64), group["offset"].to_numpy(np.int64)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        return pd.DataFrame({"row": group["row"], "length": sizes, "part": group["part"], "bin": bins, "offset": offsets, "filled": used[bins], "gap": len(used) - lower_bound(sizes, capacity)})

    return pack


def _deal(capacity: int, n_parts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Deals the rows of each length in turn, so that all parts get the same mix of lengths."""
        seen = np.full(capacity, TaskContext.get().partitionId() * 7919, np.int64)
        for frame in frames:
            turn = seen[frame["length"]] + frame.groupby("length").cumcount().to_numpy(np.int64)
            seen += np.bincount(frame["length"], minlength=capacity)
            yield frame.assign(part=turn % n_parts)

    return deal


def pack_pieces(pieces: DataFrame, capacity: int = 1024, part_rows: int = 50_000, rounds: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; offsets in a sequence leave no gaps.

    Rows are numbered once, as a stored table. A full piece is a sequence by itself and isn't moved. The others are dealt,
    length by length, over parts of about ``part_rows`` rows; best-fit decreasing packs each part, and a part whose bins
    are as few as its lower bound is done. Of the other parts, the bins that still have room are dealt anew, whole bins at
    a time, and each new part is packed again; what came in stays where that saves nothing. That goes on until one part is
    left or a round saves no bin, or, if given, for ``rounds`` rounds. No value of any column puts more rows in a part. :func:`certificate`
    compares the whole with its bound.
    """
    numbered = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "packing-rows")
    full = numbered.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.col("row") * 2, "offset": F.lit(0).cast("long")})
    rest = numbered.filter(F.col("length") < capacity).select("row", "length")
    n_parts = max(1, -(-rest.count() // part_rows))
    schema = "row long, length long, part long, bin long, offset long, filled long, gap long"
    # Tasks read the stored rows in the same order each time, so that a lost task gives the same again.
    dealt = rest.mapInPandas(_deal(capacity, n_parts), "row long, length long, part long").withColumns({"bin": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    bin_id = F.col("part") * (1 << 24) + F.col("bin")
    packed = dealt.groupBy("part").applyInPandas(_pack(capacity), schema).withColumn("bin_id", bin_id)
    done, base, before = None, n_parts, None
    for turn in count():
        if n_parts == 1 or turn == rounds:
            break
        packed = materialize(packed, "packing-round")
        is_open = (F.col("gap") > 0) & (F.col("filled") < capacity)
        n_again, n_bins = packed.agg(F.sum(is_open.cast("long")), F.count(F.when((F.col("offset") == 0) & is_open, 1))).first()
        if not n_again or before is not None and n_bins >= before:
            break
        closed, again = packed.filter(~is_open), packed.filter(is_open)
        done = closed if done is None else done.unionByName(closed)
        before, n_parts = n_bins, max(1, -(-n_again // part_rows))
        again = again.withColumns({"part": base + F.pmod(F.xxhash64("bin_id"), F.lit(n_parts)), "bin": F.col("bin_id")})
        packed = again.select("row", "length", "part", "bin", "offset").groupBy("part").applyInPandas(_pack(capacity), schema).withColumn("bin_id", bin_id)
        base += n_parts
    done = packed if done is None else done.unionByName(packed)
    placed = done.select("row", (F.col("bin_id") * 2 + 1).alias("sequence_id"), "offset")
    rest = numbered.filter(F.col("length") < capacity).join(placed, "row")
    return full.unionByName(rest).drop("row")


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: n_sequences, bound (no packing of these pieces has fewer) and certified, whether they are equal.

    The bound is that of :func:`lower_bound` over the lengths of all rows, which is a table of at most ``capacity`` counts.
    """
    counts = packed.groupBy("length").agg(F.count("*").alias("n"))
    used = packed.select("sequence_id").distinct().agg(F.count("*").alias("n_sequences"))

    def bound(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bound": [bound_of_counts(table["length"].to_numpy(), table["n"].to_numpy(), capacity)]})

    found = counts.groupBy().applyInPandas(bound, "bound long")
    return used.join(found, how="left").fillna({"bound": 0}).select("n_sequences", "bound", (F.col("n_sequences") == F.col("bound")).alias("certified"))
