"""Token counts of whole texts: only lengths leave the Arrow tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import Memo, by_bytes, hold

MARK = "▁"
#: A single space between two characters that are neither spaces nor the library's own mark for one.
BOUNDARY = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class PieceCounter:
    """Counts for one sentencepiece model.

    A piece of such a model holds the mark for a space at its start only (checked when it is loaded), so no merge joins
    the end of a word to the next space: a text may be cut before any single space, and each part, which gets that space
    back as the library's own prefix, is encoded for itself. Long texts become many small parts that way.
    """

    def __init__(self, path: str, call_bytes: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        same = self.model.normalize("x ﬁ　y") == f"{MARK}x{MARK}ﬁ　y"
        self.separable = same and not any(MARK in x.lstrip(MARK) or x.startswith(MARK * 2) and x.strip(MARK) for x in names)
        self.call_bytes = call_bytes
        self.known = Memo(self._lengths)

    def _lengths(self, parts: list[str]) -> list[int]:
        """Encodes in calls of about equally many bytes; a single long part is a call of its own."""
        ends = np.cumsum([len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass")) for x in parts]) // self.call_bytes
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(parts)]
        return [len(x) for a, b in zip(cuts, cuts[1:], strict=False) for x in self.model.encode(parts[a:b], num_threads=1)]

    def split(self, text: str) -> list[str]:
        """Parts of a text between safe boundaries."""
        if not self.separable:
            return [text]
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return BOUNDARY.split(text)
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(x) if x else [] for x in texts]
        lengths = np.array(self.known([p for x in parts for p in x]), dtype=np.int64)
        ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return np.diff(total[np.concatenate([[0], ends])]).tolist()


def _counter(path: str, call_bytes: int) -> PieceCounter:
    return hold(("pieces", path, call_bytes), lambda: PieceCounter(path, call_bytes))


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, call_bytes: int = 1 << 18, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit.

    ``model`` is the path of a sentencepiece model that every executor has. A null text counts as empty (0 bytes,
    0 tokens). Texts are whole; begin, end and other added tokens are not counted. Equal rows give equal rows, a null key
    stays null, an empty table gives an empty one, and other columns are not read.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model, call_bytes)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                texts = part.column("text").to_pylist()
                sizes = pc.cast(pc.fill_null(pc.binary_length(part.column("text")), 0), pa.int64())
                counts = pa.array(counter.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), sizes, counts, pc.greater(counts, limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, f"key {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("key", key)
