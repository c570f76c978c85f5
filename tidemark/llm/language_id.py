"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.llm.text import by_bytes

UNKNOWN = "und"
#: The network reads running text, spaces and all, in segments of so many bytes.
SEGMENT = 128
#: Bytes whose labels count: letters of ASCII, and all bytes of other characters.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], np.float32)


class ByteGru:
    """Two gated recurrent layers, one in each direction, label each byte of a segment.

    A gate is (1 + tanh(a)) / 2, which is the logistic function of 2a.
    """

    def __init__(self, n_labels: int, hidden: int, rng: np.random.Generator):
        h = hidden
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h = h
        self.p = {"out": scale(2 * h, n_labels), "bias": np.zeros(n_labels, np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = (rng.standard_normal((256, 3 * h)) * 0.3).astype(np.float32)
            self.p[f"x{d}"][:, :h] += 0.5  # update gates start nearly closed: the state lasts
            self.p[f"u{d}"] = scale(h, 2 * h) / 2
            self.p[f"c{d}"] = scale(h, h)

    def _run(self, d: str, ids: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (time, hidden, batch) of one direction over ids (time, batch); kept: gets what backpropagation needs.

        The batch comes last, so that gates are whole blocks of memory.
        """
        h, table, u, c = self.h, self.p[f"x{d}"], self.p[f"u{d}"].T, self.p[f"c{d}"].T
        inputs = np.take(np.ascontiguousarray(table.T), ids, axis=1)
        states = np.empty((len(ids), h, ids.shape[1]), table.dtype)
        state = np.zeros(states.shape[1:], table.dtype)
        for t in range(len(ids)):
            gates = u @ state
            gates += inputs[: 2 * h, t]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:h], gates[h:]
            reset = r * state
            new = c @ reset
            new += inputs[2 * h :, t]
            np.tanh(new, out=new)
            after = states[t]
            np.subtract(state, new, out=after)
            after *= z
            after += new
            if kept is not None:
                kept.append((state, z, r, reset, new))
            state = after
        return states

    @staticmethod
    def _flip(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
        """For each (time, item) the time read from the other end of its segment, padding in place; None if all are full."""
        if (lengths == len(ids)).all():
            return None
        t = np.arange(len(ids))[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    @staticmethod
    def _turned(x: np.ndarray, flip: np.ndarray | None) -> np.ndarray:
        """x (time, ..., batch) read from the other end."""
        if flip is None:
            return x[::-1]
        return np.take_along_axis(x, flip if x.ndim == 2 else flip[:, None, :], 0)

    def forward(self, ids: np.ndarray, lengths: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, tuple]:
        """Probabilities (time, label, batch) of each byte's label."""
        flip = self._flip(ids, lengths)
        back_ids = self._turned(ids, flip)
        ahead = self._run("f", ids, kept and kept[0])
        back = self._turned(self._run("b", back_ids, kept and kept[1]), flip)
        h = self.h
        p = np.matmul(self.p["out"][:h].T, ahead)
        p += np.matmul(self.p["out"][h:].T, back)
        p += self.p["bias"][:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p, (flip, back_ids, ahead, back)

    def _back(self, d: str, ids: np.ndarray, grad_states: np.ndarray, kept: list, grads: dict[str, np.ndarray]) -> None:
        """Backpropagation through time in one direction."""
        h, u, c = self.h, self.p[f"u{d}"], self.p[f"c{d}"]
        gu, gc = np.zeros_like(u), np.zeros_like(c)
        inputs = np.empty((3 * h, *ids.shape), u.dtype)
        later = np.zeros(grad_states.shape[1:], u.dtype)
        for t in range(len(kept) - 1, -1, -1):
            state, z, r, reset, new = kept[t]
            g = grad_states[t] + later
            g_new = g * (1 - z) * (1 - new * new)
            g_reset = c @ g_new
            # of (1 + tanh(a)) / 2 = s by a: 2 s (1 - s)
            inputs[:h, t] = g * (state - new) * z * (1 - z) * 2
            inputs[h : 2 * h, t] = g_reset * state * r * (1 - r) * 2
            inputs[2 * h :, t] = g_new
            g_gates = inputs[: 2 * h, t]
            later = g * z + g_reset * r + u @ g_gates
            gu += state @ g_gates.T
            gc += reset @ g_new.T
        flat = ids.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        gx = np.zeros_like(self.p[f"x{d}"])
        gx[flat[order][first]] = np.add.reduceat(inputs.reshape(3 * h, -1)[:, order], first, axis=1).T
        grads[f"x{d}"], grads[f"u{d}"], grads[f"c{d}"] = gx, gu, gc

    def gradients(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes of a batch, and its gradients."""
        kept: tuple[list, list] = ([], [])
        p, (flip, back_ids, ahead, back) = self.forward(ids, lengths, kept)
        real = (np.arange(len(ids))[:, None] < lengths).astype(p.dtype)
        n, rows, h = real.sum(), np.arange(len(labels)), self.h
        loss = -(np.log(p[:, labels, rows]) * real).sum() / n
        p[:, labels, rows] -= 1
        p *= real[:, None, :] / n
        grads = {"out": np.concatenate([np.einsum("thn,tkn->hk", x, p) for x in (ahead, back)]), "bias": p.sum((0, 2))}
        self._back("f", ids, np.matmul(self.p["out"][:h], p), kept[0], grads)
        self._back("b", back_ids, self._turned(np.matmul(self.p["out"][h:], p), flip), kept[1], grads)
        return float(loss), grads


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (time, batch), and lengths."""
    lengths = np.array([len(x) for x in parts], np.int64)
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(parts), width).T), lengths


def segments(text: bytes, size: int = SEGMENT) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def train(parts: dict[str, list[bytes]], hidden: int = 8, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 7) -> tuple[list[str], ByteGru]:
    """Fits a network to segments by language; each language makes up an equal part of each batch.

    A batch is cut to a length drawn for it, an eighth of a segment to a whole one, so that short texts are learned as well.
    """
    labels = sorted(parts)
    rng = np.random.default_rng(seed)
    net = ByteGru(len(labels), hidden, rng)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    each = max(1, batch // len(labels))
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        size = int(rng.integers(SEGMENT // 8, SEGMENT + 1))
        picks = []
        for label in labels:
            for i in rng.integers(0, len(parts[label]), each):
                x = parts[label][i]
                at = int(rng.integers(0, max(1, len(x) - size + 1)))
                picks.append(x[at : at + size])
        ids, lengths = padded(picks)
        _, grads = net.gradients(ids, lengths, np.repeat(np.arange(len(labels)), each))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return labels, net


def pooled(net: ByteGru, texts: list[bytes], batch: int = 1024) -> np.ndarray:
    """For each text the sum of its letters' label probabilities, by label."""
    parts = [segments(x) for x in texts]
    flat = [s for x in parts for s in x]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    sums = np.zeros((len(texts), len(net.p["bias"])))
    order = np.argsort([-len(s) for s in flat], kind="stable")
    for a in range(0, len(flat), batch):
        some = order[a : a + batch]
        ids, lengths = padded([flat[i] for i in some])
        p, _ = net.forward(ids, lengths)
        counts = LETTERS[ids]  # padding is no letter
        np.add.at(sums, owner[some], np.einsum("tn,tkn->nk", counts, p))
    return sums


def sample_segments(docs: DataFrame, key: str, text: str, lang: str, per_language: int, per_text: int) -> dict[str, list[bytes]]:
    """Segments of running text by language: of at most ``per_language`` documents of each (those with the least hash of
    the key; rows without a key have no place in that order and are left out) at most ``per_text``, evenly spaced over the whole text. They are cut where the texts lie; the driver gets
    at most ``per_language`` * ``per_text`` * SEGMENT bytes a language."""
    order = Window.partitionBy("lang").orderBy("place", "key")
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    named = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("place"))
    chosen = named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("key").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for label, x in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = segments(x.encode("utf-8", "surrogatepass").lower())
                own = [own[i * len(own) // per_text] for i in range(per_text)] if len(own) > per_text else own
                langs += [label] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "part"])

    picked = rows.join(F.broadcast(chosen), rows[key] == chosen["key"]).select("key", F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # A key may have several rows: the bound holds for rows as well.
    again = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "text")
    few = picked.withColumn("n", F.row_number().over(again)).filter(F.col("n") <= per_language).select("lang", "text")
    parts: dict[str, list[bytes]] = {}
    for r in sorted(few.mapInArrow(cut, "lang string, part binary").collect(), key=lambda r: (r.lang, bytes(r.part))):
        parts.setdefault(r.lang, []).append(bytes(r.part))
    return parts


def identify(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 150, per_text: int = 32, carry: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: key, lang_pred, score; with ``carry`` all columns of ``docs`` instead of the key alone.

    The network is fitted to a sample of the labelled rows of ``training`` (see :func:`sample_segments`; its bounds are the
    parameters). Then it reads every whole text, A-Z in lower case, in segments of running text, and labels every byte; a
    document's probabilities are the mean over its letters (a-z and every byte beyond ASCII, so parts of a dash or an emoji
    count as well, though a text of those alone has no letter). ``und`` with score 0: a null text, one without any letter,
    or a training table without rows. Of equal probabilities the first language wins. Equal rows give equal rows; null keys
    stay; other columns are not read.
    """
    parts = sample_segments(training, key, text, lang, per_language, per_text)
    labels, net = train(parts) if parts else ([], None)
    rows = docs if carry else docs.select(key, text)
    kept = rows.columns if carry else [key]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in by_bytes(batch, text, batch_bytes):
                texts = [x.encode("utf-8", "surrogatepass").lower() if net and x and any(map(str.isalpha, x)) else b"" for x in part.column(text).to_pylist()]
                found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                for i, row in enumerate(pooled(net, texts)) if net else ():
                    if row.any():
                        best = int(row.argmax())
                        found[i], score[i] = labels[best], float(min(1.0, row[best] / row.sum()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.string()), pa.array(score, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
