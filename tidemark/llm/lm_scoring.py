"""Scoring of documents by a causal self-attention model over subword ids, trained in numpy."""

from __future__ import annotations

import base64
import copy
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize
from tidemark.llm.text import by_bytes, hold

# ---------------------------------------------------------------- words and subword ids


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts one after the other, each different one once, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.filter(real).cast(pa.binary()).dictionary_encode(), np.diff(before[starts])


#: What a tokenizer's pattern may take for a space, but the ASCII ones; and what stands for bytes that are no UTF-8.
SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\ufffd]")


class Subwords:
    """Ids of lower-cased words, each encoded for itself with one space before it, by a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = len(ranks)
        self.bytes_of = np.zeros(self.size, np.int64)
        for word, rank in ranks.items():
            self.bytes_of[rank] = len(word)

    def _encode(self, some: list[bytes]) -> list[bytes]:
        encode = self.coding.encode_ordinary
        return [np.array(encode(" " + w.decode("utf-8", "replace")), "<i4").tobytes() for w in some]

    def known(self, some: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        ids, size = self.encode(pa.array(some, pa.binary()))
        return [x.astype("<i4").tobytes() for x in np.split(ids, np.cumsum(size)[:-1])] if some else []

    def encode(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has.

        Words and their spaces are encoded as one string: no id reaches over an ASCII space, but where a word has another
        space in it, and then each word is encoded for itself. Ids are dealt to words by their bytes.
        """
        sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)  # a copy
        if not len(sizes):
            return np.empty(0, np.int32), sizes
        start, end = some.offset, some.offset + len(some)
        offsets = np.frombuffer(some.buffers()[1], np.int32)[start : end + 1]
        letters = np.frombuffer(some.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        joined = np.insert(letters, offsets[:-1] - offsets[0], 32).tobytes().decode("utf-8", "replace")
        if SPACES.search(joined):
            odd = np.array([bool(SPACES.search(w.decode("utf-8", "replace"))) for w in some.to_pylist()])
            own = [np.frombuffer(x, "<i4") for x in self._encode(some.filter(pa.array(odd)).to_pylist())]
            ids, sizes[~odd] = self.encode(some.filter(pa.array(~odd)))
            sizes[odd] = [len(x) for x in own]
            of_odd, out = np.repeat(odd, sizes), np.empty(sizes.sum(), np.int32)
            out[of_odd], out[~of_odd] = np.concatenate(own), ids
            return out, sizes
        ids = np.array(self.coding.encode_ordinary(joined), np.int32)
        at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes + 1), "right")
        return ids, np.diff(at, prepend=0)

    def texts(self, found: pa.DictionaryArray, n: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, with the end's id last, from its words as :func:`split` gives them."""
        table, size = self.encode(found.dictionary)
        table, size = np.append(table, np.int32(self.size)), np.append(size, 1)  # a last word that is the end
        starts = np.cumsum(size) - size
        word = np.insert(found.indices.to_numpy(), np.cumsum(n), len(size) - 1)
        size_of = size[word]
        ends = np.cumsum(size_of)
        place = np.arange(ends[-1] if len(ends) else 0)
        place += np.repeat(starts[word] - (ends - size_of), size_of)
        return np.split(table[place], ends[np.cumsum(n + 1) - 1][:-1]) if len(n) else []


def subwords(path: str, pattern: str) -> Subwords:
    return hold(("subwords", path), lambda: Subwords(path, pattern))


# ---------------------------------------------------------------- model

#: Products that an exponential takes are cut to this size, so that sums of them stay finite and positive.
LIMIT = 60.0


def cut(x: np.ndarray) -> None:
    np.minimum(x, x.dtype.type(LIMIT), out=x)
    np.maximum(x, x.dtype.type(-LIMIT), out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """In place, by one exponential, which numpy has faster."""
    x *= x.dtype.type(2)
    np.minimum(x, x.dtype.type(LIMIT), out=x)
    np.exp(x, out=x)
    x += x.dtype.type(1)
    np.divide(x.dtype.type(-2), x, out=x)
    x += x.dtype.type(1)
    return x


def sums_of_rows(g: np.ndarray, order: np.ndarray, first: np.ndarray, times: np.ndarray, many: int = 16) -> np.ndarray:
    """Sums of the rows of g in groups: the rows ``order[first[i] : first[i] + times[i]]`` are group i.

    Groups of many rows are summed one by one, the others together, their n-th rows at a time.
    """
    out = np.empty((len(first), g.shape[1]), g.dtype)
    large = np.flatnonzero(times > many)
    ones = np.ones(times.max(initial=0), g.dtype)
    for i in large:
        out[i] = ones[: times[i]] @ np.take(g, order[first[i] : first[i] + times[i]], axis=0)
    small = np.argsort(-np.where(times > many, 0, times), kind="stable")[: len(times) - len(large)]
    begin, counts = first[small], times[small]
    total = np.take(g, order[begin], axis=0)
    for turn in range(1, int(counts.max(initial=0))):
        some = np.searchsorted(-counts, -turn)  # those with more rows come first
        total[:some] += np.take(g, order[begin[:some] + turn], axis=0)
    out[small] = total
    return out


class CausalModel:
    """One causal attention layer that predicts the next id in two steps: its class, then its place in the class.

    Seen ids are ranked by their counts over all training texts. A class holds neighbours in that order: ``first`` ids, or
    a ``growth``-th of the ranks before it where that is more. So frequent ids sit in small classes and each seen id has
    places of its own, as input and as output, while a prediction costs about as many terms as there are classes and
    members of a frequent one. Unseen ids share the last class, with equal odds. The end of a text is an id.
    Probabilities of all ids sum to 1.
    """

    def __init__(self, counts: np.ndarray, width: int = 24, hidden: int = 32, window: int = 32, overlap: int = 8, first: int = 32, growth: int = 4, seed: int = 3):
        self.window, self.overlap, self.width = window, overlap, width
        rng = np.random.default_rng(seed)
        seen = np.flatnonzero(counts > 0)
        order = seen[np.argsort(-counts[seen], kind="stable")]
        n = len(order)
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(min(n, cuts[-1] + max(first, cuts[-1] // growth)))
        self.cuts = np.array(cuts)  # class c holds the ranks from cuts[c] to cuts[c + 1]
        self.n_classes = len(cuts) - 1
        self.place = np.full(len(counts), n, np.int32)  # of each id: its rank; unseen ids share the last place
        self.place[order] = np.arange(n)
        self.class_of = np.append(np.repeat(np.arange(self.n_classes), np.diff(self.cuts)), self.n_classes).astype(np.uint16)
        self.unseen_logp = np.float32(-np.log(max(1, len(counts) - n)))
        top = counts[order].astype(np.float64)
        mass = np.append(np.add.reduceat(top, self.cuts[:-1]) if n else [], 0.5 * max(1, len(counts) - n))
        inner = np.log(top / mass[self.class_of[:n]]) if n else top
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "ids": (rng.standard_normal((n + 2, width)) * 0.5).astype(np.float32),  # unseen ids, then the start, come last
            "at": (rng.standard_normal((window, width)) * 0.1).astype(np.float32),
            "qkv": scale(width, 3 * width),
            "w": scale(width, hidden),
            "b": np.zeros(hidden, np.float32),
            "class": scale(hidden, self.n_classes + 1) * np.float32(0.3),
            "class_b": np.log(mass / mass.sum()).astype(np.float32),
            "member": scale(hidden, n).T * np.float32(0.3),
            "member_b": inner.astype(np.float32),
        }
        self.p["member"] = np.ascontiguousarray(self.p["member"])
        self.start = n + 1
        self._tables: tuple | None = None
        self.causal = np.tril(np.ones((window, window), np.float32))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows over n positions, and the first position that each one scores."""
        w, step = self.window, self.window - self.overlap
        if n <= w:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        starts = np.append(np.arange(0, n - w, step), n - w)
        return starts, np.append(0, starts[:-1] + w)

    def _rows(self, x: np.ndarray, one: int) -> tuple[np.ndarray, np.ndarray]:
        """Products of inputs with the weights: keys, values and ``one``; queries and what goes to the hidden layer as it is.

        What attention and the hidden layer take from an input is linear in it, so it is a row of a table, and the hidden
        layer's weights go into the values. The column of ones makes a product with the values sum the weights as well.
        """
        width = self.width
        own = x @ self._joined()
        ones = np.full((len(x), 1), one, own.dtype)
        return np.concatenate([own[:, : -width - len(self.p["b"])], ones], 1), own[:, -width - len(self.p["b"]) :]

    def _joined(self) -> np.ndarray:
        """The weights of keys, values, queries and the hidden layer side by side."""
        p, width = self.p, self.width
        q, k, v = np.split(p["qkv"], 3, 1)
        return np.concatenate([k, v @ p["w"], q * q.dtype.type(width**-0.5), p["w"]], 1)

    def _attend(self, kv: np.ndarray, qx: np.ndarray, calm: bool = False) -> tuple[np.ndarray, tuple]:
        """Hidden states of the last positions of windows, as many as have queries, and what backpropagation needs."""
        width = self.width
        e = np.matmul(qx[..., :width], kv[..., :width].transpose(0, 2, 1))
        if not calm:
            cut(e)
        np.exp(e, out=e)
        e *= self.causal[self.window - e.shape[1] :]
        mixed = np.matmul(e, kv[..., width:])
        total = mixed[..., -1:]
        y = mixed[..., :-1] / total
        h = y + qx[..., width:]
        return tanh(h), (e, total, y)

    def _hidden(self, places: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Hidden states of (batch, window) input places, and what backpropagation needs."""
        kv, qx = self._rows(self.p["ids"], 1)
        at_kv, at_qx = self._rows(self.p["at"], 0)
        h, more = self._attend(kv[places] + at_kv, qx[places] + at_qx + np.append(np.zeros(self.width, qx.dtype), self.p["b"]))
        return h.reshape(-1, h.shape[-1]), more

    def _by_class(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of targets by class, and where each class starts in it."""
        group = self.class_of[place]
        return np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=self.n_classes + 1))])

    def _calm(self, *tables: tuple[np.ndarray, np.ndarray]) -> tuple[bool, bool]:
        """Whether no product of keys and queries, and none of hidden states and weights, can be so large that it has to be cut."""
        p = self.p
        longest = [sum(np.sqrt(np.square(t[i][:, : self.width]).sum(1).max(initial=0)) for t in tables) for i in (0, 1)]
        reach = max(np.abs(p[k]).sum(axis).max() + np.abs(p[f"{k}_b"]).max() for k, axis in (("class", 0), ("member", 1)) if p[k].size)
        return bool(longest[0] * longest[1] < LIMIT), bool(reach < LIMIT)

    def _fold(self) -> tuple[tuple, tuple, bool, bool]:
        """The rows of :meth:`_rows` by place and by position, made once for scoring.

        Last, whether no product can be so large that it has to be cut.
        """
        if self._tables is None:
            p = self.p
            ids, at = self._rows(p["ids"], 1), self._rows(p["at"], 0)
            at[1][:, self.width :] += p["b"]
            self._tables = tuple(map(np.ascontiguousarray, ids)), at, *self._calm(ids, at)
        return self._tables

    def _states(self, places: np.ndarray, skip: int = 0) -> np.ndarray:
        """As :meth:`_hidden`, by the tables of :meth:`_fold`, without the first ``skip`` positions of each window."""
        (kv, qx), (at_kv, at_qx), calm, _ = self._fold()
        kv, qx = np.take(kv, places, axis=0), np.take(qx, places[:, skip:], axis=0)
        kv += at_kv
        qx += at_qx[skip:]
        h = self._attend(kv, qx, calm)[0]
        return h.reshape(-1, h.shape[-1])

    def _leads(self, scored: np.ndarray) -> np.ndarray:
        """Of windows: whether their first positions are scored as well, not context alone."""
        return scored[:, : self.overlap].any(1)

    def logp(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the target ids at the scored positions of (batch, window) input places."""
        p, some = self.p, 64  # windows whose attention fits in a core's cache
        calm = self._fold()[3]
        skip = 0 if self._leads(scored).any() else self.overlap
        place = self.place[targets[scored]]
        group = self.class_of[place]
        ones = np.ones(max(self.n_classes + 1, int(np.diff(self.cuts).max(initial=0))), np.float32)
        rows = np.arange(len(place))
        states, out, at = np.empty((len(place), len(p["b"])), np.float32), np.empty(len(place), np.float32), 0
        for a in range(0, len(inputs), some):
            h = self._states(inputs[a : a + some], skip)[scored[a : a + some, skip:].ravel()]
            end = at + len(h)
            states[at:end] = h
            logits = h @ p["class"]
            logits += p["class_b"]
            if not calm:
                cut(logits)
            out[at:end] = logits[rows[: len(h)], group[at:end]]
            np.exp(logits, out=logits)
            out[at:end] -= np.log(logits @ ones[: self.n_classes + 1])
            at = end
        order, starts = self._by_class(place)
        h, place, inner = np.take(states, order, axis=0), place[order], np.empty(len(place), np.float32)
        for c in range(self.n_classes):
            a, b, low, high = starts[c], starts[c + 1], self.cuts[c], self.cuts[c + 1]
            if a < b:
                own = h[a:b] @ p["member"][low:high].T
                own += p["member_b"][low:high]
                if not calm:
                    cut(own)
                inner[a:b] = own[rows[: b - a], place[a:b] - low]
                np.exp(own, out=own)
                inner[a:b] -= np.log(own @ ones[: high - low])
        inner[starts[-2] :] = self.unseen_logp
        out[order] += inner
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray | None = None) -> tuple[float, dict[str, tuple[np.ndarray | slice, np.ndarray]]]:
        """Mean negative log-probability over the scored positions of windows (all by default), and its gradients.

        Each gradient comes with the rows that it is of; the other rows of that table have none.
        """
        p, width, hidden = self.p, self.width, len(self.p["b"])
        scored = np.ones(inputs.shape, bool) if scored is None else scored
        leads = self._leads(scored)
        turn = np.argsort(leads, kind="stable")  # windows whose first positions are context alone come first
        inputs, targets, scored = inputs[turn], targets[turn], scored[turn]
        some = len(leads) - int(leads.sum())
        # Rows of the different inputs, dealt to all positions.
        read = inputs.ravel()
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(read[order]) != 0]))
        used, times = read[order[first]], np.diff(np.append(first, len(read)))
        inverse = np.empty(len(read), np.int64)
        inverse[order] = np.repeat(np.arange(len(used)), times)
        inverse = inverse.reshape(inputs.shape)
        x = p["ids"][used]
        kv, qx = self._rows(x, 1)
        at_kv, at_qx = self._rows(p["at"], 0)
        at_qx[:, width:] += p["b"]
        calm, calm_out = self._calm((kv, qx), (at_kv, at_qx))
        kind = kv.dtype.type
        kv = np.take(kv, inverse, axis=0)
        kv += at_kv
        qx = np.ascontiguousarray(qx)
        parts = []
        for a, b, skip in ((0, some, self.overlap), (some, len(inputs), 0)):
            if a < b:
                own = np.take(qx, inverse[a:b, skip:], axis=0)
                own += at_qx[skip:]
                parts.append((a, b, skip, own, *self._attend(kv[a:b], own, calm)))
        every = [(h.reshape(-1, hidden), np.flatnonzero(scored[a:b, skip:]), targets[a:b, skip:]) for a, b, skip, _, h, _ in parts]
        h = np.concatenate([np.take(h, use, axis=0) for h, use, _ in every])
        place = self.place[np.concatenate([t.ravel()[use] for _, use, t in every])]
        n, (by_class, starts) = len(h), self._by_class(place)
        h, place = np.take(h, by_class, axis=0), place[by_class]
        scaled = h * kind(1 / n)
        group = self.class_of[place]
        rows = np.arange(n)
        logits = h @ p["class"]
        logits += p["class_b"]
        if not calm_out:
            cut(logits)
        np.exp(logits, out=logits)
        logits /= (logits @ np.ones(self.n_classes + 1, kind))[:, None]
        loss = -np.log(logits[rows, group]).sum()
        logits[rows, group] -= 1
        all_rows, ones = slice(None), np.ones(n, kind)
        grads = {"class": (all_rows, scaled.T @ logits), "class_b": (all_rows, (ones @ logits) * kind(1 / n))}
        gh = logits @ p["class"].T
        touched, members, biases, chosen = [], [], [], np.ones(n, kind)
        for c in range(self.n_classes):
            a, b, low, high = starts[c], starts[c + 1], self.cuts[c], self.cuts[c + 1]
            if a == b:
                continue
            weights = p["member"][low:high]
            own = h[a:b] @ weights.T
            own += p["member_b"][low:high]
            if not calm_out:
                cut(own)
            np.exp(own, out=own)
            own /= (own @ np.ones(high - low, kind))[:, None]
            target = rows[: b - a] * (high - low)
            target += place[a:b]
            target -= low
            flat = own.reshape(-1)
            np.take(flat, target, out=chosen[a:b], mode="clip")
            flat[target] = chosen[a:b] - 1
            touched.append(np.arange(low, high))
            members.append(own.T @ scaled[a:b])
            biases.append(ones[a:b] @ own)
            gh[a:b] += own @ weights
        loss -= np.log(chosen).sum() + float(self.unseen_logp) * (n - starts[-2])
        if touched:
            at = np.concatenate(touched)
            grads["member"], grads["member_b"] = (at, np.concatenate(members)), (at, np.concatenate(biases) * kind(1 / n))
        h *= -h
        h += 1
        gh *= h
        gh *= kind(1 / n)
        back = np.empty_like(gh)
        back[by_class] = gh
        # The gradients of all positions' rows: keys, values, queries, hidden layer.
        g, done = np.empty((*inputs.shape, 2 * (width + hidden)), kind), 0
        g[:some, : self.overlap, width + hidden :] = 0
        for (a, b, skip, q, _, (e, total, y)), (_, use, _) in zip(parts, every, strict=True):
            gy = np.zeros((y.shape[0] * y.shape[1], hidden + 1), kind)
            gy[use, :-1] = back[done : done + len(use)]
            done += len(use)
            gy = gy.reshape(*y.shape[:2], -1)
            # Less the mean of the weights' gradients, through the column of ones.
            np.einsum("bij,bij->bi", gy[..., :-1], y, out=gy[..., -1])
            np.negative(gy[..., -1], out=gy[..., -1])
            e /= total
            ga = np.matmul(gy, kv[a:b, :, width:].transpose(0, 2, 1))
            ga *= e
            own = g[a:b]
            own[..., :width] = np.matmul(ga.transpose(0, 2, 1), q[..., :width])
            own[..., width : width + hidden] = np.matmul(e.transpose(0, 2, 1), gy[..., :-1])
            own[:, skip:, width + hidden : -hidden] = np.matmul(ga, kv[a:b, :, :width])
            own[:, skip:, -hidden:] = gy[..., :-1]
        at = (np.ones(len(g), kind) @ g.reshape(len(g), -1)).reshape(self.window, -1)
        g = sums_of_rows(g.reshape(-1, g.shape[-1]), order, first, times)
        joined = self._joined()
        grads["ids"], grads["at"], grads["b"] = (used, g @ joined.T), (all_rows, at @ joined.T), (all_rows, at[:, -hidden:].sum(0))
        k, v, q, w = np.split(x.T @ g + p["at"].T @ at, np.cumsum([width, hidden, width]), 1)
        grads["qkv"] = (all_rows, np.concatenate([q * kind(width**-0.5), k, v @ p["w"].T], 1))
        grads["w"] = (all_rows, p["qkv"][:, 2 * width :].T @ v + w)
        return float(loss) / n, grads

    def sequence(self, ids: np.ndarray) -> np.ndarray:
        """Input places that predict ids: the start, then all but the last id."""
        return np.concatenate([[self.start], self.place[ids[:-1]]])

    def _flat(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and input places of all texts one after the other, and a window of padding."""
        pad = np.zeros(self.window, np.int32)
        return np.concatenate([*texts, pad]), np.concatenate([*(self.sequence(t) for t in texts), pad])

    def n_windows(self, texts: list[np.ndarray]) -> int:
        """How many windows the texts take."""
        step = self.window - self.overlap
        return sum(1 + max(0, -(-(len(t) - self.window) // step)) for t in texts)

    def _spread(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """All texts as one: ids, input places, and by window its text's first place and size, its start, its first scored position."""
        w = self.window
        n = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        flat, places = self._flat(texts)
        step = w - self.overlap
        count = np.where(n <= w, 1, 1 + -(-(n - w) // step))
        turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        last = turn == np.repeat(count, count) - 1
        starts = np.where(last, np.repeat(np.maximum(n - w, 0), count), turn * step)
        fresh = np.where(turn == 0, 0, (turn - 1) * step + w)
        return flat, places, np.repeat(np.arange(len(texts)), count), first, n, starts, fresh

    def train(self, texts: list[np.ndarray], steps: int | None = None, batch: int = 128, rate: float = 0.05, span: tuple[float, float] = (0.0, 1.0), seed: int = 5) -> None:
        """Adam over the windows of all texts, in random order.

        The windows are those that score: they overlap, and each id is learned once in a pass, in the window that scores
        it, with the ids before it as its context. Each text ends with the end id, short windows are padded and masked. By default every
        window comes up once. ``span`` is the part of the whole training that this call is: the rate falls over its second half.
        """
        rng = np.random.default_rng(seed)
        w, self._tables = self.window, None
        flat, places, owner, first, n, starts, fresh = self._spread(texts)
        places = places.astype(np.min_scalar_type(self.start))  # numbers of 16 bits are sorted faster
        steps_in = np.arange(w)
        per_pass = -(-len(starts) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, (steps or per_pass) + 1):
            turn = (step - 1) % per_pass
            if turn == 0:
                order = rng.permutation(len(starts))
            some = order[turn * batch : (turn + 1) * batch]
            place = starts[some, None] + steps_in
            index = first[owner[some], None] + place
            _, grads = self.gradients(places[index], flat[index], (place >= fresh[some, None]) & (place < n[owner[some], None]))
            pace = np.float32(rate * min(1.0, 2 * (1 - span[0] - (span[1] - span[0]) * step / ((steps or per_pass) + 1))) / (1 - 0.9**step))
            soft = np.float32(1 / (1 - 0.99**step))
            # m and v are kept as sums without their factors 0.1 and 0.01.
            scale = np.sqrt(np.float32(0.01) * soft)
            for k, (at, g) in grads.items():
                # Of the tables by id only the rows that a batch touches move; neighbours move without a copy.
                cuts = [] if isinstance(at, slice) else np.flatnonzero(np.diff(at) != 1) + 1
                if len(cuts) > 8 or isinstance(at, slice):
                    some = [(at, g)]
                else:
                    ends = [0, *cuts, len(at)]
                    some = [(slice(int(at[i]), int(at[j - 1]) + 1), g[i:j]) for i, j in zip(ends, ends[1:])]
                for rows, g in some:
                    new_m, new_v = m[k][rows], v[k][rows]
                    new_m *= np.float32(0.9)
                    new_m += g
                    new_v *= np.float32(0.99)
                    g *= g
                    new_v += g
                    if not isinstance(rows, slice):
                        m[k][rows], v[k][rows] = new_m, new_v
                    np.sqrt(new_v, out=g)
                    g += np.float32(1e-8) / scale
                    np.divide(new_m, g, out=g)
                    g *= np.float32(0.1) * pace / scale
                    self.p[k][rows] -= g

    def score(self, texts: list[np.ndarray], rows: int = 512) -> np.ndarray:
        """Log10 probability of each text (ids with the end id); every id is scored once."""
        w = self.window
        flat, places, owner, first, n, starts, fresh = self._spread(texts)
        total = np.zeros(len(texts))
        steps = np.arange(w)
        leads = fresh - starts < self.overlap
        for some in (np.flatnonzero(~leads), np.flatnonzero(leads)):  # the first have context that needs no states
            for a in range(0, len(some), rows):
                at = some[a : a + rows]
                own, place = owner[at], starts[at, None] + steps
                scored = (place >= fresh[at, None]) & (place < n[own, None])
                index = first[own, None] + place
                logp = self.logp(places[index], flat[index], scored)
                by_window = np.add.reduceat(logp.astype(np.float64), np.concatenate([[0], np.cumsum(scored.sum(1))[:-1]]))
                np.add.at(total, own, by_window)
        return total / np.log(10)


# ---------------------------------------------------------------- operators


def word_counts(docs: DataFrame, text: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """word (binary), count: words of all texts; a null word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = rows = 0

        def tallied() -> list[pa.Table]:
            return [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])] if held else []

        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                found, n = split(part.column("text"))
                times = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                held.append(pa.table([found.dictionary, pa.array(times, pa.int64())], ["word", "n"]))
                ends += len(n)
                rows += len(times)
                if rows > 1_000_000:
                    held = tallied()
                    rows = len(held[0])
                if rows > 500_000:
                    yield from held[0].to_batches() if len(held) == 1 else tallied()[0].to_batches()
                    held, rows = [], 0
        for table in tallied():
            yield from table.to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def subword_counts(counts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """Occurrences of each subword id in the counted words, and last of the end of a text: one number per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(path, pattern)
        total = np.zeros(coder.size + 1, np.int64)
        for batch in batches:
            some, n = batch.column("word"), batch.column("n").to_numpy()
            inner = some.is_valid()
            ids, size = coder.encode(some.filter(inner))
            inner = inner.to_numpy(zero_copy_only=False)
            np.add.at(total, ids, np.repeat(n[inner], size))
            total[-1] += n[~inner].sum()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    size = subwords(path, pattern).size + 1
    found = np.zeros(size, np.float64)
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        found[r.id] = r.n
    return found


def fit(model: CausalModel, training: DataFrame, tokenizer: str, pattern: str, total: float, key: str = "doc_id", text: str = "text", shard_ids: int = 8_000_000, rounds: int = 2, passes: int = 1, part: int = 4096) -> int:
    """Fits the weights to all training texts, which have ``total`` ids with their ends; how many ids were learned.

    Rows are dealt by a hash of key, text and place in the table (so that repeated rows part) into shards of about
    ``shard_ids`` ids and into ``rounds``. In a round a task trains a copy of the weights on a shard's rows of that round;
    the mean of all copies, by ids learned, goes to the next round. So the steps grow with the input and every text is
    learned ``passes`` times, whatever the size of the table. Copies are added up in parts of ``part`` numbers.
    """
    if not total:
        return 0
    spark = training.sparkSession
    shards = math.ceil(total / shard_ids)
    place = F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id())
    rows = training.select(F.col(text).alias("text"), place.alias("place"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright(place, 32), F.lit(rounds)).alias("turn"))
    names, learned = list(model.p), 0
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(group: pa.Table) -> pa.Table:  # runs before the next round begins
            model, coder = copy.deepcopy(shared.value), subwords(tokenizer, pattern)
            group = group.sort_by([("place", "ascending"), ("text", "ascending")])
            texts = [x for batch in group.to_batches() for piece in by_bytes(batch, "text", 1 << 20) for x in coder.texts(*split(piece.column("text")))]
            batch = 128
            model.train(texts, passes * -(-model.n_windows(texts) // batch), batch, span=(turn / rounds, (turn + 1) / rounds))
            n = sum(map(len, texts))
            flat = np.concatenate([model.p[k].ravel() for k in names]).astype("<f4")
            parts = [flat[a : a + part].tobytes() for a in range(0, len(flat), part)]
            shard = group.column("shard")[0].as_py()
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
            return pa.Table.from_arrays(columns, ["part", "shard", "n", "numbers"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([(held / n).astype("<f4").tobytes()], pa.binary())], ["part", "n", "numbers"])

            at, n, held = None, 0, None
            for batch in batches:
                for one, own, numbers in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "numbers")), strict=True):
                    if one != at:
                        if at is not None:
                            yield out()
                        at, n, held = one, 0, 0.0
                    n += own
                    held = held + own * np.frombuffer(numbers, "<f4").astype(float)
            if at is not None:
                yield out()

        copies = rows.filter(F.col("turn") == turn).groupBy("shard").applyInArrow(run, "part int, shard int, n long, numbers binary")
        dealt = copies.repartition("part").sortWithinPartitions("part", "shard").select("part", "n", "numbers")
        means = sorted(dealt.mapInArrow(add, "part int, n long, numbers binary").collect())
        shared.unpersist()
        if means:
            flat, at = np.frombuffer(b"".join(bytes(r.numbers) for r in means), "<f4"), 0
            for k in names:
                size = model.p[k].size
                model.p[k] = flat[at : at + size].reshape(model.p[k].shape).copy()
                at += size
            model._tables = None
            learned += means[0].n
    return learned


def score_documents(
    docs: DataFrame,
    training: DataFrame,
    tokenizer: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    head: int = 200_000,
    unit: int = 64,
    batch_bytes: int = 1 << 20,
    passes: int = 1,
) -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end per text. ``base_score`` is that of a smoothed unigram model over the exact
    counts of all ``training`` texts. ``score`` is the log10 probability of the text's subword ids and end under the
    attention model, whose frequencies and weights also come from all training texts (see :func:`fit`). An id is scored
    with at least 8 ids before it in its window, or all of its text's. Counts of the most frequent words (whole levels of
    frequency, short and long ones alike) are sent to all tasks, a table of at most ``head`` times ``unit`` bytes; rarer
    words of the documents are joined with their counts. Null texts are empty: one token, the end. Repeated rows and null
    keys stay; other columns are not read. Without training rows every count is 0, train_tokens is 0, base_score is null
    and the model knows no frequencies.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(training, text), "word-counts")
    n_all, n_distinct, n_ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    frequent = counts.filter(F.col("word").isNotNull()).select("word", "n", F.floor(F.log2("n") * 16).alias("level"), F.ceil(F.octet_length("word") / unit).alias("units"))
    least, held = None, 0
    for level, n in sorted(frequent.groupBy("level").agg(F.sum("units")).collect(), reverse=True):
        if held + n > head:
            break
        least, held = level, held + n
    top = {bytes(r.word): r.n for r in frequent.filter(F.col("level") >= least).collect()} if held else {}

    seen = subword_counts(counts, tokenizer, pattern)
    model = CausalModel(seen)
    fit(model, training, tokenizer, pattern, seen.sum(), key, text, passes=passes)
    # Words that aren't sent to tasks come last and have no count there.
    shared = spark.sparkContext.broadcast((model, pa.array(list(top), pa.binary()), np.array([*top.values(), 0], np.float64)))
    kind = docs.schema[key].dataType.simpleString()
    bottom = n_all + 0.5 * (n_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, top_n = shared.value
        coder = subwords(tokenizer, pattern)
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                found, n = split(part.column("text"))
                index, text_of = found.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
                at = pc.fill_null(pc.index_in(found.dictionary, value_set=top), len(top_n) - 1)
                times = top_n[at.to_numpy(zero_copy_only=False)][index]
                seen = times > 0
                by_text = lambda at, x=None: np.bincount(text_of[at], x, len(n))  # noqa: B023, E731
                base = by_text(seen, np.log10(times[seen] + 0.5)) + np.log10(n_ends + 0.5)
                pairs, repeats = np.unique(text_of[~seen] * len(found.dictionary) + index[~seen], return_counts=True)
                owner, rare = np.divmod(pairs, max(1, len(found.dictionary)))
                offsets = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(offsets, x) for x in (found.dictionary.take(pa.array(rare)), pa.array(repeats, pa.int64())))
                score = model.score(coder.texts(found, n))
                columns = [pa.array(n + 1, pa.int64()), pa.array(by_text(seen) + (n_ends > 0), pa.int64()), pa.array(base), *lists, pa.array(score)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], ["key", "n_tokens", "n_known", "base", "rare", "times", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, n_tokens long, n_known long, base double, rare array<binary>, times array<long>, score double"
    scored = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    known = rare.join(counts.filter("word is not null"), "word", "left")
    more = known.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_base"),
    )
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(bottom))
    return scored.join(more, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (base if n_all else F.lit(None).cast("double")).alias("base_score"),
        "score",
    )
