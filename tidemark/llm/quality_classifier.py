"""Quality by co-training: a classifier of the words and one of the page's metadata teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import materialize
from tidemark.llm.text import Memo, by_bytes

BUCKETS = 4096
#: Share of a bucket among a text's tokens counts so many times, to be of the size of other features.
SCALE = 20.0
#: Numbers of the text view besides its buckets: share of repeated tokens, and how well the text compresses.
EXTRAS = 2


def _token(word: bytes) -> bytes:
    """Checksum of a word, then its buckets: the word, its last three bytes, its shape."""
    shape = bytes(65 if 65 <= b <= 90 else 97 if b >= 97 else 48 if 48 <= b <= 57 else b for b in word)
    kinds = (b"w" + word.lower(), b"e" + word[-3:], b"s" + shape[:2] + shape[-3:])
    return np.array([zlib.crc32(word) & 0x7FFFFFFF, *(zlib.crc32(k) % BUCKETS for k in kinds)], np.int32).tobytes()


_TOKENS = Memo(lambda words: map(_token, words), 300_000)


def _compressed(raw: bytes, block: int = 65536) -> int:
    """Bytes of the whole text compressed as one stream, fed in blocks so that no compressed copy is held."""
    stream = zlib.compressobj(1)
    view = memoryview(raw)
    return sum(len(stream.compress(view[a : a + block])) for a in range(0, len(raw), block)) + len(stream.flush())


def content(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The text view: by text its buckets, their shares of its tokens, and the extra numbers (texts, EXTRAS)."""
    raws = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    at, share, extras = [], [], np.zeros((len(texts), EXTRAS), np.float32)
    for i, raw in enumerate(raws):
        table = np.frombuffer(b"".join(_TOKENS(raw.split())), np.int32).reshape(-1, 4)
        count = np.bincount(table[:, 1:].ravel(), minlength=BUCKETS)
        used = np.flatnonzero(count)
        at.append(used.astype(np.int16))
        share.append((count[used] / max(1, len(table))).astype(np.float32))
        same = table[1:, 0] == table[:-1, 0]
        extras[i] = same.mean() if len(same) else 0, _compressed(raw) / max(1, len(raw))
    return at, share, extras


def metadata(texts: list[str | None], n_chars: list[int | None], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """The page view: length, layout of lines, language and source. What the lines say doesn't matter."""
    rows = []
    for x, n, lang, source in zip(texts, n_chars, langs, sources, strict=True):
        size = np.array([len(y) for y in (x or "").split("\n")])
        filled = size[size > 0]
        mean = filled.mean() if len(filled) else 0.0
        row = [
            np.log1p(n if n is not None and n >= 0 else len(x or "")), np.log1p(len(filled)), np.log1p(mean), (size == 0).mean(), np.log1p(filled.max(initial=0)),
            filled.std() / (mean + 1) if len(filled) else 0.0, (filled < 40).mean() if len(filled) else 0.0,
        ]
        one = [0.0] * 24
        one[zlib.crc32((lang or "").encode()) % 8] = 1.0
        one[8 + zlib.crc32((source or "").encode()) % 16] = 1.0
        rows.append(row + one)
    return np.array(rows, np.float32).reshape(len(texts), -1)


def dense(at: list[np.ndarray], share: list[np.ndarray], extras: np.ndarray) -> np.ndarray:
    """The text view as a matrix."""
    x = np.zeros((len(at), BUCKETS + EXTRAS), np.float32)
    for i, (a, s) in enumerate(zip(at, share, strict=True)):
        x[i, a] = s
    x[:, BUCKETS:] = extras
    return x * np.float32(SCALE)


# ---------------------------------------------------------------- views


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    """Weights, the last one of a constant, by Adam over all rows; both classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (weight * (p - y).astype(np.float32)) @ x
        g[:-1] += np.float32(ridge) * w[:-1]
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        w -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
    return w


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins log-odds, by Newton's method with Platt's softened labels."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(1e-9, np.abs(margin).max()) if len(margin) else 1.0
    x = np.stack([margin / spread, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w)
    return max(0.0, w[0]) / spread, w[1]


def joint_probabilities(margins: tuple[np.ndarray, np.ndarray], platt: tuple, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probability of each view, and of both together as if each told its own story.

    The odds of both are multiplied and divided by those of the prior, which both contain.
    """
    odds = [np.clip(a * m + b, -30, 30) for m, (a, b) in zip(margins, platt, strict=True)]
    return tuple(1 / (1 + np.exp(-x)) for x in (*odds, np.clip(odds[0] + odds[1] - np.log(prior / (1 - prior)), -30, 30)))


@dataclass
class Views:
    """Weights of both views over their features as they are stored; the last one is of a constant."""

    words: np.ndarray
    page: np.ndarray

    def margins(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Margins of stored rows (at, share, extras, page)."""
        at, share = (batch.column(c) for c in ("at", "share"))
        gain = share.flatten().to_numpy() * self.words[at.flatten().to_numpy()]
        ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
        total = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
        extras, page = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, n)) for c, n in (("extras", EXTRAS), ("page", len(self.page) - 1)))
        words = SCALE * (total[ends[1:]] - total[ends[:-1]] + extras @ self.words[BUCKETS:-1]) + self.words[-1]
        return words, page @ self.page[:-1] + self.page[-1]


# ---------------------------------------------------------------- operator


FEATURES = "at array<smallint>, share array<float>, extras array<float>, page array<float>"


def features(docs: DataFrame, labels: DataFrame, key: str, label: str, batch_bytes: int) -> DataFrame:
    """key, row (a number), label (null if none), at, share, extras, page of all documents: a stored table."""
    kind = docs.schema[key].dataType.simpleString()
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = docs.select(F.col(key).alias("key"), "text", F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", batch_bytes):
                texts, *meta = (part.column(c).to_pylist() for c in ("text", "n_chars", "lang", "source"))
                at, share, extras = content(texts)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]), pa.int32())
                flat = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, []]).astype(kind)))
                rest = [pa.array(list(x), pa.list_(pa.float32())) for x in (extras, metadata(texts, *meta))]
                yield pa.RecordBatch.from_arrays([part.column("key"), flat(at, np.int16), flat(share, np.float32), *rest], ["key", "at", "share", "extras", "page"])

    found = rows.mapInArrow(run, f"key {kind}, {FEATURES}").withColumn("row", F.monotonically_increasing_id())
    # By a merge at every size: labels grow with the documents.
    return materialize(found.join(known.hint("merge"), "key", "left"), "page-features")


def bounds(platt: tuple[tuple[float, float], tuple[float, float]], sure: float) -> list[tuple[float, float]]:
    """By view the margins at and beyond which its calibrated probability is at most 1 - ``sure``, and at least ``sure``.

    A view that tells nothing is calibrated to a slope of nothing and is never sure.
    """
    edge = np.log(sure / (1 - sure))
    return [((-edge - b) / a, (edge - b) / a) if a > 1e-9 else (-np.inf, np.inf) for a, b in platt]


def surest(table: DataFrame, views: Views, told: tuple[list[int], list[int]], limits: list[tuple[float, float]], n_good: int, n_bad: int) -> list:
    """Of the unlabelled rows, for each view the ``n_good`` of largest margin, from its upper limit on, and the ``n_bad`` of
    least, up to its lower limit, that the other view (``told[1 - view]`` by row number) doesn't know yet; equal margins go
    by row number.

    Every unlabelled row is scored; each task hands on its own first rows, of which the first of all are kept. Result rows
    have view, good and the features.
    """
    shared = table.sparkSession.sparkContext.broadcast((views, [np.array(sorted(x), np.int64) for x in told]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, told = shared.value
        best: dict[tuple[int, bool], pa.Table] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row").to_numpy()
            for view, margin in enumerate(views.margins(batch)):
                fresh = ~np.isin(row, told[1 - view])
                for good, n in ((True, n_good), (False, n_bad)):
                    rate = -margin if good else margin
                    use = np.flatnonzero(fresh & (margin >= limits[view][1] if good else margin <= limits[view][0]))
                    use = use[np.lexsort((row[use], rate[use]))[:n]]
                    new = pa.Table.from_batches([batch.take(pa.array(use))]).append_column("rate", pa.array(rate[use], pa.float64()))
                    held = pa.concat_tables([best[view, good], new]) if (view, good) in best else new
                    best[view, good] = held.sort_by([("rate", "ascending"), ("row", "ascending")]).slice(0, n)
        for (view, good), held in best.items():
            for part in held.combine_chunks().to_batches():
                own = [pa.array([view] * part.num_rows, pa.int32()), pa.array([good] * part.num_rows)]
                yield pa.RecordBatch.from_arrays([*own, *(part.column(c) for c in ("rate", "row", "at", "share", "extras", "page"))], ["view", "good", "rate", "row", "at", "share", "extras", "page"])

    rows = table.filter("label is null").select("row", "at", "share", "extras", "page").mapInArrow(run, f"view int, good boolean, rate double, row long, {FEATURES}")
    order = Window.partitionBy("view", "good").orderBy("rate", "row")
    first = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.when(F.col("good"), n_good).otherwise(n_bad))
    found = sorted(first.drop("n").collect(), key=lambda r: (r.view, r.good, r.rate, r.row))
    shared.unpersist()
    return found


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", per_class: int = 1000, rounds: int = 4, per_round: int = 200, sure: float = 0.8, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per document (key, text, lang, source, n_chars): key, text_score, page_score, score, kept.

    Features of whole texts are stored once. Both views are fitted on the driver to at most ``per_class`` labelled documents
    of each class, those with the least hash of their key, a fifth of which is kept for calibration. Then, ``rounds`` times,
    each view scores all unlabelled documents and gives the other one those ``per_round`` that it is surest of (by its
    calibrated probability at least ``sure``), good and bad in proportion to the labels, with its labels. ``score`` is the probability of label 1 by both calibrated views
    together, ``kept`` whether it is at least half. Null texts are empty; a null n_chars is counted, null languages and
    sources are a value. Labels other than 0 and 1 are no labels; a key labelled twice takes the higher one. Without ten
    documents of both classes the scores are the share of label 1. Repeated rows and null keys stay.
    """
    spark = docs.sparkSession
    table = features(docs, labels, key, label, batch_bytes)
    kind = table.schema["key"].dataType.simpleString()
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key", "row")
    sample = sorted(table.filter("label is not null").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_class).collect(), key=lambda r: (r.n, r.label))
    good, n = table.filter("label is not null").agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    prior = good / max(n, 1)
    truth = np.array([r.label for r in sample], int)
    views, platt, safe = None, None, min(0.99, max(0.01, prior))
    if (truth == 1).sum() >= 10 and (truth == 0).sum() >= 10:
        read = lambda rows: (dense([np.array(r["at"], int) for r in rows], [np.array(r["share"], np.float32) for r in rows], np.array([r.extras for r in rows], np.float32)), np.array([r.page for r in rows], np.float32))
        x = read(sample)
        mean, deviation = x[1].mean(0), x[1].std(0) + 1e-6
        calibrate = np.arange(len(sample)) // 2 % 5 == 0
        xs, ys, told = [[a[~calibrate]] for a in x], [[truth[~calibrate]] for _ in x], ([], [])
        n_good = max(1, int(per_round * safe))
        for turn in range(rounds + 1):
            words = fit_logistic(np.concatenate(xs[0]), np.concatenate(ys[0]), 1e-4)
            page = fit_logistic((np.concatenate(xs[1]) - mean) / deviation, np.concatenate(ys[1]), 1e-3)
            plain = page[:-1] / deviation
            views = Views(words, np.append(plain, page[-1] - plain @ mean))
            margins = x[0][calibrate] @ views.words[:-1] + views.words[-1], x[1][calibrate] @ views.page[:-1] + views.page[-1]
            platt = tuple(fit_platt(m.astype(float), truth[calibrate]) for m in margins)
            if turn == rounds:
                break
            for r in (found := surest(table, views, told, bounds(platt, sure), n_good, max(1, per_round - n_good))):
                told[1 - r["view"]].append(r["row"])
            for view in (0, 1):
                given = [r for r in found if r["view"] == view]
                if given:
                    xs[1 - view].append(read(given)[1 - view])
                    ys[1 - view].append(np.array([int(r["good"]) for r in given]))
    shared = spark.sparkContext.broadcast((views, platt))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, platt = shared.value
        for batch in batches:
            scores = joint_probabilities(views.margins(batch), platt, safe) if views else [np.full(batch.num_rows, prior)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, pa.float64()) for x in scores), pa.array(scores[2] >= 0.5)], ["key", "text_score", "page_score", "score", "kept"])

    return table.select("key", "at", "share", "extras", "page").mapInArrow(score, f"key {kind}, text_score double, page_score double, score double, kept boolean").withColumnRenamed("key", key)
