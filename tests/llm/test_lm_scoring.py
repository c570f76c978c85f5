import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm_scoring
from tidemark.llm.text import remainder, words

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counts():
    return np.random.default_rng(0).integers(0, 50, 300).astype(float)


def test_gradients(counts):
    model = lm_scoring.CausalModel(counts, first=4, growth=2, width=4, hidden=5, window=6, overlap=2)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    ids = np.random.default_rng(1).integers(0, 300, (2, 6))
    places = np.concatenate([[model.start], model.place[ids.ravel()[:-1]]]).reshape(2, 6)
    _, grads = model.gradients(places, ids)
    for name, (rows, part) in grads.items():
        g = np.zeros_like(model.p[name])
        g[rows] = part
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = model.p[name][at], []
        for step in (1e-4, -1e-4):
            model.p[name][at] = old + step
            losses.append(model.gradients(places, ids)[0])
        model.p[name][at] = old
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def test_probabilities_sum_to_one(counts):
    model = lm_scoring.CausalModel(counts, first=4, growth=2, window=5, overlap=2)
    prefix = np.array([7, 3, 200])
    total = 0.0
    for i in range(300):
        total += 10 ** (model.score([np.append(prefix, i)])[0] - model.score([prefix])[0])
    assert total == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 8, 9, 40])
def test_each_id_is_scored_once_with_its_window(counts, n):
    model = lm_scoring.CausalModel(counts, first=4, growth=2, window=5, overlap=2)
    ids = np.random.default_rng(n).integers(0, 300, n)
    places = model.sequence(ids)
    starts, fresh = model.windows(n)
    want, done = 0.0, 0
    for start, first in zip(starts, fresh):
        assert first == done and first - start >= (2 if start else 0)
        for at in range(first, min(n, start + 5)):  # by a window that ends at this id: what comes later must not matter
            inputs = np.zeros((1, 5), np.int64)
            inputs[0, : at - start + 1] = places[start : at + 1]
            targets, scored = np.zeros((1, 5), np.int64), np.zeros((1, 5), bool)
            targets[0, at - start], scored[0, at - start] = ids[at], True
            want += float(model.logp(inputs, targets, scored)[0])
            done += 1
    assert done == n
    alone, _, among = model.score([ids, ids[:1], ids])
    assert alone == pytest.approx(want / math.log(10), rel=1e-4) and among == pytest.approx(alone)


def test_documents(odd_docs, no_docs):
    held_out = remainder("doc_id", 5) == 1
    train = odd_docs.filter(~held_out)
    rows = lm_scoring.score_documents(odd_docs.withColumn("score", F.lit("clash")), train, RANKS, P.PATTERN, head=5).collect()
    texts = odd_docs.collect()
    seen = Counter()
    for r in texts:
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 != 1:
            seen.update([*words(r.text), None])
    n, bottom = sum(seen.values()), sum(seen.values()) + 0.5 * (len(seen) + 1)
    want = []
    for r in texts:
        own = [*words(r.text), None]
        want.append((str(r.doc_id), len(own), sum(seen[w] > 0 for w in own), n, round(sum(math.log10((seen[w] + 0.5) / bottom) for w in own), 5)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == sorted(want)
    assert all(r.score < 0 for r in rows)
    assert lm_scoring.score_documents(no_docs, no_docs, RANKS, P.PATTERN).count() == 0


def test_training_helps():
    rng = np.random.default_rng(2)
    texts = [np.append(np.tile([3, 9, 27, 5], 12)[: rng.integers(36, 48)], 0) for _ in range(40)]
    model = lm_scoring.CausalModel(np.bincount(np.concatenate(texts), minlength=50).astype(float), first=3, growth=2, window=8, overlap=3)
    before = model.score(texts).sum()
    model.train(texts, steps=200)
    assert model.score(texts).sum() > 0.3 * before


def test_a_frequent_long_word_is_sent_to_tasks(spark):
    """A long word in a third of all rows, and one too long for the table, count like any other."""
    texts = [f"w{i} {'x' * 500}" if i % 3 == 0 else f"w{i} {'y' * 7000}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for head in (12, 10_000):
        rows = lm_scoring.score_documents(docs, docs, RANKS, P.PATTERN, head=head).collect()
        want = math.log10(1.5 / (180 + 0.5 * 64)) + math.log10(60.5 / (180 + 0.5 * 64))
        assert all(r.n_known == 3 and r.n_tokens == 3 for r in rows)
        assert sorted({round(r.base_score - want, 6) for r in rows}) == sorted(round(math.log10((n + 0.5) / (180 + 0.5 * 64)), 6) for n in (20, 40))


def test_every_seen_id_has_a_place_and_short_texts_are_learned():
    counts = np.append(np.arange(1, 3000), np.zeros(500))
    model = lm_scoring.CausalModel(counts.astype(float))
    assert len(set(model.place[:2999])) == 2999 and model.place[:2999].max() == 2998 and set(model.place[2999:]) == {2999}
    assert model.cuts[0] == 0 and model.cuts[-1] == 2999 and (np.diff(model.cuts) > 0).all()
    texts = [np.array([2500, 7, 2999 - 1, 0])] * 30
    before = model.score(texts[:1])[0]
    model.train(texts, steps=60)
    assert model.score(texts[:1])[0] > 0.5 * before


def test_masked_gradients(counts):
    model = lm_scoring.CausalModel(counts, first=4, growth=2, width=4, hidden=5, window=6, overlap=2)
    ids = np.argsort(-counts)[None, :6].copy()  # ids with places: the odds within the others' group are not learned
    places, scored = model.sequence(ids[0])[None], np.array([[False, False, True, True, False, False]])
    loss, grads = model.gradients(places, ids, scored)
    assert loss == pytest.approx(-model.logp(places, ids, scored).mean(), rel=1e-4)
    ids[0, 4:], places[0, 4:] = ids[0, 0], 5  # what comes after the scored positions doesn't matter
    again = model.gradients(places, ids, scored)[1]
    assert all(np.allclose(again[k][1], g, atol=1e-6) for k, (_, g) in grads.items() if k not in ("ids", "at"))


def test_weights_learn_from_all_rows(spark):
    """More texts than any fixed sample, most of them under a window, with null and repeated keys; in several shards."""
    rng = np.random.default_rng(4)
    rows = [(i if i % 50 else None, " ".join(["red", "green", "blue", "grey"] * int(rng.integers(1, 12))) if i % 40 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = lm_scoring.subword_counts(lm_scoring.word_counts(docs), RANKS, P.PATTERN)
    models = [lm_scoring.CausalModel(seen) for _ in range(3)]
    ids = int(seen.sum())
    for model, rows in zip(models[1:], (docs, docs.repartition(5))):
        assert lm_scoring.fit(model, rows, RANKS, P.PATTERN, ids, shard_ids=ids // 3, passes=1) == ids
    coder = lm_scoring.subwords(RANKS, P.PATTERN)
    text = [np.append(np.frombuffer(b"".join(coder.known(words("red green blue grey " * 5))), "<i4"), coder.size)]
    start, one, other = (m.score(text)[0] for m in models)
    assert one > 0.7 * start and other > 0.7 * start


def test_context_of_long_texts(counts):
    """Every id past the first window has at least 8 ids of context in the window that scores it."""
    model = lm_scoring.CausalModel(counts)
    starts, fresh = model.windows(1000)
    assert (fresh - starts)[1:].min() >= 8 and model.p["at"].shape[1] >= 24


@pytest.mark.parametrize("factor", [1.0, 30.0])
def test_folded_tables_give_the_same_states(counts, factor):
    """Also where products are so large that they are cut."""
    model = lm_scoring.CausalModel(counts, first=4, growth=2)
    model.p["qkv"] *= np.float32(factor)
    ids = np.random.default_rng(8).integers(0, 300, (3, 32))
    places = np.stack([model.sequence(x) for x in ids])
    assert np.allclose(model._states(places), model._hidden(places)[0], atol=2e-4 if factor > 1 else 1e-5)
    assert np.isfinite(model.logp(places, ids, np.ones(ids.shape, bool))).all()


def test_split_texts_give_the_same_words_and_ids():
    """Words of many texts at once, with odd spaces, empty texts and words that hold a space of their own."""
    texts = ["", None, " A  b\tc\x0bd\x0ce\rf\n", "\x1c\x1dx\x1fy\x85z w É İ", "  ", "x　y a\xa0b it's 12,5", "the the end "]
    coder = lm_scoring.subwords(RANKS, P.PATTERN)
    for part in (pa.array(texts), pa.array(texts)[2:6], pa.array([None], pa.string()), pa.array([], pa.string())):
        found, n = lm_scoring.split(part)
        want = [words(x) for x in part.to_pylist()]
        assert n.tolist() == [len(w) for w in want] and found.to_pylist() == [w for own in want for w in own]
        ids = [[i for w in own for i in coder.coding.encode_ordinary(" " + w.decode())] + [coder.size] for own in want]
        assert [x.tolist() for x in coder.texts(found, n)] == ids
    word = pa.array([b"ab", b"a\xffb", b"\xff", "a　".encode(), b"the"])
    ids, size = coder.encode(word[1:])
    assert ids.astype("<i4").tobytes() == b"".join(coder._encode(word[1:].to_pylist())) and size.sum() == len(ids)


def test_context_alone_takes_no_states(counts, monkeypatch):
    """Of a long text 24 states a window are computed in training and scoring, not 32; gradients stay the same."""
    model = lm_scoring.CausalModel(counts)
    seen, whole = [], lm_scoring.CausalModel._attend

    def attend(self, kv, qx, *more):
        seen.append(qx.shape[0] * qx.shape[1])
        return whole(self, kv, qx, *more)

    monkeypatch.setattr(lm_scoring.CausalModel, "_attend", attend)
    ids = np.random.default_rng(6).integers(0, 300, 32 + 24 * 50)
    model.score([ids])
    assert sum(seen) == len(ids)
    seen.clear()
    model.train([ids])
    assert sum(seen) == len(ids)


def test_sums_of_rows():
    rng = np.random.default_rng(7)
    key, g = rng.zipf(1.3, 3000) % 500, rng.standard_normal((3000, 5))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    times = np.diff(np.append(first, len(key)))
    for many in (1, 16, 10_000):
        assert np.allclose(lm_scoring.sums_of_rows(g, order, first, times, many), np.add.reduceat(g[order], first, axis=0))
