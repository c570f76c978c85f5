import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.text import remainder


def test_gradients():
    net = language_id.ByteGru(3, 4, np.random.default_rng(0))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, lengths = language_id.padded([b" ab", b" cdef", b" a"])
    truth = np.array([0, 1, 2])
    _, grads = net.gradients(ids, lengths, truth)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = old + step
            losses.append(net.gradients(ids, lengths, truth)[0])
        net.p[name][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 1e-3 * abs(g[at]) + 1e-6


def test_held_out_accuracy(spark, tmp_path):
    rng = np.random.default_rng(4)
    bits = {"en": ["the", "ing", "and", "er"], "fr": ["eau", "le", "tion", "é"], "de": ["sch", "ung", "ein", "ü"]}
    rows = []
    for i in range(240):
        lang = list(bits)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(bits[lang], 3)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = remainder("doc_id", 4) == 2
    found = language_id.identify(docs, docs.filter(~held_out)).join(docs, "doc_id").filter(held_out)
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 30 and right >= 0.95 * n


def test_odd_rows(odd_docs, no_docs):
    rows = language_id.identify(odd_docs.withColumn("score", F.lit("clash")), odd_docs).collect()
    assert len(rows) == odd_docs.count()
    text = {r.doc_id: r.text for r in odd_docs.filter("doc_id is not null").collect()}
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text[r.doc_id] or "")))
    assert language_id.identify(no_docs, no_docs).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_docs, no_docs).collect()} == {"und"}


def test_pooling_against_one_text_at_a_time():
    """Batches of segments of several lengths against each segment alone, byte by byte."""
    net = language_id.ByteGru(3, 4, np.random.default_rng(1))
    texts = [b"", b"a", b"words of running text, " * 30, b"12 34 \xc3\xa9", b"x" * 128, b"y z " * 64]
    want = []
    for text in texts:
        total = np.zeros(3)
        for a in range(0, len(text), 128):
            own = text[a : a + 128]
            p, _ = net.forward(*language_id.padded([own]))
            total += sum((p[t, :, 0] for t, b in enumerate(own) if chr(b).isascii() and chr(b).isalpha() or b >= 128), np.zeros(3))
        want.append(total)
    assert np.allclose(language_id.pooled(net, texts, batch=7), want, atol=1e-4)


def test_state_crosses_spaces():
    """A byte's label depends on the words around it."""
    net = language_id.ByteGru(2, 4, np.random.default_rng(3))
    a, b, c = (net.forward(*language_id.padded([x]))[0][4, :, 0] for x in (b"abc def ghi", b"xyz def ghi", b"abc def xyz"))
    assert not np.allclose(a, b) and not np.allclose(a, c)


def test_carried_columns(odd_docs):
    found = language_id.identify(odd_docs, odd_docs, carry=True)
    assert found.columns == [*odd_docs.columns, "lang_pred", "score"]
    assert sorted(map(repr, found.select(*odd_docs.columns).collect())) == sorted(map(repr, odd_docs.collect()))


def test_sample_is_spread_over_the_text(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(2000)), "en") for i in range(5)] + [(7, "kurz", "de"), (None, "x", "en"), (8, None, "en"), (9, "y", None)]
    parts = language_id.sample_segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 3, 10)
    assert set(parts) == {"de", "en"} and parts["de"] == [b"kurz"] and len(parts["en"]) == 30
    assert any(b"w19" in x for x in parts["en"]) and any(b"w5" in x for x in parts["en"])
