import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier as q


def _docs(spark, n):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = ["".join(rng.choice(list("aeiounrst"), rng.integers(2, 8))) for _ in range(rng.integers(40, 90))]
        if good:
            words = [w + "." if k % 9 == 8 else w for k, w in enumerate(words)]
        elif i % 2:
            words = [w + "***" for w in words]
        else:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", None))
        if i % 2 or i % 5 == 0:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int"), labels


def test_held_out(spark):
    docs, _, labels = _docs(spark, 600)
    held = {k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 0}  # all kinds of rows are on both sides
    train = spark.createDataFrame([x for x in labels if x[0] not in held], "doc_id long, quality int")
    found = {r.doc_id: r for r in q.classify(docs, train).collect()}
    assert len(found) == 600
    right = [found[k].kept == bool(y) for k, y in labels if k in held]
    assert np.mean(right) > 0.97
    truth = {k: k % 3 > 0 for k in range(600)}
    brier = np.mean([(r.score - truth[k]) ** 2 for k, r in found.items()])
    assert brier < 0.05 and all(0 <= x <= 1 for r in found.values() for x in (r.text_score, r.page_score, r.score))


def _stored(spark, n, seed=1):
    """Feature rows with two views that tell of a hidden label, most of them unlabelled."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    rows = []
    for i in range(n):
        at = np.sort(rng.choice(40, 12, replace=False)) + 50 * int(y[i] if rng.random() < 0.8 else 1 - y[i])
        page = rng.normal(size=4) + (2 * y[i] - 1) * 0.7
        rows.append((i, i, int(y[i]) if i < 40 else None, [int(a) for a in at], [1 / 12] * 12, [0.0] * q.EXTRAS, [float(x) for x in page]))
    return spark.createDataFrame(rows, f"key long, row long, label int, {q.FEATURES}"), y


def test_surest_against_brute_force(spark):
    """Every unlabelled row is a candidate, in whatever task it is; rows the other view knows are passed over."""
    table, _ = _stored(spark, 700)
    rng = np.random.default_rng(9)
    views = q.Views(rng.normal(size=q.BUCKETS + q.EXTRAS + 1).astype(np.float32), np.round(rng.normal(size=5), 1).astype(np.float32))
    told = ([50, 51, 52], [60, 61, 699])
    limits = [(-0.4, 0.2), (-1.0, 0.5)]
    found = q.surest(table.repartition(5), views, told, limits, 7, 4)
    rows = [r for r in table.collect() if r.label is None]
    want = []
    for view in (0, 1):
        margin = {}
        for r in rows:
            words = q.SCALE * (sum(s * views.words[a] for a, s in zip(r["at"], r["share"])) + np.dot(r.extras, views.words[q.BUCKETS : -1])) + views.words[-1]
            margin[r.row] = (words, float(np.dot(r.page, views.page[:-1]) + views.page[-1]))[view]
        free = [k for k in margin if k not in told[1 - view]]
        want += [(view, False, k) for k in sorted((k for k in free if margin[k] <= limits[view][0]), key=lambda k: (margin[k], k))[:4]]
        want += [(view, True, k) for k in sorted((k for k in free if margin[k] >= limits[view][1]), key=lambda k: (-margin[k], k))[:7]]
    assert sorted((r["view"], r["good"], r["row"]) for r in found) == sorted(want)


def test_bounds():
    (low, high), none = q.bounds(((2.0, 0.5), (0.0, 0.3)), 0.8)
    p = lambda m: 1 / (1 + np.exp(-(2.0 * m + 0.5)))
    assert np.isclose(p(low), 0.2) and np.isclose(p(high), 0.8) and none == (-np.inf, np.inf)


def test_joint_probability():
    """By Bayes' rule, from the two views' probabilities and the prior."""
    platt, prior = ((0.7, 0.1), (1.3, -0.2)), 0.3
    a, b, both = q.joint_probabilities((np.array([-1.0, 0.5, 2.0]), np.array([0.3, -2.0, 1.0])), platt, prior)
    good, bad = a * b / prior, (1 - a) * (1 - b) / (1 - prior)
    assert np.allclose(both, good / (good + bad))


def test_pseudo_labels_help(spark):
    """With few labels, what the other view is sure of makes a view better on rows without a label."""
    n = 900
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, n)
    words = [["good", "fine", "well", "nice"], ["bad", "poor", "ill", "vile"]]
    rows = []
    for i in range(n):
        own = [str(rng.choice(words[1 - y[i]] if rng.random() < 0.62 else words[y[i]])) + str(rng.integers(0, 30)) for _ in range(60)]
        wide = 10 if (y[i] and rng.random() < 0.9) or (not y[i] and rng.random() < 0.1) else 3
        rows.append((i, "\n".join(" ".join(own[k : k + wide]) for k in range(0, 60, wide)), "en", "s", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "doc_id long, quality int")
    right = []
    for rounds in (0, 4):
        found = {r.doc_id: r for r in q.classify(docs, labels, rounds=rounds, per_round=100).collect()}
        right.append(np.mean([(found[i].text_score > 0.5) == bool(y[i]) for i in range(60, n)]))
    assert right[1] > right[0]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (3, None), (9, 1), (9, 0), (100, 1)], "doc_id long, quality int")
    rows = q.classify(odd_docs.withColumn("kept", F.lit("clash")), labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score == rows[0].score for r in rows)
    assert q.classify(no_docs, labels).count() == 0
    many, train, _ = _docs(spark, 200)
    assert q.classify(many.unionByName(odd_docs), train).count() == 200 + odd_docs.count()
    assert q.classify(odd_docs, labels.filter("false")).count() == odd_docs.count()


def test_stored_margins_agree_with_the_matrix(spark, odd_docs):
    table = q.features(odd_docs, spark.createDataFrame([(3, 1), (4, 7)], "doc_id long, quality int"), "doc_id", "quality", 1 << 20)
    rows = table.collect()
    assert len(rows) == odd_docs.count() and sum(r.label is not None for r in rows) == 1
    rng = np.random.default_rng(0)
    views = q.Views(rng.normal(size=q.BUCKETS + q.EXTRAS + 1), rng.normal(size=len(rows[0].page) + 1))
    batch = table.select("at", "share", "extras", "page").toArrow().combine_chunks().to_batches()[0]
    words, page = views.margins(batch)
    x = q.dense([np.array(r["at"], int) for r in rows], [np.array(r["share"]) for r in rows], np.array([r.extras for r in rows]))
    assert np.allclose(words, x @ views.words[:-1] + views.words[-1], atol=1e-4)
    assert np.allclose(page, np.array([r.page for r in rows]) @ views.page[:-1] + views.page[-1])


def test_the_end_of_a_long_text_counts():
    """Two texts with the same first 64 KB: the one with a repetitive tail compresses better, and its words differ."""
    rng = np.random.default_rng(3)
    prose = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    head = prose(70_000)
    clean, junk = head + prose(200_000), head + "buy now " * 25_000
    at, share, extras = q.content([clean, junk, "", None])
    assert extras[1, 1] < 0.6 * extras[0, 1] and extras[2, 1] == extras[3, 1] == len(zlib.compress(b"", 1))
    assert np.isclose(extras[0, 1], len(zlib.compress(clean.encode(), 1)) / len(clean), rtol=1e-3)
    word = zlib.crc32(b"wbuy") % q.BUCKETS
    found = [dict(zip(a.tolist(), b.tolist())).get(word, 0) for a, b in zip(at, share)]
    assert found[1] > 0.3 > found[0] and not len(at[2])


def test_the_page_view_does_not_read_the_words():
    a, b = q.metadata(["Good words here.\nMore of them!", "xxxx yyyyy zzzzz\n1234567890 #$"], [None] * 2, ["en"] * 2, [None] * 2)
    assert np.allclose(a, b)


def test_a_verdict_turns_on_the_end_of_a_long_text(spark):
    docs, train, _ = _docs(spark, 300)
    rng = np.random.default_rng(5)
    head = " ".join("".join(rng.choice(list("aeiounrst"), 6)) for _ in range(10_500))
    assert len(head) > 70_000
    tails = {900: " ".join("".join(rng.choice(list("aeiounrst"), 6)) + "." * (k % 9 == 8) for k in range(30_000)), 901: "BUYNOW!! " * 30_000}
    long = spark.createDataFrame([(k, f"{head} {t}", "en", "s0", None) for k, t in tails.items()], docs.schema)
    found = {r.doc_id: r.text_score for r in q.classify(docs.unionByName(long), train).filter("doc_id >= 900").collect()}
    assert found[900] > 0.5 > found[901]
