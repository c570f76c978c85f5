import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, least_docs=10, top=10):
    """(text, lang, source) rows -> the audit's rows, by dense sums over all kept terms."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in sources:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "pair", item.decode(), -v, i + 1) for i, (v, item) in enumerate(pair)]
            out += [(lang, s, "term", item.decode(), -v, i + 1) for i, (v, item) in enumerate(own[:top])]
    return sorted(out)


def run(docs, **options):
    return sorted(map(tuple, sa.source_audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(n=150, seed=3):
    import random

    rng = random.Random(seed)
    words = ["a", "Zed", "zed", "é", "ééé", "naïve", "eightlet", "ninechars", "sixteencharslong", "seventeencharslon", "x" * 40, "é" * 33, "漢字", "Ω"] + [f"w{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 30))) if i % 17 else None, lang, source))
    return rows + [("1 2 3 !!", "xx", "only"), ("", "xx", "other"), ("lone", "yy", "s")]


@pytest.mark.parametrize("least_docs", [1, 4, 10])
def test_equals_brute_force(spark, least_docs):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert run(docs, least_docs=least_docs) == brute(rows, least_docs)


def test_many_partitions_small_batches_and_hot_terms(spark):
    rows = corpus(300, 5) + [("hot " * 500 + "cold", "en", "s1")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a term's rows straddle batches
    try:
        assert run(docs, least_docs=2) == brute(rows, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_docs_empty_table_and_extra_columns(odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    extra = odd_docs.withColumns({c: F.lit("x") for c in ("w0", "n", "value", "rank", "p", "item", "total")})
    assert run(extra, least_docs=2) == brute(rows, 2)
    assert run(no_docs) == []


def test_a_text_over_a_batch_and_a_term_of_a_megabyte(spark):
    rows = [("漢" * 400_000 + " tail", "zh", "a"), ("漢" * 400_000 + " tail tail", "zh", "b"), ("word " * 2_000_000, "zh", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert run(docs, least_docs=1) == brute(rows, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("aB1 éß漢\n" + "z" * 3, max_size=60), st.integers(0, 3)), min_size=1, max_size=12))
def test_runs_equal_counts(rows):
    rows = sorted(rows, key=lambda r: r[1])
    data = b"".join(t.encode() for t, _ in rows)
    offsets = np.cumsum([0, *(len(t.encode()) for t, _ in rows)])
    got = {}
    for w0, w1, long_terms, group, n, n_docs in sa.term_runs(np.frombuffer(data, np.uint8), offsets, np.array([g for _, g in rows])):
        for a, b, t, g, x, y in zip(w0.tolist(), w1.tolist(), long_terms, group.tolist(), n.tolist(), n_docs.tolist(), strict=True):
            term = t or (a.to_bytes(8, "big") + b.to_bytes(8, "big")).rstrip(b"\0")
            assert (g, term) not in got
            got[g, term] = (x, y)
    want = defaultdict(lambda: [0, 0])
    for text, g in rows:
        for t, c in Counter(terms(text)).items():
            want[g, t.encode()][0] += c
            want[g, t.encode()][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=50))
def test_radix_order_is_stable(pairs):
    words = [np.array([p[i] for p in pairs], np.uint64) for i in (1, 0)]
    assert sa.radix_order(words).tolist() == sorted(range(len(pairs)), key=lambda i: (pairs[i][1], pairs[i][0]))


def test_share_is_exact_for_large_totals(spark):
    rows = [(c, t, v) for c in (0, 1, 10**6, 4 * 10**15) for t in (c, 5 * 10**15) for v in (1, 3, 10**7) if t >= c]
    df = spark.createDataFrame(rows, "c long, t long, v long")
    for r in df.withColumn("p", sa.share(F.col("c"), F.col("t"), F.col("v"))).collect():
        assert r.p == 1 + 10**9 * (r.c + 2) // (r.t + 2 * r.v)
