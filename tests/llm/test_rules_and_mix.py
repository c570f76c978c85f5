import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_base_counts(odd_docs):
    rows = quality_rules.quality_rules(odd_docs.withColumn("n_words", F.lit("clash")).withColumn("rules", F.lit(1))).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        x = r.rules
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == _counts(r.text or "")
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.base_failed and x.kept)


def test_lines(spark):
    prose = "The engine reads every row of the table once and keeps what it needs."
    cases = [
        (prose, False), ("Home | About | News | Contact", True), ("Start » Shop » Shoes", True), ("Start » Shop » Shoes for walking", False), ("It costs more › or less › than you might think it would cost there.", False), ("Licensed under the Apache License, Version 2.0.", True), ("BUY!! NOW!! CHEAP!! STUFF!!", True),
        ("a*** b### c%%% d$$$ e&&&", True), ("Read more", True), ("Short, but ends.", False), ("", False), (None, False), ("a line of five words", False),
    ]
    rows = spark.createDataFrame(cases, "line string, bad boolean").withColumn("found", quality_rules.bad_line(F.col("line")))
    assert [r.line for r in rows.collect() if r.line and r.found != r.bad] == []
    docs = spark.createDataFrame([(1, "\n".join(" ".join(w + str(i) for w in prose.split()) + "." for i in range(8)) + "\nHome | About | News"), (2, f"{prose}\n" + "BUY!! NOW!! CHEAP!! " * 40)], "doc_id long, text string")
    kept = {r.doc_id: r.rules for r in quality_rules.quality_rules(docs).collect()}
    assert kept[1].kept and "Home" not in kept[1].cleaned and not kept[2].kept and kept[2].lost_too_much | kept[2].base_failed


def test_empty(no_docs):
    assert quality_rules.quality_rules(no_docs).count() == 0
    assert mixing.systematic_copies(no_docs).count() == 0


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0])
def test_targets(spark, share):
    sizes = {"a": 10, "b": 500, "c": 70, None: 3, "d": 0}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), share=share).collect()
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, free, rest = {}, set(sizes), share * sum(sizes.values())
    while free:
        per = rest / sum(weights[s] for s in free)
        over = {s for s in free if per * weights[s] > 2 * sizes[s]}
        if not over:
            want |= {s: per * weights[s] for s in free}
            break
        want |= {s: 2 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        free -= over
    assert {r.source: r.target for r in rows} == pytest.approx(want)


def test_copies(spark, odd_docs):
    rows = mixing.systematic_copies(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.copies <= 2 for r in rows)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pmod(id * 37, 211) as int))").alias("text"), F.expr("concat('s', pmod(id, 5))").alias("source"))
    mixed = mixing.systematic_copies(many)
    again = mixing.systematic_copies(many.repartition(7))
    assert sorted(map(tuple, mixed.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    taken, target = defaultdict(int), {}
    for r in mixed.collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] for s in target)


def test_copies_by_a_plain_walk(spark):
    """Documents one after the other along the same order, with text keys, a hot source, repeated and null keys."""
    rng = random.Random(4)
    rows = [(rng.choice([None, f"k{i}", f"k{i}", "hot"]), "w " * rng.randint(0, 300), rng.choice(["a", "a", "a", "b", None])) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    found = mixing.systematic_copies(docs, bucket_rows=50).collect()
    target = {r.source: r.target for r in found}
    assert Counter(mixing.systematic_copies(docs, bucket_rows=7).collect()) == Counter(found)  # buckets don't change the order
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
    want = Counter()
    for source in target:
        own = [(k, len(t.split())) for k, t, s in rows if s == source]
        own.sort(key=lambda r: (len(str(r[1])) * 100 + int(str(r[1])[:2]), digest(r[0] or ""), r[1], r[0] is None, r[0] or ""))
        rate = target[source] / sum(n for _, n in own)
        at = digest(f"mix:{source}" if source is not None else "mix:\\null") / (1 << 32)
        for i, (key, n) in enumerate(own):
            copies = math.floor(rate * (i + 1) + at) - math.floor(rate * i + at)
            want[key, source, n, copies] += 1
    assert Counter((r.doc_id, r.source, r["size"], r.copies) for r in found) == want
