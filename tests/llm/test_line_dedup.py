import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup as ld

BLANKS = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def brute(rows, least_docs, least_chars=1, keep_first=False):
    """(key, text) rows -> per row n_lines, n_dropped, kept text."""
    docs = Counter()
    first = {}
    for key, text in rows:
        seen = {}
        for i, line in enumerate((text or "").split("\n")):
            k = key_of(line)
            if len(k) >= max(1, least_chars):
                seen.setdefault(k, i)
        docs.update(seen.keys())
        for k, i in seen.items():
            place = (key is None, key or 0, text or "", i)
            first[k] = min(first.get(k, place), place)
    out = []
    for key, text in rows:
        kept = []
        lines = (text or "").split("\n")
        for i, line in enumerate(lines):
            k = key_of(line)
            gone = len(k) >= max(1, least_chars) and docs[k] >= least_docs
            if gone and keep_first:
                gone = first[k] != (key is None, key or 0, text or "", i)
            if not gone:
                kept.append(line)
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(docs, **options):
    found = ld.line_dedup(docs, **options)
    kept = ld.kept_text(F.col("text"), F.col("line_dedup.keep"))
    return sorted(map(tuple, found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", kept.alias("kept")).collect()), key=repr)


@pytest.mark.parametrize("options", [{"least_docs": 3}, {"least_docs": 2, "least_chars": 4}, {"least_docs": 3, "keep_first": True}, {"least_docs": 1}])
def test_equals_brute_force(spark, options):
    import random

    rng = random.Random(1)
    pool = ["Common", " common\t", "É", "é", "", "   ", "x", "Rare one", "deep\x0b", "a|b"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(7, "common\ncommon\n\nend"), (8, None), (None, "common\nend"), (None, None), (61, "\n\n"), (62, "common")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), **options) == brute(rows, **options)


def test_repeated_rows_count_and_are_treated_alike(spark):
    rows = [(1, "same\nown")] * 12 + [(2, "other")] * 9
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 10)


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs, least_docs=2) == brute(rows, 2)
    assert run(no_docs) == []


def test_clashing_columns_survive(spark):
    names = ["text", "doc_id", "_key", "_h1", "_d1", "_d2", "_lost", "_doc", "_row", "_pos", "keep", "n_lines", "line_dedup"]
    docs = spark.createDataFrame([("a\nb", 1, *("x",) * 11), ("a", 2, *("y",) * 11)], names)
    found = ld.line_dedup(docs, least_docs=2)
    assert found.columns == names
    assert {(r.doc_id, r._h1, r._lost, r.keep, r.line_dedup.n_dropped) for r in found.collect()} == {(1, "x", "x", "x", 1), (2, "y", "y", "y", 1)}


def test_bitmap_runs_and_very_long_text(spark):
    text = "\n".join(f"line {i}" if i % 3 else "every third" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "every third")], "doc_id long, text string")
    rows = {r[0]: r for r in run(docs, least_docs=2)}
    assert rows[1][1:3] == (60_000, 20_000)
    assert hashlib.sha256(rows[1][3].encode()).hexdigest() == hashlib.sha256("\n".join(f"line {i}" for i in range(60_000) if i % 3).encode()).hexdigest()
    keep = [tuple(r) for r in ld.line_dedup(docs, least_docs=2).filter("doc_id = 1").select(F.explode("line_dedup.keep").alias("r")).select("r.*").collect()]
    assert keep[:2] == [(1, 2), (4, 2)] and len(keep) == 20_000


def test_a_hot_line_takes_many_ranges(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot\nown "), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = ld.line_table(docs)
        hot = lines.groupBy("_h1").count().orderBy(F.desc("count")).first()
        parts = lines.filter(F.col("_h1") == hot["_h1"]).groupBy(F.input_file_name()).count().collect()
        assert hot["count"] == 4000 and len(parts) >= 2
        assert max(p["count"] for p in parts) < 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = ld.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
