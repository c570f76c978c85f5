"""The stages against what each is to do, row by row, on a small corpus with planted cases."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.near_dedup import simhash
from tidemark.llm.quality_rules import quality_rules

PARTS = {"en": ["the", "ing", "and", "er", "wh"], "fr": ["eau", "le", "tion", "é", "oi"], "de": ["sch", "ung", "ein", "ü", "keit"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)

    def prose(lang, n):
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))

    rows = [(i, prose(lang := list(PARTS)[i % 3], rng.randint(60, 400)), lang, f"s{i % 4}" if i % 7 else None, 1) for i in range(160)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "s1", None) for i in range(10)]  # exact copies
    rows += [(2000 + i, None if i < 2 else "123 456", "en", "s2", 0) for i in range(4)]  # no language
    rows += [(3000 + i, "Home | News | About\n" * 30, "en", "s3", 0) for i in range(3)] + [(4000, "BUY!! NOW!! CHEAP!! " * 30, "en", "s3", 0)]  # junk
    rows += [rows[0], *((None, prose("en", 90 + i), "en", "s0", 5) for i in range(3)), (5000, prose("fr", 100), "fr", "s1", 1), (5000, prose("fr", 120), "fr", "s1", 1)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda name: Counter(r.doc_id for r in seen[name])
    assert not any(2000 <= (k or 0) < 2004 for k in ids("language_id")) and len(seen["language_id"]) == 180
    kept = {r.doc_id for r in quality_rules(spark.createDataFrame(seen["language_id"], docs.schema)).filter("rules.kept").collect()}
    assert set(ids("quality_rules")) == kept and not any(3000 <= (k or 0) < 5000 for k in kept)
    fps = [simhash(r.text) for r in seen["quality_rules"]]
    left = Counter(simhash(r.text) for r in seen["near_dedup"])
    assert set(left.values()) == {1} and set(left) <= set(fps)
    assert all(any((fp ^ other).bit_count() <= 4 for other in left) for fp in fps)
    # Unlike texts without an id, or with the same one, all stay; of copies one does.
    assert ids("near_dedup")[None] == 3 and ids("near_dedup")[5000] == 2
    assert all(ids("near_dedup")[i] + ids("near_dedup")[1000 + i] == 1 for i in range(10) if i in kept)
    mixed = Counter((r.doc_id, r.text) for r in seen["source_mix"])
    assert set(mixed) <= {(r.doc_id, r.text) for r in seen["near_dedup"]} and max(mixed.values()) <= 2
    taken = sum(len(t.split()) * n for (_, t), n in mixed.items())
    assert abs(taken - 1.5 * sum(len(r.text.split()) for r in seen["near_dedup"])) < 0.1 * taken


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text is not null").select("doc_id", "text").collect()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = {(r.doc_id, len(tool.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs}
    by_doc, by_bin = Counter(), Counter()
    for r in rows:
        by_doc[r.document, r.doc_id] += r.length
        by_bin[r.sequence_id] += r.length
    assert rows and all((k, n) in n_tokens for (_, k), n in by_doc.items())
    assert len({(r.document, r.piece) for r in rows}) == len(rows)
    assert max(Counter(k for _, k in by_doc if k is not None and k < 5000).values()) == 2
    assert max(by_bin.values()) <= 1024 and len(by_bin) <= 1.1 * sum(by_bin.values()) / 1024 + 1


def test_null_and_empty(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


CLASHES = ("score", "lang_pred", "copies", "_row", "_fp", "_rules", "_copy", "_key", "c0", "rules", "size", "source_size", "target", "key", "fp", "row", "sequence_id")


def test_columns_of_any_name_go_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns, name
    rows = docs.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert corpus_pipeline.pack(spark, docs, folder).count() >= len(rows)


def test_a_text_longer_than_a_batch(spark, folder):
    """A text of several megabytes goes through each stage whole."""
    some = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 60")
    rng = random.Random(1)
    lines = [" ".join("".join(rng.choice(PARTS["en"]) for _ in range(rng.randint(1, 4))) for _ in range(12)).capitalize() + "." for _ in range(40_000)]
    long = spark.createDataFrame([(9000, "\n".join(lines), "en", "s9", 1)], some.schema)
    docs = some.unionByName(long)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.filter("doc_id = 9000").first().text == "\n".join(lines), name
    packed = corpus_pipeline.pack(spark, docs.filter("doc_id = 9000"), folder)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.agg(F.sum("length")).first()[0] == len(tool.encode("\n".join(lines), add_special_tokens=False).ids) + 1
