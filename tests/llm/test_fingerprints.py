import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp


def _slow_cuts(text):
    """Boundaries by a byte-at-a-time walk."""
    found, start, h, i = [], 0, 0, 0
    hashes = []
    for b in text:
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    while len(text) - start > fp.LEAST:
        end = min(len(text), start + fp.MOST)
        for i in range(start + fp.LEAST, min(len(text) + 1, start + fp.MOST)):
            if hashes[i - 1] >> (32 - (fp.HARD if i < start + fp.NORMAL else fp.EASY)) == 0:
                end = i
                break
        found.append(end)
        start = end
    return found + [len(text)] * (start < len(text))


def _slow_chunks(text):
    """Chunks as ten hexadecimal digits of their XXH64 and two of their length less one."""
    ends = _slow_cuts(text)
    parts = [text[a:b] for a, b in zip([0, *ends], ends)]
    return {int(xxhash.xxh64_hexdigest(x)[:10] + f"{len(x) - 1:02x}", 16) for x in parts}


def _slow_share(a, b):
    weigh = lambda x: sum(c % 256 + 1 for c in x)
    return weigh(a & b) / min(weigh(a), weigh(b)) if a and b else float(not a and not b)


def test_chunks_against_a_slow_walk():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdef ghi\n") for _ in range(n)) for n in (0, 1, 15, 16, 17, 40, 500, 5000)]
    for text, found in zip(texts, fp.chunk_sets(texts)):
        assert found == _slow_chunks(text)


def test_shift_resistance():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefghij klmno") for _ in range(4000))
    plain, shifted, other = fp.chunk_sets([text, b"new words first " + text, text[::-1]])
    assert fp.containment(plain, shifted) > 0.95 and fp.containment(plain, other) < 0.05
    assert fp.containment(set(), set()) == 1 and fp.containment(set(), plain) == 0


def _want(rows):
    digest = lambda x: (xxhash.xxh64_intdigest(x.encode(), 42) + (1 << 63)) % (1 << 64)
    rows = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1]), r[1]))
    out = []
    for i, (key, text) in enumerate(rows):
        n, after = len(text) // 3, rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - n] + after[:n]
        a, b, c = (_slow_chunks(x.encode()) for x in (text, edited, after))
        text_of = lambda chunks: "".join(f"{x:012x}" for x in sorted(chunks))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), _slow_share(a, b), _slow_share(a, c)))
    return sorted(out, key=repr)


def test_documents(spark, odd_docs, no_docs):
    found = fp.fingerprint_edits(odd_docs.repartition(3).withColumn("near_next", F.lit("clash"))).collect()
    assert sorted(map(tuple, found), key=repr) == _want(odd_docs.collect())
    assert fp.fingerprint_edits(no_docs).count() == 0
    many = spark.range(-40, 160).select((F.col("id") * 3).alias("doc_id"), F.expr("repeat(concat('word', id, ' and so on. '), 10)").alias("text"))
    assert sorted(map(tuple, fp.fingerprint_edits(many).collect()), key=repr) == _want(many.collect())
    hot = many.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(9)).when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    hot = hot.unionByName(hot.limit(20))  # a key and null with many rows over several parts, and rows that repeat
    assert sorted(map(tuple, fp.fingerprint_edits(hot, part_bytes=3000).collect()), key=repr) == _want(hot.collect())
    for ids in ([None, None], [5], [7, 7, 7]):
        few = spark.createDataFrame([(i, f"text {k} " * 9) for k, i in enumerate(ids)], "doc_id long, text string")
        assert sorted(map(tuple, fp.fingerprint_edits(few).collect()), key=repr) == _want(few.collect())
