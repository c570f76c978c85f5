import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.components import components


SPANS = ((0, 64), (0, 22), (22, 43), (43, 64), (18, 26), (40, 46))


def _reach(n, linked):
    """Least index that each of n items reaches."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(i, i + 1) for i in range(500, 560)] + [(700, i) for i in range(701, 760)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _reach(800, edges)
    assert found == {i: want[i] for e in edges for i in e if e[0] != e[1]} | {i: want[i] for i in found}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_keys_meet():
    code = near_dedup.GOLAY
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 21, 3000)
    assert len(np.unique(code.decode(np.arange(1 << 23)))) == 4096
    for n in (1, 2):
        other = words.copy()
        for w in range(len(words)):
            for i in rng.choice(21, n, replace=False):
                other[w] ^= 1 << int(i)
        (a, use_a), (b, use_b) = code.keys(words, 21), code.keys(other, 21)
        assert all(set(x[u]) & set(y[v]) for x, u, y, v in zip(a, use_a, b, use_b))


def test_fingerprints_meet():
    """Two that differ in up to four bits, wherever these are, share a key; no key comes twice, and there are few."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    other = fps.copy()
    for row in range(len(fps)):
        span = SPANS[row % len(SPANS)]  # anywhere, or dense in one or two segments
        for i in rng.choice(np.arange(*span), row % 5, replace=False):
            other[row] ^= np.uint64(1 << int(i))
    found = []
    for some in (fps, other):
        keys, rows = near_dedup.bucket_keys(some)
        pairs = set(zip(rows.tolist(), keys.tolist()))
        assert len(pairs) == len(keys) and len(keys) < 31 * len(some)
        found.append(pairs)
    assert {row for row, _ in found[0] & found[1]} == set(range(len(fps)))


def test_no_link_is_lost(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for fp in base.tolist():
        for _ in range(12):  # chains of one to six bits a step
            for i in rng.choice(64, rng.integers(1, 7), replace=False):
                fp ^= 1 << int(i)
            fps.add(fp)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = _reach(len(fps), [(int(i), int(j)) for i, j in np.argwhere(near) if i < j])
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for limit in (8192, 6, 2):  # most buckets are over the last limits and visited block by block
        pairs = [(place[r.a], place[r.b]) for r in near_dedup.links(table.repartition(3), bucket_rows=limit).collect()]
        assert all(near[i, j] for i, j in pairs)
        assert _reach(len(fps), pairs) == want


def test_large_buckets_are_handed_on():
    """Over any cut of the rows into batches, a bucket is visited whole or handed on whole."""
    rng = np.random.default_rng(4)
    keys = np.sort(np.concatenate([np.full(40, 3), np.full(9, 5), np.full(10, 6), rng.integers(7, 30, 60)])).astype(np.int32)
    fps = rng.integers(0, 1 << 62, len(keys), dtype=np.int64)
    sizes = {int(k): int((keys == k).sum()) for k in keys}
    for size in (1, 7, 64, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size]), pa.array(fps[a : a + size])], ["key", "fp"]) for a in range(0, len(keys), size)]
        rows = [r for b in near_dedup._buckets(4, 9)(iter(batches)) for r in b.to_pylist()]
        passed = sorted((r["key"], r["a"]) for r in rows if r["key"] is not None)
        assert passed == sorted((int(k), int(f)) for k, f in zip(keys, fps) if sizes[int(k)] > 9)


def test_one_of_each(spark, odd_docs):
    """Null and repeated keys: rows are told apart by their place."""
    unlike = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdefg"]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[2]), (1, unlike[3]), (2, unlike[4]), (2, unlike[5]), (3, unlike[0]), (3, unlike[6]), (3, unlike[6]), (None, None), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = near_dedup.one_of_each(docs).collect()
    assert sorted(r.text or "" for r in kept) == ["", *unlike]
    assert near_dedup.one_of_each(odd_docs).columns == odd_docs.columns and near_dedup.one_of_each(odd_docs.filter("false")).count() == 0


def _slow(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents(spark, odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs.withColumn("fp", F.lit("clash"))).collect()
    texts = odd_docs.collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in rows) == sorted((str(r.doc_id), _slow(r.text)) for r in texts)
    fps = sorted({_slow(r.text) for r in texts})
    want = _reach(len(fps), [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if i < j and (a ^ b).bit_count() <= 4])
    least = {}
    for r in texts:
        if r.doc_id is not None:
            root = want[fps.index(_slow(r.text))]
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    for r in rows:
        assert r.component_id == least.get(want[fps.index(r.fp & (1 << 64) - 1)])
    assert near_dedup.near_duplicates(no_docs).count() == 0
