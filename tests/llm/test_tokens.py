import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts

MODEL, FILE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab .,'\n\t▁éß\u00a0\u3000\x1c💙", " the", " ing", "  ", "<s>", "<|endoftext|>"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


def test_counts_are_the_librarys(odd_docs):
    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = odd_docs.withColumn("n_tokens", F.lit("clash")).transform(lambda d: token_counts.token_counts(d, MODEL)).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0], x[1], len(x[2])))
    want = sorted((a, b, len(t.encode()), len(whole.encode(t))) for a, b, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and any(r.over_limit for r in rows)


def test_empty_table(no_docs):
    assert token_counts.token_counts(no_docs, MODEL).count() == 0
    assert packing.pack_pieces(packing.token_pieces(no_docs, FILE)).count() == 0


WHOLE, TOOL = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(FILE)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_parts_give_whole_counts(texts):
    assert token_counts._counter(MODEL, 64).count(texts) == [len(WHOLE.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_parts_give_whole_ids(texts):
    assert packing.encoder(FILE).encode(texts) == [np.array(TOOL.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing(odd_docs, spark):
    pieces = packing.token_pieces(odd_docs.drop("n_chars").withColumn("length", F.lit("clash")), FILE)
    rows = packing.pack_pieces(pieces, part_rows=5).collect()
    tool = Tokenizer.from_file(FILE)
    want = []
    for r in odd_docs.collect():
        ids = [*tool.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(r.doc_id is None, r.doc_id or 0, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024


def _fewest(sizes, capacity):
    """Exact bin packing by search."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_bound_and_bins(sizes):
    found = np.array(sorted(sizes, reverse=True))
    bins, offsets = packing.best_fit_decreasing(found, 24)
    fewest = _fewest(found.tolist(), 24)
    assert packing.lower_bound(found, 24) <= fewest <= bins.max() + 1 <= fewest * 1.5 + 1


def test_many_parts_reach_the_bound(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1024, 6000)
    pieces = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "doc_id long, length long")
    packed = packing.pack_pieces(pieces, part_rows=500)
    used = packed.select("sequence_id").distinct().count()
    assert used <= 1.01 * packing.lower_bound(sizes, 1024) + 1
    row = packing.certificate(packed).first()
    assert (row.n_sequences, row.bound, row.certified) == (used, packing.lower_bound(sizes, 1024), used == packing.lower_bound(sizes, 1024))
    assert packing.certificate(packed.filter("false")).first().n_sequences == 0


def test_a_bound_is_reached_and_certified(spark):
    pieces = spark.createDataFrame([(i, 512 if i % 3 else 1024) for i in range(900)], "doc_id long, length long")
    assert packing.certificate(packing.pack_pieces(pieces, part_rows=100)).first().certified
