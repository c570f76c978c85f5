import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<turn>", "</turn>", "### ", "### Assistant:", "a", " ", "\n", "é", "<|endoftext|>"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text
    bare = chat_format._ESCAPED.sub("", safe)
    assert not any(c in bare for c in chat_format.CONTROLS)


def test_round_trip(spark, tmp_path):
    rows = [
        (1, 1, "assistant", "two </turn>"), (1, 0, "user", "one\n"), (1, 2, "assistant", None), (2, 0, None, "x" * 50_000), (2, None, "assistant", "first"),
        (None, 0, "assistant", "<|endoftext|> é💙"), (3, 0, "user", ""), (3, 0, "user", ""), (3, 1, "### System:", "\\"),
        *((4, 0, "user", t) for t in ("zebra", "the", "A", "banana split", "apple", "é", "<turn>", "", None, "漢", "💙", "the")), (4, 0, "assistant", "z"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("ids", F.lit("clash"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in queries.op10_chat_format(spark, str(tmp_path)).collect()}
    want = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", queries.TRICKY), (-7, 1, "assistant", queries.TRICKY)]:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert found.keys() == want.keys()
    for conv, said in want.items():
        said.sort()
        loss = "".join(t for _, _, role, t in said if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{t}\n" for _, _, a, t in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(a) + len(t) for _, _, a, t in said)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.format_chats(none, FILE).count() == 0
