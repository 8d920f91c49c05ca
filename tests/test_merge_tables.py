"""Ids of byte-pair tokens against the library that the vocabulary's file is for."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gimbal.operators import conversations as V
from gimbal.operators import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


CASES = ["", " ", "a", "  a  b ", "it's we'LL they'd", "a\x1cb \x1d c\x85d e f", "x<|endoftext|>y <|endoftext|>", "naïve Straße 東京 😀👍🏽", "1234 ٣٤ Ⅷ²", "\n\n\t \r\n x", "é‍", "a" * 5000, " " * 3000, "ab" * 2000 + "!?" * 900]


@pytest.mark.parametrize("text", CASES)
def test_ids_of_odd_texts(exact, text):
    assert tokens.table(PATH).encode(text) == exact(text)


def test_ids_of_random_texts(exact):
    rng, letters = random.Random(11), list("abcdeEST  \n\t'.,!-_0159éß中あ😀\x1c\x1f\x85 　")
    t = tokens.table(PATH)
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(40)))
        assert t.encode(text) == exact(text)
        assert t.decode(t.encode(text), {}) == text


def test_ids_of_whole_documents_and_conversations(spark, exact):
    texts = [r.text for name in ("documents", "conversations") for r in spark.read.parquet(f"{SF}/{name}.parquet").select("text").collect()]
    t = tokens.table(PATH)
    assert all(t.encode(x or "") == exact(x or "") for x in texts)


def test_nothing_depends_on_what_is_kept(exact, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    t = tokens.MergeTable(PATH)
    text = "one two three four five one two three " * 3
    assert t.encode(text) == exact(text) and len(t.kept) <= 3


def test_conversations_are_encoded_by_a_lookup(spark, exact):
    a = [("Look: <image> well", "It is <query>.", True, True, "\n"), ("and?", None, None, None, None), (None, "no", False, None, "")]
    rows = spark.createDataFrame([(1, a), (2, []), (3, None), (4, [(None, None, None, None, None)])], f"id long, turns array<{V.TURN}>")
    known = rows.withColumn("known", tokens.ids_of(V.pieces(F.col("turns")), PATH))
    got = {r.id: r.x for r in known.select("id", V.encode(F.col("turns"), lambda t: F.col("known")[t], 7, 9, image_length=2).alias("x")).collect()}
    first, out = [7] + exact("Look: ") + [V.IMAGE_IN] * 2 + exact(" well"), exact("It is ") + [V.QUERY] + exact(".") + [9]
    last = exact("no") + [9]
    assert got[1].input_ids == first + out + exact("\n") + [7] + exact("and?") + [7] + last
    assert [x for x in got[1].labels if x != V.IGNORE] == out
    assert got[2].input_ids == [] and got[3] is None and got[4].input_ids == [7]


def test_texts_of_ids(spark, exact):
    rows = spark.createDataFrame([(1, exact("naïve 東京")), (2, [-200, *exact(" b")]), (3, []), (4, None)], "id long, ids array<int>")
    got = {r.id: r.t for r in rows.select("id", tokens.text_of(F.col("ids"), PATH, {-200: "<image>"}).alias("t")).collect()}
    assert got == {1: "naïve 東京", 2: "<image> b", 3: "", 4: None}


def test_few_rows_are_python_objects_at_once():
    """Texts go through in slices of an Arrow batch, and ids come back packed."""
    import pyarrow as pa

    seen = []
    rows = pa.array([["a b", "cd"], [], ["x" * 9]] * 40)
    out = tokens.packed_ids(rows, lambda t: (seen.append(t), [len(t), 7])[1])
    assert out.to_pylist() == [[[len(t), 7] for t in v] for v in rows.to_pylist()] and out.type == pa.list_(pa.list_(pa.int32())) and len(seen) == 120
