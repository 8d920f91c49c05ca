"""Token counts of every code point, between letters and by itself, against the tokenizer."""

import random

import pytest
from tokenizers import Tokenizer

from gimbal.llm.token_count import Counter


@pytest.mark.parametrize("frame", ["a{}b", "{}", "x {}'s", " {}", "{} "])
def test_every_code_point(frame):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, count = Tokenizer.from_file(path), Counter(path)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    wrong = []
    for at in range(0, len(points), 50_000):
        texts = [frame.format(c) for c in points[at : at + 50_000]]
        want = (len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False))
        wrong += [t for t, n in zip(texts, want) if count(t) != n]
    assert not wrong


def test_random_texts_with_separators_and_blanks():
    """U+001C to U+001F are blanks to Python, but not to the tokenizer: beside other blanks, and at both ends of a text."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, count = Tokenizer.from_file(path), Counter(path)
    rng = random.Random(7)
    some = [*"abE7.,'", *" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2003\u2028\u3000", "é", "漢", "🙂", "<|endoftext|>", "'s"]
    texts = ["".join(rng.choices(some, k=rng.randrange(12))) for _ in range(40_000)]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, n in zip(texts, want) if count(t) != n] == []
