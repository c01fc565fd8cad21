"""Ids kept by piece equal those of the library on whole texts."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconry.llm import encoding

LETTERS = st.text(st.sampled_from("abSTredlmv'’ÀéßİıŉſΣς½²7 \t\n\x1c\x85\xa0,.#<|>中é"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(LETTERS, st.text(max_size=20)), max_size=6))
def test_equal_to_whole_texts(texts):
    enc = encoding.encoder()
    assert enc.encode(texts) == enc._encode(texts)


def test_special_tokens_long_words_and_a_full_store(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_PIECES", 3)
    enc = encoding.WordEncoder(public_tokenizers.path(encoding.VOCABULARY))
    texts = ["", "a<|endoftext|>b", "<|ENDOFTEXT|>", "x" * 500, "Don't stop, we'll see ''s", "one two three four five"]
    for _ in range(2):
        assert enc.encode(texts) == enc._encode(texts)
    assert all(len(p) <= encoding.LONGEST_KEPT for p in enc.known)


def test_plain_pieces_are_not_normalized_and_cut_again():
    """Pieces of a plain text are lower-case and cut already: they go through the vocabulary alone, with the same ids."""
    enc = encoding.WordEncoder(public_tokenizers.path(encoding.VOCABULARY))
    texts = ["Don't stop, we'll see: 42 ÀÉßıŉŽ.", "x" * 500 + " <-- ''s ½²7"]
    want, seen = enc._encode(texts), []

    class Full:
        def encode_batch_fast(self, some, **kwargs):
            seen.extend(some)
            return whole.encode_batch_fast(some, **kwargs)

    whole, enc.tokenizer = enc.tokenizer, Full()
    assert enc.encode(texts) == want and seen == []
