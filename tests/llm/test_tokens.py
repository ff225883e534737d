"""Token ids equal those of the tokenizers library on any text."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from lamella.llm.tokens import BYTE_BPE, WORD_BPE, byte_encoder, word_encoder

PARTS = list("ab A'sé1 \n\t\xa0ß\u0301İΣς漢!?.\x1c<|>#\u2003\u0301") + ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "  ", "'ll", " the", "\r\n"]
FRESH = {p: Tokenizer.from_file(p) for p in (BYTE_BPE, WORD_BPE)}
ODD = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


BOTH = pytest.mark.parametrize("encoder,path", [(byte_encoder, BYTE_BPE), (word_encoder, WORD_BPE)], ids=["byte", "word"])


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@BOTH
@settings(max_examples=400, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=80)))
def test_ids(encoder, path, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(encoder(), text) == FRESH[path].encode(text, add_special_tokens=False).ids


@BOTH
def test_special_strings(encoder, path):
    """They have an id of their own, as in a fresh library object; or are ordinary text where that is asked for."""
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "<|startoftext|>Ab", "x<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "a <| b"):
        assert ids(encoder(), text) == FRESH[path].encode(text, add_special_tokens=False).ids
        assert ids(encoder(special_as_text=True), text) == plain.encode(text, add_special_tokens=False).ids
    assert ids(encoder(), "a <|endoftext|> b") != ids(encoder(special_as_text=True), "a <|endoftext|> b")
