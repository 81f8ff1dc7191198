"""Ids by ranks against the library's own."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm.byte_bpe import ByteEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    found = ByteEncoder(PATH)
    assert found.ranks is not None
    return found


def test_every_kind_of_character(encoder):
    for k in range(0, 0x11000, 256):
        text = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}." for c in range(k, k + 256) if not 0xD800 <= c < 0xE000)
        assert np.array_equal(encoder.ids(text), encoder._by_library(text))


def test_random_and_long_texts(encoder):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("etaoin  shrdlu'\n\t.,0129éß日😀<|>") for _ in range(rng.randrange(200)))
        assert np.array_equal(encoder.ids(text), encoder._by_library(text))
    for text in ("", " " * 300_000, "ab" * 150_000, "one two  three\n" * 30_000, "<|endoftext|> x " * 9_000):
        assert np.array_equal(encoder.ids(text), encoder._by_library(text))


def test_plain_specials_and_files_that_differ(encoder, tmp_path):
    plain = ByteEncoder(PATH, plain_specials=True)
    assert 50256 in encoder.ids("a<|endoftext|>b") and 50256 not in plain.ids("a<|endoftext|>b")
    parts = json.load(open(PATH, encoding="utf-8"))
    parts["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(parts), encoding="utf-8")
    spaced = ByteEncoder(str(other))
    assert spaced.ranks is None and np.array_equal(spaced.ids("word"), encoder.ids(" word"))
    parts["pre_tokenizer"]["add_prefix_space"] = False
    parts["model"]["merges"][300], parts["model"]["merges"][301] = parts["model"]["merges"][301], parts["model"]["merges"][300]
    other.write_text(json.dumps(parts), encoding="utf-8")
    assert ByteEncoder(str(other)).ranks is None
