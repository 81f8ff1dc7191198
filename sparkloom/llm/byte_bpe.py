"""Byte-level BPE files encoded by their ranks, where that provably gives the library's ids."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from sparkloom.llm.texts import segments

# Fixed value: the pattern by which byte-level pre-tokenizers find words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST = 1 << 16


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 characters themselves, the others counted from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rank_encoding(path: str, tokenizer):
    """A ``tiktoken`` encoding with the ids of the ``tokenizers`` file at ``path``, or None if it need not have them.

    Both merge the neighbours of the lowest rank, the leftmost first. One ranks pairs, the other what they make. Where two neighbours
    make a token, no merge has crossed the ends of its bytes, so they are the last two that the token alone comes down to.
    So ids are equal if later merges make greater ids and every token, encoded alone, comes out whole. Both are checked here.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    model, words, of = parts["model"], parts.get("pre_tokenizer") or {}, byte_of_character()
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space") and not parts.get("normalizer")
    added = parts.get("added_tokens", [])
    if not plain or not level or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
        return None
    names = {t["content"] for t in added}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in names}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if not all(a < b for a, b in zip([-1, *merged], merged)) or not all(c in of for t in vocabulary for c in t) or len(merged) + 256 != len(vocabulary):
        return None
    if any([x.id for x in tokenizer.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        return None
    ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


class ByteEncoder:
    """The ids of texts by a ``tokenizers`` file, without added special tokens, truncation or padding."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = plain_specials
        self.ranks = rank_encoding(path, self.tokenizer)
        self.specials = set() if plain_specials else "all"

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """Long texts are encoded in parts; a part without a single space for long goes to the library itself."""
        if self.ranks is None:
            return self._by_library(text)
        found = [self.ranks.encode_to_numpy(part, allowed_special=self.specials, disallowed_special=()) if len(part) <= 2 * LONGEST else self._by_library(part) for part in segments(text, LONGEST)]
        return found[0] if len(found) == 1 else np.concatenate(found)


@lru_cache(maxsize=4)
def byte_encoder(path: str, plain_specials: bool = False) -> ByteEncoder:
    """One for all tasks of a worker process."""
    return ByteEncoder(path, plain_specials)
