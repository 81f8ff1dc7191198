"""Cutting texts where every tokenizer here ends a word."""

from __future__ import annotations

import re
from collections.abc import Iterator

from sparkloom.llm.tokens import WHITE

_single_space = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")


def segments(text: str, size: int = 1 << 18) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before single spaces, which begin the next part.

    A stretch without such a space stays whole. What is made of one part at a time stays small for the longest texts.
    """
    begin = 0
    while len(text) - begin > size:
        at = _single_space.search(text, begin + size)
        if at is None:
            break
        yield text[begin : at.start()]
        begin = at.start()
    yield text[begin:] if begin else text
