"""Pieces of more cuts than Python's recursion limit."""

import sys

from wavelake.llm import bpe_chunks
from wavelake.llm.queries import tokenizer_path


def test_more_cuts_than_the_recursion_limit():
    codec = bpe_chunks.Codec(tokenizer_path(), 8)
    text = "some\nlines\tand  more\n" * (4 * sys.getrecursionlimit())
    assert codec.ids(text) == codec.library.encode(text, add_special_tokens=False).ids


def test_long_text_without_a_safe_place():
    codec = bpe_chunks.codec(tokenizer_path())
    text = "ab1," * (1 << 20)
    assert codec.ids(text) == codec.library.encode(text, add_special_tokens=False).ids
