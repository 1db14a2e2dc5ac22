"""Token ids of whole texts by the public word-level BPE tokenizer, cached per word.

White space never survives the tokenizer's normaliser and no token crosses it, so the ids of a text are the ids
of its white-space separated words in order. Words repeat, so each task keeps a bounded cache word -> ids; a
word made of letters of the first Latin blocks goes straight to the byte-pair merges (the same merges, as
ranks), every other word through ``tokenizers`` itself. The result equals ``encode(text).ids`` exactly.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

WORD_END = b"\xff"  # stands for the vocabulary's end-of-word mark; no UTF-8 text holds this byte
SUFFIX = "</w>"
ENTRY_BYTES = 170  # of a dictionary entry, beside the contents of the two byte strings
PLAIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)").fullmatch
ASCII_WORD = re.compile(r"[!-~]+").fullmatch
# The pre-tokenizer's pattern on lower-case ASCII.
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall


def _byte_of_sign() -> dict[str, int]:
    """The signs with which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class WordIds(dict):
    """word (bytes) -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, max_bytes: int = 24_000_000):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.max_bytes, self.held = max_bytes, 0
        self.full = Tokenizer.from_file(path)
        model = json.loads(self.full.to_str())["model"]
        signs = _byte_of_sign()
        ranks = {}
        for token, number in model["vocab"].items():
            body, end = (token[: -len(SUFFIX)], WORD_END) if token.endswith(SUFFIX) else (token, b"")
            ranks[bytes(signs[c] for c in body) + end] = number
        ranks[WORD_END] = 1 << 20  # never in a result: the merges with a final byte come first
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        if self.held >= self.max_bytes:
            self.clear()
            self.held = 0
        text = word.decode()
        if plain := PLAIN_WORD(text):
            ids = self.merge(plain[1].lower().encode() + WORD_END)
            if plain[2]:
                ids = ids + self.merge(plain[2].encode() + WORD_END)
        elif ASCII_WORD(text) and "<|" not in text:
            ids = [i for part in ASCII_PARTS(text.lower()) for i in self.merge(part.encode() + WORD_END)]
        else:
            ids = self.full.encode(text, add_special_tokens=False).ids
        self[word] = packed = array("I", ids).tobytes()
        self.held += len(word) + len(packed) + ENTRY_BYTES
        return packed

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table per worker process and file, kept between tasks."""
    return WordIds(path)
