"""Byte-level BPE by a rank-based encoder built from the tokenizer file.

The ids are those that the tokenizers library gives for the file, its added tokens included.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

#: The byte-level pre-tokenizer's own split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space so long that the split's look-ahead could exceed its steps.
_LONG_SPACE = re.compile(r"\s{10000}")


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary of a byte-level BPE file as ranks, if ids follow the order of its merges, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    char, vocab = byte_of_char(), model["vocab"]
    added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made) or made and made[0] < 256:
        raise ValueError("ids don't follow the merges")
    return {bytes(char[c] for c in t): i for t, i in vocab.items() if t not in added and (len(t) == 1 or all(c in char for c in t))}, added


def listed(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


class ByteBPE:
    """path: a tokenizers file of a byte-level BPE, or a .tiktoken file of ranks without added tokens."""

    def __init__(self, path: str):
        import tiktoken

        self.ranks, self.added = (listed(path), {}) if path.endswith(".tiktoken") else ranked(path)
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.added)
        if max([*self.ranks.values(), *self.added.values()]) > 65535:
            raise ValueError("ids must fit 16 bits")

    def ordinary(self, text: str) -> list[int]:
        if len(text) < 10_000 or not _LONG_SPACE.search(text):
            return self.encoding.encode_ordinary(text)
        import regex

        out: list[int] = []
        for piece in regex.findall(PATTERN, text):
            out += self.encoding._encode_single_piece(piece)
        return out

    def ids(self, text: str) -> list[int]:
        if not any(a in text for a in self.added):
            return self.ordinary(text)
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text):
            out += [self.added[part]] if part in self.added else self.ordinary(part)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 16-bit numbers."""
        return array("H", self.ids(text)).tobytes()
