"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
import json

import numpy as np


class Encoder:
    """ids(text): the text's token ids.

    tiktoken encodes with the ranks of byte_bpe_50k.json's vocabulary, several
    times as fast as the JSON form; the tests hold its ids against that form.
    The JSON form's added tokens (the string that ends a text) have their own
    ids wherever their strings stand.
    """

    def __init__(self, path: str | None = None, added: str | None = None):
        """path: the vocabulary's ranks; added: the JSON form that lists added tokens."""
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(added or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
            self.special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.names = set(self.special)

    def ids(self, text: str) -> np.ndarray:
        if any(x in text for x in self.names):
            return np.array(self.own.encode(text, allowed_special=self.names, disallowed_special=()), "<u4")
        return np.array(self.own.encode_ordinary(text), "<u4")


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
