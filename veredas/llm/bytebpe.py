"""Ids of a byte-level BPE tokenizer file, without building the tokenizers library's own encodings.

The file's vocabulary is given to tiktoken, whose merges by rank give the same ids and
take about a quarter of the time. That holds where every merge's result has the id order of the merges, which the constructor
checks; it refuses files of another kind. Texts with a run of white space beyond ``LONG_RUN``, on which tiktoken's
pattern engine runs out of stack, go through the tokenizers library. The tests hold both to equal ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 50_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 stands for itself, the other bytes follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder of one file. ``plain``: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made["pre_tokenizer"] or {}
        vocabulary, merges = made["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        first = len(vocabulary) - len(merges) - sum(t in vocabulary for t in special)
        if made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError("needs a byte-level tokenizer without a normalizer")
        if any(vocabulary[a + b] != first + k for k, (a, b) in enumerate(merges)):
            raise ValueError("the ids of the merges' results are not in the order of the merges")
        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.path, self.plain = path, plain
        self.n_vocabulary = max([*ranks.values(), *special.values()]) + 1
        #: Bytes of every id.
        self.bytes_of = [b""] * self.n_vocabulary
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = t
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={} if plain else special)
        self.library = None
        self.long_run = re.compile(r"\s{%d}" % LONG_RUN)

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of a text, without a closing one."""
        if len(text) >= LONG_RUN and self.long_run.search(text):
            return self._by_library(text)
        return self.coder.encode_to_numpy(text, allowed_special="all")

    def _by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = self.plain
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
