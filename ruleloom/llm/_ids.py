"""Token ids of whole texts as the tokenizers library gives them.

Where a vocabulary allows it, tiktoken's encoder over the same merges does the
work, which gives the same ids several times faster. Long texts are encoded in
runs that begin where the byte-level pattern begins a piece whatever stands
around: where white space follows another character.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from ._common import held

#: How the byte-level pre-tokenizer splits, and what it takes as white space: fixed values of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
#: Characters of a run.
RUN = 500_000


class IdEncoder:
    """Encodes as the library's encode() does without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = {t.content: i for i, t in added.items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if added else None
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        #: of an id as it is kept
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        # added tokens that take something from their surroundings cannot be cut out
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self._fast = self._by_ranks() if plain else None

    def _by_ranks(self):
        """tiktoken's encoder, where it must give the same ids: the byte-level
        pattern splits, nothing is normalised, and merges come in the order of
        their ids. None elsewhere."""
        spec = json.loads(self.tokenizer.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        usual = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        odd = ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix")
        if not usual or spec["normalizer"] or any(model.get(k) for k in odd):
            return None
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or len(ids) + 256 != len(vocab):
            return None
        import tiktoken

        # the library shows a byte as its Latin-1 character, or as the next one from U+0100 on where that cannot be printed
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printed} | {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*printed}))}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}
        return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def packed(self, text: str) -> Iterator[bytes]:
        """The ids of a text in a row, ``dtype`` each."""
        if not self._fast:
            yield array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return
        for k, part in enumerate(self._special.split(text) if self._special else [text]):
            if k % 2:
                yield array(self.code, [self.specials[part]]).tobytes()
            else:
                for run in cut(part):
                    yield array(self.code, self._fast(run)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.packed(text)), self.dtype)

    def starts(self, text: str) -> list[int]:
        """Offset in characters of each token's first character."""
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]


def cut(text: str, most: int = RUN) -> Iterator[str]:
    """Cuts a text before white space into runs of about ``most`` characters
    (longer where there is none)."""
    start = 0
    while len(text) - start > most:
        m = _EDGE.search(text, start + most)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def load(path: str) -> IdEncoder:
    """The worker's own; see ``held``."""
    return held(("ids", path), lambda: IdEncoder(path))
