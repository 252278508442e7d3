"""Token ids of a tokenizer file, as its own library gives them, at a useful speed."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread per task; Spark runs the tasks

# Characters whose class (letter, number, space, other) every Unicode version and library agrees on.
_PLAIN = re.compile("[\t\n\r -~¡-ɏΑ-Ωα-ωА-я‐-‧一-龥]*")
# How byte-level BPE splits a text before merging (a fixed value of the vocabulary's format).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: char -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """ids(text) equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Byte-level BPE files whose ids follow their merge order run through ``tiktoken`` (the same
    merges, three times faster) where the text holds only plain characters and no special token;
    every other text, and every other kind of file, goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._as_ranks(spec)

    @staticmethod
    def _as_ranks(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges"):
            return None
        chars = _byte_of_char()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        import tiktoken

        return tiktoken.Encoding("from_file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # a run too long for that library
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def tokens(path: str) -> Tokens:
    """One tokenizer per file and Python worker."""
    return Tokens(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
