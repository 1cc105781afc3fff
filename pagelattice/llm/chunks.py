"""Whole texts to token ids through the tokenizers library, with a memo for the parts of a text that cannot influence each other.

A byte-level model cuts a text before each single space that stands between two other characters, and the word model
drops white space; so the parts between such spaces are encoded alone. Parts that were seen before come from a bounded
memo. Of the others, those of ASCII and common Latin letters are cut by the model's own pattern and merged by tiktoken's core from
the merges of the same file, which is faster, and byte-level models do so with a whole text of such characters; all others, and
whole texts that hold a string of a special token, go to the library.
The tests hold both ways against the library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import islice

import regex
import tiktoken
from tokenizers import Tokenizer

from pagelattice.llm.common import Memo

_ODD_SPACE = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Characters that no normalisation composes and whose classes and lower case all libraries agree on.
_COMMON = re.compile("[ -~\u00a1-\u00ac\u00ae-\u00ff]*")
_COMMON_TEXT = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u00ff]*")
#: How the two kinds of model cut a text before merging.
BYTE_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = b"\xff"  # no byte of UTF-8


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class MergeCore:
    """Ids of a part by its merges alone; None where a part needs the library, or the file's merges are not in the order of its ids."""

    def __init__(self, path: str, byte_level: bool):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of, vocabulary = _byte_of_char(), model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            ends = bool(suffix) and token.endswith(suffix)
            ranks[bytes(of[c] for c in (token[: -len(suffix)] if ends else token)) + WORD_END * ends] = i
        base = len(vocabulary) - len(model["merges"])
        self.usable = all(vocabulary[a + b] == base + i for i, (a, b) in enumerate(map(tuple, model["merges"]))) and not model.get("unk_token")
        self.end = WORD_END if suffix else b""
        self.lower = not byte_level
        self.find = regex.compile(BYTE_PATTERN if byte_level else WORD_PATTERN).findall
        if self.end:
            # a byte never stands alone as an end mark, so any unused id will do
            ranks.setdefault(WORD_END, 1 << 30)
        self.encoding = tiktoken.Encoding("parts", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merge = self.encoding._core_bpe.encode_single_piece

    def ids(self, part: str) -> list[int]:
        if part.isalpha():
            return self.merge((part.lower() if self.lower else part).encode() + self.end)
        out: list[int] = []
        for x in self.find(part.lower() if self.lower else part):
            out += self.merge(x.encode() + self.end)
        return out


class ChunkEncoder:
    """encode(text): its ids as little-endian unsigned 32-bit bytes; null is encoded as empty.

    memo: how many parts are kept at most.
    """

    def __init__(self, path: str, memo: int = 500_000):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as the machine's 32-bit integers, little-endian here")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = self.tokenizer.pre_tokenizer
        self.byte_level = type(pre).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        core = MergeCore(path, self.byte_level) if self.known_pattern() else None
        self.core = core if core is not None and core.usable else None
        self.memo = Memo((lambda p: self.make(" " + p)) if self.byte_level else self.make, memo)

    def known_pattern(self) -> bool:
        """Whether the file cuts and normalises texts in one of the two known ways."""
        own = json.loads(self.tokenizer.to_str())
        if self.byte_level:
            return own["pre_tokenizer"].get("use_regex", True) and not own["pre_tokenizer"]["add_prefix_space"]
        steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": WORD_PATTERN}

    def make(self, part: str) -> bytes:
        if self.core is not None and len(part) <= 200 and _COMMON.fullmatch(part):
            return array("I", self.core.ids(part)).tobytes()
        return self.by_library(part)

    def by_library(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.by_library(text)
        if self.byte_level:
            if self.core is not None and _COMMON_TEXT.fullmatch(text):
                return self.core.encoding.encode_to_numpy(text, disallowed_special=()).tobytes()
            parts = _LONE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
            head = self.make(parts[0]) if parts[0] else b""
            return head + b"".join(map(self.memo.__getitem__, islice(parts, 1, None)))
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def shared_encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, so that tasks go on with what earlier ones have learned."""
    return ChunkEncoder(path)
