"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from salesmart.llm.segments import SegmentMemo, chunk_starts

#: Segments that the split pattern leaves whole, so that the merges alone decide.
ONE_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others get the characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_SYMBOLS = byte_symbols()


def id_type(vocabulary: int) -> str:
    """The smaller of the two payload types that holds every id."""
    return "<u2" if vocabulary <= 2**16 else "<u4"


def uncut(token: str) -> bool:
    """Whether a text's cuts never fall into this added token."""
    data = np.frombuffer(("x" + token).encode(), np.uint8)
    return not (chunk_starts(data, np.array([0, len(data)])) > 1).any()


def check_file(file: dict) -> None:
    """Raises for a tokenizer file whose texts can't be cut and encoded as here."""
    model, split = file["model"], file["pre_tokenizer"] or {}
    wrong = {
        "no byte-level BPE": model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel",
        "a prefix space": split.get("add_prefix_space"),
        "another split pattern": not split.get("use_regex", True),
        "a normalizer": file.get("normalizer"),
        "dropout": model.get("dropout"),
        "merges ignored for known words": model.get("ignore_merges"),
        "bytes as tokens": model.get("byte_fallback"),
        "affixes of words": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
        "added tokens that take in what is around them": any(
            t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file.get("added_tokens") or []
        ),
    }
    if found := [name for name, is_so in wrong.items() if is_so]:
        raise ValueError(f"unsupported tokenizer file: {', '.join(found)}")


class TextEncoder:
    """Encodes columns of whole texts, null as empty, without special tokens around them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            check_file(json.load(source))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all(map(uncut, added)):
            raise ValueError(f"texts can't be cut without cutting one of {added}")
        self.merge = self.tokenizer.model.tokenize
        self.words = not any(ONE_WORD.fullmatch(t.strip()) for t in added)
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.memo = SegmentMemo(self._segment, self.dtype)

    def _segment(self, text: str) -> list[int]:
        if self.words and ONE_WORD.fullmatch(text):
            return [t.id for t in self.merge(text.encode().decode("latin-1").translate(BYTE_SYMBOLS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the n + 1 places where those of each text begin."""
        return self.memo(column)


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """The worker's own encoder; it stays, with its memo, for the worker's later tasks."""
    return TextEncoder(path)
