"""Byte-level BPE by an automaton compiled from the merge list.

The automaton reads tokens and accepts a sequence exactly if it is the BPE result
for the bytes that it spells. It starts as one state with an arc for each byte,
back to itself. Each merge (u, v) -> w, in the order of the list, adds a gadget:

* the state s that the u-arcs reach is copied without its v-arc, and the u-arcs
  are led to the copy, so that u may no longer be followed by v;
* each state with a u-arc gets a w-arc, to where u and then v led before.

All arcs with one label reach the same state, so a state is kept as the copy it
was made from, the label it lost and the merge that made it; whether it has an arc
follows from those and is kept in a table once asked.

Words are encoded by table-driven transitions over their bytes: every prefix of a
word has one accepted spelling, so each position carries one state, and the last
token of a prefix is the one whose arc leaves the state at that token's start. A
trie over the labels reads the bytes from each position on.
Texts are cut by the split pattern first. Decoding emits the bytes of the arcs'
labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.segments import SegmentMemo
from salesmart.llm.shared import with_fields
from salesmart.llm.tokens import byte_symbols, check_file, id_type, uncut

#: Fixed value: the split pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

START = 0
#: Materialized arcs and copied states kept by a worker; bounds its memory.
KEPT_ARCS = 2_000_000
KEPT_STATES = 4_000


class MergeAutomaton:
    """Compiled from the bytes of each token id and the merges as triples of ids."""

    def __init__(self, labels: dict[int, bytes], merges: Sequence[tuple[int, int, int]]):
        self.labels = labels
        self.ids = {label: i for i, label in labels.items()}
        self.copy_of, self.lost, self.born = [START], [-1], [-1]
        made = {w for _, _, w in merges}
        self.reached = {i: START for i in labels if i not in made}  # state that a label's arcs reach
        self.left: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}
        self._losses: dict[int, dict[int, int]] = {}
        for rank, (u, v, w) in enumerate(merges):
            self._gadget(rank, u, v, w)
        self.ids = {label: i for label, i in self.ids.items() if i in self.reached}
        # A trie over the labels: for each node the next nodes by byte, and its token or -1.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for label, i in self.ids.items():
            node = 0
            for byte in label:
                after = self.next[node].get(byte)
                if after is None:
                    after = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = i

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u not in self.reached or v not in self.reached:
            return  # a part that no text can spell
        s = self.reached[u]
        if w in self.reached or not self.has_arc(s, v):
            return  # made by an earlier merge, or v never follows u any more
        self.left[w], self.rank[w] = u, rank
        self.reached[w] = s if u == v else self.reached[v]
        self.copy_of.append(s)
        self.lost.append(v)
        self.born.append(rank)
        self.reached[u] = len(self.copy_of) - 1

    def _lost_by(self, state: int) -> dict[int, int]:
        """Labels that the state or one it was copied from lost, with the merge that did it."""
        known = self._losses.get(state)
        if known is None:
            known, at = {}, state
            while at != START:
                known[self.lost[at]] = self.born[at]
                at = self.copy_of[at]
            if len(self._losses) > KEPT_STATES:
                self._losses.clear()
            self._losses[state] = known
        return known

    def has_arc(self, state: int, label: int) -> bool:
        """A label merged after a loss is missing where its left part is missing."""
        if state == START:
            return True
        name = state << 24 | label
        found = self._arcs.get(name)
        if found is None:
            lost = self._lost_by(state)
            found, above = True, len(self.copy_of)
            while True:
                at = lost.get(label)
                if at is not None and at <= above:
                    found = False
                    break
                above = self.rank.get(label, -1)
                if above < 0:
                    break
                label = self.left[label]
            if len(self._arcs) > KEPT_ARCS:
                self._arcs.clear()
            self._arcs[name] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word of the split pattern."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        next_, token, reached, arcs = self.next, self.token, self.reached, self._arcs.get
        size = len(word)
        states: list[int] = [START] + [-1] * size
        last: list[tuple[int, int]] = [(-1, -1)] * (size + 1)
        for begin in range(size):
            state = states[begin]
            if state < 0:
                raise ValueError(f"byte {word[begin - 1]} has no token")
            node, end = 0, begin
            while end < size:
                node = next_[node].get(word[end])
                if node is None:
                    break
                end += 1
                if states[end] < 0:
                    label = token[node]
                    if label >= 0 and (
                        state == START or (arcs(state << 24 | label) or self.has_arc(state, label))
                    ):
                        states[end] = reached[label]
                        last[end] = (label, begin)
        if states[size] < 0:
            raise ValueError(f"byte {word[-1]} has no token")
        out, at = [], len(word)
        while at:
            label, at = last[at]
            out.append(label)
        return out[::-1]


class AutomatonTokenizer:
    """Encodes and decodes whole texts by the automaton of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model = file["model"]
        check_file(file)
        byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
        spell = lambda token: bytes(byte_of[c] for c in token)
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = MergeAutomaton({i: spell(t) for t, i in vocab.items()}, merges)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if not all(map(uncut, self.added)):
            raise ValueError(f"texts can't be cut without cutting one of {list(self.added)}")
        self.words = regex.compile(PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.apart = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})") if self.added else None
        emitted = self.automaton.labels | {i: t.encode() for t, i in self.added.items()}
        size = max(emitted) + 1
        self.emit = [emitted.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        self.memo = SegmentMemo(self._segment, id_type(size))

    def _segment(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.apart.split(text) if self.apart else [text]:
            if part in self.added:
                out.append(self.added[part])
            else:
                for word in self.words.findall(part):
                    out += self.automaton.encode(word.encode())
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the n + 1 places where those of each text begin."""
        return self.memo(column)

    def decode(self, ids: Sequence[int]) -> str:
        """The labels' bytes on end; bytes that are no UTF-8 become U+FFFD."""
        emit = self.emit
        return b"".join([emit[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton_tokenizer(path: str) -> AutomatonTokenizer:
    """The worker's own automaton; it stays, with its memo, for the worker's later tasks."""
    return AutomatonTokenizer(path)


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of the whole text, ``array<int>``; null texts are empty ones.

    A column of the new one's name is replaced, whatever its case; all others pass.
    """
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    rows = docs.select(*kept)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton_tokenizer(tokenizer)
        for batch in batches:
            flat, bounds = tool.encode(batch.column(text))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return rows.mapInArrow(encode, with_fields(rows, f"`{ids}` array<int>"))


def decode_ids(encoded: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the ids spell; null ids give an empty text."""
    kept = [c for c in encoded.columns if c.lower() != text.lower()]
    rows = encoded.select(*kept)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton_tokenizer(tokenizer)
        for batch in batches:
            texts = [tool.decode(own or []) for own in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text]
            )

    return rows.mapInArrow(decode, with_fields(rows, f"`{text}` string"))


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text they decode to.

    A null text is an empty one, of no ids. Each row is a document, also one with a null
    doc_id or one that others have, too; other columns are ignored; an empty table gives no row.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton_tokenizer(tokenizer)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            flat, bounds = tool.encode(batch.column("text"))
            ids_sha, text_sha = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                ids = flat[lo:hi].tolist()
                ids_sha.append(sha(",".join([tool.decimal[i] for i in ids])))
                text_sha.append(sha(tool.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(digest, DIGESTS)
