"""Byte-pair encoding and decoding with a tokenization automaton.

The automaton reads *tokens* and accepts exactly the token sequences that byte-pair encoding makes. It starts as one
state with a loop for each byte. Each merge ``a b -> c`` then applies one gadget: the state that ``a`` leads to is
copied without its ``b`` arc, ``a`` now leads to the copy, every state with an ``a`` arc gets a ``c`` arc, and ``c``
leads to where ``b`` led. A merge therefore adds one state, which is stored as (state it was copied from, arc taken
away); arcs to later tokens follow from the arc to their left part. ``arc`` resolves this description, and the answers
fill a transition table that later words only look up.

A pre-split word is encoded by following arcs whose labels spell it, longest label first, going back where none fits.
The automaton is deterministic and holds one sequence for each string, so a byte has one state at most: a byte that
failed once is never tried again, and the first sequence that spells the word is the encoding. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ridgeline.llm.common import arrow_map, pack, shipped_file
from ridgeline.llm.token_count import byte_symbols

# Fixed value: how this kind of vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_ENTRIES = 1_000_000
CACHE_ENTRIES = 300_000  # runs, and words, a Python worker remembers; a full memory is emptied
CACHE_LENGTH = 64


class TokenAutomaton:
    """States, arcs and labels; tokens are the ids of the vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocabulary.values(), default=-1) + 1
        self.size = size
        self.label = [b""] * size
        for name, number in vocabulary.items():
            self.label[number] = name
        self.length = list(map(len, self.label))
        self.longest = max(self.length, default=0)
        self.left = [-1] * size  # left part of a merged token
        self.born = [-1] * size  # the merge that made a token
        self.leads = [0] * size  # the state a token leads to
        self.copied = [0]  # state 0 has every arc
        self.without = [-1]
        self.dead: set[int] = set()  # tokens without an arc
        for step, (a, b) in enumerate(merges):
            self._gadget(step, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.table: dict[int, int] = {}
        self.shorter = [-1] * size  # the longest other token that a token begins with
        self.tree: dict[int, dict] = {}
        for name in sorted(n for n, number in vocabulary.items() if number not in self.dead):  # beginnings come first
            node = self.tree
            for byte in name:
                if -1 in node:
                    self.shorter[vocabulary[name]] = node[-1]
                node = node.setdefault(byte, {})
            node[-1] = vocabulary[name]

    def _gadget(self, step: int, a: int, b: int, c: int) -> None:
        if a in self.dead or b in self.dead or not self.arc(self.leads[a], b):
            self.dead.add(c)  # earlier merges never leave a and b side by side
            self.copied.append(0)
            self.without.append(-1)
            return
        self.left[c], self.born[c] = a, step
        self.leads[c] = self.leads[b]
        self.copied.append(self.leads[a])
        self.without.append(b)
        self.leads[a] = step + 1  # state s is made by merge s - 1

    def arc(self, state: int, token: int) -> bool:
        """Whether the built automaton has an arc; ``state - 1`` is the merge that made the state."""
        while state:
            if self.born[token] >= state - 1:
                token = self.left[token]
            elif self.without[state] == token:
                return False
            else:
                state = self.copied[state]
        return True

    def step(self, state: int, token: int) -> int:
        """The next state by the transition table, or -1."""
        key = state * self.size + token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            found = self.table[key] = self.leads[token] if self.arc(state, token) else -1
        return found

    def encode(self, word: bytes) -> list[int]:
        table, size, end = self.table, self.size, len(word)
        at, state = 0, 0
        ids: list[int] = []
        states: list[int] = []
        failed: set[int] = set()
        token = self._longest(word, 0)
        while True:
            while token >= 0:  # the longest label that the table allows here and that does not lead to a dead end
                key = state * size + token
                after = table.get(key)
                if after is None:
                    after = self.step(state, token)
                if after >= 0 and at + self.length[token] not in failed:
                    break
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                states.append(state)
                at += self.length[token]
                if at == end:
                    return ids
                state = after
                token = self._longest(word, at)
            else:
                failed.add(at)
                token = ids.pop()
                state = states.pop()
                at -= self.length[token]
                token = self.shorter[token]

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token at a byte, by the tree of labels."""
        node = self.tree
        found = -1
        for byte in memoryview(word)[at : at + self.longest]:
            node = node.get(byte)
            if node is None:
                break
            found = node.get(-1, found)
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


class TextCodec(dict):
    """Whole texts to ids and back; a dictionary from runs of text to packed ids."""

    def __init__(self, content: bytes):
        super().__init__()
        described = json.loads(content)
        byte = {symbol: number for number, symbol in enumerate(byte_symbols())}
        raw = lambda name: bytes(byte[c] for c in name)
        model = described["model"]
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.automaton = TokenAutomaton({raw(name): number for name, number in model["vocab"].items()}, merges)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.label = list(self.automaton.label)
        for name, number in self.special.items():
            self.label += [b""] * (number + 1 - len(self.label))
            self.label[number] = name.encode()
        self.special_split = regex.compile("(" + ("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)") + ")")
        self.words = regex.compile(SPLIT)
        self.simple = re.compile(" ?[A-Za-z]+").fullmatch  # one word of SPLIT
        self.of_word: dict[str, tuple[int, ...]] = {}
        # Coarse runs: no word of SPLIT crosses their borders. Python's \s has four control characters more.
        self.runs = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.odd_runs = regex.compile(r" ?\S+|\s+(?!\S)|\s+")

    def __missing__(self, run: str) -> bytes:
        encode = self.automaton.encode
        ids: list[int] = []
        for word in [run] if self.simple(run) else self.words.findall(run):
            known = self.of_word.get(word)
            if known is None:
                known = encode(word.encode())
                if len(word) <= CACHE_LENGTH:
                    if len(self.of_word) >= CACHE_ENTRIES:
                        self.of_word.clear()
                    self.of_word[word] = tuple(known)
            ids += known
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(run) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return b"".join(map(self.__getitem__, (self.odd_runs if odd else self.runs).findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not any(name in text for name in self.special):
            return self._plain(text)
        parts = []
        for part in self.special_split.split(text):
            parts.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.label.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _encode(file: shipped_file, batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = file.build(TextCodec)
    packed = [codec.encode(value.as_py() or "") for value in batch.column(1)]
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "ids"])


def _decode(file: shipped_file, batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = file.build(TextCodec)
    texts = [None if not value.is_valid else codec.decode(value.values.to_numpy(zero_copy_only=False)) for value in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def _digest(file: shipped_file, batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = file.build(TextCodec)
    count, ids_sha, decoded_sha = [], [], []
    for value in batch.column(1):
        packed = codec.encode(value.as_py() or "")
        count.append(len(packed) // 4)
        ids_sha.append(hashlib.sha256(packed).hexdigest())
        decoded_sha.append(hashlib.sha256(codec.decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
    arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _narrow(frame: DataFrame, id_col: str, value_col: str, work, columns: str, vocabulary: str) -> DataFrame:
    rows = pack(frame, id=id_col, value=value_col)
    kind = rows.schema["id"].dataType.simpleString()
    file = shipped_file(frame.sparkSession, vocabulary)
    return arrow_map(rows, partial(work, file), f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text: ``id_col, ids``.

    A narrow pass. A null text counts as empty and gives an empty list; null and repeated ids stay as they are, a row
    for each row; an empty table gives an empty result; other columns are not read.
    """
    return _narrow(docs, id_col, text_col, _encode, "ids array<int>", vocabulary)


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids, special tokens included: ``id_col, text``. A null list gives a null text."""
    return _narrow(encoded, id_col, ids_col, _decode, "text string", vocabulary)


def codec_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the ids as little-endian 32-bit integers, and of the decoded text in UTF-8. Cases as in
    ``encode_texts``.
    """
    return _narrow(docs, id_col, text_col, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", vocabulary)


def _with_tokens(file: shipped_file, text_at: int, names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    codec = file.build(TextCodec)
    encoded = _encode(file, pa.RecordBatch.from_arrays([batch.column(text_at)] * 2, ["id", "text"])).column("ids")
    count = np.diff(encoded.offsets.to_numpy())
    same = [codec.decode(ids.values.to_numpy(zero_copy_only=False)) == (text.as_py() or "") for ids, text in zip(encoded, batch.column(text_at))]
    return pa.RecordBatch.from_arrays([*batch.columns, encoded, pa.array(count.astype(np.int64)), pa.array(same, pa.bool_())], names)


def with_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``round_trip``: whether the decoded ids are the text (a null one: empty).

    Columns of those names are replaced; other cases as in ``encode_texts``.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"ids", "n_tokens", "round_trip"}])
    schema = StructType(list(docs.schema.fields)).add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    file = shipped_file(docs.sparkSession, vocabulary)
    return arrow_map(docs, partial(_with_tokens, file, docs.columns.index(text_col), schema.names), schema)
