"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as its symbols. The adjacent pair of the lowest rank is taken from a heap again and again, its right
symbol leaves a linked list, and the pairs with the new neighbours enter the heap. Each merge takes away one symbol,
so the count is *symbols at the start minus merges*: no token identifier is ever looked up or built.

The vocabularies meant here put word ends on the last symbol, drop white space and fold case (the ``word`` kind of
``tokenizers`` files). White space always ends a word, so counts are kept for each run of other characters.
"""

from __future__ import annotations

import json
import unicodedata
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ridgeline.llm.common import arrow_map, pack, shipped_file

CACHE_ENTRIES = 500_000  # counts of runs, and of words, a Python worker remembers; a full memory is emptied
CACHE_LENGTH = 64  # longer runs are counted anew each time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merges_needed(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding does on a word: lowest rank first, leftmost first among equals."""
    size = len(symbols)
    rank_of = ranks.get
    heap = [(rank, at) for at, rank in enumerate(map(rank_of, zip(symbols, symbols[1:]))) if rank is not None]
    if not heap:
        return 0
    heapify(heap)
    following = list(range(1, size + 1))
    leading = list(range(-1, size - 1))
    alive = list(symbols)
    merged = 0
    while heap:
        rank, at = heappop(heap)
        right = following[at]
        if right >= size:
            continue
        symbol, other = alive[at], alive[right]
        if symbol is None or rank_of((symbol, other)) != rank:
            continue  # one of the two symbols has changed since this pair was noted
        symbol = alive[at] = symbol + other
        alive[right] = None
        merged += 1
        after = following[at] = following[right]
        if after < size:
            leading[after] = at
            found = rank_of((symbol, alive[after]))
            if found is not None:
                heappush(heap, (found, at))
        before = leading[at]
        if before >= 0:
            found = rank_of((alive[before], symbol))
            if found is not None:
                heappush(heap, (found, before))
    return merged


class WordCounter(dict):
    """Number of tokens of a run without white space; remembers short runs."""

    def __init__(self, content: bytes):
        super().__init__()
        described = json.loads(content)
        model = described["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.ending = model["end_of_word_suffix"] or ""
        steps = described["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.marks = [text[:2] for text in special]
        self.symbols = byte_symbols()
        self.spaces = regex.compile(r"\s+")
        self.of_word: dict[str, int] = {}

    def _plain(self, run: str) -> int:
        run = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()  # no final form of sigma
        tokens = 0
        for word in [run] if run.isascii() and run.isalpha() else self.words.findall(run):
            known = self.of_word.get(word)
            if known is None:
                symbols = [self.symbols[b] for b in word.encode()]
                symbols[-1] += self.ending
                known = len(symbols) - merges_needed(symbols, self.ranks)
                if len(word) <= CACHE_LENGTH:
                    if len(self.of_word) >= CACHE_ENTRIES:
                        self.of_word.clear()
                    self.of_word[word] = known
            tokens += known
        return tokens

    def __missing__(self, run: str) -> int:
        tokens = 0
        if any(mark in run for mark in self.marks):
            at = 0
            for found in self.special.finditer(run):
                tokens += self._plain(run[at : found.start()]) + 1
                at = found.end()
            tokens += self._plain(run[at:])
        else:
            tokens = self._plain(run)
        if len(run) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = tokens
        return tokens

    def tokens(self, text: str) -> int:
        # str.split() also parts at four control characters that are not white space here
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        runs = [r for r in self.spaces.split(text) if r] if odd else text.split()
        return sum(map(self.__getitem__, runs))


def _count(file: shipped_file, limit: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    counter = file.build(WordCounter)
    sizes, tokens = [], []
    for value in batch.column(1):  # one text at a time
        text = value.as_py() or ""
        sizes.append(len(text.encode()))
        tokens.append(counter.tokens(text))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
        ["id", "n_bytes", "n_tokens", "over_limit"],
    )


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of each whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    One narrow pass without a shuffle, so hot sources and repeated texts cost nothing extra. A null text counts as
    empty (no bytes, no tokens, not over the limit); null and repeated ids are kept as they are, a row for each row;
    an empty table gives an empty result; other columns are not read. ``vocabulary`` is a path on the driver.
    """
    file = shipped_file(docs.sparkSession, vocabulary)
    rows = pack(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, partial(_count, file, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
