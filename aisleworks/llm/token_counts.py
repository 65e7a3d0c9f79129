"""Token counts by rank-synchronous merging of ragged arrays of byte-pair symbols.

Method: the pre-tokens of a batch are held as one flat symbol array with the pre-token of each
symbol beside it. A round looks up the rank of every adjacent pair, takes the lowest rank of each
pre-token and merges its non-overlapping occurrences, left to right, in all pre-tokens at once. When no
pair has a rank, the surviving symbols of each pre-token are counted.

A count depends on a white-space-delimited chunk alone, so the counts of chunks already seen are kept
in a table of bounded size per worker; the arrays only hold chunks not in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from aisleworks.llm.common import KEPT_CHARACTERS, bounded_batches, literal_splitter, texts_of, two_columns

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Chunks whose counts a worker keeps; the table is emptied when it is full.
KEPT_CHUNKS = 1_000_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others take the code points from 256 on, in order.
    """
    printable = {b for b in range(256) if (33 <= b <= 126) or (161 <= b <= 172) or b >= 174}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class MergeTable:
    """Symbols as integers and the merge ranks as one sorted array of pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        vocabulary = spec["model"]["vocab"]
        self.end_of_word = spec["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = len(vocabulary)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], dtype=np.int64)
        results = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        # of a pair listed twice, the later rank holds
        unique, last = np.unique(keys[::-1], return_index=True)
        self.keys, self.ranks = unique, len(keys) - 1 - last
        self.results = results[self.ranks]
        symbols = byte_symbols()
        self.byte_id = np.array([vocabulary[symbols[b]] for b in range(256)], dtype=np.int64)
        self.last_byte_id = np.array([vocabulary[symbols[b] + self.end_of_word] for b in range(256)], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {symbol: byte for byte, symbol in symbols.items()}

    def pre_tokens(self, chunk: str) -> list[bytes]:
        """Pre-tokens of a chunk without white space: composed, lower-cased by character, cut by the pattern.

        From U+0250 on the library's own tables of letters and cases are asked, which differ from Python's for newer characters;
        before it no character composes with another.
        """
        if chunk.isascii() or max(chunk) < "\u0250":
            return [word.encode("utf-8") for word in self.words.findall(chunk.lower())]
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in pieces]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when all merges are done."""
        return np.bincount(self.merged(words)[1], minlength=len(words))

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when all merges are done and the pre-token each belongs to; a pre-token's are together, in order."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.byte_id[data]
        ends = np.cumsum(lengths) - 1
        filled = lengths > 0
        symbols[ends[filled]] = self.last_byte_id[data[ends[filled]]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], owner[:0])]
        while len(symbols):
            rank, result = self._pair_ranks(symbols, owner)
            best = np.full(len(words), NO_RANK)
            np.minimum.at(best, owner, rank)
            active = best[owner] != NO_RANK
            if not active.all():  # finished pre-tokens leave the arrays
                done.append((symbols[~active], owner[~active]))
                symbols, owner, rank, result = symbols[active], owner[active], rank[active], result[active]
                if not len(symbols):
                    break
            chosen = self._leftmost(rank == best[owner], owner)
            symbols[chosen] = result[chosen]
            kept = np.ones(len(symbols), dtype=bool)
            kept[chosen + 1] = False
            symbols, owner = symbols[kept], owner[kept]
        return tuple(np.concatenate(parts) for parts in zip(*done, strict=True))

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(symbols), NO_RANK)
        result = np.zeros(len(symbols), dtype=np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        keys = symbols[inside] * self.size + symbols[inside + 1]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        rank[inside[found]] = self.ranks[at[found]]
        result[inside[found]] = self.results[at[found]]
        return rank, result

    @staticmethod
    def _leftmost(hit: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of adjacent hits of one pre-token (as in ``aaa``) every second one, from the left."""
        at = np.flatnonzero(hit)
        starts = np.ones(len(at), dtype=bool)
        starts[1:] = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
        run_start = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - run_start) % 2 == 0]


class ChunkCounter:
    """Token counts of texts, with the chunks' counts kept."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.split_special = literal_splitter(*self.table.special) if self.table.special else None
        self.spaces = regex.compile(r"\s+")
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.kept: dict[str, int] = {}

    def _chunks(self, text: str) -> list[str]:
        # str.split() also cuts at four separators that the tokenizer's pattern takes for symbols
        return self.spaces.split(text) if self.odd_space.search(text) else text.split()

    def _learn(self, chunks: Iterable[str]) -> None:
        chunks = list(chunks)
        words, owner = [], []
        for index, chunk in enumerate(chunks):
            found = self.table.pre_tokens(chunk)
            words.extend(found)
            owner.extend([index] * len(found))
        totals = np.zeros(len(chunks), dtype=np.int64)
        if words:
            np.add.at(totals, np.array(owner), self.table.count(words))
        self.kept.update(zip(chunks, totals.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        special = [0] * len(texts)
        cut = []
        for index, text in enumerate(texts):
            if self.split_special and "<|" in text:
                parts = self.split_special.split(text)
                special[index] = len(parts) - 1
                cut.append([c for part in parts for c in self._chunks(part)])
            else:
                cut.append(self._chunks(text))
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        fresh = set().union(*cut) - self.kept.keys()
        self._learn(fresh)
        look = self.kept.__getitem__
        totals = [sum(map(look, chunks)) + more for chunks, more in zip(cut, special, strict=True)]
        for chunk in fresh:
            if len(chunk) > KEPT_CHARACTERS:
                del self.kept[chunk]
        return totals


_COUNTERS: dict[str, ChunkCounter] = {}


def counter(path: str) -> ChunkCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = ChunkCounter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each;
    other columns are not read. The tokenizer file must be readable at ``tokenizer_path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path)
        for batch in bounded_batches(batches, 2 << 20):
            texts = texts_of(batch.column(1))
            counted = tokens.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(counted, pa.int64()),
                    pa.array([n > limit for n in counted], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return two_columns(docs, id_column, text_column).mapInArrow(run, SCHEMA)
