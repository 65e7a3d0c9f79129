"""Packing documents into training sequences by shortest-pack-first over the length histogram.

Method: each document's ids are cut into full pieces and a rest; only the histogram of piece lengths
(at most ``max_tokens`` numbers) reaches the driver. There, lengths are placed longest first, each as often as it fits
into the packs with most room, and packs of one kind are kept as a pattern with a count. A pattern's slots become
ranges of ranks: piece number r of its length goes to a known sequence and offset. The rank of a piece is its
number within its task plus the pieces of that length in earlier tasks, so no task sees all pieces of a length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_batches, literal_splitter, texts_of, two_columns, written

#: White-space characters in a row from which a run is cut out of its text.
LONG_SPACE_RUN = 10_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, task_rank long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokenizer:
    """Ids of a byte-level vocabulary file (``.json``) with its special strings recognised, as its library gives them.

    The file's vocabulary, read as ranks, is run by tiktoken, which gives the same ids in a fifth of the time.
    Its look-ahead for runs of white space is only needed where a text has such a run, so two encoders are kept.
    """

    def __init__(self, path: str):
        import json

        from aisleworks.llm.token_counts import byte_symbols

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte_of[symbol] for symbol in token): number
            for token, number in spec["model"]["vocab"].items()
            if token not in special
        }
        # The pre-token pattern of byte-level vocabularies: a fixed value.
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        self.full = tiktoken.Encoding("full", pat_str=words + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=words + r"|\s+", mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.split_special = literal_splitter(*special) if special else None
        self.ranks = ranks
        self.space_run = re.compile(r"\s\s")
        self.long_space_run = regex.compile(r"\s{%d,}" % LONG_SPACE_RUN)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; special ids have none."""
        tokens = [b""] * (max([*self.ranks.values(), *self.special.values()]) + 1)
        for token, number in self.ranks.items():
            tokens[number] = token
        return tokens

    def _short_run_ids(self, text: str) -> list[int]:
        return (self.full if self.space_run.search(text) else self.plain).encode_ordinary(text)

    def plain_ids(self, text: str) -> list[int]:
        """Ids with special strings taken as text.

        Runs of white space are cut out where they are long, as the look-ahead's stack grows with them: all of a
        run but the character before a word is one pre-token, which the pattern without look-ahead gives too.
        """
        if len(text) < LONG_SPACE_RUN or not (runs := list(self.long_space_run.finditer(text))):
            return self._short_run_ids(text)
        out: list[int] = []
        last = 0
        for run in runs:
            end = run.end() - (run.end() < len(text))
            out += self._short_run_ids(text[last : run.start()]) + self.plain.encode_ordinary(text[run.start() : end])
            last = end
        return out + self._short_run_ids(text[last:])

    def ids(self, text: str) -> list[int]:
        if not self.split_special or not self.split_special.search(text):
            return self.plain_ids(text)
        out: list[int] = []
        last = 0
        for found in self.split_special.finditer(text):
            out += self.plain_ids(text[last : found.start()])
            out.append(self.special[found.group()])
            last = found.end()
        return out + self.plain_ids(text[last:])


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int) -> DataFrame:
    """One row per piece, numbered within its task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, dtype=np.int64)
        for batch in bounded_batches(batches):
            doc, start, length, crc, total, rank = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.array([*encoder.ids(text), end_id], dtype="<u4")
                data = memoryview(ids.tobytes())
                for begin in range(0, len(ids), max_tokens):
                    size = min(max_tokens, len(ids) - begin)
                    doc.append(doc_id)
                    start.append(begin)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * begin : 4 * (begin + size)]))
                    total.append(len(ids))
                    rank.append(int(seen[size]))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
                + [pa.array([task] * len(doc), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"],
            )

    return docs.mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with the number of packs of each.

    Open packs are kept by the room they have left; a length goes to the packs with most room, as often as it fits
    into each, which are split off their pattern if fewer are needed, and to new packs, filled alike, when no pack has room.
    """
    open_packs: dict[int, list[tuple[list[int], int]]] = {}
    closed: list[tuple[list[int], int]] = []
    for length in sorted((n for n, count in counts.items() if count > 0), reverse=True):
        left = counts[length]
        placed = []
        while left:
            room = max(open_packs, default=0)
            if room < length:
                pattern, packs, room = [], left, capacity
            else:
                pattern, packs = open_packs[room].pop()
            each = min(room // length, left)
            used = min(packs, left // each)
            left -= used * each
            if room < capacity:
                if packs > used:
                    open_packs[room].append((pattern, packs - used))
                if not open_packs[room]:
                    del open_packs[room]
            placed.append(([*pattern, *[length] * each], used, room - each * length))
            if len(placed) > 2 * capacity:  # merge what this length has made before going on
                placed = _merged(placed)
        for pattern, packs, room in placed:
            if room:
                open_packs.setdefault(room, []).append((pattern, packs))
            else:
                closed.append((pattern, packs))
    return closed + [entry for entries in open_packs.values() for entry in entries]


def _merged(placed: list[tuple[list[int], int, int]]) -> list[tuple[list[int], int, int]]:
    total: dict[tuple[int, ...], list[int]] = {}
    for pattern, packs, room in placed:
        total.setdefault(tuple(pattern), [0, room])[0] += packs
    return [(list(pattern), packs, room) for pattern, (packs, room) in total.items()]


def rank_ranges(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Per pattern slot: length, first rank, first sequence id, offset; sorted by (length, first rank)."""
    next_rank: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            first = next_rank.get(length, 0)
            rows.append((length, first, sequence, offset))
            next_rank[length] = first + packs
            offset += length
        sequence += packs
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T.copy(), strict=True))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = 1024,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone; a very long one, of white space too, is cut like any other. Repeated rows and repeated ids are packed each. A null id stays
    null. An empty table gives no row. Other columns are not read. The tokenizer file must be readable at
    ``tokenizer_path`` on every executor. The pieces (numbers only) are written once to the shared folder.
    """
    pieces = written(cut_pieces(two_columns(docs, id_column, text_column), tokenizer_path, max_tokens, end_id), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = rank_ranges(pack_histogram(histogram, max_tokens))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = ranges["length"] << 44 | ranges["rank"]
        for batch in batches:
            length = batch.column(2).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)]
                + [pa.array(ranges["sequence"][at] + rank - ranges["rank"][at]), pa.array(ranges["offset"][at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("task_rank")).alias("rank")
    )
    return ranked.mapInArrow(place, SCHEMA)
