"""Alignment of two tokenizers' ids: groups of tokens that end together, and how often ids are linked corpus-wide.

Method: whitespace-token anchors. Each text is tokenised whole by both tokenizers. Where both have a token ending at one
byte and both next tokens are marked with a space, the shared end is an anchor, and anchors cut the text into windows
of token ids. A window's groups are worked out once and kept under its two id tuples, so words seen before cost a lookup.

The linked id pairs of every document are written once, counted in Spark, and looked up again per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_batches, two_columns, written
from aisleworks.llm.packing import ByteTokenizer

#: Space mark of pieces and the form of byte pieces: fixed values of the piece vocabulary.
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Characters from which a text is tokenised in stretches, cut where a space follows another character.
STRETCH = 1 << 19
#: Weight at which a worker forgets its windows: about the bytes they take.
KEPT_WEIGHT = 64 << 20
#: The lower half of a pair's number: the second side's id.
LOW = (1 << 32) - 1
#: Links from which a group's pairs are made from its distinct ids.
LARGE_GROUP = 1 << 16
#: Linked id pairs up to which their counts are broadcast (17 bytes each); more are joined by a shuffle.
MOST_PAIRS = 2_000_000

ALIGNED = (
    "doc_id long, task int, row long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<long>, times array<long>"
)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs given by their starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def summed(owner: np.ndarray, pair: np.ndarray, time: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each owner, ascending, with their times added up, and how many each owner has."""
    if len(pair) and owners < 1 << 15 and int((pair & LOW).max()) < 1 << 16 and int(pair.max() >> 32) < 1 << 16:
        order = np.argsort(owner << 32 | pair >> 32 << 16 | pair & LOW)  # as one number: quicker than by two keys
    else:
        order = np.lexsort((pair, owner))
    owner, pair, time = owner[order], pair[order], time[order]
    fresh = np.ones(len(pair), dtype=bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(fresh)
    total = np.add.reduceat(time, begins) if len(begins) else time
    return pair[begins], total, np.bincount(owner[begins], minlength=owners)


def alike(a: np.ndarray, b: np.ndarray, starts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A first window for each distinct one, and each window's place among these.

    Windows of up to four tokens with ids of 16 bits are told apart as numbers; others stand for themselves.
    """
    count = len(sizes[0])
    firsts, place = [], np.empty(count, dtype=np.int64)
    rest = np.ones(count, dtype=bool)
    known = 0
    if count and max(int(a.max()), int(b.max())) < 1 << 16:
        for n, m in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)):
            at = np.flatnonzero((sizes[0] == n) & (sizes[1] == m))
            packed = np.zeros(len(at), dtype=np.uint64)
            for ids, start, size in ((a, starts[0], n), (b, starts[1], m)):
                for k in range(size):
                    packed = packed << np.uint64(16) | ids[start[at] + k].astype(np.uint64)
            _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
            firsts.append(at[first])
            place[at] = known + inverse
            known += len(first)
            rest[at] = False
    others = np.flatnonzero(rest)
    place[others] = known + np.arange(len(others))
    return np.concatenate([*firsts, others]), place


def tuple_keys(a: np.ndarray, b: np.ndarray, starts: list[np.ndarray], sizes: list[np.ndarray]) -> list[bytes]:
    """Each window's two id tuples as one value: the first side's ids, a number that is no id, the second side's ids."""
    n, m = sizes
    stops = np.cumsum(n + m + 1)
    begins = stops - n - m - 1
    flat = np.full(stops[-1] if len(stops) else 0, 0xFFFFFFFF, dtype=np.uint32)
    flat[spread(begins, n)] = a[spread(starts[0], n)]
    flat[spread(begins + n + 1, m)] = b[spread(starts[1], m)]
    data = flat.tobytes()
    return [data[x:y] for x, y in zip((4 * begins).tolist(), (4 * stops).tolist(), strict=True)]


class Pool:
    """A numpy array that grows at its end."""

    def __init__(self):
        self.data, self.size = np.zeros(1 << 14, dtype=np.int64), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class Groups:
    """Runs of both sides' tokens between shared ends, of a batch."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray):
        self.a, self.b, self.a_end, self.b_end = a, b, a_end, b_end
        self.a_start, self.b_start = (np.concatenate([[0], ends[:-1]]) for ends in (a_end, b_end))
        self.a_size, self.b_size = a_end - self.a_start, b_end - self.b_start

    def pairs(self, chosen: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs ``a << 32 | b`` of the chosen groups, added up per owner."""
        links = self.a_size[chosen] * self.b_size[chosen]
        small, large = chosen[links <= LARGE_GROUP], chosen[links > LARGE_GROUP]
        links, width = links[links <= LARGE_GROUP], self.b_size[small]
        place = spread(np.zeros_like(links), links)
        left = np.repeat(self.a_start[small], links) + place // np.repeat(width, links)
        right = np.repeat(self.b_start[small], links) + place % np.repeat(width, links)
        pair = [self.a[left].astype(np.int64) << 32 | self.b[right]]
        time, of = [np.ones(len(left), dtype=np.int64)], [np.repeat(owner[np.isin(chosen, small)], links)]
        for group, its in zip(large.tolist(), owner[np.isin(chosen, large)].tolist(), strict=True):
            x, n = np.unique(self.a[self.a_start[group] : self.a_end[group]], return_counts=True)
            y, m = np.unique(self.b[self.b_start[group] : self.b_end[group]], return_counts=True)
            pair.append((x.astype(np.int64)[:, None] << 32 | y).ravel())
            time.append((n[:, None] * m).ravel())
            of.append(np.full(len(x) * len(y), its))
        return summed(np.concatenate(of), np.concatenate(pair), np.concatenate(time), owners)

    def codes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token of the chosen groups, first side first, what stands for it in ``TokenTexts``; and each group's end."""
        n, m = self.a_size[chosen], self.b_size[chosen]
        ends = np.cumsum(n + m)
        starts = ends - n - m
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
        out[spread(starts, n)] = 4 * self.a[spread(self.a_start[chosen], n)].astype(np.int64)
        out[spread(starts + n, m)] = 4 * self.b[spread(self.b_start[chosen], m)].astype(np.int64)
        out[starts + n - 1] += 1
        out[ends - 1] += 2
        return out, ends


class TokenTexts(dict):
    """Text of four times an id, plus 1 before a bar, plus 2 before a semicolon."""

    def __missing__(self, code: int) -> str:
        self[code] = text = f"{code >> 2}{',|;'[code & 3]}"
        return text


class Sides:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        self.bytes = ByteTokenizer(byte_path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_token = self.bytes.token_bytes()
        self.b_token = [self._piece_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.vocab_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in tokens], dtype=np.int64) for tokens in (self.a_token, self.b_token))
        self.a_spaced, self.b_spaced = (
            np.array([t.startswith(b" ") for t in tokens], dtype=bool) for tokens in (self.a_token, self.b_token)
        )
        self.letters = [np.frombuffer(b"".join(tokens), np.uint8) for tokens in (self.a_token, self.b_token)]
        self.letters_start = [np.cumsum(sizes) - sizes for sizes in (self.a_size, self.b_size)]
        # pieces that join nothing to a space after it allow cutting there
        self.cuttable = not any(b" " in t.lstrip(b" ") for t in self.b_token)

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte.group(1), 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def stretches(self, text: str) -> list[str]:
        """The text in parts, each from a space that follows another character; no token spans such a place."""
        if len(text) <= STRETCH or not self.cuttable:
            return [text]
        parts, start = [], 0
        while len(text) - start > STRETCH:
            cut = re.compile(r"(?<=\S) ").search(text, start + STRETCH)
            if cut is None:
                break
            parts.append(text[start : cut.start()])
            start = cut.start()
        return [*parts, text[start:]]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides of ``" " + text``."""
        if len(text) <= STRETCH:
            return self.bytes.plain_ids(" " + text), self.pieces.encode(text, num_threads=1)
        a: list[int] = []
        b: list[int] = []
        for number, part in enumerate(self.stretches(text)):
            spaced = " " + part if number == 0 else part
            a += self.bytes.plain_ids(spaced)
            b += self.pieces.encode(spaced[1:], num_threads=1)
        return a, b

    def spelled(self, found: list[tuple[list[int], list[int]]], texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
        """The same ids, without those of texts that either side's bytes differ from, and each side's in one array."""
        wanted = [(" " + text).encode() if text else b"" for text in texts]
        flat = [flat_ids([f[side] for f in found]) for side in (0, 1)]
        if all(self._spells(side, flat[side], [len(f[side]) for f in found], wanted) for side in (0, 1)):
            return found, *flat
        sides = self.a_token, self.b_token
        found = [
            f if all(b"".join([tokens[i] for i in ids]) == w for tokens, ids in zip(sides, f, strict=True)) else ([], [])
            for f, w in zip(found, wanted, strict=True)
        ]
        return found, *[flat_ids([f[side] for f in found]) for side in (0, 1)]

    def _spells(self, side: int, ids: np.ndarray, counts: list[int], wanted: list[bytes]) -> bool:
        """Whether the ids spell every text, given how many ids each text has."""
        size = (self.a_size, self.b_size)[side][ids]
        ends, stops = np.concatenate([[0], np.cumsum(size)]), np.cumsum([0, *counts])
        if (np.diff(ends[stops]) != [len(w) for w in wanted]).any():
            return False
        spelled = self.letters[side][spread(self.letters_start[side][ids], size)]
        return np.array_equal(spelled, np.frombuffer(b"".join(wanted), np.uint8))


def flat_ids(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=sum(map(len, ids)))


class WindowMemory:
    """Groups, links, texts and pairs of windows by their id tuples."""

    def __init__(self):
        self.token_texts = TokenTexts()
        self.empty()

    def empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups, self.links, self.pair_start, self.pair_size = Pool(), Pool(), Pool(), Pool()
        self.pair, self.time = Pool(), Pool()
        self.weight = 0

    def learn(self, keys: list[bytes], groups: Groups, first: np.ndarray, sizes: np.ndarray) -> None:
        """Adds windows, given by their first group and number of groups in a batch."""
        chosen = spread(first, sizes)
        owner = np.repeat(np.arange(len(keys)), sizes)
        links = np.bincount(owner, groups.a_size[chosen] * groups.b_size[chosen], len(keys)).astype(np.int64)
        pair, time, pair_size = groups.pairs(chosen, owner, len(keys))
        self.pair_start.add(self.pair.size + np.cumsum(pair_size) - pair_size)
        for pool, values in ((self.groups, sizes), (self.links, links), (self.pair_size, pair_size), (self.pair, pair), (self.time, time)):
            pool.add(values)
        codes, ends = groups.codes(chosen)
        tokens = list(map(self.token_texts.__getitem__, codes.tolist()))
        stops = ends[np.cumsum(sizes) - 1].tolist()
        self.texts += ["".join(tokens[x:y]) for x, y in zip([0, *stops[:-1]], stops, strict=True)]
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys)), strict=True))
        self.weight += 420 * len(keys) + 16 * len(pair) + 14 * len(codes)


class Aligner:
    """Aligns batches of texts."""

    def __init__(self, byte_path: str, piece_path: str):
        self.sides = Sides(byte_path, piece_path)
        self.memory = WindowMemory()

    def align(self, texts: list[str | None]) -> list[list]:
        """Columns ``n_a, n_b, n_groups, n_links, groups, pairs, times``, a row per text."""
        found, a, b = self.sides.spelled([self.sides.ids(text) if text else ([], []) for text in texts], texts)
        a_count, b_count = (np.array([len(f[side]) for f in found], dtype=np.int64) for side in (0, 1))
        # both sides spell the same bytes, so ends agree across the whole batch
        a_bytes, b_bytes = np.cumsum(self.sides.a_size[a]), np.cumsum(self.sides.b_size[b])
        at = np.searchsorted(b_bytes, a_bytes)
        ours = np.flatnonzero(b_bytes[at] == a_bytes) if len(a) else np.zeros(0, dtype=np.int64)
        theirs = at[ours]
        groups = Groups(a, b, ours + 1, theirs + 1)
        a_next, b_next = np.append(self.sides.a_spaced[a[1:]], True), np.append(self.sides.b_spaced[b[1:]], True)
        doc_end = np.zeros(len(a) + 1, dtype=bool)
        doc_end[np.cumsum(a_count)] = True
        anchors = np.flatnonzero((a_next[ours] & b_next[theirs]) | doc_end[ours + 1])
        number = self._windows(groups, anchors)
        memory = self.memory
        stops = np.concatenate([[0], np.searchsorted(groups.a_end[anchors], np.cumsum(a_count), side="right")])
        first, last = stops[:-1], stops[1:]
        totals = [np.concatenate([[0], np.cumsum(pool.data[number])]) for pool in (memory.groups, memory.links)]
        n_groups, n_links = (total[last] - total[first] for total in totals)
        in_order = list(map(memory.texts.__getitem__, number.tolist()))
        texts_of = ["".join(in_order[x:y])[:-1] for x, y in zip(first.tolist(), last.tolist(), strict=True)]
        sizes = memory.pair_size.data[number]
        take = spread(memory.pair_start.data[number], sizes)
        owner = np.repeat(np.repeat(np.arange(len(texts)), last - first), sizes)
        pair, time, held = summed(owner, memory.pair.data[take], memory.time.data[take], len(texts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (pair, time)]
        return [a_count, b_count, n_groups, n_links, texts_of, *lists]

    def _windows(self, groups: Groups, anchors: np.ndarray) -> np.ndarray:
        """The memory's number of each window; a window ends with the group at an anchor."""
        memory = self.memory
        if memory.weight > KEPT_WEIGHT:
            memory.empty()
        ends = [groups.a_end[anchors], groups.b_end[anchors]]
        starts = [np.concatenate([[0], end[:-1]]) for end in ends]
        distinct, place = alike(groups.a, groups.b, starts, [end - start for end, start in zip(ends, starts, strict=True)])
        keys = tuple_keys(groups.a, groups.b, [s[distinct] for s in starts], [(e - s)[distinct] for e, s in zip(ends, starts, strict=True)])
        found = list(map(memory.number.get, keys))
        fresh = {keys[index]: index for index, number in enumerate(found) if number is None}
        if fresh:
            places = distinct[np.fromiter(fresh.values(), dtype=np.int64)]
            firsts = np.concatenate([[0], anchors[:-1] + 1])[places]
            memory.learn(list(fresh), groups, firsts, anchors[places] + 1 - firsts)
            found = list(map(memory.number.__getitem__, keys))
        return np.array(found, dtype=np.int64)[place]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    key = byte_path, piece_path
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def aligned_groups(
    docs: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: token counts of both sides, groups, links, the groups' text (``a1,a2|b1;a3|b2,b3``), and the distinct
    linked id pairs (``a << 32 | b``) with how often each is linked; ``task`` and ``row`` tell rows of one id apart.

    Both tokenizers see the whole text after a space, special strings as plain text. A null or empty text, and one that
    either side's tokens do not spell (such as one holding the space mark itself), has no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, task, rows = aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0
        for batch in bounded_batches(batches, 3 << 19):
            columns = align.align(batch.column(1).to_pylist())
            size = batch.num_rows
            numbers = [pa.array(c, pa.int64()) for c in columns[:4]]
            place = [pa.array([task] * size, pa.int32()), pa.array(range(rows, rows + size), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *place, *numbers, pa.array(columns[4], pa.string()), *columns[5:]],
                names=["doc_id", "task", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
            )
            rows += size

    return two_columns(docs, id_column, text_column).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked id pair: in how many rows it is linked, and whether no pair of its first id is linked in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_first = Window.partitionBy(F.shiftright("pair", 32))  # as many rows at most as the other vocabulary has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_first))


KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def with_counts_broadcast(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` from a broadcast of all counts."""
    held = counts.select("pair", "n", "best").orderBy("pair").toArrow()
    pair, n, best = (held[c].to_numpy() for c in ("pair", "n", "best"))
    shared = aligned.sparkSession.sparkContext.broadcast((pair, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            ends = np.cumsum(pairs.value_lengths().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(v[at] * times)]) for v in (best, n)]
            added = [pa.array(s[ends] - s[np.concatenate([[0], ends[:-1]])], pa.int64()) for s in sums]
            kept = [batch.column(name) for name in (*KEPT, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=[*KEPT, "groups_sha256", "n_best", "count_sum"])

    shape = ", ".join(f"{c} long" for c in KEPT) + ", groups_sha256 string, n_best long, count_sum long"
    return aligned.select(*KEPT, "groups_sha256", "pairs", "times").mapInArrow(run, shape)


def with_counts_joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of every row's pairs with the counts."""
    one = aligned.select("task", "row", F.explode(F.arrays_zip("pairs", "times")).alias("at"))
    links = one.select("task", "row", F.col("at.pairs").alias("pair"), F.col("at.times").alias("times"))
    found = links.join(counts, "pair").groupBy("task", "row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    added = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return aligned.join(found, ["task", "row"], "left").select(*KEPT, "groups_sha256", *added)


def tokenizer_alignment(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``count_sum`` adds, over a row's links, in how many rows the link's id pair is linked; ``n_best`` counts the links whose
    pair is linked in as many rows as any of its first id. The digest is of the groups' text, empty for a row without
    tokens. Null ids stay null, repeated rows count each, an empty table gives no row, other columns are not read. Both
    vocabulary files must be readable on every executor.
    """
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = aligned_groups(docs, byte_path, piece_path, id_column, text_column)
    aligned = written(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = written(pair_counts(aligned), "pair-counts")
    few = counts.count() <= most_pairs
    return with_counts_broadcast(aligned, counts) if few else with_counts_joined(aligned, counts)
