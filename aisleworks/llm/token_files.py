"""Token ids of documents in files of entropy-coded blocks, written in order and read back in parallel.

Method: a static range asymmetric numeral system. The ids of all documents are counted once, the counts become one
frequency table that every block shares, and each block of ids is coded on its own with interleaved states: id number i
belongs to state i modulo the number of states, and all states share one stream of 32-bit words. At every checkpoint
inside a block the states and the place in the stream are kept, so decoding can start there. A block carries the
checksum of its bytes, each checkpoint the checksum of the ids that follow it, the table its own.

Files hold ranges of the document order; a file's footer lists its blocks. Files are named by task attempt, and only
the index of a task that ended well names its file, so a lost or repeated attempt leaves files nothing refers to.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from aisleworks.llm.common import (
    KEPT_CHARACTERS,
    bounded_batches,
    delete_folder,
    run_folder,
    texts_of,
    two_columns,
    written,
)
from aisleworks.llm.token_counts import byte_symbols

#: Ids of a block, ids between two checkpoints of a block, and interleaved states of a full block.
BLOCK_IDS, CHECKPOINT_IDS, LANES = 1 << 19, 1 << 17, 512
#: States lie in [LOW, LOW << 32) and shed words of 32 bits.
LOW_BITS = 31
LOW = np.uint64(1 << LOW_BITS)
WORD = np.uint64(32)
#: Symbols below this are found by a table of their places.
DENSE_SYMBOLS = 1 << 22
#: Blocks that a reading task takes.
READ_BLOCKS = 8
#: Marks at the start of a table, a block and a file's footer.
TABLE_MARK, BLOCK_MARK, FOOTER_MARK = b"AWT1", b"AWB1", b"AWF1"
#: Bytes that the chunks a worker keeps may take.
KEPT_BYTES = 110 << 20

#: Kinds of characters that the pattern below tells apart.
SPACE, LETTER, DIGIT, SYMBOL = range(4)
#: What is looked up once: words, chunks that the library cuts into words, and chunks that hold a special string.
WORDS, CHUNKS, WITH_SPECIAL = range(3)
#: The steps before the model that ``ChunkIds`` takes over as arrays.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def kind_of(character: str) -> int:
    found = (k for k, p in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")) if regex.match(p, character))
    return next(found, SYMBOL)


#: Kind of each character below U+0100, and of each byte, as far as it is a character by itself.
LATIN_KINDS = np.array([kind_of(chr(c)) for c in range(256)], dtype=np.uint8)
KINDS = np.where(np.arange(256) < 128, LATIN_KINDS, SYMBOL).astype(np.uint8)
LOWER = np.array([b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)], dtype=np.uint8)
#: Letters that end an abbreviation after an apostrophe, and the second letters of the longer ones.
ONE_LETTER = np.isin(np.arange(256), list(b"stmd"))
SECOND_LETTER = np.array([{ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}.get(b, 0) for b in range(256)], dtype=np.uint8)
BYTE_SYMBOLS = {byte: symbol for byte, symbol in byte_symbols().items() if byte != ord(" ")}

#: How ids lie between the stages where the vocabulary allows; else in four bytes.
NARROW = "<u2"

TOKENS = "doc_id long, task int, row long, n long, crc long, ids binary"
INDEX = "part int, file string, block int, first long, ids long"
DOCUMENTS = "doc_id long, start long, ids binary"


class FrequencyTable:
    """Symbols and their frequencies, which add up to a power of two."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols = symbols.astype(np.uint32)
        self.frequency = frequencies.astype(np.uint64)
        self.bits = max(0, int(self.frequency.sum()).bit_length() - 1)
        self.below = np.cumsum(self.frequency) - self.frequency
        body = struct.pack("<II", len(self.symbols), self.bits) + self.symbols.tobytes() + self.frequency.astype("<u4").tobytes()
        self.crc = zlib.crc32(body)
        self.data = TABLE_MARK + struct.pack("<I", self.crc) + body
        self._owners: np.ndarray | None = None
        self._numbers: np.ndarray | None = None

    @classmethod
    def from_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> FrequencyTable:
        """Counts scaled to a power of two, every counted symbol with 1 at least; without symbols the table is empty."""
        order = np.argsort(symbols, kind="stable")
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        bits = min(24, max(12, len(symbols).bit_length() + 4))
        exact = counts * ((1 << bits) / max(counts.sum(), 1.0))
        whole = np.maximum(1, np.floor(exact)).astype(np.int64)
        spare = (1 << bits) - int(whole.sum())
        if spare > 0 and len(whole):  # rounding took less than one from each
            whole[np.argsort(whole - exact, kind="stable")[:spare]] += 1
        elif spare < 0:  # what rare symbols were given is taken from frequent ones, in proportion to what they can give
            given = np.cumsum(whole - 1)
            whole -= np.diff(np.concatenate([[0], given * -spare // given[-1]]))
        return cls(symbols, whole)

    @classmethod
    def from_data(cls, data: bytes) -> FrequencyTable:
        if data[:4] != TABLE_MARK or struct.unpack_from("<I", data, 4)[0] != zlib.crc32(data[8:]):
            raise ValueError("damaged frequency table")
        count = struct.unpack_from("<I", data, 8)[0]
        symbols = np.frombuffer(data, "<u4", count, 16)
        return cls(symbols, np.frombuffer(data, "<u4", count, 16 + 4 * count))

    def owners(self) -> np.ndarray:
        """For each value below the sum of frequencies: the number of the symbol whose range holds it."""
        if self._owners is None:
            number = np.arange(len(self.symbols), dtype=np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
            self._owners = np.repeat(number, self.frequency.astype(np.int64))
        return self._owners

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """The number of each id's symbol in the table."""
        most = int(self.symbols[-1]) if len(self.symbols) else 0
        if most >= DENSE_SYMBOLS:
            return np.searchsorted(self.symbols, ids)
        if self._numbers is None:
            self._numbers = np.zeros(most + 1, dtype=np.int32)
            self._numbers[self.symbols] = np.arange(len(self.symbols))
        return self._numbers[ids]


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """One block: head, a checkpoint per ``CHECKPOINT_IDS`` ids, and the words."""
    lanes = min(LANES, max(1, len(ids) // LANES))
    every = CHECKPOINT_IDS // lanes  # steps between checkpoints
    at = table.numbers(ids)
    frequency, below = table.frequency[at], table.below[at]
    bits = np.uint64(table.bits)
    most = frequency << np.uint64(LOW_BITS + 32 - table.bits)  # from here on a state sheds a word first
    state = np.full(lanes, LOW)
    words: list[np.ndarray] = []
    emitted = 0
    checkpoints = []
    for step in range((len(ids) - 1) // lanes, -1, -1):
        here = slice(step * lanes, (step + 1) * lanes)
        f = frequency[here]
        x = state[: len(f)]
        full = np.flatnonzero(x >= most[here])
        if len(full):
            shed = x[full]
            words.append(shed.astype(np.uint32))
            emitted += len(shed)
            x[full] = shed >> WORD
        times = x // f
        x += times * ((np.uint64(1) << bits) - f)  # times << bits, and the rest of the division
        x += below[here]
        if step % every == 0:
            first = step * lanes
            crc = zlib.crc32(ids[first : first + every * lanes].astype("<u4").tobytes())
            checkpoints.append((emitted, crc, state.astype("<u8").tobytes()))
    head = BLOCK_MARK + struct.pack("<IIIIII", table.crc, len(ids), lanes, every, len(checkpoints), emitted)
    marks = b"".join(struct.pack("<II", emitted - done, crc) + states for done, crc, states in reversed(checkpoints))
    return head + marks + b"".join(w.astype("<u4").tobytes() for w in reversed(words))


class Block:
    """A coded block whose stretches between checkpoints are decoded one at a time."""

    def __init__(self, data: bytes, tables: dict[int, FrequencyTable]):
        if data[:4] != BLOCK_MARK:
            raise ValueError("not a block")
        table_crc, self.count, self.lanes, self.every, self.checkpoints, words = struct.unpack_from("<IIIIII", data, 4)
        self.table = tables[table_crc]
        self.data = data
        self.mark_size = 8 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", words, 28 + self.checkpoints * self.mark_size)
        self.stretch = self.every * self.lanes

    def decode(self, checkpoint: int) -> np.ndarray:
        """The ids from a checkpoint to the next one, held against their checksum."""
        at = 28 + checkpoint * self.mark_size
        place, crc = struct.unpack_from("<II", self.data, at)
        state = np.frombuffer(self.data, "<u8", self.lanes, at + 8).astype(np.uint64)
        owners, frequency, below = self.table.owners(), self.table.frequency, self.table.below
        bits, low_bits = np.uint64(self.table.bits), np.uint64((1 << self.table.bits) - 1)
        first = checkpoint * self.stretch
        out = np.empty(min(self.stretch, self.count - first), dtype=np.uint32)
        for begin in range(0, len(out), self.lanes):
            part = out[begin : begin + self.lanes]
            x = state[: len(part)]
            slot = x & low_bits
            number = owners[slot.view(np.int64)]
            part[:] = number
            x >>= bits
            x *= frequency[number]
            x += slot
            x -= below[number]
            short = np.flatnonzero(x < LOW)
            if len(short):
                x[short] = x[short] << WORD | self.words[place : place + len(short)].astype(np.uint64)
                place += len(short)
        out = self.table.symbols[out]
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("decoded ids differ from their checksum")
        return out


class FileWriter:
    """Appends documents to a file: block after block, each followed by the documents that begin in it, then the footer."""

    def __init__(self, folder: str, name: str, table: FrequencyTable):
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.name, self.table = name, table
        self.out = files.open_output_stream(f"{path}/{name}", compression=None)
        self.at = self.ids = 0  # bytes written, ids in closed blocks
        self.waiting: list[np.ndarray] = []
        self.size = 0  # ids waiting
        self.begun: list[tuple[int | None, int, int]] = []  # document, first id in the file, ids
        self.blocks: list[tuple[int, int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.begun.append((doc_id, self.ids + self.size, len(ids)))
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK_IDS:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // BLOCK_IDS * BLOCK_IDS
            for begin in range(0, whole, BLOCK_IDS):
                self._close_block(flat[begin : begin + BLOCK_IDS])
            self.waiting, self.size = [flat[whole:]], len(flat) - whole

    def _close_block(self, ids: np.ndarray) -> None:
        end = self.ids + len(ids)
        here = [d for d in self.begun if d[1] < end]
        self.begun = self.begun[len(here) :]
        known = np.array([d[0] is not None for d in here], dtype=np.uint8)
        numbers = np.array([(d[0] or 0, d[1], d[2]) for d in here], dtype="<i8").reshape(-1, 3)
        documents = zlib.compress(known.tobytes() + numbers.tobytes(), 1)
        data = encode_block(ids, self.table)
        self.out.write(data + documents)
        self.blocks.append((self.at, len(data), len(documents), len(here), len(ids), zlib.crc32(data + documents)))
        self.at += len(data) + len(documents)
        self.ids = end

    def close(self) -> list[tuple[int, int, int]]:
        """Writes the rest; returns number, first id and ids of each block."""
        if self.size:
            self._close_block(np.concatenate(self.waiting))
        footer = b"".join(struct.pack("<QIIIII", *block) for block in self.blocks)
        self.out.write(footer + struct.pack("<II", len(self.blocks), zlib.crc32(footer)) + FOOTER_MARK)
        self.out.close()
        firsts = np.cumsum([0, *(b[4] for b in self.blocks)])
        return [(number, int(firsts[number]), block[4]) for number, block in enumerate(self.blocks)]


class FileReader:
    """Ids of files by range, with the last block and the last stretch decoded kept."""

    def __init__(self, folder: str, tables: dict[int, FrequencyTable]):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.tables = tables
        self.name, self.source = None, None
        self.block_at, self.stretch_at = None, None

    def open(self, name: str) -> None:
        if self.name == name:
            return
        if self.source is not None:
            self.source.close()
        self.source, self.name = self.files.open_input_file(f"{self.folder}/{name}"), name
        self.block_at = self.stretch_at = None
        size = self.source.size()
        count, crc, mark = struct.unpack("<II4s", self.source.read_at(12, size - 12))
        footer = self.source.read_at(28 * count, size - 12 - 28 * count) if count else b""
        if mark != FOOTER_MARK or zlib.crc32(footer) != crc:
            raise ValueError(f"{name} has no whole footer")
        self.blocks = list(struct.iter_unpack("<QIIIII", footer))
        self.firsts = np.cumsum([0, *(b[4] for b in self.blocks)])

    def _block(self, number: int) -> Block:
        if self.block_at != number:
            offset, coded, listed, self.listed_rows, _, crc = self.blocks[number]
            data = self.source.read_at(coded + listed, offset)
            if zlib.crc32(data) != crc:
                raise ValueError(f"block {number} of {self.name} is damaged")
            self.block, self.listed = Block(data[:coded], self.tables), data[coded:]
            self.block_at, self.stretch_at = number, None
        return self.block

    def documents(self, number: int) -> list[tuple[int | None, int, int]]:
        """Documents that begin in a block: id, first id in the file, number of ids."""
        self._block(number)
        data = zlib.decompress(self.listed)
        numbers = np.frombuffer(data, "<i8", offset=self.listed_rows).reshape(-1, 3).tolist()
        return [(d if known else None, first, n) for known, (d, first, n) in zip(data, numbers, strict=False)]

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from number ``start`` of the open file, decoded from the checkpoint before it."""
        parts = []
        while count:
            number = int(np.searchsorted(self.firsts, start, side="right")) - 1
            block = self._block(number)
            checkpoint, inside = divmod(start - int(self.firsts[number]), block.stretch)
            if self.stretch_at != checkpoint:
                self.stretch, self.stretch_at = block.decode(checkpoint), checkpoint
            part = self.stretch[inside : inside + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def stretches(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes[i]`` values of ``flat`` from ``starts[i]`` on, for every i in a row."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class ChunkIds:
    """Ids of texts as the tokenizers library gives them; each distinct word goes through the library's model once.

    For a vocabulary that composes, lower-cases and cuts at white space and classes of characters, texts of a batch are cut
    into words together, as arrays over their bytes, and a text's ids are those of its words in a row. Chunks between white
    space with characters beyond U+00FF are cut into words by the library, those with a special string go through it whole. Ids
    of short words and chunks are kept up to ``KEPT_BYTES``, of others for their batch. For other vocabularies the library takes
    whole texts.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.library = Tokenizer.from_file(path)
        vocabulary, added = self.library.get_vocab(), spec["added_tokens"]
        self.wide = max(vocabulary.values(), default=0) >= 1 << 16
        suffix = spec["model"].get("end_of_word_suffix")
        self.known_cuts = (
            (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and not any(regex.search(r"\s", t["content"]) for t in added)
            and bool(suffix)
            and all(symbol + suffix in vocabulary for symbol in byte_symbols().values())
        )
        self.special = re.compile(b"|".join(re.escape(t["content"].encode("utf-8")) for t in added)) if added else None
        bare = {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.model = Tokenizer.from_str(json.dumps(spec | bare))
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.filled = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)
        self.weight = 0

    def _units(self, data: bytes) -> tuple[np.ndarray, pa.Array, bool]:
        """Where words, and chunks that the library cuts, begin in ``data``, which ends with white space; lower-cased words
        and unchanged chunks; whether there are such chunks."""
        raw = np.frombuffer(data, dtype=np.uint8)
        kind, lower = KINDS[raw], LOWER[raw]
        start = kind == DIGIT
        lead = np.flatnonzero((raw & 0xFE) == 0xC2)  # of the two bytes of U+0080 to U+00FF
        if len(lead):
            after = raw[lead + 1]
            kind[lead] = kind[lead + 1] = found = LATIN_KINDS[(raw[lead] & 3) << 6 | after & 63]
            lower[lead[(raw[lead] == 0xC3) & (after <= 0x9E) & (after != 0x97)] + 1] += 32  # \u00c0 to \u00de but \u00d7
            start[lead] = found == DIGIT
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        start &= kind != SPACE
        quote = np.flatnonzero(raw == ord("'"))
        quote = quote[start[quote]]
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):  # 's 't 'm 'd 're 've 'll, where a run of symbols would begin
            one, two = lower[quote + 1], lower[quote + 2]
            size = np.where(ONE_LETTER[one], 1, np.where((two == SECOND_LETTER[one]) & (two > 0), 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            end = quote + 1 + size
            start[end[kind[end] == LETTER]] = True
        odd = np.flatnonzero(raw >= 0xC4)
        if self.special:
            odd = np.concatenate([odd, np.array([m.start() for m in self.special.finditer(data)], dtype=np.int64)])
        if len(odd):
            spaces = np.flatnonzero(kind == SPACE)
            chunk = np.unique(np.searchsorted(spaces, odd))
            begin = np.where(chunk > 0, spaces[chunk - 1] + 1, 0)
            edges = np.zeros(len(raw), dtype=np.int8)
            edges[begin] = 1
            edges[spaces[chunk]] = -1
            inside = np.cumsum(edges, dtype=np.int8).astype(bool)
            lower[inside] = raw[inside]
            start[inside] = False
            start[begin] = True
        kept = kind != SPACE
        spelled = lower[kept]
        offsets = np.append(np.flatnonzero(start[kept]), len(spelled)).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(spelled)]
        return np.flatnonzero(start), pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers), len(odd) > 0

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, spelled in the vocabulary's byte symbols, and how many each has."""
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for begin in range(0, len(words), 1 << 13):
            part = [words[begin : begin + (1 << 13)]]
            coded = self.model.encode_batch_fast(part, is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(coded.ids, dtype=np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.ends_word[ids[-1]]), prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _merged_chunks(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks, which the library cuts into words."""
        text = self.normalizer.normalize_str(b"\n".join(units).decode("utf-8"))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        ends = np.cumsum([len(chunk) + 1 for chunk in text.split("\n")])
        chunk = np.searchsorted(ends, np.array([begin for _, (begin, _) in pieces], dtype=np.int64), side="right")
        distinct = {word: n for n, word in enumerate(dict.fromkeys(word for word, _ in pieces))}
        at = np.array([distinct[word] for word, _ in pieces], dtype=np.int64)
        flat, sizes = self._merged(list(distinct))
        found = stretches(flat, (np.cumsum(sizes) - sizes)[at], sizes[at])
        return found, np.bincount(chunk, weights=sizes[at], minlength=len(units)).astype(np.int64)

    def _learn(self, units: list[bytes], way: int, first: int) -> None:
        """Ids of units, numbered from ``first`` on."""
        if way == WORDS:
            words = b" ".join(units).decode("latin-1").translate(BYTE_SYMBOLS).split(" ")
            flat, sizes = self._merged(words)
        elif way == CHUNKS:
            flat, sizes = self._merged_chunks(units)
        else:
            coded = [self.library.encode(unit.decode("utf-8"), add_special_tokens=False).ids for unit in units]
            flat, sizes = np.concatenate(coded).astype(np.uint32), np.array([len(ids) for ids in coded])
        while first + len(units) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[first : first + len(units)] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(units)] = sizes
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)

    def _way(self, unit: bytes) -> int:
        if self.special and self.special.search(unit):
            return WITH_SPECIAL
        return CHUNKS if max(unit) >= 0xC4 else WORDS

    def _numbers(self, units: list[bytes], odd: bool) -> np.ndarray:
        """Each unit's number; those of long units are given again after the batch."""
        numbers = np.fromiter(map(self.number.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        groups: dict[tuple[bool, int], list[int]] = {}
        for i in np.flatnonzero(numbers < 0).tolist():
            way = self._way(units[i]) if odd else WORDS
            groups.setdefault((len(units[i]) > KEPT_CHARACTERS, way), []).append(i)
        first, kept = len(self.number), self.filled
        for (long, way), places in sorted(groups.items()):
            found = [units[i] for i in places]
            self._learn(found, way, first)
            numbers[places] = np.arange(first, first + len(found))
            if not long:
                self.number.update(zip(found, range(first, first + len(found)), strict=True))
                self.weight += sum(map(len, found)) + 165 * len(found) + 4 * (self.filled - kept)
                kept = self.filled
            first += len(found)
        self.filled = kept  # what long units filled is still read by this batch
        return numbers

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if not self.known_cuts:
            return [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts]
        if not texts:
            return []
        if self.weight > KEPT_BYTES:
            self._empty()
        lines = [text.encode("utf-8") for text in texts]
        begins, units, odd = self._units(b"\n".join([*lines, b""]))
        coded = units.dictionary_encode()
        at = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), odd)[coded.indices.to_numpy()]
        sizes = self.sizes[at].astype(np.int64)
        flat = stretches(self.flat, self.starts[at], sizes)
        line_ends = np.cumsum([len(line) + 1 for line in lines])
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.searchsorted(begins, line_ends)])]
        return [flat[x:y] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


_ENCODERS: dict[str, ChunkIds] = {}


def encoder(path: str) -> ChunkIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkIds(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Frees what a reused worker kept of an earlier stage."""
    _ENCODERS.clear()


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of each document with the end id, its task and its number there, in the scan's own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, rows = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        narrow = not tokens.wide and end_id < 1 << 16
        for batch in bounded_batches(batches):
            found = [np.append(ids, np.uint32(end_id)) for ids in tokens.ids(texts_of(batch.column(1)))]
            crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in found]
            data = [ids.astype(NARROW if narrow else "<u4").tobytes() for ids in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([task] * len(data), pa.int32()),
                    pa.array(range(rows, rows + len(data)), pa.int64()),
                    pa.array(map(len, found), pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                names=["doc_id", "task", "row", "n", "crc", "ids"],
            )
            rows += len(data)

    return docs.mapInArrow(run, TOKENS)


def stored_ids(data: pa.Scalar, count: int) -> np.ndarray:
    """Ids of a row between the stages, by the bytes each takes."""
    return np.frombuffer(data.as_buffer(), NARROW if len(data.as_buffer()) == 2 * count else "<u4")


def shared_table(tokens: DataFrame) -> FrequencyTable:
    """The frequency table of all ids. What reaches the driver is a number per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        total = np.zeros(0, dtype=np.int64)
        for batch in bounded_batches(batches, 1 << 20):
            rows = zip(batch.column(0), batch.column(1).to_pylist(), strict=True)
            seen = np.bincount(np.concatenate([stored_ids(data, n) for data, n in rows]))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), dtype=np.int64)])
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    per_id = tokens.select("ids", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return FrequencyTable.from_counts(np.array([r["id"] for r in per_id], dtype=np.int64), np.array([r["n"] for r in per_id]))


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Writes the ids of every document, each followed by ``end_id``, to files below ``folder`` in ascending id order.

    Returns the index, one row per block (file, block, first id, ids), which is written there too. Null ids come first;
    rows of one id are ordered by checksum, length and place in the scan, so a repeated id may fill many files. A null or
    empty text is the end id alone; an empty table makes no file. Other columns are not read. The tokenizer file must be
    readable at ``tokenizer_path`` on every executor, ``folder`` a place that all executors share.
    """
    spark = docs.sparkSession
    aside = run_folder(spark, "token-ids")
    tokens = written(tokenised(two_columns(docs, id_column, text_column), tokenizer_path, end_id), "token-ids", aside)
    table = shared_table(tokens)
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/table", compression=None) as out:
        out.write(table.data)
    shared = spark.sparkContext.broadcast(table.data)  # 8 bytes per id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        context = TaskContext.get()
        part, out = context.partitionId(), None
        for batch in batches:
            if out is None and batch.num_rows:
                name = f"{part:07d}-{context.taskAttemptId()}.ids"
                out = FileWriter(f"{folder}/files", name, FrequencyTable.from_data(shared.value))
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5), strict=True):
                out.add(doc_id, stored_ids(data, n).astype(np.uint32))
        blocks = out.close() if out else []
        number, first, ids = zip(*blocks, strict=True) if blocks else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(blocks), pa.int32()),
                pa.array([out.name] * len(blocks) if out else [], pa.string()),
                pa.array(number, pa.int32()),
                pa.array(first, pa.int64()),
                pa.array(ids, pa.int64()),
            ],
            names=["part", "file", "block", "first", "ids"],
        )

    order = ["doc_id", "crc", "n", "task", "row"]
    tokens.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    delete_folder(spark, aside)
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files below ``folder``: ``doc_id, start, ids`` (little-endian unsigned 32-bit integers).

    ``start`` counts the ids of all documents before it. Blocks are dealt to tasks in runs; a task reads the documents
    that begin in its blocks, those that reach into further blocks as far as they go.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/table", compression=None) as source:
        shared = spark.sparkContext.broadcast(source.read())
    # one row per file: the task count of the writing stage bounds this window
    ends = index.groupBy("part").agg(F.sum("ids").alias("in_file"))
    before = F.coalesce(F.sum("in_file").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("part", before.alias("before"))
    run = F.floor(F.col("block") / READ_BLOCKS)
    tasks = max(1, -(-index.count() // READ_BLOCKS))
    dealt = index.join(starts, "part").repartition(tasks, "file", run).sortWithinPartitions("file", "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        table = FrequencyTable.from_data(shared.value)
        reader = FileReader(f"{folder}/files", {table.crc: table})
        for batch in batches:
            for name, block, before_file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader.open(name)
                rows, weight = [], 0
                for doc_id, first, count in reader.documents(block):
                    data = reader.ids(first, count).astype("<u4").tobytes()
                    rows.append((doc_id, before_file + first, data))
                    weight += len(data)
                    if weight > 8 << 20:
                        yield as_batch(rows)
                        rows, weight = [], 0
                yield as_batch(rows)

    return dealt.select("file", "block", "before").mapInArrow(read, DOCUMENTS)


def as_batch(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "ids"]
    )


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **named) -> DataFrame:
    """Writes the token files of ``docs`` (by default to a new folder below spark.checkpoint.dir) and reads them back."""
    folder = folder or run_folder(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, folder, **named)
    return read_token_files(docs.sparkSession, folder)
