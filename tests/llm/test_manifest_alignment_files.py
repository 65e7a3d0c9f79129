import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from aisleworks.llm import merkle, token_files
from aisleworks.llm.alignment import Aligner, Sides, tokenizer_alignment
from aisleworks.llm.packing import ByteTokenizer
from aisleworks.llm.token_files import Block, ChunkIds, FrequencyTable, encode_block, token_file_round_trip, write_token_files

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CHARACTERS = st.text(st.sampled_from(list("aAbthe rsnl'’ \n\t\x1c\x85éÉΣİß1½²!?<|>中🙂▁́​ꟋꟜ")), max_size=60)


# --- Merkle manifest --------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(nodes):
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0]


def plain_siblings(nodes, pos):
    out = []
    while len(nodes) > 1:
        run = pos // 8 * 8
        out += [n for i, n in enumerate(nodes[run : run + 8], run) if i != pos]
        nodes, pos = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], pos // 8
    return out


def plain_manifest(rows):
    """``rows`` of (doc_id, text, lang, source, n_chars); every root recomputed from all nodes."""

    def leaf(row, text):
        values = (row[0], row[3], row[2], row[4], text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for row in rows:
        small = row[1]
        if small is not None and zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 3 == 0:
            small = "".join(c.lower() if "A" <= c <= "Z" else c for c in small)
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, small)))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: sorted(groups[n]) for n in names}
    subroots = [plain_root([x[2] for x in trees[n]]) for n in names]
    root = plain_root(subroots) if subroots else None
    out = []
    for place, name in enumerate(names):
        leaves = [x[2] for x in trees[name]]
        for pos, (known, doc_id, own, changed) in enumerate(trees[name]):
            proof = plain_siblings(leaves, pos) + plain_siblings(subroots, place)
            folded = plain_root([*subroots[:place], plain_root([*leaves[:pos], changed, *leaves[pos + 1 :]]), *subroots[place + 1 :]])
            out.append((doc_id if known else None, own, subroots[place], root, sha("".join(proof)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(awkward):
    langs = ["en", "é", None, "de", "+", ""]
    rows = [(i, t, langs[n % 6], None if n % 4 else "A b", n_chars) for n, ((i, t), n_chars) in enumerate(zip(awkward, [None, *range(99)], strict=False))]
    many = [(100 + n, f"Text {n} OF Many", "many", "src", n) for n in range(75)]
    alone = [(500 + n, f"Lang {n}", f"l{n:02d}", "s", 1) for n in range(9)]
    return rows + many + alone + [rows[4], rows[4]]


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest_equals_full_recomputation(spark, awkward, levels):
    rows = manifest_rows(awkward)
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2, "y") for r in rows],
        "doc_id long, text string, lang string, source string, n_chars int, pos int, tree string, block long, node string",
    ).repartition(5)
    got = sorted(map(tuple, merkle.document_manifest(docs, levels).collect()), key=str)  # blocks of one level make several storeys
    assert got == plain_manifest(rows)


def test_manifest_of_one_row_and_none(spark, docs):
    (row,) = merkle.document_manifest(docs([(3, "Abc", None)])).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    assert merkle.document_manifest(docs([])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 8), st.data())
def test_resumed_states_hash_only_what_lies_to_the_right(children, data):
    names = [sha(str(i)) for i in range(children)]
    parent, slot = merkle.Parent(names), data.draw(st.integers(0, children - 1))
    assert parent.digest == sha("".join(names)) and len(parent.states) == children
    assert parent.folded(slot, "x") == sha("".join([*names[:slot], "x", *names[slot + 1 :]]))
    left, right = parent.siblings(slot)
    assert merkle.UpperStep(left, right).folded("x") == parent.folded(slot, "x")


# --- alignment --------------------------------------------------------------
LIBRARY = Tokenizer.from_file(BYTES)
LIBRARY.encode_special_tokens = True
PIECE_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
BYTE_OF = {}


def spelled(text):
    """Ids and byte lengths of both sides from the libraries alone."""
    if not BYTE_OF:
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        BYTE_OF.update({chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)})
    if not text:
        return [], [], [], []
    a, b = LIBRARY.encode(" " + text, add_special_tokens=False).ids, PIECE_LIBRARY.encode(text)
    a_bytes = [bytes(BYTE_OF[c] for c in LIBRARY.id_to_token(i)) for i in a]
    b_bytes = [PIECE_LIBRARY.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if PIECE_LIBRARY.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, b_bytes, strict=True)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    return a, b, np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()


def plain_groups(text):
    a, b, a_end, b_end = spelled(text)
    groups = []
    low = 0
    for end in sorted(set(a_end) & set(b_end)):
        groups.append(([i for i, e in zip(a, a_end, strict=True) if low < e <= end], [i for i, e in zip(b, b_end, strict=True) if low < e <= end]))
        low = end
    return len(a), len(b), groups


def plain_alignment(rows):
    found = [(doc_id, *plain_groups(text)) for doc_id, text in rows]
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for *_, groups in found]
    count = Counter(pair for per_doc in links for pair in per_doc)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, n_a, n_b, groups), own in zip(found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(n for pair, n in own.items() if count[pair] == best[pair[0]])
        total = sum(n * count[pair] for pair, n in own.items())
        out.append((doc_id, n_a, n_b, len(groups), sum(own.values()), sha(text) if groups else "", n_best, total))
    return sorted(out, key=str)


MORE = [
    (20, "a▁b"), (21, "<|endoftext|> and <s>x</s> <unk>"), (22, " " * 700 + "x"), (23, "🙂🙂 中文字符 naïve"), (24, "\n\n\t  tab"),
    (25, "supercalifragilistic" * 40), (26, "the quick"),
]


def test_alignment_equals_plain_version(spark, docs, awkward):
    rows = [r for r in awkward if r[0] != 7] + MORE + [(30, " ".join(f"word{i % 97}, {i}" for i in range(2000)))]
    expected = plain_alignment(rows)
    for most in (2_000_000, 0):
        got = tokenizer_alignment(docs(rows), BYTES, PIECES, most_pairs=most).collect()
        order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
        assert sorted([tuple(r[c] for c in order) for r in got], key=str) == expected
    assert tokenizer_alignment(docs([]), BYTES, PIECES).count() == 0


ALIGNER = Aligner(BYTES, PIECES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), CHARACTERS), max_size=5))
def test_groups_of_random_texts(texts):
    n_a, n_b, n_groups, n_links, groups, pairs, times = ALIGNER.align(texts)
    for place, text in enumerate(texts):
        a, b, expected = plain_groups(text)
        assert (n_a[place], n_b[place], n_groups[place]) == (a, b, len(expected))
        assert groups[place] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in expected)
        own = Counter(x << 32 | y for left, right in expected for x in left for y in right)
        assert dict(zip(pairs[place].as_py(), times[place].as_py(), strict=True)) == dict(own)
        assert n_links[place] == sum(own.values())


def test_a_long_text_is_tokenised_in_stretches(monkeypatch):
    text = " ".join(f"word{i % 997}  and\n{i % 13}" for i in range(3000))
    whole = ALIGNER.sides.ids(text)
    monkeypatch.setattr("aisleworks.llm.alignment.STRETCH", 1000)
    assert len(ALIGNER.sides.stretches(text)) > 20 and ALIGNER.sides.ids(text) == whole


def test_a_group_of_many_tokens_is_linked_by_distinct_ids(monkeypatch):
    texts = ["🙂中" * 30, "the same " * 20]
    expected = ALIGNER.align(texts)
    monkeypatch.setattr("aisleworks.llm.alignment.LARGE_GROUP", 0)
    got = Aligner(BYTES, PIECES).align(texts)
    assert [list(map(str, c)) for c in got] == [list(map(str, c)) for c in expected]


def test_very_long_texts_without_words():
    sides = Sides(BYTES, PIECES)
    for text in (" " * 3_000_000, "x" + " \n" * 600_000 + "y", "ab" * 1_000_000):
        ((a, b),), _, _ = sides.spelled([sides.ids(text)], [text])
        assert a and b"".join(sides.a_token[i] for i in a) == b"".join(sides.b_token[i] for i in b) == (" " + text).encode()


def test_long_white_space_has_the_ids_of_the_library():
    ids, library = ByteTokenizer(BYTES), Tokenizer.from_file(BYTES)
    for text in (" " * 30_000, "x" + " \n" * 30_000, "a" + " " * 12_000 + "b  c" + "　" * 15_000, " " * 10_000 + "<|endoftext|>" + "\n" * 10_001):
        assert ids.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert len(ids.ids(" " * 3_000_000)) > 1000


# --- token files ------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), min_size=1, max_size=400), st.integers(1, 40))
def test_a_block_decodes_from_every_checkpoint(ids, skew):
    ids = np.array(ids * skew, dtype=np.uint32)
    table = FrequencyTable.from_counts(*np.unique(ids, return_counts=True))
    assert int(table.frequency.sum()) == 1 << table.bits and (table.frequency > 0).all()
    again = FrequencyTable.from_data(table.data)
    old = token_files.CHECKPOINT_IDS
    try:
        token_files.CHECKPOINT_IDS = 512
        block = Block(encode_block(ids, table), {again.crc: again})
    finally:
        token_files.CHECKPOINT_IDS = old
    order = np.random.default_rng(1).permutation(block.checkpoints)
    for number in order:
        assert (block.decode(number) == ids[number * block.stretch : (number + 1) * block.stretch]).all()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 70
    table = FrequencyTable.from_counts(*np.unique(ids, return_counts=True))
    data = bytearray(encode_block(ids, table))
    data[-200] ^= 4
    with pytest.raises(ValueError):
        Block(bytes(data), {table.crc: table}).decode(0)
    with pytest.raises(ValueError):
        FrequencyTable.from_data(table.data[:-1] + b"\x07")


WORD_LIBRARY, WORD_IDS = Tokenizer.from_file(WORDS), ChunkIds(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(CHARACTERS, max_size=4))
def test_chunk_ids_equal_the_library(texts):
    assert [x.tolist() for x in WORD_IDS.ids(texts)] == [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def library_ids(library, texts):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunk_ids_cut_every_latin_character_and_abbreviation_as_the_library():
    latin = [chr(c) for c in range(0x250)]
    texts = [f"a{c}b{c}{c} 1{c}2'{c} {c}'s{c}" for c in latin] + [f"<|endoftext|>{c}<|x <|startoftext|>{c}" for c in latin]
    marks = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'Re", "'r", "'l", "'", "''", "é'", ".'", "1'", " '"]
    texts += [a + b + c for a in marks for b in marks for c in ("", "t", "é", "'", "²", "ſ", " e")]
    assert [x.tolist() for x in WORD_IDS.ids(texts)] == library_ids(WORD_LIBRARY, texts)
    texts = ["Слово, слово-СЛОВО! ΣΑΣ a\u0301É\u3000x \u3000 don’t İI\u0307 中文,中文", "\u0301a \u2028", "слово İ’s 12½ "]
    assert [x.tolist() for x in WORD_IDS.ids(texts)] == library_ids(WORD_LIBRARY, texts)
    texts = ["", *[w * 30 for w in ("ab", "é", "中", "<|endoftext|>")], "ab"]  # some too long to be kept
    for _ in range(2):
        assert [x.tolist() for x in WORD_IDS.ids(texts)] == library_ids(WORD_LIBRARY, texts)


def test_a_word_goes_through_the_model_once_whatever_stands_beside_it(monkeypatch):
    encoder, learned = ChunkIds(WORDS), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda units, *more: (learned.extend(units), learn(units, *more)))
    for texts in (["Stock, stock. (stock) stock's"], ["STOCK; stock-'s"]):
        assert [x.tolist() for x in encoder.ids(texts)] == library_ids(WORD_LIBRARY, texts)
    assert learned.count(b"stock") == 1


def test_ids_of_other_vocabularies_come_from_the_whole_library():
    texts = ["Two words, 12 3", "", "a\u00a0\u4e2d <|endoftext|>"]
    assert [x.tolist() for x in ChunkIds(BYTES).ids(texts)] == library_ids(Tokenizer.from_file(BYTES), texts)


def expected_files(rows):
    """Start, length and checksum per row from the library alone, in id order; rows of one id by checksum and length."""
    coded = []
    for doc_id, text in rows:
        ids = np.array([*WORD_LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        coded.append((doc_id is not None, doc_id or 0, zlib.crc32(ids.tobytes()), len(ids)))
    out, start = [], 0
    for known, doc_id, crc, n in sorted(coded):
        out.append((doc_id if known else None, start, n, crc))
        start += n
    return sorted(out, key=str)


@pytest.mark.parametrize("block,checkpoint", [(1 << 18, 1 << 16), (1 << 12, 1 << 10)])
def test_files_give_back_every_document(spark, docs, awkward, monkeypatch, tmp_path, block, checkpoint):
    rows = awkward + [(900 - n, f"row {n} <|endoftext|> says it's №{n}!" * (n % 7)) for n in range(60)] + [(950, "x" * 5000), (951, " " * 3_000_000)]
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "CHECKPOINT_IDS", checkpoint)
    found = token_file_round_trip(docs(rows), WORDS).collect()
    got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in found]
    assert sorted(got, key=str) == expected_files(rows)


def test_an_empty_table_makes_no_file(spark, docs, tmp_path):
    assert token_file_round_trip(docs([]), WORDS).count() == 0
    folder = f"file://{tmp_path}/files"
    assert write_token_files(docs([]), WORDS, folder).count() == 0
    files, path = fs.FileSystem.from_uri(folder)
    assert files.get_file_info(f"{path}/files").type == fs.FileType.NotFound
