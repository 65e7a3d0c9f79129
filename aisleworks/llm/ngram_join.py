"""N-gram Jaccard join by parity sketches.

Method: the distinct word shingles of a text are XOR-hashed into the parts of a parity sketch: each shingle toggles
one part, so a part's value is the parity of the shingles dealt to it, and the number of parts in which two sketches
differ is at most the size of the symmetric difference. Sets are grouped in size bands; for a band's pairs the
similarity bounds that difference by D, so of any D + 1 parts of a fixed order one must be equal (pigeonhole). Each
text gives its D + 1 parts with most shingles that are not frequent in the corpus, and texts with an equal part meet.
Pairs that meet are kept if their sizes allow and the Hamming distance of their bit sketches is within the bound, and
then verified on the whole sets.

Texts with equal sets are one class from the start. In a bucket of equal parts every class is first held against
one of them, drawn by a hash of class and part; only classes that verified links have not joined yet are then held against
each other, a large bucket's as pairs of bounded blocks in tasks of their own. So a large group of copies costs one pair per copy and part, and no link between
different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_batches, mix64, small_or_shuffled, two_columns, written
from aisleworks.llm.graph import components
from aisleworks.llm.shingles import set_fingerprint, shingle_sets

#: Two sets link when SCALE * intersection >= LEVEL * union.
LEVEL, SCALE = 80, 100
#: Shingles called frequent are in more texts than this, and than the number of all shingles over MOST_FREQUENT, which
#: bounds how many there are. They only decide the order of parts; any choice gives the same links.
LEAST_FREQUENT, MOST_FREQUENT = 100, 1_000_000
#: Times a task must see a shingle to report it, and classes of which a task remembers that it has given their parts.
LOCAL_REPEATS, REMEMBERED = 4, 200_000
#: Classes, and bytes of whole sets, of a bucket that make up a block, on average.
BLOCK_CLASSES, BLOCK_BYTES = 1024, 8 << 20

FACTS = "kind int, doc_id long, size long, class long"
PARTS = "part long, class long"
MEETINGS = "kind int, part long, a long, b long"
SETS = "class long, rep long, size long, members binary, sketch binary, lower_sketch binary"


def most_different(total: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return (SCALE - LEVEL) * total // (SCALE + LEVEL)


def band_of(size: int) -> int:
    """The band of a set: bands start at powers of four."""
    return (size.bit_length() - 1) // 2


def largest_partner(size: int) -> int:
    return SCALE * size // LEVEL


def smallest_partner(size: int) -> int:
    return -(-LEVEL * size // SCALE)


def parts_of(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The parts by which a set meets others, in its own band and, if a partner can be there, in the band below."""
    size = len(members)
    own = band_of(size)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rare = frequent[at] != members
    else:
        rare = np.ones(size, dtype=bool)
    toggles = mix64(members ^ np.uint64(0xA24BAED4963EE407))
    out = []
    for band in (own, own - 1):
        start = 4**band if band >= 0 else 0
        if band < 0 or (band < own and smallest_partner(size) >= 4 * start):
            continue
        number = start + max(2, start // 8)
        partner = largest_partner(size) if band == own else min(size, 4 * start - 1)
        needed = most_different(size + partner) + 1
        part = (members % np.uint64(number)).astype(np.int64)
        parity = np.zeros(number, dtype=np.uint64)
        np.bitwise_xor.at(parity, part, toggles)
        value = mix64(parity ^ mix64(np.arange(number, dtype=np.uint64) + np.uint64((band + 1) << 40)))
        rares = np.minimum(np.bincount(part[rare], minlength=number), 255).astype(np.uint64)
        order = ((np.uint64(255) - rares) << np.uint64(56)) | (value >> np.uint64(8))
        chosen = np.argpartition(order, needed - 1)[:needed] if needed < number else np.arange(number)
        out.append(value[chosen])
    return np.concatenate(out).view(np.int64)


def bit_sketch(members: np.ndarray, band: int) -> bytes:
    """Parities of the members over 64 bits for each 16 of the band's smallest size."""
    bits = max(64, 4 * 4 ** max(band, 0))
    count = np.bincount(((members >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def corpus_facts(docs: DataFrame) -> DataFrame:
    """Kind 0: id, set size and class of each text; kind 1: a frequent shingle (as class) with its texts in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64),) * 2
            often = counts >= LOCAL_REPEATS
            return facts_batch(1, pa.nulls(int(often.sum()), pa.int64()), counts[often], values[often].view(np.int64))

        for batch in bounded_batches(batches):
            sets = shingle_sets(batch.column(1))
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            classes = np.fromiter(map(set_fingerprint, sets), dtype=np.int64, count=len(sets))
            yield facts_batch(0, batch.column(0).cast(pa.int64()), sizes, classes)
            seen.extend(sets)
            held += int(sizes.sum())
            if held > 2_000_000:
                yield repeated()
                seen, held = [], 0
        yield repeated()

    return docs.mapInArrow(run, FACTS)


def facts_batch(kind: int, ids: pa.Array, sizes: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(ids), kind, dtype=np.int32)), ids, pa.array(sizes.astype(np.int64)), pa.array(classes)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "size", "class"])


def sketch_parts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``part, class`` rows, once per class and task where the task still remembers the class."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in bounded_batches(batches):
            parts, classes = [], []
            for members in shingle_sets(batch.column(1)):
                if not len(members) or (own := set_fingerprint(members)) in given:
                    continue
                if len(given) >= REMEMBERED:
                    given.clear()
                given.add(own)
                parts.append(parts_of(members, shared.value))
                classes.append(np.full(len(parts[-1]), own, dtype=np.int64))
            if parts:
                both = [pa.array(np.concatenate(parts)), pa.array(np.concatenate(classes))]
                yield pa.RecordBatch.from_arrays(both, names=["part", "class"])

    return docs.mapInArrow(run, PARTS)


def bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sorted batches cut so that no value of the first column lies in two of them: start of each run, columns."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(columns[0]):
            continue
        if kept is not None:
            columns = [np.concatenate(pair) for pair in zip(kept, columns, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        kept = [c[last:] for c in columns]
        if last:
            head = [c[:last] for c in columns]
            yield np.flatnonzero(np.append(True, head[0][1:] != head[0][:-1])), head
    if kept is not None:
        yield np.zeros(1, dtype=np.int64), kept


def meetings(parts: DataFrame) -> DataFrame:
    """Kind 0: pair of a bucket's drawn class ``a`` and another ``b``; kind 1: class ``b`` of a bucket of three or more.

    Buckets pass through their task as a stream sorted by the drawing's lot, of which two classes and a count are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drawn, second, last, count = None, 0, 0, 0, 0  # of the bucket that the batch before ended in
        for batch in batches:
            part, own = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.append(True, (part[1:] != part[:-1]) | (own[1:] != own[:-1]))[: len(part)]
            if len(part) and part[0] == at and own[0] == last:
                new[0] = False
            part, own = part[new], own[new]
            if not len(part):
                continue
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sizes = np.diff(np.append(starts, len(part)))
            firsts, seconds = own[starts].copy(), own[np.minimum(starts + 1, len(own) - 1)].copy()
            before = np.zeros(len(starts), dtype=np.int64)
            if part[0] == at:
                before[0], firsts[0], seconds[0] = count, drawn, second if count > 1 else own[0]
            place = np.arange(len(part)) + np.repeat(before - starts, sizes)
            centre, next_one = np.repeat(firsts, sizes), np.repeat(seconds, sizes)
            star, third, rest = place > 0, place == 2, place > 1
            kind = np.repeat(np.array([0, 1], dtype=np.int32), [star.sum(), 2 * third.sum() + rest.sum()])
            columns = [
                np.concatenate([part[star], part[third], part[third], part[rest]]),
                np.concatenate([centre[star], centre[third], centre[third], centre[rest]]),
                np.concatenate([own[star], centre[third], next_one[third], own[rest]]),
            ]
            at, drawn, second, last, count = part[-1], firsts[-1], seconds[-1], own[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], names=["kind", "part", "a", "b"])

    drawing = parts.withColumn("lot", F.xxhash64("part", "class"))
    dealt = drawing.repartition("part").sortWithinPartitions("part", "lot", "class").select("part", "class")
    return dealt.mapInArrow(run, MEETINGS)


def fetched_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole sets and bit sketches of the wanted ``doc_id, class, size`` rows."""
    lookup = small_or_shuffled(written(wanted.select(F.col("doc_id").alias("rep"), "class", "size"), "wanted"))
    texts = docs.join(lookup, docs["doc_id"] == F.col("rep")).select("class", "rep", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            own = batch.column(0).to_pylist()
            sets = shingle_sets(batch.column(3))
            # an id may have several texts: only the one of the wanted class counts
            right = [i for i, members in enumerate(sets) if set_fingerprint(members) == own[i]]
            bands = [band_of(len(sets[i])) for i in right]
            columns = [batch.column(i).take(pa.array(right, pa.int64())) for i in range(3)]
            columns.append(pa.array([sets[i].tobytes() for i in right], pa.binary()))
            for lower in (0, 1):
                sketches = [bit_sketch(sets[i], band - lower) for i, band in zip(right, bands, strict=True)]
                columns.append(pa.array(sketches, pa.binary()))
            names = ["class", "rep", "size", "members", "sketch", "lower_sketch"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return written(texts.mapInArrow(run, SETS).dropDuplicates(["class"]), "sets")


def sketch_distance(size_a: int, sketches_a: tuple, size_b: int, sketches_b: tuple) -> int:
    """Hamming distance of two sets' bit sketches in the band of the smaller set (0 where bands are too far apart)."""
    low = min(band_of(size_a), band_of(size_b))
    steps = band_of(size_a) - low, band_of(size_b) - low
    if max(steps) > 1:
        return 0
    first = np.frombuffer(sketches_a[steps[0]], dtype=np.uint8)
    second = np.frombuffer(sketches_b[steps[1]], dtype=np.uint8)
    return int(np.bitwise_count(first ^ second).sum())


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes that sizes and bit sketches allow, with the classes' representatives as ``rep_a, rep_b``."""
    light = sets.select("class", "rep", "size", "sketch", "lower_sketch")
    for side in ("a", "b"):
        named = light.select(*[F.col(c).alias(f"{c}_{side}") for c in light.columns])
        pairs = pairs.join(named, F.col(side) == F.col(f"class_{side}"))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    fitting = pairs.where(SCALE * small >= LEVEL * large)
    columns = ["a", "b", "rep_a", "rep_b", "shared", "size_a", "size_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            keep = [
                sketch_distance(sa, (ka, la), sb, (kb, lb)) <= most_different(sa + sb)
                for sa, sb, ka, la, kb, lb in zip(
                    *(rows[c] for c in ("size_a", "size_b", "sketch_a", "lower_sketch_a", "sketch_b", "lower_sketch_b")),
                    strict=True,
                )
            ]
            yield batch.select(columns[:5]).filter(pa.array(keep, pa.bool_()))

    sketches = ["sketch_a", "lower_sketch_a", "sketch_b", "lower_sketch_b"]
    return fitting.select(*columns, *sketches).mapInArrow(run, "a long, b long, rep_a long, rep_b long, shared long")


def sets_link(first: bytes | pa.Buffer, second: bytes | pa.Buffer) -> bool:
    x, y = np.frombuffer(first, dtype=np.uint64), np.frombuffer(second, dtype=np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return SCALE * common >= LEVEL * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` representatives of those pairs whose whole sets link."""
    for side in ("a", "b"):
        named = sets.select(F.col("class").alias(f"of_{side}"), F.col("members").alias(f"members_{side}"))
        pairs = pairs.join(named, F.col(side) == F.col(f"of_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            keep = []
            for first, second in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(sets_link(first.as_buffer(), second.as_buffer()))
            yield batch.select(["rep_a", "rep_b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    chosen = pairs.select("rep_a", "rep_b", "members_a", "members_b")
    return written(chosen.mapInArrow(run, "a long, b long"), "verified")


def unjoined(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose representatives are not in one component yet."""
    for side in ("a", "b"):
        named = joined.select(F.col("node").alias(f"node_{side}"), F.col("component").alias(f"component_{side}"))
        pairs = pairs.join(named, F.col(f"rep_{side}") == F.col(f"node_{side}"), "left")
    differ = F.coalesce("component_a", "rep_a") != F.coalesce("component_b", "rep_b")
    return pairs.where(differ).select("a", "b", "rep_a", "rep_b", "shared")


def in_block_pairs(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """``part, b, ..`` rows with ``pair, block``: a bucket's classes are dealt to blocks, and blocks to all pairs of them.

    ``sums`` has for each part its number of classes ``n`` and the ``total`` of their sizes. Any two classes of a bucket meet
    in one pair of different blocks, or in the pair of their common block with itself.
    """
    fit = F.greatest(F.col("n") / BLOCK_CLASSES, F.col("total") * 8 / BLOCK_BYTES)
    number = sums.select(F.col("part").alias("of_part"), F.ceil(fit).cast("int").alias("blocks"))
    dealt = rows.join(number, rows["part"] == F.col("of_part")).drop("of_part")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "part", "b"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.withColumn("pair", pair).drop("blocks", "other")


def to_compare(blocks: np.ndarray) -> list[tuple[int, int]]:
    """Positions of a pair of blocks with the first of the later positions that each is compared with."""
    second = int(np.searchsorted(blocks, blocks[0], side="right"))
    return [(i, second if second < len(blocks) else i + 1) for i in range(second)]


def possible_partners(i: int, first: int, labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Positions from ``first`` on of other groups whose sizes and bit sketches allow a link with position ``i``."""
    others = np.flatnonzero(labels[first:] != labels[i]) + first
    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    others = others[SCALE * small >= LEVEL * large]
    distance = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
    return others[distance <= (SCALE - LEVEL) * (sizes[others] + sizes[i]) // (SCALE + LEVEL)]


def band_sketches(sizes: np.ndarray, sketches: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The bit sketches of a bucket's classes in its lowest band, as rows of bytes."""
    bands = [band_of(int(n)) for n in sizes]
    low = min(bands)
    own = [(sketches if band == low else lower)[k] for k, band in enumerate(bands)]
    return np.frombuffer(b"".join(own), dtype=np.uint8).reshape(len(own), -1)


def contested(rows: DataFrame) -> DataFrame:
    """``part, b`` of the classes that sizes and bit sketches allow to link with one of another component in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, block, part, own, component, size, sketch, lower) in bucket_runs(batches):
            marked = np.zeros(len(part), dtype=bool)
            for start, end in zip(starts, np.append(starts[1:], len(part)), strict=True):
                table = band_sketches(size[start:end], sketch[start:end], lower[start:end])
                for i, first in to_compare(block[start:end]):
                    others = possible_partners(i, first, component[start:end], size[start:end], table)
                    if len(others):
                        marked[start + i] = True
                        marked[start + others] = True
            yield pa.RecordBatch.from_arrays([pa.array(part[marked]), pa.array(own[marked])], names=["part", "b"])

    light = rows.select("pair", "block", "part", "b", "component", "size", "sketch", "lower_sketch")
    dealt = light.repartition("pair").sortWithinPartitions("pair", "block", "b")
    return dealt.mapInArrow(run, "part long, b long").distinct()


def linked_in_blocks(
    blocks: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, members: np.ndarray
) -> list[tuple[int, int]]:
    """Positions of verified pairs that join the groups of a pair of blocks, at most one fewer than there are groups.

    Groups that a link joins need no more pairs between them.
    """
    labels = labels.copy()
    out = []
    for i, first in to_compare(blocks):
        for j in possible_partners(i, first, labels, sizes, sketches).tolist():
            if labels[j] != labels[i] and sets_link(members[i], members[j]):
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def links_within_buckets(buckets: DataFrame, sets: DataFrame, joined: DataFrame) -> DataFrame:
    """Verified ``a, b`` representatives that join classes of a bucket which are not in one component yet.

    Sketches go to buckets that still have several components; whole sets only to their contested classes. No task holds
    more of a bucket than two blocks.
    """
    of_class = sets.select("class", "rep", "size").join(joined, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("class", "rep", "size", F.coalesce("component", "rep").alias("component"))
    placed = written(of_class, "placed")
    sums = (F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    rows = buckets.join(placed, buckets["b"] == placed["class"]).select("part", "b", "component", "size")
    open_parts = (
        rows.groupBy("part")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), *sums)
        .where("low <> high")
    )
    rows = in_block_pairs(rows.drop("size"), open_parts)
    sketches = sets.select(F.col("class").alias("of"), "size", "sketch", "lower_sketch")
    left = written(contested(rows.join(sketches, F.col("b") == F.col("of"))), "contested")
    rows = left.join(placed, left["b"] == placed["class"]).select("part", "b", "component", "size")
    rows = in_block_pairs(rows.drop("size"), rows.groupBy("part").agg(*sums))
    rows = rows.join(sets, F.col("b") == sets["class"])
    rows = rows.select("pair", "block", "component", "rep", "size", "members", "sketch", "lower_sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, block, component, rep, size, members, sketch, lower) in bucket_runs(batches):
            found: set[tuple[int, int]] = set()
            for start, end in zip(starts, np.append(starts[1:], len(rep)), strict=True):
                table = band_sketches(size[start:end], sketch[start:end], lower[start:end])
                pairs = linked_in_blocks(block[start:end], component[start:end], size[start:end], table, members[start:end])
                found.update((int(rep[start + i]), int(rep[start + j])) for i, j in pairs)
            columns = [pa.array([pair[k] for pair in sorted(found)], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    dealt = rows.repartition("pair").sortWithinPartitions("pair", "block", "rep")
    return written(dealt.mapInArrow(run, "a long, b long").distinct(), "bucket-links")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id`` (smallest id reachable by links, itself included).

    A text of fewer than five words has its whole sequence as its one shingle; a null or empty text has none and
    links with nothing. Rows with equal ids are one node with the links of all their texts. A row with a null id
    links with nothing and has a null component. An empty table gives no row. Other columns are not read.
    """
    texts = two_columns(docs, id_column, text_column)
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    all_facts = written(corpus_facts(texts), "facts")
    facts = all_facts.where("kind = 0").drop("kind")
    total = facts.agg(F.sum("size")).first()[0] or 0
    bound = max(LEAST_FREQUENT, total // MOST_FREQUENT)
    counted = all_facts.where("kind = 1").groupBy("class").agg(F.sum("size").alias("n")).where(F.col("n") > bound)
    frequent = np.sort(np.array([r[0] for r in counted.select("class").collect()], dtype=np.int64).view(np.uint64))

    known = facts.where("size > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"))
    named = texts.where("doc_id IS NOT NULL")
    met = written(meetings(sketch_parts(named, frequent)), "meetings")
    stars = met.where("kind = 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    candidates = met.select(F.col("b").alias("candidate")).union(met.where("kind = 0").select("a")).distinct()
    wanted = classes.join(candidates, classes["class"] == candidates["candidate"], "left_semi")
    sets = fetched_sets(named, wanted.select(F.col("rep").alias("doc_id"), "class", "size"))

    # ids with several texts join the classes of those texts
    several = known.groupBy("doc_id").agg(F.count_distinct("class").alias("n")).where("n > 1").select("doc_id")
    of_class = classes.select(F.col("class").alias("c"), "rep")
    tied = known.join(several, "doc_id").join(of_class, F.col("class") == F.col("c"))
    links = written(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "tied")

    pairs = written(possible(stars, sets), "pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("best"))
    marked = pairs.join(best.withColumnRenamed("b", "best_b"), F.col("b") == F.col("best_b"))
    links = links.union(verified(marked.where("a = best").drop("best", "best_b"), sets))
    joined = components(links)
    links = links.union(verified(unjoined(marked.where("a <> best").drop("best", "best_b"), joined), sets))
    joined = components(links)
    links = links.union(links_within_buckets(met.where("kind = 1").select("part", "b"), sets, joined))
    joined = components(links)

    # every id stands with its class's representative, which stands with its component
    placed = facts.join(of_class, (F.col("class") == F.col("c")) & (F.col("size") > 0), "left")
    roots = joined.select(F.col("node").alias("root_node"), F.col("component").alias("root"))
    placed = placed.join(roots, F.coalesce("rep", "doc_id") == F.col("root_node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return placed.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
