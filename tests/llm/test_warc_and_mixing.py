import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from aisleworks.llm.mixing import mix_sources, source_targets
from aisleworks.llm.warc import BundleReader, BundleWriter, archive_round_trip, make_record, parse_record, read_archives

PAGES = "page_id long, url string, html string, digest string, refers_to long"


def test_round_trip_with_awkward_rows(spark):
    big, other = "é" * 600, "b" * 999
    rows = [(1, "http://a", big), (2, None, big), (3, "http://x\r\ny: z", big), (4, "u", other), (5, "u", other), (6, "u", None),
            (7, "u", ""), (None, "u", big), (3, "again", big), (8, "u", "WARC/1.1\r\n\r\n" * 100), (9, "u", "c" * 1000)]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], PAGES).repartition(3)
    got = sorted(map(tuple, archive_round_trip(pages).collect()), key=str)
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page_id != 3
        expected.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(expected, key=str)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_urls_of_any_length(spark):
    pages = spark.createDataFrame([(n, "http://é/" + "u" * size, "x", "d", 1) for n, size in enumerate((10, 65_000, 70_000, 200_000))], PAGES)
    assert {r["page_id"]: r["payload_bytes"] for r in archive_round_trip(pages).collect()} == dict.fromkeys(range(4), 1)


def test_a_head_without_end_is_noticed():
    with pytest.raises(ValueError):
        parse_record(memoryview(b"WARC/1.1\r\n" + b"x" * 300_000), 0)


def test_index_reads_single_records(spark, tmp_path):
    folder = f"file://{tmp_path}"
    writer = BundleWriter(f"{folder}/bundles", "000000-1")
    for n in range(500):
        writer.add(n, make_record(n, f"http://{n}", b"x" * (n * 7), "0" * 40, None))
    writer.close()
    index = spark.createDataFrame(writer.taken_places().to_pylist(), "page_id long, bundle string, frame int, position int")
    assert index.agg(F.max("frame")).first()[0] > 1
    few = read_archives(index.where("page_id % 97 = 5"), folder)
    assert {r["page_id"]: len(r["payload"]) for r in few.collect()} == {n: n * 7 for n in range(5, 500, 97)}


def test_bundle_is_plain_zstandard_with_a_seek_table(tmp_path):
    writer = BundleWriter(f"file://{tmp_path}", "b")
    records = [make_record(n, None, bytes([n]) * 50_000, "d", None) for n in range(20)]
    for n, record in enumerate(records):
        writer.add(n, record)
    writer.close()
    data = (tmp_path / "b-00000.warc.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(records)
    reader = BundleReader(f"file://{tmp_path}")
    _, bundle, frame, position = writer.places[7]
    fields, payload = parse_record(reader.frame(bundle, frame), position)
    assert fields["WARC-Record-ID"] == "<urn:x-page:7>" and payload == bytes([7]) * 50_000


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeating the sharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        whole = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole > most * sizes[s]]
        if not over:
            return capped | {s: rest * weight[s] / whole for s in free}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 100, "b": 100, "c": 100, None: 100}, {"z": 7}, {"a": 0, "b": 9, "c": 0, "d": 400, None: 1},
    {f"s{k:02}": (k * 37) % 101 for k in range(40)},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(table, (5, 2, 1), 3).collect()}
    expected = shares(sizes)
    assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-6 for s in got)


def test_mix_meets_targets_and_agrees_with_itself(spark, docs, awkward):
    rows = [(*r, "en", s) for r, s in zip(awkward, ["b", "a", None] * 9)]
    rows += [(100 + n, "w " * (n % 40 + 1), "en", "hot" if n % 3 else "c") for n in range(600)]
    first = mix_sources(docs(rows))
    got = sorted(map(tuple, first.collect()), key=str)
    assert got == sorted(map(tuple, mix_sources(docs(rows[::-1])).collect()), key=str) and len(got) == len(rows)
    targets = {}
    for _, size, source_size, target, taken in got:
        assert 0 <= taken <= 3 * size
        targets.setdefault((source_size, target), []).append(taken)
    for (source_size, target), taken in targets.items():
        assert abs(sum(taken) - target) <= 0.5 + 1e-6, (source_size, target)
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {0}
    assert mix_sources(docs([])).count() == 0
