import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisleworks.llm.graph import components
from aisleworks.llm.ngram_join import in_block_pairs, meetings, most_different, near_copies, parts_of
from aisleworks.llm.vector_dedup import near_vectors
from aisleworks.llm.vector_search import nearest_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_copies(rows):
    sets, groups = [(i, shingles(t)) for i, t in rows if i is not None], Groups()
    for k, (a, x) in enumerate(sets):
        groups.find(a)
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                groups.join(a, b)
    return sorted(((i, len(shingles(t)), None if i is None else groups.find(i)) for i, t in rows), key=str)


def varied(seed, families=12, each=10):
    """Families of texts with word changes that leave similarities on both sides of the limit, many sharing a passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 12, 30, 70, 150, 400]))]
        if rnd.random() < 0.5:
            base = passage + base
        for _ in range(each):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(text) // 25))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                text = text[: int(len(text) * 0.85)]
            out.append(" ".join(text).title() if rnd.random() < 0.2 else " ".join(text))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, docs, seed):
    rows = varied(seed)
    assert sorted(map(tuple, near_copies(docs(rows)).collect()), key=str) == brute_copies(rows)


def test_near_copies_of_awkward_rows(spark, docs, awkward):
    assert sorted(map(tuple, near_copies(docs(awkward)).collect()), key=str) == brute_copies(awkward)


def test_near_copies_of_nothing(spark, docs):
    assert near_copies(docs([])).count() == 0


def test_linked_sets_share_a_part_whatever_is_frequent():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 5, 9, 17, 40, 64, 200, 255, 256, 300, 1500):
        for _ in range(20):
            whole = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            extra = rng.integers(0, 2**63, size, dtype=np.uint64)
            change = rng.integers(0, most_different(2 * len(whole)) // 2 + 1)
            other = np.unique(np.concatenate([whole[change:], extra[:change]]))
            assert len(np.setxor1d(whole, other)) <= most_different(len(whole) + len(other))
            frequent = np.sort(rng.choice(whole, len(whole) // 2, replace=False))
            assert set(parts_of(whole, frequent)) & set(parts_of(other, frequent))
            larger = np.unique(np.concatenate([whole, extra[: most_different(2 * len(whole))]]))
            if len(larger) - len(whole) <= most_different(len(whole) + len(larger)):
                assert set(parts_of(whole, frequent)) & set(parts_of(larger, frequent))


def test_meetings_of_buckets_over_many_batches(spark):
    sizes = {1: 1, 2: 2, 3: 3, 4: 700, 5: 2, 6: 40}
    rows = [(part, c) for part, n in sizes.items() for c in range(n) for _ in range(1 + c % 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = meetings(spark.createDataFrame(rows, "part long, class long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for part, n in sizes.items():
        pairs = [(r["a"], r["b"]) for r in got if r["part"] == part and r["kind"] == 0]
        assert len({a for a, _ in pairs}) == (n > 1) and sorted({*dict(pairs), *(b for _, b in pairs)}) == (list(range(n)) if n > 1 else [])
        assert len(pairs) == n - 1
        assert sorted(r["b"] for r in got if r["part"] == part and r["kind"] == 1) == (list(range(n)) if n > 2 else [])


def test_large_buckets_are_dealt_as_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr("aisleworks.llm.ngram_join.BLOCK_CLASSES", 10)
    sizes = {1: 3, 2: 100}
    rows = spark.createDataFrame([(part, b) for part, n in sizes.items() for b in range(n)], "part long, b long")
    sums = spark.createDataFrame([(part, n, n) for part, n in sizes.items()], "part long, n long, total long")
    met, pairs = {}, {}
    for r in in_block_pairs(rows, sums).collect():
        pairs.setdefault((r["part"], r["pair"]), []).append((r["block"], r["b"]))
    assert max(map(len, pairs.values())) < 50
    for (part, _), own in pairs.items():
        several = len({block for block, _ in own}) > 1
        for x, a in own:
            for y, b in own:
                if a < b and (x != y or not several):
                    met[part, a, b] = met.get((part, a, b), 0) + 1
    assert len(met) == sum(n * (n - 1) // 2 for n in sizes.values()) and set(met.values()) == {1}


def test_near_copies_of_a_template_over_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr("aisleworks.llm.ngram_join.BLOCK_CLASSES", 4)
    rnd = random.Random(9)
    template = [f"t{k}" for k in range(60)]
    bases = [[f"v{rnd.randrange(500)}" for _ in range(50)] for _ in range(40)]
    rows = [(2 * n + k, " ".join(template + base[: len(base) - k])) for n, base in enumerate(bases) for k in range(2)]
    assert sorted(map(tuple, near_copies(docs(rows)).collect()), key=str) == brute_copies(rows)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 199)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(n, rng.standard_normal(16).tolist()) for n in range(0, 300)]
    base = rng.standard_normal(16)
    rows += [(n, (base + rng.standard_normal(16) * 0.12).tolist()) for n in range(300, 380)]
    rows += [(n, (base * 3).tolist()) for n in range(380, 400)]
    return rows + [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [float("nan")] * 16),
                   (405, [float("inf")] * 16), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, base.tolist()), (5, rows[5][1])]


def usable(vector):
    return bool(vector) and None not in vector and np.isfinite(vector).all() and np.any(vector)


VECTORS = "vec_id long, embedding array<double>, data string, rank int, block int"


def test_near_vectors_equal_brute_force(spark):
    rows = vector_rows()
    got = near_vectors(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v)]
    groups, links = Groups(), []
    for i, v in rows:
        count = -1 if i is not None and usable(v) else 0
        for j, w in good:
            if i is not None and usable(v) and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                count += 1
                groups.join(i, j)
        links.append(count)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    right = total = 0
    for (i, _), n in zip(rows, links, strict=True):
        root = None if i is None else groups.find(i)
        for n_links, component, kept in found[i]:
            assert n_links <= n and kept == (i is not None and i == component)
            right, total = right + n_links, total + n
            assert component == root
    assert right >= 0.9 * total
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest_vectors_recall_and_order(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    got = nearest_vectors(table, F.pmod("vec_id", F.lit(20)) == 0, 10).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v) and len(v) == 16]
    right = total = 0
    for q, v in good:
        if q % 20:
            continue
        exact = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:10]
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        distance = dict((i, d) for d, i in sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good))
        assert all(abs(distance[i] - d) < 1e-9 for _, d, i in mine)
        right, total = right + len({i for _, i in exact} & {m[2] for m in mine}), total + 10
    assert right >= 0.9 * total
    assert not [r for r in got if r["query_id"] in (400, 401, 402, 403, 404, 405)]
    assert nearest_vectors(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0


def test_repeated_vectors_take_no_places(spark):
    rng = np.random.default_rng(5)
    rows = [(n, rng.standard_normal(16).tolist()) for n in range(200)]
    close = min(range(1, 200), key=lambda n: np.linalg.norm(np.subtract(rows[n][1], rows[0][1])))
    rows += [rows[0]] * 30 + [rows[close]] * 30
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    got = nearest_vectors(table, F.col("vec_id") == 0, 10).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and len({r["vec_id"] for r in got}) == 10
    assert got[0]["vec_id"] == close
