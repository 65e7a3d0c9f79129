from pathlib import Path

import corpus_pipeline
from aisleworks.llm.common import temporary_tables
from aisleworks.session import shared_folder
from tests.llm.test_classifiers import LABELS, labelled


def test_stages_keep_columns_and_take_effect(spark, docs, awkward, tmp_path):
    rows, labels = labelled(docs, spark, ["idiot", "moron", "trash", "scumbag"])
    rows = [(n, t, "en", "abc"[n % 3]) for n, t in rows]
    extra = [(None if i is None else 1000 + i, t, "en", None) for i, t in awkward]
    copies = [(2000 + n, rows[n][1] + " end", "en", "copy") for n in (1, 2, 3)]
    folder = str(tmp_path)
    docs(rows + extra + copies).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = at.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, folder).write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        assert at.columns == columns
        kept[name] = sorted((r["doc_id"], r["text"]) for r in at.select("doc_id", "text").where("doc_id IS NOT NULL").collect())
    ids = {name: {i for i, _ in got} for name, got in kept.items()}
    assert not ids["language id"] & {1001, 1002, 1003, 1009} and ids["language id"] >= set(range(400)) | {2001, 2002, 2003}
    toxic = {n for n, _, t in labels if t}
    assert len(ids["toxicity"] & toxic) <= 2 and ids["toxicity"] >= set(range(400)) - toxic
    assert not ids["near copies"] & {2001, 2002, 2003, 1005, 1006} and {1, 2, 3, 1004} <= ids["near copies"]
    assert len(kept["near copies"]) == len(ids["near copies"])
    texts = dict(kept["near copies"])
    assert all(texts[i] == t for i, t in kept["mixing"])
    packed = corpus_pipeline.STAGES[-1][1](spark, at, folder).collect()
    assert {r["doc_id"] for r in packed if r["doc_id"] is not None} == ids["mixing"]


def test_columns_of_any_name_come_through_as_they_were(spark, awkward, tmp_path):
    names = ["row_key", "key", "time", "times", "gone", "again", "listed", "y", "of", "hash", "size", "taken", "part", "of row"]
    base = [(i, t, "en", "abc"[n % 3], 1) for n, (i, t) in enumerate(awkward)]
    more = [(2000 + n, " ".join(f"word{(n * 7 + k) % 50}" for k in range(30)), "en", "s", 1) for n in range(40)]
    docs = [(*r, *[f"{c} of {r[0]}" for c in names]) for r in base + more]
    shape = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in names)
    spark.createDataFrame(docs, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept = at.collect()
        assert kept and all(r[c] == f"{c} of {r['doc_id']}" for r in kept for c in names)


def test_stages_leave_nothing_but_their_documents(spark, docs, awkward, tmp_path):
    docs([(i, t, "en", "s") for i, t in awkward]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    with temporary_tables(spark):
        corpus_pipeline.run(spark, str(tmp_path)).write.parquet(f"{tmp_path}/packed")
        left = {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before}
        assert left == {"mixing", "pieces"}  # what the last stage reads and what it wrote
    assert set(shared.iterdir()) == before and spark.read.parquet(f"{tmp_path}/packed").count() > 0


def test_an_empty_table_passes_all_stages(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
