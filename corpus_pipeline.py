"""A training corpus from documents: language, toxicity, near copies, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks.llm.common import delete_folder, run_folder, ship_package, small_or_shuffled, table, temporary_tables, written
from aisleworks.llm.language_id import identify
from aisleworks.llm.mixing import mix_sources
from aisleworks.llm.ngram_join import near_copies
from aisleworks.llm.packing import pack
from aisleworks.llm.toxicity import toxicity

#: No SQL: language models, a trained classifier and tokenizers take part. Tests check what each stage drops and keeps.
ORACLE_SQL = None


#: Names for what a stage adds while it works; a document's columns are put aside in one column of that kind.
ROW, KEY, LISTED = "_pipeline_row", "_pipeline_key", "_pipeline_listed"


def keyed(docs: DataFrame) -> DataFrame:
    """Each document as one value, with its id, text and a hash of both: what a stage decides by text is the same for equal keys.

    No other name is left in the frame, so none of the documents' columns can clash with those of a stage.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW),
        "doc_id",
        "text",
        *([F.col("lang")] if "lang" in docs.columns else []),
        *([F.col("source")] if "source" in docs.columns else []),
        F.xxhash64("doc_id", "text").alias(KEY),
    )


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among ``keys``; null keys take nothing away."""
    listed = small_or_shuffled(written(keys.toDF(LISTED).where(F.col(LISTED).isNotNull()).distinct(), "gone"))
    return rows.join(listed, F.col(column) == F.col(LISTED), "left_anti")


def documents(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def language_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops texts without letters and texts that no learnt language accounts for.

    Null, empty and letterless texts go; rows that are equal in id and text share their fate; texts of any length count whole.
    An empty table stays empty. Columns of any name are returned as they came.
    """
    rows = keyed(docs)
    found = identify(rows, F.lit(True), id_column=KEY)
    return documents(without(rows, found.where("rejected").select("doc_id"), KEY))


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops texts that score as toxic.

    A null or empty text scores as one without listed words; rows that are equal in id and text share their fate; texts of
    any length count whole. Without labels nothing goes. Columns of any name are returned as they came.
    """
    rows = keyed(docs)
    found = toxicity(rows, table(spark, folder, "labels"), result_column=KEY)
    return documents(without(rows, found.where("predicted = 1").select("doc_id"), KEY))


def near_copy_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of rows with equal ids the one with the smallest key.

    Rows with a null id have no group and stay. Columns of any name are returned as they came.
    """
    rows = keyed(docs)
    copies = near_copies(rows.select("doc_id", "text"))
    kept = without(rows, copies.where("doc_id <> component_id").select("doc_id"), "doc_id")
    counted = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias(KEY)).where(F.col(KEY) > 1)
    repeated = written(counted.select("doc_id"), "repeated")
    once = without(kept, repeated, "doc_id")
    several = kept.join(small_or_shuffled(repeated.toDF(LISTED)), F.col("doc_id") == F.col(LISTED), "left_semi")
    first = several.groupBy("doc_id").agg(F.min_by(ROW, KEY).alias(ROW))
    return documents(once.select(ROW).unionByName(first.select(ROW)))


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents (the one at a source's cut if half of it is taken).

    Documents without words are not in the mix. Columns of any name are returned as they came.
    """
    rows = keyed(docs)
    taken = mix_sources(rows, id_column=KEY)
    share = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)
    times = taken.groupBy(F.col("doc_id").alias(LISTED)).agg(F.round(F.avg(share)).cast("int").alias("times"))
    times = small_or_shuffled(written(times.where("times > 0"), "times"))
    repeated = rows.join(times, F.col(KEY) == F.col(LISTED))
    return documents(repeated.select(ROW, F.explode(F.sequence(F.lit(1), F.col("times")))))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packed pieces of every document that the mix repeats or takes once; other columns are not read.

    A null or empty text would be the end id alone; texts of any length are cut.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language id", language_stage),
    ("toxicity", toxicity_stage),
    ("near copies", near_copy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next.

    What a stage wrote besides goes when its rows are written, and these go when the next stage's are.
    """
    ship_package(spark)
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        place = run_folder(spark, name.replace(" ", "-"))
        with temporary_tables(spark):
            docs = written(stage(spark, docs, folder), name, place)
        if before is not None:
            delete_folder(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, folder)
