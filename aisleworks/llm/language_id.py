"""Language identification by interpolated Kneser-Ney character models.

Method: words of the learning texts are padded with start symbols and an end symbol, and n-grams of the full order are
counted per language over all of them; lower orders follow as continuation counts. A language's model is a pair of
sorted hash arrays for every order (interpolated probabilities of n-grams, back-off weights of contexts), looked up
by binary search. Models too large to broadcast are estimated and kept as tables over all n-grams, with which the distinct
n-grams of the texts are joined order by order. A text gets the language with the lowest cross-entropy per predicted symbol.

Scores and rejection are calibrated on all learning texts: one temperature turns cross-entropies into probabilities,
and a text is rejected if its best cross-entropy is nearer to that of chance (all symbols of the language alike)
than to the bulk of that language's learning texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import bounded_batches, mix64, texts_of, written

ORDER = 5
START, END = 1, 2
UNDETERMINED = "und"
#: n-grams of the full order up to which models are broadcast, of a language and of all; with more, all models stay tables
#: and are joined.
MOST_GRAMS, MOST_IN_ALL = 2_000_000, 8_000_000
#: Distinct chunks a learning task holds before it emits counts, and chunks whose scores a worker keeps.
HELD_CHUNKS, KEPT_CHUNKS = 400_000, 400_000
#: Characters of kept chunks in all, after which they are forgotten too.
KEPT_CHARACTERS_IN_ALL = 16 << 20
#: Chunks whose symbols are laid out in arrays at once.
SLICE = 25_000
#: Quantile of the learning texts' cross-entropy that counts as their bulk.
BULK = 0.999
TEMPERATURES = tuple(2.0**k for k in range(8))

SYMBOLS = [f"s{k}" for k in range(ORDER)]
_PLACE = mix64(np.arange(101, 101 + ORDER, dtype=np.uint64)) | np.uint64(1)
_ALPHA: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _ALPHA[0]


def predicted_symbols(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every letter and word end of the lower-cased chunks: the last ``ORDER`` symbols (rows), and its chunk."""
    code = np.frombuffer("\n".join(c.lower() for c in chunks).encode("utf-32-le"), dtype=np.uint32)
    inside = letters_table()[code]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64)
    begins = np.append(True, np.diff(at) != 1)
    word = np.cumsum(begins) - 1
    words = int(word[-1]) + 1
    padded = np.full(len(at) + words * ORDER, START, dtype=np.uint32)
    place = np.arange(len(at)) + ORDER - 1 + ORDER * word
    last = np.append(np.flatnonzero(begins)[1:] - 1, len(at) - 1)
    ends = place[last] + 1
    padded[place] = code[at]
    padded[ends] = END
    chunk = np.cumsum(code == 10)[at]
    predicted = np.concatenate([place, ends])
    rows = np.stack([padded[predicted - ORDER + 1 + k] for k in range(ORDER)], axis=1)
    return rows, np.concatenate([chunk, chunk[last]])


def gram_keys(symbols: np.ndarray, order: int, skip: int = 0) -> np.ndarray:
    """Hashes of the last ``order`` symbols of each row, after leaving out ``skip`` at the end."""
    total = np.zeros(len(symbols), dtype=np.uint64)
    for k in range(order):
        total += symbols[:, symbols.shape[1] - 1 - skip - k].astype(np.uint64) * _PLACE[k]
    return mix64(total + np.uint64(order))


def summed(symbols: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of symbols with the sums of their numbers."""
    _, first, inverse = np.unique(gram_keys(symbols, ORDER), return_index=True, return_inverse=True)
    return symbols[first], np.bincount(inverse, weights=numbers, minlength=len(first)).astype(np.int64)


def gram_counts(texts: DataFrame) -> DataFrame:
    """``lang, s0.., n``: counts of full-order n-grams over all rows of ``lang, text``."""

    def emitted(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            chunks, numbers = list(counter), np.fromiter(counter.values(), dtype=np.int64, count=len(counter))
            found = []
            for start in range(0, len(chunks), SLICE):
                symbols, chunk = predicted_symbols(chunks[start : start + SLICE])
                found.append(summed(symbols, numbers[start + chunk]))
            if not found:
                continue
            grams, sums = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            grams = grams.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(sums), pa.string())] + [pa.array(grams[:, k]) for k in range(ORDER)] + [pa.array(sums)],
                names=["lang", *SYMBOLS, "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in bounded_batches(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                held.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, held.values())) > HELD_CHUNKS:
                yield from emitted(held)
                held = {}
        yield from emitted(held)

    schema = ", ".join(["lang string", *(f"{s} int" for s in SYMBOLS), "n long"])
    return texts.mapInArrow(run, schema).groupBy("lang", *SYMBOLS).agg(F.sum("n").alias("n"))


def discount_of(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def kneser_ney(symbols: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted arrays of a model from the distinct full-order n-grams and their counts.

    ``k{order}``, ``p{order}``: n-gram hashes and log probabilities; ``c{order}``, ``g{order}``: hashes of the contexts
    of that order's n-grams and logs of the weight their lower order gets. ``floor``: log probability of an unseen symbol.
    """
    levels = {ORDER: (symbols, counts.astype(np.float64))}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before each n-gram
        grams = levels[order + 1][0][:, 1:]
        _, first, inverse = np.unique(gram_keys(grams, order), return_index=True, return_inverse=True)
        levels[order] = grams[first], np.bincount(inverse, minlength=len(first)).astype(np.float64)
    model: dict[str, np.ndarray] = {}
    alphabet = len(levels[1][0]) + 1
    lower = np.full(len(levels[1][0]), 1.0 / alphabet)
    for order in range(1, ORDER + 1):
        grams, number = levels[order]
        discount = discount_of(float((number == 1).sum()), float((number == 2).sum()))
        if order > 1:
            below = gram_keys(grams, order - 1)
            lower = np.exp(model[f"p{order - 1}"][np.searchsorted(model[f"k{order - 1}"], below)])
        context = gram_keys(grams, order - 1, skip=1)
        known, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=number)
        kinds = np.bincount(inverse)
        weight = discount * kinds / total
        probability = (number - discount) / total[inverse] + weight[inverse] * lower
        keys = gram_keys(grams, order)
        by_key = np.argsort(keys)
        model[f"k{order}"], model[f"p{order}"] = keys[by_key], np.log(probability)[by_key]
        model[f"c{order}"], model[f"g{order}"] = known, np.log(weight)
        if order == 1:
            model["floor"] = np.log(weight / alphabet)
    return model


def trained_models(counts: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """A model per language. A language's n-grams (``MOST_GRAMS`` at most) are turned into arrays in one task."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        symbols = frame[SYMBOLS].to_numpy().astype(np.uint32)
        order = np.lexsort(symbols.T)
        model = kneser_ney(symbols[order], frame["n"].to_numpy()[order])
        rows = [(frame["lang"].iloc[0], name, values.tobytes()) for name, values in model.items()]
        return pd.DataFrame(rows, columns=["lang", "name", "data"])

    models: dict[str, dict[str, np.ndarray]] = {}
    for row in counts.groupBy("lang").applyInPandas(build, "lang string, name string, data binary").collect():
        kind = np.uint64 if row["name"][0] in "kc" else np.float64
        models.setdefault(row["lang"], {})[row["name"]] = np.frombuffer(row["data"], dtype=kind)
    return dict(sorted(models.items()))


class ModelTables:
    """Kneser-Ney models over all n-grams as tables of each order, for models that are too large for a broadcast.

    ``probabilities[order]``: ``lang``, the order's symbols, ``value``; ``weights[order]``: ``lang``, the symbols of the
    context, ``value`` (both logs). ``floors``, ``alphabets``: numbers of each language. A join's key has at most as many
    rows as there are symbols and languages.
    """

    def __init__(self, counts: DataFrame):
        levels = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before each n-gram
            grams = levels[order + 1].groupBy("lang", *SYMBOLS[ORDER - order :]).agg(F.count(F.lit(1)).alias("n"))
            levels[order] = written(grams, "lower-grams")
        self.floors: dict[str, float] = {}
        self.alphabets: dict[str, int] = {}
        self.probabilities: dict[int, DataFrame] = {}
        self.weights: dict[int, DataFrame] = {}
        for order in range(1, ORDER + 1):
            own, grams = SYMBOLS[ORDER - order :], levels[order]
            facts = grams.groupBy("lang").agg(
                F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count(F.lit(1)).alias("kinds")
            )
            # one row per learnt language
            discounts = []
            for r in facts.collect():
                discounts.append((r["lang"], discount_of(r["once"], r["twice"])))
                if order == 1:
                    self.alphabets[r["lang"]] = r["kinds"]
            given = F.broadcast(counts.sparkSession.createDataFrame(discounts, "lang string, discount double"))
            context = ["lang", *own[:-1]]
            totals = grams.groupBy(*context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(given, "lang")
            totals = totals.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total"))
            self.weights[order] = written(totals.select(*context, F.log("weight").alias("value")), "weights")
            rows = grams.join(totals.drop("kinds"), context)
            if order == 1:
                for r in self.weights[1].collect():
                    self.floors[r["lang"]] = r["value"] - math.log(self.alphabets[r["lang"]] + 1)
                below = [(lang, 1.0 / (n + 1)) for lang, n in self.alphabets.items()]
                rows = rows.join(F.broadcast(counts.sparkSession.createDataFrame(below, "lang string, below double")), "lang")
            else:
                lower = self.probabilities[order - 1].withColumn("below", F.exp("value")).drop("value")
                rows = rows.join(lower, ["lang", *own[1:]])
            value = F.log((F.col("n") - F.col("discount")) / F.col("total") + F.col("weight") * F.col("below"))
            self.probabilities[order] = written(rows.select("lang", *own, value.alias("value")), "probabilities")
        self.alphabets = dict(sorted(self.alphabets.items()))

    def gram_scores(self, asked: DataFrame) -> DataFrame:
        """``s0.., values``: natural log of each distinct asked n-gram's last symbol under each language."""

        def by_lang(table: DataFrame, symbols: list[str], name: str) -> DataFrame:
            return table.groupBy(*symbols).agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias(name))

        asked = written(asked.select(*SYMBOLS).distinct(), "asked")
        scores = None
        for order in range(1, ORDER + 1):
            own = SYMBOLS[ORDER - order :]
            rows = asked.select(*own).distinct().join(by_lang(self.probabilities[order], own, "p"), own, "left")
            if scores is not None:
                rows = rows.join(by_lang(self.weights[order], own[:-1], "g"), own[:-1], "left").join(scores, own[1:])
            values = []
            for k, lang in enumerate(self.alphabets):
                if scores is None:
                    lower = F.lit(self.floors[lang])
                else:
                    lower = F.col("values")[k] + F.coalesce(F.try_element_at("g", F.lit(lang)), F.lit(0.0))
                values.append(F.coalesce(F.try_element_at("p", F.lit(lang)), lower))
            scores = written(rows.select(*own, F.array(*values).alias("values")), "gram-scores")
        return scores


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(symbols: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log of each row's last symbol after the symbols before it."""
    out = np.full(len(symbols), model["floor"][0])
    for order in range(1, ORDER + 1):
        if order > 1:
            at, seen = found(model[f"c{order}"], gram_keys(symbols, order - 1, skip=1))
            out[seen] += model[f"g{order}"][at[seen]]
        at, seen = found(model[f"k{order}"], gram_keys(symbols, order))
        out[seen] = model[f"p{order}"][at[seen]]
    return out


class ChunkScorer:
    """Summed log probabilities of chunks under all models, and their numbers of symbols, kept in a bounded table."""

    def __init__(self, models: list[dict[str, np.ndarray]]):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.characters = 0
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(self.models) + 1))

    def _learn(self, chunks: list[str]) -> None:
        symbols, owner = predicted_symbols(chunks)
        new = np.zeros((len(chunks), len(self.models) + 1))
        if len(symbols):
            _, first, inverse = np.unique(gram_keys(symbols, ORDER), return_index=True, return_inverse=True)
            for k, model in enumerate(self.models):
                values = log_probabilities(symbols[first], model)[inverse]
                new[:, k] = np.bincount(owner, weights=values, minlength=len(chunks))
            new[:, -1] = np.bincount(owner, minlength=len(chunks))
        self.characters += sum(map(len, chunks))
        self.place.update(zip(chunks, range(len(self.table), len(self.table) + len(chunks)), strict=True))
        self.table = np.concatenate([self.table, new])

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Per text the cross-entropy under each model, and the number of symbols in the last column."""
        cut = [text.split() for text in texts]
        if len(self.place) > KEPT_CHUNKS or self.characters > KEPT_CHARACTERS_IN_ALL:
            self.clear()
        new = list(set().union(*cut) - self.place.keys())
        for start in range(0, len(new), SLICE):
            self._learn(new[start : start + SLICE])
        look = self.place.__getitem__
        out = np.zeros((len(texts), len(self.models) + 1))
        for row, chunks in enumerate(cut):
            if chunks:
                out[row] = self.table[list(map(look, chunks))].sum(axis=0)
        out[:, :-1] /= -np.maximum(out[:, -1:], 1)
        return out


def scored(texts: DataFrame, models: dict[str, dict[str, np.ndarray]]) -> DataFrame:
    """``doc_id, lang, learns, best, entropies, symbols`` of ``doc_id, text, lang, learns`` rows."""
    langs = list(models)
    shared = texts.sparkSession.sparkContext.broadcast(list(models.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ChunkScorer(shared.value)
        for batch in bounded_batches(batches, 2 << 20):
            values = scorer.entropies(texts_of(batch.column(1)))
            symbols = values[:, -1].astype(np.int64)
            lowest = values[:, :-1].argmin(axis=1) if langs else symbols
            best = [langs[k] if n and langs else None for k, n in zip(lowest, symbols, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array(best, pa.string()),
                    pa.array(list(values[:, :-1]), pa.list_(pa.float64())),
                    pa.array(symbols),
                ],
                names=["doc_id", "lang", "learns", "best", "entropies", "symbols"],
            )

    schema = "doc_id long, lang string, learns boolean, best string, entropies array<double>, symbols long"
    return texts.mapInArrow(run, schema)


def text_chunks(texts: DataFrame) -> DataFrame:
    """``key, chunk, times`` of ``key, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            counted = [Counter(text.split()) for text in texts_of(batch.column(1))]
            keys = np.repeat(batch.column(0).to_numpy(), [len(c) for c in counted])
            chunks = pa.array([chunk for c in counted for chunk in c], pa.string())
            times = pa.array([n for c in counted for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), chunks, times], names=["key", "chunk", "times"])

    return texts.mapInArrow(run, "key long, chunk string, times long")


def chunk_grams(chunks: DataFrame) -> DataFrame:
    """``chunk_key, s0..`` of every symbol that a model predicts in ``chunk_key, chunk`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 1 << 18):
            symbols, owner = predicted_symbols(texts_of(batch.column(1)))
            columns = [pa.array(symbols[:, k].astype(np.int32)) for k in range(ORDER)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_numpy()[owner], pa.int64()), *columns], names=["chunk_key", *SYMBOLS]
            )

    return chunks.mapInArrow(run, ", ".join(["chunk_key long", *(f"{s} int" for s in SYMBOLS)]))


def scored_by_joins(texts: DataFrame, models: ModelTables) -> DataFrame:
    """As ``scored``, with every distinct n-gram, chunk and text scored once by shuffled joins."""
    langs = list(models.alphabets)
    keyed = texts.withColumn("key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    pairs = text_chunks(keyed.where("text IS NOT NULL").select("key", "text").dropDuplicates(["key"]))
    chunks = pairs.select("chunk").distinct().select(F.xxhash64("chunk").alias("chunk_key"), "chunk")
    grams = written(chunk_grams(chunks), "chunk-grams")

    def sums(times: Column) -> list[Column]:
        return [F.sum(F.col("values")[k] * times).alias(f"v{k}") for k in range(len(langs))]

    own = [F.col(f"v{k}") for k in range(len(langs))]
    of_chunk = grams.join(models.gram_scores(grams), SYMBOLS).groupBy("chunk_key")
    of_chunk = of_chunk.agg(*sums(F.lit(1)), F.count(F.lit(1)).alias("in_chunk"))
    of_chunk = written(of_chunk.select("chunk_key", F.array(*own).alias("values"), "in_chunk"), "chunk-scores")
    times = F.col("times")
    of_text = pairs.select("key", F.xxhash64("chunk").alias("chunk_key"), "times").join(of_chunk, "chunk_key").groupBy("key")
    of_text = of_text.agg(*sums(times), F.sum(F.col("in_chunk") * times).alias("n"))
    rows = keyed.drop("text").join(of_text, "key", "left")
    rows = rows.withColumn("symbols", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("entropies", F.array(*[F.coalesce(-v / F.col("n"), F.lit(0.0)) for v in own]))
    place = F.array_position("entropies", F.array_min("entropies")).cast("int")
    best = F.when(F.col("symbols") > 0, F.element_at(F.array(*[F.lit(x) for x in langs]), place))
    return rows.select("doc_id", "lang", "learns", best.alias("best"), "entropies", "symbols")


def identify(
    docs: DataFrame, learns: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """Per row: ``doc_id, learns, lang_pred, score, entropy, rejected``, models learnt from rows where ``learns`` holds.

    Learning rows with a null language or text teach nothing. A text that is null or has no letter is ``und``, has
    score 0 and is rejected, and so is every text if nothing could be learnt. Equal texts get equal results; ties go to
    the language first by name. An empty table gives no row. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.col(lang_column).cast("string").alias("lang"),
        F.coalesce(learns, F.lit(False)).alias("learns"),
    )
    counts = written(gram_counts(rows.where("learns AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")), "grams")
    kinds = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    most_kinds, all_kinds = kinds.agg(F.coalesce(F.max("kinds"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    if most_kinds > MOST_GRAMS or all_kinds > MOST_IN_ALL:
        tables = ModelTables(counts)
        alphabets = tables.alphabets
        values = written(scored_by_joins(rows, tables), "entropies")
    else:
        models = trained_models(counts)
        alphabets = {lang: len(model["k1"]) for lang, model in models.items()}
        values = written(scored(rows, models), "entropies")

    known = values.where("learns AND symbols > 0").withColumn(
        "own_place", F.array_position(F.array(*[F.lit(x) for x in alphabets]).cast("array<string>"), F.col("lang"))
    )

    def probability(at: Column, temperature: float) -> Column:
        own = F.element_at("entropies", at)
        return 1.0 / F.aggregate("entropies", F.lit(0.0), lambda s, x: s + F.exp((own - x) * temperature))

    own_place = F.col("own_place").cast("int")
    likelihoods = [F.avg(F.log(F.greatest(probability(own_place, t), F.lit(1e-12)))) for t in TEMPERATURES]
    sums = known.where("own_place > 0").agg(*[x.alias(f"t{k}") for k, x in enumerate(likelihoods)]).first()
    temperature = max(zip([s if s is not None else 0.0 for s in sums], TEMPERATURES, strict=True))[1]

    lowest = F.array_min("entropies")
    bulk = (
        known.where("best = lang")
        .groupBy("best")
        .agg(F.percentile_approx(lowest, BULK, 10_000).alias("bulk"))
        .select(F.col("best").alias("of"), "bulk")
    )
    chance = F.lit(None).cast("double")
    for lang, letters in alphabets.items():
        chance = F.when(F.col("best") == lang, math.log(letters)).otherwise(chance)
    most = F.greatest("bulk", (F.col("bulk") + chance) / 2)
    # one row for each learnt language at most
    joined = values.join(F.broadcast(bulk), F.col("best") == F.col("of"), "left")
    at = F.array_position("entropies", lowest).cast("int")
    best = F.col("best").isNotNull()
    return joined.select(
        "doc_id",
        "learns",
        F.coalesce("best", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(best, probability(at, temperature)).otherwise(0.0).alias("score"),
        F.when(best, lowest).alias("entropy"),
        (~best | F.coalesce(lowest > most, F.lit(True))).alias("rejected"),
    )
