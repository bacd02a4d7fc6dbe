"""Quality rules with n-gram perplexity: plain counts of a text, and a modified Kneser-Ney model.

The model is one of bytes: five in a row of the lower-cased words of a text, one blank between
words.  Five bytes are 40 bits, so an n-gram is its own hash, its context and its suffix are shifts
of it, and no context has more than 256 continuations: no join or group of the model can
grow hot, whatever the texts repeat.  Tasks count their own texts before anything is
shuffled; Spark adds up the counts, derives the continuation counts of the lower orders, the
discounts of each language and order, and the interpolated probability of every n-gram.

For scoring, the model lies in arrays sorted by n-gram, one pair for each language.  The arrays
are sent to the tasks if they are within ``model_bytes``, else the n-grams of the texts are
joined with the model; both give the same rows.  Every text is scored whole, by a model of all
texts.  Its perplexity per byte must lie between two bounds that follow from the quartiles of its
language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Bytes in an n-gram.
ORDER = 5
#: Texts of fewer words, or with a larger share of words in repeated windows, are rejected.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Words in a window of the repetition rule.
WINDOW = 3
#: A band reaches so many times the distance of the quartiles beyond them, which counts as
#: this share of the median at least.
REACH = 3.0
LEAST_SPREAD = 0.02
#: Width of the bins (of log perplexity) from which quartiles are read.
BIN = 1 / 4096
#: Sorted arrays up to this size are sent to the tasks.
MODEL_BYTES = 64 << 20
#: Language of rows without one.
NO_LANGUAGE = "und"

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_GRAM_BYTES = 16
#: N-grams that a task holds before it passes its counts on.
_HELD = 1 << 22


# --------------------------------------------------------------------------- plain counts


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which occurs at least twice in the text."""
    windows = list(zip(*(words[i:] for i in range(window))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    count, covered = 0, 0
    for at, found in enumerate(windows):
        if times[found] > 1:
            count += at + window - max(at, covered)
            covered = at + window
    return count


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, _BLANKS))
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


# --------------------------------------------------------------------------- n-grams


def _stream(text: str | None) -> bytes:
    """The bytes of a text that the model sees; the leading ones are context only."""
    return b"\0" * (ORDER - 1) + b" ".join((text or "").lower().encode().split()) + b"\n"


def gram_streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of some texts in a row, and where those of each text begin."""
    streams = [_stream(t) for t in texts]
    data = np.frombuffer(b"".join(streams), np.uint8).astype(np.int64)
    found = np.zeros(max(0, len(data) - ORDER + 1), np.int64)
    for i in range(ORDER):
        found = found << 8 | data[i : len(data) - ORDER + 1 + i]
    sizes = np.fromiter(map(len, streams), np.int64, len(streams)) - (ORDER - 1)
    # Windows that reach from one text into the next are none.
    keep = np.ones(len(found), bool)
    ends = np.cumsum(sizes + (ORDER - 1))[:-1]
    for i in range(1, ORDER):
        keep[ends - i] = False
    return found[keep], np.cumsum(np.append(0, sizes))[:-1]


def _by_language(langs: list[str]) -> Iterator[tuple[str, list[int]]]:
    places: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        places.setdefault(lang, []).append(i)
    yield from places.items()


def _source(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("_lang"),
    )


def gram_counts(source: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[str, list[np.ndarray]] = {}
        merged: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def merge() -> None:
            for lang, parts in fresh.items():
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in merged:
                    both = np.concatenate((merged[lang][0], grams))
                    weights = np.concatenate((merged[lang][1], counts))
                    grams, at = np.unique(both, return_inverse=True)
                    counts = np.zeros(len(grams), np.int64)
                    np.add.at(counts, at, weights)
                merged[lang] = grams, counts
            fresh.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in merged.items():
                for at in range(0, len(grams), 50_000):
                    part = slice(at, at + 50_000)
                    n = len(grams[part])
                    columns = [pa.array([lang] * n, pa.string()), pa.array(grams[part]), pa.array(counts[part])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
            merged.clear()

        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            for lang, at in _by_language(batch.column("_lang").to_pylist()):
                found, _ = gram_streams([texts[i] for i in at])
                fresh.setdefault(lang, []).append(found)
                held += len(found)
            if held > _HELD:
                merge()
                held = 0
                if sum(len(g) for g, _ in merged.values()) > _HELD:
                    yield from rows()
        merge()
        yield from rows()

    counted = source.mapInArrow(run, "lang string, gram bigint, n bigint")
    return materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


# --------------------------------------------------------------------------- the model


def discounts(rows: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: what an n-gram that was seen once, twice, or more often gives away."""
    times = [F.sum((F.col("n") == i).cast("bigint")).cast("double").alias(f"t{i}") for i in range(1, 5)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    given = [i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}") for i in range(1, 4)]
    # What takes their place where counts are too few to tell.
    usual = (0.5, 1.0, 1.5)
    enough = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0) & (F.col("t4") > 0)
    sound = enough & (given[0] >= 0) & (given[1] >= 0) & (given[2] >= 0)
    return rows.groupBy("lang").agg(*times).select(
        "lang", *[F.when(sound, g).otherwise(F.lit(u)).alias(f"d{i}") for i, (g, u) in enumerate(zip(given, usual), 1)]
    )


def _given(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def probabilities(rows: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """``lang, gram, p, q`` of one order, interpolated with the order below (or all 256 bytes).

    ``q`` is the probability after one occurrence is taken away (leaving one out).  An n-gram
    that was there once is then gone, with it one of the bytes that stand before its suffix,
    so the order below has lost an occurrence as well; if the context was there once, only
    the order below is left.
    """
    found = rows.join(materialize(discounts(rows), "discounts"), "lang")
    found = found.select(
        "lang", "gram", "n", _given(F.col("n")).alias("d"), _given(F.col("n") - 1).alias("less"),
        F.shiftright("gram", 8).alias("context"),
    )
    contexts = found.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
    found = found.join(contexts, ["lang", "context"])
    if lower is None:
        found = found.withColumns({"below_p": F.lit(1 / 256), "below_q": F.lit(1 / 256)})
    else:
        suffix = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below_p"), F.col("q").alias("below_q"))
        mask = (1 << 8 * (order - 1)) - 1
        found = found.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(suffix, ["lang", "suffix"])
    n, d, less, total, mass = (F.col(c) for c in ("n", "d", "less", "total", "mass"))
    p = (n - d + mass * F.col("below_p")) / total
    below = F.when(n == 1, F.col("below_q")).otherwise(F.col("below_p"))
    q = F.when(total == 1, below).otherwise((n - 1 - less + (mass - d + less) * below) / (total - 1))
    return materialize(found.select("lang", "gram", p.alias("p"), q.alias("q")), f"order{order}")


def model(counts: DataFrame) -> DataFrame:
    """``lang, gram, cost``: minus the log probability of every n-gram's last byte, stored.

    The highest order has the counts themselves, a lower one the number of different bytes
    that stand before an n-gram.  The texts that are scored are those that were counted, so
    the probability is the one that leaves the occurrence itself out: else what occurs nowhere
    else would seem certain.
    """
    orders = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << 8 * order) - 1)
        above = orders[order + 1].select("lang", F.col("gram").bitwiseAND(mask).alias("gram"))
        orders[order] = materialize(above.groupBy("lang", "gram").agg(F.count("*").alias("n")), f"continued{order}")
    found = None
    for order in range(1, ORDER + 1):
        found = probabilities(orders[order], found, order)
    return found.select("lang", "gram", (-F.log("q")).alias("cost"))


def _sorted_arrays(costs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """N-grams and costs of each language, in the order of n-grams; the caller has checked the size."""
    table = costs.toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    code = langs.indices.to_numpy()
    grams, cost = table.column("gram").to_numpy(), table.column("cost").to_numpy()
    order = np.lexsort((grams, code))
    code, grams, cost = code[order], grams[order], cost[order]
    starts = np.searchsorted(code, np.arange(len(langs.dictionary) + 1))
    return {
        lang: (grams[a:b].copy(), cost[a:b].copy())
        for lang, a, b in zip(langs.dictionary.to_pylist(), starts, starts[1:])
    }


_STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_COUNTS = [c.split()[0] for c in _STATS.split(", ")]


def _count_columns(texts: list[str | None]) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in (zip(*map(text_counts, texts)) if texts else [[]] * 5)]


def _scored_by_arrays(source: DataFrame, costs: DataFrame) -> DataFrame:
    kind = source.schema["_id"].dataType.simpleString()
    shipped = source.sparkSession.sparkContext.broadcast(_sorted_arrays(costs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shipped.value
        for rows in slices(batches):
            texts, langs = rows.column("_text").to_pylist(), rows.column("_lang").to_pylist()
            means = np.zeros(len(texts))
            for lang, at in _by_language(langs):
                grams, cost = arrays[lang]
                found, starts = gram_streams([texts[i] for i in at])
                total = np.add.reduceat(cost[np.searchsorted(grams, found)], starts)
                means[at] = total / np.diff(np.append(starts, len(found)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_lang"), *_count_columns(texts), pa.array(means)],
                ["_id", "_lang", *_COUNTS, "mean"],
            )

    return source.mapInArrow(run, f"_id {kind}, _lang string, {_STATS}, mean double")


def _scored_by_join(source: DataFrame, costs: DataFrame) -> DataFrame:
    """The same for a model that is too large to send: n-grams of each text meet it in a join."""
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            texts = rows.column("_text").to_pylist()
            listed = [np.unique(gram_streams([t])[0], return_counts=True) for t in texts]
            entries = [[{"gram": int(g), "c": int(c)} for g, c in zip(*found)] for found in listed]
            kinds = pa.list_(pa.struct([("gram", pa.int64()), ("c", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_lang"), *_count_columns(texts), pa.array(entries, kinds)],
                ["_id", "_lang", *_COUNTS, "grams"],
            )

    schema = f"_id {kind}, _lang string, {_STATS}, grams array<struct<gram: bigint, c: bigint>>"
    # Stored, so that a row keeps its number.
    listed = materialize(source.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "listed")
    used = listed.select("_row", F.col("_lang").alias("lang"), F.inline("grams"))
    sums = used.join(costs, ["lang", "gram"]).groupBy("_row").agg(
        (F.sum(F.col("c") * F.col("cost")) / F.sum("c")).alias("mean")
    )
    return listed.drop("grams").join(sums, "_row").drop("_row")


# --------------------------------------------------------------------------- the verdict


def bands(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """``_lang, lower, upper`` of log perplexity, from the quartiles of the texts that pass the plain rules.

    Quartiles are read from counts per bin, so no task holds the texts of a language.
    """
    bins = scored.filter(~F.col("base_failed")).groupBy("_lang", F.floor(F.col("mean") / BIN).alias("bin"))
    bins = materialize(bins.agg(F.count("*").alias("n")), "bins")
    order = Window.partitionBy("_lang").orderBy("bin")
    place = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("_lang")))
    at = [F.min(F.when(4 * F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN)).alias(f"q{q}") for q in (1, 2, 3)]
    spread = F.greatest(F.col("q3") - F.col("q1"), LEAST_SPREAD * F.col("q2"))
    return place.groupBy("_lang").agg(*at).select(
        "_lang", (F.col("q1") - reach * spread).alias("lower"), (F.col("q3") + reach * spread).alias("upper")
    )


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    reach: float = REACH,
    model_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, log_perplexity, lower, upper, kept``.

    Words are runs of characters other than ASCII white space.  A text fails the plain rules
    if it has fewer than 50 words, or more than half of them lie in repeated windows of three.
    Of the others those are kept whose log perplexity per byte lies within the band of their
    language (``lower`` and ``upper``; null where no text of the language passes).

    Null and empty texts have no words and fail.  A null language is ``und``.  Rows that repeat an id or a
    text are rows of their own, null ids stay; an empty table gives an empty table; other
    columns are not looked at.
    """
    source = _source(docs, id_col, text_col, lang_col)
    costs = model(gram_counts(source))
    fits = costs.count() * _GRAM_BYTES <= model_bytes
    scored = _scored_by_arrays(source, costs) if fits else _scored_by_join(source, costs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    scored = materialize(scored.withColumn("base_failed", failed), "scored")
    judged = scored.join(materialize(bands(scored, reach), "bands"), "_lang", "left")
    return judged.select(
        F.col("_id").alias(id_col),
        *_COUNTS,
        "base_failed",
        F.col("mean").alias("log_perplexity"),
        "lower",
        "upper",
        (~F.col("base_failed") & F.col("mean").between(F.col("lower"), F.col("upper"))).alias("kept"),
    )
