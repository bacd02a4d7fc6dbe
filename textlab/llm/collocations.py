"""Phrase collocations by prefix-free parsing.

A document is a stream of words and breaks.  Words chosen by their hash trigger a new chunk,
so equal passages are cut alike wherever they stand; a chunk runs on over the first words of
the next one, as far as a phrase can reach.  A phrase belongs to the chunk in which its first
word stands before the overlap, so each occurrence is counted once.  The parse is a dictionary
of distinct chunks with their frequencies: a passage that occurs a million times is read once.

Phrases are counted in the dictionary, weighted.  Three rounds count 64-bit marks in place of
phrases: of words, of pairs of frequent words, and of longer phrases of frequent pairs.  A
phrase cannot be frequent unless its parts are, and a mark is there at least as often as each of
its phrases, so what these rounds leave out changes no result.  What is left is counted as it is
written, in a last round.  What is frequent travels to the tasks as a bitmap of fixed size; a
bit that is set by chance costs work and changes nothing either.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from textlab.llm.batches import slices
from textlab.storage import materialize

#: Words in a phrase, at most.
LONGEST = 5
#: Occurrences that make a phrase a candidate.
MIN_COUNT = 100
#: Phrases reported for a language.
TOP = 2000
#: One word in so many triggers a chunk, and tokens of its own that a chunk has at most.
TRIGGER = 24
MAX_CHUNK = 4096
#: Bits that say what is frequent (16 MB).
BITMAP_BITS = 1 << 27
#: Language of rows without one.
NO_LANGUAGE = "und"

#: The break between pieces; no word holds this character.
_BREAK = b"."
_SIGNS = b",;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SIGNS, b"abcdefghijklmnopqrstuvwxyz" + _BREAK * len(_SIGNS)
)
#: Spark's bitmap functions work on pieces of this many bits.
_PIECE_BITS = 8 * 4096
#: Distinct marks that a task holds before it passes them on.
_HELD = 1 << 20
#: Distinct phrases that a task holds before it passes them on.
HELD_PHRASES = 1 << 18
#: Tasks of the last round for each core, and parts of the dictionary that a task takes at most beyond that.
TASKS_PER_CORE = 4
JOINED_PARTS = 16
#: Rows of the dictionary that are looked at together.
_ROWS = 8192


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z as a-z, and a break wherever a piece ends."""
    return text.encode().translate(_FOLD).replace(_BREAK, b" . ").split() if text else []


def word_codes(listed: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each token, and 0 for a break alone."""
    codes = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed))
    codes[codes == 0] = 1
    # Of tokens of one byte no other has this hash.
    single = np.fromiter(map(len, listed), np.int64, len(listed)) == 1
    codes[single & (codes == zlib.crc32(_BREAK))] = 0
    return codes


def cut(
    listed: list[bytes], trigger: int = TRIGGER, longest: int = MAX_CHUNK, reach: int = LONGEST - 1
) -> Iterator[tuple[bytes, int]]:
    """Chunks of a token stream, and how many tokens of each are its own.

    The other tokens, ``reach`` at most and none beyond a break, are the beginning of the next chunk.
    """
    codes = word_codes(listed)
    begins = np.flatnonzero((codes % np.uint32(trigger) == 0) & (codes > 0)).tolist()
    bounds = [0]
    for at in [*begins, len(listed)]:
        while at - bounds[-1] > longest:
            bounds.append(bounds[-1] + longest)
        if at > bounds[-1]:
            bounds.append(at)
    for start, end in zip(bounds, bounds[1:]):
        over = listed[end : end + reach]
        if _BREAK in over:
            over = over[: over.index(_BREAK)]
        yield b" ".join(listed[start:end] + over), end - start


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the dictionary with the codes of their tokens, which the rounds work on."""
    for rows in slices(batches, _ROWS):
        chunks = rows.column("chunk").cast(pa.binary()).to_pylist()
        lengths = np.fromiter((c.count(b" ") + 1 for c in chunks), np.int64, len(chunks))
        codes = word_codes(b" ".join(chunks).split(b" ")) if chunks else np.empty(0, np.uint32)
        ends = np.append(0, np.cumsum(lengths)) * 4
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(chunks), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())]
        )
        yield pa.RecordBatch.from_arrays([*rows.columns, packed.cast(pa.binary())], [*rows.schema.names, "codes"])


def parse(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", trigger: int = TRIGGER) -> DataFrame:
    """The dictionary of the parse: ``lang, chunk, own, n, codes``, stored."""
    source = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("_lang"),
        F.col(text_col).cast("string").alias("_text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 64):
            langs, chunks, owns = [], [], []
            for lang, text in zip(rows.column("_lang").to_pylist(), rows.column("_text").to_pylist()):
                for chunk, own in cut(tokens(text), trigger):
                    langs.append(lang)
                    chunks.append(chunk)
                    owns.append(own)
            columns = [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(owns, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "own"])

    found = source.mapInArrow(run, "lang string, chunk string, own int")
    merged = found.groupBy("lang", "chunk", "own").agg(F.count("*").alias("n"))
    return materialize(merged.mapInArrow(_encoded, DICTIONARY), "parse")


DICTIONARY = "lang string, chunk string, own int, n bigint, codes binary"


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K1
    return x ^ (x >> np.uint64(29))


class _Chunks:
    """Some rows of the dictionary: their tokens in a row, and the marks of the phrases that begin at each."""

    def __init__(self, rows: pa.RecordBatch, longest: int):
        self.langs = rows.column("lang").to_pylist()
        packed = rows.column("codes").to_pylist()
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        words = np.frombuffer(b"".join(packed), np.uint32).astype(np.uint64)
        codes = np.array([zlib.crc32(lang.encode()) for lang in self.langs], np.uint64)
        self.row = np.repeat(np.arange(len(packed)), lengths)
        place = np.arange(len(self.row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.own = place < rows.column("own").to_numpy()[self.row]
        self.n = rows.column("n").to_numpy()
        with np.errstate(over="ignore"):
            self.marks = [_mix(words * _K1 + _K2 * codes[self.row])]
            self.whole = [words != 0]
            for k in range(1, longest):
                end = len(words) - k
                if end <= 0:
                    break
                self.marks.append(_mix(self.marks[-1][:end] * _K2 + words[k:]))
                # All words, and the last one in the row of the first.
                self.whole.append(self.whole[-1][:end] & self.whole[0][k:] & (self.row[:end] == self.row[k:]))

    def holding(self, size: int, words: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Where phrases of ``size`` words begin whose words (and pairs, if given) are frequent."""
        if size > len(self.marks):
            return np.zeros(0, bool)
        end = len(self.marks[size - 1])
        out = self.whole[size - 1].copy()
        for bits, step in ((words, 1), (pairs, 2)):
            if bits is not None and size >= step:
                hit = _are_set(bits, self.marks[step - 1])
                for i in range(size - step + 1):
                    out &= hit[i : i + end]
        return out & self.own[:end]


def _are_set(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(marks: DataFrame, size: int = BITMAP_BITS) -> np.ndarray:
    """A bit for each mark; ``size`` bits (a power of two), whatever the number of marks."""
    at = F.col("mark").bitwiseAND(F.lit(size - 1))
    pieces = marks.groupBy(F.floor(at / _PIECE_BITS).cast("int").alias("piece")).agg(
        # The function counts positions within a piece from 1.
        F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(at, F.lit(_PIECE_BITS)) + 1)).alias("bits")
    )
    out = np.zeros(size // 8, np.uint8)
    for piece, bits in pieces.toLocalIterator():
        start = piece * _PIECE_BITS // 8
        out[start : start + len(bits)] = np.frombuffer(bits, np.uint8)[: len(out) - start]
    return out


def _summed(marks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks and the sums of their numbers."""
    if not len(marks):
        return marks, n
    order = np.argsort(marks)
    marks, n = marks[order], n[order]
    starts = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
    return marks[starts], np.add.reduceat(n, starts)


def _frequent_marks(
    chunks: DataFrame,
    sizes: range,
    min_count: int,
    find: Callable[[_Chunks, int], np.ndarray],
    name: str,
    parts: Callable[[_Chunks], np.ndarray] | None = None,
) -> DataFrame:
    """``mark`` of what occurs ``min_count`` times among the phrases that ``find`` points at.

    With them come the marks of both words of the pairs that ``parts`` points at, however few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([m for m, _ in held]), np.concatenate([n for _, n in held]))

        def rows(marks: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(marks), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(marks[part].view(np.int64)), pa.array(n[part])], ["mark", "n"])

        fresh = 0
        for part in slices(batches, _ROWS):
            found = _Chunks(part, max(sizes, default=2))
            for size in sizes:
                at = np.flatnonzero(find(found, size))
                if len(at):
                    held.append((found.marks[size - 1][at], found.n[found.row[at]]))
                    fresh += len(at)
            if parts is not None:
                at = parts(found)
                marks = np.unique(found.marks[0][np.append(at, at + 1)])
                held.append((marks, np.full(len(marks), min_count)))
            if fresh > _HELD:
                held = [merged()]
                fresh = 0
                if len(held[0][0]) > 4 * _HELD:
                    yield from rows(*held.pop())
        if held:
            yield from rows(*merged())

    counted = chunks.mapInArrow(run, "mark bigint, n bigint").groupBy("mark").agg(F.sum("n").alias("n"))
    return materialize(counted.filter(F.col("n") >= min_count).select("mark"), name)


def _phrase_counts(longest: int, words: Broadcast, pairs: Broadcast, rest: Broadcast, most: int = HELD_PHRASES):
    """A ``mapInArrow`` function that counts the phrases that the bitmaps let through, as ``lang, phrase, n``.

    Counts are held for the whole task, unless more than ``most`` phrases come together.
    """

    def reported(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            phrases, numbers = list(found), list(found.values())
            for at in range(0, len(phrases), 50_000):
                part = slice(at, at + 50_000)
                columns = [
                    pa.array([lang] * len(phrases[part]), pa.string()),
                    pa.array(phrases[part], pa.binary()).cast(pa.string()),
                    pa.array(numbers[part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for rows in slices(batches, _ROWS):
            part = _Chunks(rows, longest)
            tokens_of = b" ".join(rows.column("chunk").cast(pa.binary()).to_pylist()).split(b" ")
            times = part.n[part.row]
            code: dict[str, int] = {}
            lang_of = np.array([code.setdefault(lang, len(code)) for lang in part.langs])[part.row]
            places = []
            for size in range(1, longest + 1):
                good = part.holding(size, words.value, pairs.value)
                if size != 2 and len(good):
                    good &= _are_set(rest.value, part.marks[size - 1])
                places.append(np.flatnonzero(good))
            mine = part.whole[0] & part.own
            for lang, number in code.items():
                found = held.setdefault(lang, Counter())
                # The empty phrase stands for all words.
                found[b""] += int(times[mine & (lang_of == number)].sum())
                for size, at in enumerate(places, 1):
                    at = at[lang_of[at] == number]
                    more = times[at] > 1
                    if size == 1:
                        listed = [tokens_of[i] for i in at.tolist()]
                    else:
                        listed = [b" ".join(tokens_of[i : i + size]) for i in at.tolist()]
                    found.update(listed)
                    for i in np.flatnonzero(more).tolist():
                        found[listed[i]] += int(times[at[i]]) - 1
            if sum(map(len, held.values())) > most:
                yield from reported(held)
                held = {}
        yield from reported(held)

    return count


def frequent_phrases(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    trigger: int = TRIGGER,
    bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """``lang, phrase, size, n`` of all phrases of 2 to ``longest`` words that occur ``min_count`` times.

    Of single words those are there that a frequent pair is made of.  The empty phrase (size 0) has the number of all words of a language.  Stored.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    if bitmap_bits < 8 or bitmap_bits & (bitmap_bits - 1):
        raise ValueError("the bits of the bitmap are a power of two, 8 or more")
    chunks = parse(docs, text_col=text_col, lang_col=lang_col, trigger=trigger)
    ship = lambda marks: docs.sparkSession.sparkContext.broadcast(bitmap(marks, bitmap_bits))
    step = lambda *how: ship(_frequent_marks(chunks, how[0], min_count, *how[1:]))

    words = step(range(1, 2), lambda c, size: c.whole[0] & c.own, "words")
    pairs = step(range(2, 3), lambda c, size: c.holding(size, words.value), "pairs")
    # Of the words, those are wanted that frequent pairs are made of.
    rest = step(
        range(3, longest + 1),
        lambda c, size: c.holding(size, words.value, pairs.value),
        "rest",
        lambda c: np.flatnonzero(c.holding(2, words.value, pairs.value)),
    )

    # A task reports a phrase once, so their number and not that of the blocks decides on the rows.
    spread = max(
        TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism, chunks.rdd.getNumPartitions() // JOINED_PARTS
    )
    count = _phrase_counts(longest, words, pairs, rest)
    counted = chunks.coalesce(spread).mapInArrow(count, "lang string, phrase string, n bigint")
    counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases")
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return counted.withColumn("size", size)


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    absorb_percent: int = 100,
    trigger: int = TRIGGER,
    bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Words are lower-cased in A-Z and separated by blanks and tabs; phrases of 2 to ``longest``
    words do not cross sentence signs or line ends.  ``a`` counts a phrase, ``n`` all words of
    the language.  A cut into two parts of ``l`` and ``r`` occurrences scores floor(1000 * a * n /
    (l * r)), in exact arithmetic; the cut with the lowest score counts, the first of equals.  A phrase
    inside a longer candidate that occurs ``absorb_percent`` as often is left out.

    Null and empty texts have no words; a null language is ``und``.  Rows that repeat an id
    or a text all count.  Equal scores are ordered by ``a``, then by the phrase's bytes.  An
    empty table gives an empty table; other columns are not looked at.
    """
    counts = frequent_phrases(
        docs, text_col=text_col, lang_col=lang_col, min_count=min_count, longest=longest, trigger=trigger,
        bitmap_bits=bitmap_bits,
    )
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    candidates = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    # The number of words of a language: a row for each, so a salt keeps a large language apart.
    salts = 64
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    candidates = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int"))
    candidates = materialize(candidates.join(salted, ["lang", "salt"]).drop("salt"), "candidates")

    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = candidates.select("lang", "phrase", "a", "total", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "total", "k",
        part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    of = lambda side, name: counts.filter("size > 0").select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} AS decimal(38,0))"
    score = F.expr(f"({wide(1000)} * {wide('a')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best")
    )

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: part(i, k)),
        )
    )
    absorbed = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    absorbed = absorbed.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(absorbed, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))
