"""Personal data by bootstrapped contextual extraction, in column expressions only.

Four strict patterns find base identifiers.  They are the seeds: the words around them
induce lexical patterns (the word before, the word after, both).  Patterns and the
identifiers seen in them form a graph on which confidence is passed back and forth: a
pattern is trusted for a kind as far as what stands in it is of that kind, and an
identifier-like string that no base pattern knows is trusted as far as the patterns around
it are.  What is trusted after the last round is found wherever it stands.

One read of the texts yields base spans and candidates with their contexts; all later steps
work on that short table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlab.storage import materialize

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

# The quantifiers never give back: what follows them cannot begin with what they take, so
# matches are those of the plain patterns and long runs take linear time.  A match begins
# where the one before ended or where a run of its first characters begins.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words with a digit, an at sign or a written one.
_CANDIDATE = r"(?<!\S)(?:(?![(\[][aA][tT][)\]])[^\s0-9@])*+(?:[0-9@]|[(\[][aA][tT][)\]])\S*+"
_CANDIDATE_LENGTHS = (6, 64)

#: Rounds of scoring; identifiers that a pattern must be seen with, and its least share of
#: one kind; score and number of patterns from which an identifier is accepted.
ROUNDS = 3
LEAST_SUPPORT = 3.0
LEAST_PRECISION = 0.6
LEAST_SCORE = 0.9
LEAST_PATTERNS = 2

_CONTEXT_CHARS = 40
_SPAN = "array<struct<start:int,stop:int,text:string,before:string,after:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def _is_valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        small = lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3
        return F.forall(F.split(text, r"\."), lambda p: F.when(small(p), F.right(p, F.lit(3)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        digits = _digits(text)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _valid_spans(kind: str) -> Column:
    return F.filter(kind, lambda s: _is_valid(kind, s["text"]))


def _seeds(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("seed"), s.alias("s")))


def _places(kind: str) -> Column:
    """Spans of a kind as number of the kind, start and stop."""
    number = F.lit(KINDS.index(kind))
    return F.transform(kind, lambda s: F.struct(number.alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _word_before(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(text, F.lit(_CONTEXT_CHARS)), r"(\S+)\s*+$", 1))


def _word_after(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.left(text, F.lit(_CONTEXT_CHARS)), r"^\s*+(\S+)", 1))


def _spans(matches: Column, pieces: Column) -> Column:
    """Places and contexts of matches, from them and the pieces of text between them."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        text = F.get(matches, i)
        stop = start + F.length(text)
        span = F.struct(
            start.alias("start"),
            stop.alias("stop"),
            text.alias("text"),
            _word_before(F.get(pieces, i)).alias("before"),
            _word_after(F.get(pieces, i + 1)).alias("after"),
        )
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), empty, add, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(_SPAN))


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` with base spans of each kind and with ``candidate`` spans that touch none of them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    patterns = PATTERNS | {"candidate": _CANDIDATE}
    # A text without the one sign that a kind needs is not searched for it.
    needs = {"email": "@", "ip": ".", "phone": "+"}
    none = F.array().cast("array<string>")
    matches = {
        f"_m_{k}": F.when(F.contains("_text", F.lit(needs[k])), F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none)
        if k in needs
        else F.regexp_extract_all("_text", F.lit(p), F.lit(0))
        for k, p in patterns.items()
    }
    found = found.withColumns(matches)
    pieces = {
        f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(F.col("_text"), p, -1)).otherwise(none) for k, p in patterns.items()
    }
    found = found.withColumns(pieces)
    spans = {k: _spans(F.col(f"_m_{k}"), F.col(f"_p_{k}")) for k in patterns}
    found = found.select("_id", *[s.alias(k) for k, s in spans.items()])
    found = found.select("_id", *[_valid_spans(k).alias(k) for k in KINDS], "candidate")
    low, high = _CANDIDATE_LENGTHS

    def free(s: Column) -> Column:
        touching = [F.exists(k, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])) for k in KINDS]
        apart = ~(touching[0] | touching[1] | touching[2] | touching[3])
        return F.length(s["text"]).between(low, high) & apart

    return found.withColumn("candidate", F.filter("candidate", free))


def _could_be(kind: str, text: Column) -> Column:
    """Whether a string has the rough shape of a kind."""
    n = F.length(_digits(text))
    if kind == "email":
        return text.rlike(r"(?i)\S(@|[(\[]at[)\]])\S")
    if kind == "ip":
        return text.rlike(r"^\W*[0-9a-fA-F]{1,4}([.:][0-9a-fA-F]{0,4}){3,7}\W*$")
    if kind == "card":
        return n.between(12, 19) & ~text.rlike("[A-Za-z]{3}")
    return n.between(7, 15) & ~text.rlike("[A-Za-z]{3}")


def _edges(spans: DataFrame) -> DataFrame:
    """Distinct ``pattern, instance, seed`` of spans with their contexts."""
    before = F.when(F.col("s.before") == "", "^").otherwise(F.col("s.before"))
    after = F.when(F.col("s.after") == "", "$").otherwise(F.col("s.after"))
    patterns = F.array(F.concat(F.lit("B "), before), F.concat(F.lit("A "), after), F.concat(F.lit("C "), before, F.lit(" "), after))
    return spans.select(F.explode(patterns).alias("pattern"), F.lower("s.text").alias("instance"), "seed").distinct()


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``instance, kind``: candidates that the context of known identifiers gives away.

    A pattern's precision for a kind is the summed score of its instances for the kind over
    the number of its instances, and one; base identifiers score 1.  A candidate's score is
    the chance that not all of its trusted patterns are wrong.  Hot patterns and instances
    are merged in their tasks before they meet, and stand on the divisible side of joins.
    """
    seeds = found.select(F.explode(F.concat(*[_seeds(k) for k in KINDS])).alias("x")).select("x.*")
    loose = found.select(F.explode("candidate").alias("s")).select(F.lit(None).cast("string").alias("seed"), "s")
    edges = materialize(_edges(seeds.unionByName(loose)), "edges")
    totals = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("total"))
    totals = materialize(totals.filter(F.col("total") >= LEAST_SUPPORT), "patterns")
    kinds = F.explode(F.array(*[F.when(_could_be(k, F.col("instance")), F.lit(k)) for k in KINDS]))
    open_edges = edges.filter("seed is null").select("pattern", "instance", kinds.alias("kind")).filter("kind is not null")
    known = edges.filter("seed is not null").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    accepted = None
    extra = None
    for _ in range(rounds):
        scored = known if extra is None else known.unionByName(extra)
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).filter(F.col("sum") >= LEAST_SUPPORT)
        trusted = sums.join(totals, "pattern").withColumn("precision", F.col("sum") / (F.col("total") + 1))
        trusted = materialize(trusted.filter(F.col("precision") >= LEAST_PRECISION).select("pattern", "kind", "precision"), "trusted")
        doubt = F.sum(F.log(1 - F.least("precision", F.lit(0.999))))
        accepted = (
            open_edges.join(trusted, ["pattern", "kind"])
            .groupBy("instance", "kind")
            .agg((1 - F.exp(doubt)).alias("score"), F.count("*").alias("patterns"))
        )
        accepted = materialize(accepted, "scores")
        extra = open_edges.join(accepted, ["instance", "kind"]).select("pattern", "kind", "score")
    sure = accepted.filter((F.col("score") >= LEAST_SCORE) & (F.col("patterns") >= LEAST_PATTERNS))
    # A string that is taken for several kinds is of the best one; ties go by name.
    best = sure.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return best


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, base, found``.

    ``base`` are the spans of the strict patterns, ``found`` those and the ones that the
    contexts gave away; both are arrays of ``(kind, start, stop)``, in code points with
    ``stop`` exclusive, ordered by kind as in ``KINDS`` (0 to 3) and start.  Null and empty texts
    have none; an empty table gives an empty table; other columns are not looked at.  Rows
    that repeat an id all get what was discovered under it; a null id gets none of that.
    """
    stored = materialize(identifiers(docs, id_col, text_col), "identifiers")
    accepted = materialize(bootstrap(stored), "accepted")
    placed = stored.select("_id", F.explode("candidate").alias("s")).withColumn("instance", F.lower("s.text"))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    span = F.struct(number.alias("kind"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"))
    more = placed.join(accepted, "instance").groupBy("_id").agg(F.collect_set(span).alias("more"))
    more = materialize(more.withColumnRenamed("_id", "_more_id"), "discovered")
    base = stored.select("_id", F.concat(*[_places(k) for k in KINDS]).alias("base"))
    joined = base.join(more, F.col("_id") == F.col("_more_id"), "left")
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select(F.col("_id").alias(id_col), "base", both.alias("found"))


def span_list(spans: str) -> Column:
    """Spans as ``kind:start:stop`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))
