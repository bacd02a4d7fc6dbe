"""Exact duplicates by content-defined chunk recipes.

A text is cut where its content says so (after a sentence or line end, within length
limits), each chunk is known by its SHA-256, and a document becomes the ordered list of its
chunks' identifiers: its recipe.  Chunks are moved once, into a store that keeps one copy of
each and checks that an identifier never stands for two contents.  From then on documents
are compared by recipe; their texts stay where they are.

Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textlab.storage import materialize

MIN_CHUNK = 1024
MAX_CHUNK = 8192


def chunks(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The text cut after the first sentence or line end beyond ``shortest`` characters.

    A stretch without such an end is cut at ``longest``; the last chunk is what remains.
    The chunks joined are the text.  Null and empty texts have none.
    """
    pattern = rf"(?s).{{{shortest},{longest}}}?[.!?\n]|.{{1,{longest}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def chunk_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per distinct chunk: ``chunk_id``, ``chunk`` and how often it occurs; stored, verified.

    Equal chunks meet once, after each task has merged its own.  If an identifier stands for
    two contents, that is an error.
    """
    pieces = docs.select(F.explode(chunks(F.col(text_col))).alias("chunk"))
    # The identifier follows from the chunk, so contents are compared whole.
    merged = pieces.groupBy("chunk").agg(F.count("*").alias("occurrences"))
    stored = materialize(merged.select(F.sha2("chunk", 256).alias("chunk_id"), "chunk", "occurrences"), "chunks")
    clashes = stored.groupBy(F.unhex("chunk_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")
    if not clashes.isEmpty():
        raise ValueError("two chunks share an identifier")
    return stored


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the text's SHA-256, and the ordered chunk identifiers (empty for no text)."""
    ids = F.transform(chunks(F.col(text_col)), lambda c: F.sha2(c, 256))
    return docs.select(
        id_col,
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
        ids.alias("recipe"),
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verify: bool = True
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as empty.  The row with the largest
    id of a group stays.  An empty table gives an empty table; other columns are not looked
    at.  Rows that repeat an id are rows of their own in ``group_size``, and all rows that
    carry the largest id are ``kept``.  A null id is smaller than any other.

    The chunk store is written first: that verifies the identifiers (``verify=False`` if it
    was done before).  A recipe is then compared by the SHA-256 of its list and its length.
    """
    if verify:
        chunk_store(docs.select(text_col), text_col)
    listed = recipes(docs, id_col, text_col).select(
        id_col,
        "text_sha256",
        F.unhex(F.sha2(F.concat_ws(",", "recipe"), 256)).alias("_recipe"),
        F.size("recipe").alias("_length"),
    )
    listed = materialize(listed, "recipes")
    # Copies are merged in each task before they meet, so a group of any size is one row per task.
    groups = listed.groupBy("_recipe", "_length").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")
    # A large group stands on the left only, where the join may split it.
    return (
        listed.join(groups, ["_recipe", "_length"], "left")
        .select(
            id_col,
            "keep_id",
            "group_size",
            F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def keep_last_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeating an id and text, all."""
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
