"""The operators of this subpackage as queries over the driver's tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.llm import (
    collocations,
    contamination,
    minmax,
    packing,
    perplexity,
    pii,
    recipes,
    records,
    repeats,
    resampling,
    toxicity,
    whitening,
    wrappers,
)
from textlab.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in whole texts: strict patterns, and what their contexts give away."""
    found = pii.find_personal_data(table(spark, folder, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.span_list("base"), 256).alias("base_sha256"),
        pii.span_list("found").alias("spans"),
    )


@query()
def op2_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as records of token ids, read back from the files."""
    docs = table(spark, folder, "documents")
    target = scratch_path(spark, "records")
    manifest = records.write_records(docs, target, tokenizer("word_bpe_49k.json"), end_id=2, lower_words=True)
    return records.read_records(spark, target, manifest).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query()
def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What remains of whole texts when strings of 100 bytes that start earlier are removed."""
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts packed into sequences of 1024 ids."""
    docs = table(spark, folder, "documents")
    packed = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed_digest(packed)


def packed_digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT least(13, len(w)) AS n FROM item WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
found AS (SELECT doc_id, windows.n, i, item_id FROM windows JOIN grams USING (n, g)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, n, i FROM found) f, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query(CONTAMINATION_SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold windows of benchmark items, and how much of them."""
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = contamination.hit_words()
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        contamination.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


@query()
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = wrappers.extract_main_text(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query()
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked at 85 % of shared word shingles."""
    return minmax.near_duplicates(table(spark, folder, "documents"))


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, folder, "labels")))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query(EXACT_SQL)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of identical texts, by chunk recipes."""
    return recipes.exact_duplicates(table(spark, folder, "documents"))


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Importance, sampling key and decision for every document."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM listed, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= 100),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a, n FROM frequent JOIN totals USING (lang) WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, n, j, l.f AS l, r.f AS r, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase
         WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM kept QUALIFY rank <= 2000"""


@query(COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The most strongly bound phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


@query()
def op12_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Plain counts of whole texts, and whether their perplexity is usual for their language."""
    return perplexity.quality_rules(table(spark, folder, "documents"))


@query()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All usable vectors on the whitened components of all of them."""
    white = whitening.whiten(table(spark, folder, "embeddings"))
    # A deviation beyond a long is an error, not a wrong number.
    return white.withColumn("deviation", F.col("deviation").cast("bigint"))
