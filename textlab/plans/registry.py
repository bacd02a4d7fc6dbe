"""Every operator as a query over the driver's tables, next to the same question in SQL.

A query takes ``(spark, folder)`` and reads whole tables.  Floating-point results are
rounded on both sides, because engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

import numpy as np
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.functions.labels import AI, HUMAN
from textlab.functions.text import clean_text, truncate, word_count
from textlab.functions.vectors import cosine, l2_normalize
from textlab.operators import checks, classify, metrics, normalize, prompts, ranks, reports, sampling, splits
from textlab.operators.candidates import CandidateStore
from textlab.operators.embed import HashingEmbedder, embed, embed_missing
from textlab.operators.increments import GrowingIds, GrowingMetrics, GrowingSplit
from textlab.operators.knn import knn_join
from textlab.plans import evaluation, training
from textlab.sources import readers, writers
from textlab.sources.readers import read_answers, read_csv_folder, spread
from textlab.storage import materialize, scratch_path
from textlab.streaming.streams import stream_embed, stream_metrics, stream_normalize, stream_score

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


def documents_to_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, over all cores even if they come in one file."""
    return spread(table(spark, folder, "documents"), "doc_id")


# --------------------------------------------------------------------------- SQL building blocks

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean_sql(c: str) -> str:
    urls = rf"https?://[^{_SPACE}]+|www\.[^{_SPACE}]+"
    return (
        f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '{urls}', '[URL]', 'g'), "
        f"'[{_SPACE}]+', ' ', 'g'))"
    )


def words_sql(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


def label_sql(c: str, human: str = "'human','original','real','0','false','no'") -> str:
    return (
        f"(CASE WHEN {c} IN ('ai','generated','machine','1','true','yes') THEN 'ai' "
        f"WHEN {c} IN ({human}) THEN 'human' END)"
    )


# Labelled documents: quality 1 stands for ai, 0 for human.
CORPUS_SQL = """corpus AS (
  SELECT d.doc_id AS id, d.text, CASE WHEN l.quality = 1 THEN 'ai' ELSE 'human' END AS label,
         CASE WHEN l.quality = 1 THEN d.source ELSE 'human' END AS source_model,
         d.lang AS platform, 'documents' AS dataset
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# Vectors of differing lengths with a class and a generator name.
VECTORS_SQL = """raw_vec AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS v,
         CASE WHEN label IN (0, 1) THEN 'human' ELSE 'ai' END AS label,
         CASE WHEN label IN (0, 1) THEN 'human' ELSE 'g' || label END AS source_model
  FROM embeddings),
normed AS (SELECT *, sqrt(list_inner_product(v, v)) AS len_v FROM raw_vec),
vec AS (SELECT id, label, source_model, list_transform(v, lambda x: x / len_v) AS u FROM normed)"""


def split_sql(source: str) -> str:
    """``splits(id, split)`` of a relation with ``id`` and ``label``."""
    return f"""sizes AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
held AS (SELECT sum(n)::BIGINT AS t, ceil(0.30::DOUBLE * sum(n))::BIGINT AS h FROM sizes),
tested AS (SELECT t, h, ceil(0.50::DOUBLE * h)::BIGINT AS e FROM held),
first_draw AS (SELECT label, n, t, h, e, (n::HUGEINT * (t - h)) // t AS base,
                      (n::HUGEINT * (t - h)) % t AS rem FROM sizes, tested),
trained AS (SELECT label, n, h, e, base + (CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
              <= (t - h) - sum(base) OVER () THEN 1 ELSE 0 END) AS n_train FROM first_draw),
second_draw AS (SELECT label, n, n_train, h, e, ((n - n_train) * (h - e)) // h AS base,
                       ((n - n_train) * (h - e)) % h AS rem FROM trained),
quotas AS (SELECT label, n, n_train, base + (CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
              <= (h - e) - sum(base) OVER () THEN 1 ELSE 0 END) AS n_val FROM second_draw),
ordered AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id)) AS r FROM {source}),
splits AS (SELECT o.id, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_val THEN 'val'
                             ELSE 'test' END AS split
           FROM ordered o JOIN quotas q ON o.label = q.label)"""


def knn_sql(queries: str, candidates: str, k: int, extra: str = "") -> str:
    """``nn(qid, tid, score, label, source_model, rank)``."""
    return f"""pairs AS (
  SELECT q.id AS qid, t.id AS tid, list_inner_product(q.u, t.u) AS score, t.label, t.source_model
  FROM {queries} q JOIN {candidates} t ON true {extra}),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM pairs
       QUALIFY rank <= {k})"""


def metrics_sql(source: str, groups: str) -> str:
    """``result`` with the metric columns from ``source(groups..., label, prediction, confidence)``."""
    by = f"PARTITION BY {groups} " if groups else ""
    lead = f"{groups}, " if groups else ""
    tail = f" GROUP BY {groups}" if groups else ""
    f1 = "(CASE WHEN 2*{0} + {1} > 0 THEN 2.0*{0} / (2*{0} + {1}) ELSE 0 END)"
    y0, x0 = "coalesce(ly, 0)::DOUBLE / p", "coalesce(lx, 0)::DOUBLE / n"
    return f"""hist AS (
  SELECT {lead}confidence AS s, sum((label = 'ai')::INT)::BIGINT AS pos, sum((label <> 'ai')::INT)::BIGINT AS neg,
         sum((label = 'ai' AND prediction = 'ai')::INT)::BIGINT AS tp,
         sum((label <> 'ai' AND prediction = 'ai')::INT)::BIGINT AS fp
  FROM {source} GROUP BY {lead}confidence),
cum AS (SELECT *, sum(pos) OVER ({by}ORDER BY s DESC)::BIGINT AS cp, sum(neg) OVER ({by}ORDER BY s DESC)::BIGINT AS cn,
               sum(pos) OVER ({by})::BIGINT AS np, sum(neg) OVER ({by})::BIGINT AS nn FROM hist),
rated AS (SELECT *, cn::DOUBLE / nullif(nn, 0) AS rate FROM cum),
summed AS (
  SELECT {lead}sum(pos)::BIGINT AS p, sum(neg)::BIGINT AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
         sum(pos * (nn - cn + 0.5 * neg))::DOUBLE AS ordered_pairs,
         max(cn) FILTER (rate <= 0.01) AS lx, max(cp) FILTER (rate <= 0.01) AS ly,
         min(cn) FILTER (rate > 0.01) AS rx, min(cp) FILTER (rate > 0.01) AS ry
  FROM rated{tail}),
result AS (
  SELECT {lead}p + n AS n_records, p AS n_ai, n AS n_human,
         round((tp + n - fp)::DOUBLE / (p + n), 4) AS accuracy,
         CASE WHEN p > 0 AND n > 0 THEN
           round(({f1.format("tp", "(fp + p - tp)")} + {f1.format("(n - fp)", "(p - tp + fp)")}) / 2, 4) END AS macro_f1,
         CASE WHEN p > 0 AND n > 0 THEN round(ordered_pairs / (p::DOUBLE * n), 4) END AS auroc,
         CASE WHEN p > 0 AND n > 0 THEN round(coalesce({y0} + (0.01::DOUBLE - {x0}) * (ry::DOUBLE / p - {y0})
              / (rx::DOUBLE / n - {x0}), {y0}), 4) END AS tpr_at_1fpr
  FROM summed)"""


_U1 = "(concat('0x', substr(md5('42-' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_U2 = "(concat('0x', substr(md5('42-' || id), 9, 8))::BIGINT / 4294967296.0::DOUBLE)"
RANDOM_SQL = f"""predicted AS (
  SELECT id, label, source_model, CASE WHEN {_U1} < 0.5 THEN 'ai' ELSE 'human' END AS prediction,
         CASE WHEN {_U1} < 0.5 THEN 0.3::DOUBLE + 0.4::DOUBLE * {_U2}
              ELSE 1.0::DOUBLE - (0.3::DOUBLE + 0.4::DOUBLE * {_U2}) END AS confidence
  FROM corpus)"""

METRIC_COLUMNS = "n_records, n_ai, n_human, accuracy, macro_f1, auroc, tpr_at_1fpr"


# --------------------------------------------------------------------------- shared inputs


def corpus_view(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("quality") == 1
    return (
        table(spark, folder, "documents")
        .join(table(spark, folder, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            F.when(found, AI).otherwise(HUMAN).alias("label"),
            F.when(found, F.col("source")).otherwise(HUMAN).alias("source_model"),
            F.col("lang").alias("platform"),
            F.lit("documents").alias("dataset"),
        )
    )


def vectors_view(spark: SparkSession, folder: str) -> DataFrame:
    human = F.col("label").isin(0, 1)
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("embedding"),
        F.when(human, HUMAN).otherwise(AI).alias("label"),
        F.when(human, HUMAN).otherwise(F.concat(F.lit("g"), F.col("label").cast("string"))).alias("source_model"),
    )


def split_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors with their split, stored: a neighbour search reads them more than once."""
    return materialize(splits.assign_split(vectors_view(spark, folder)), "vectors", partition_by=["split"])


def held_out(vectors: DataFrame) -> DataFrame:
    return splits.in_split(vectors, splits.VAL, splits.TEST)


def candidates(vectors: DataFrame) -> DataFrame:
    return splits.in_split(vectors, splits.TRAIN)


def raw_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents under the kind of headers a social export has; labels where there are any."""
    joined = documents_to_clean(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("k"),
        F.upper("lang").alias("Network"),
        F.col("text").alias("CONTENT"),
        F.col("lang").alias("post"),
        F.when(F.col("quality") == 1, "AI").when(F.col("quality") == 0, " Human ").alias("Class"),
        F.when(F.col("toxic") == 0, F.col("source")).alias("Generator"),
    )


_RAW_POSTS_SQL = """raw_posts AS (
  SELECT d.doc_id AS k, lower(d.lang) AS platform, d.text AS raw_text,
         CASE WHEN quality = 1 THEN 'ai' WHEN quality = 0 THEN 'human' ELSE 'nan' END AS raw_label,
         CASE WHEN toxic = 0 THEN d.source END AS model
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

POSTS_SQL = f"""{_RAW_POSTS_SQL},
cleaned AS (SELECT *, {clean_sql('raw_text')} AS text FROM raw_posts),
mapped AS (SELECT *, {label_sql('raw_label')} AS label FROM cleaned WHERE {words_sql('text')} >= 5),
posts AS (
  SELECT k, text, label, coalesce(model, CASE WHEN label = 'human' THEN 'human' ELSE 'unknown_ai' END) AS source_model,
         platform, 'multisocial' AS dataset
  FROM mapped WHERE label IS NOT NULL)"""


def raw_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn as a record of answers, one per line: users are people, assistants machines."""
    lines = F.split("text", "\n")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("k"),
        "turn",
        F.when(F.col("role") == "user", lines).alias("human_answers"),
        F.when(F.col("role") == "assistant", lines).otherwise(F.array().cast("array<string>")).alias("chatgpt_answers"),
    )


ANSWERS_SQL = f"""lines AS (
  SELECT conv_id AS k, turn, role, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10)))))::INT AS answer_pos
  FROM conversations WHERE role IN ('user', 'assistant')),
answers AS (
  SELECT k, turn, answer_pos, {clean_sql('line')} AS text,
         CASE WHEN role = 'user' THEN 'human' ELSE 'ai' END AS label,
         CASE WHEN role = 'user' THEN 'human' ELSE 'chatgpt' END AS source_model,
         'qa_forum' AS platform, 'hc3' AS dataset
  FROM lines WHERE {words_sql(clean_sql('line'))} >= 5)"""

MERGED_SQL = f"""{POSTS_SQL}, {ANSWERS_SQL},
merged AS (
  SELECT 0 AS source, k, 0 AS turn, 0 AS answer_pos, text, label, source_model, platform, dataset FROM posts
  UNION ALL
  SELECT 1, k, turn, answer_pos, text, label, source_model, platform, dataset FROM answers),
corpus AS (
  SELECT row_number() OVER (ORDER BY source, k, turn, answer_pos) - 1 AS id, text, label, source_model, platform, dataset
  FROM merged)"""


def merged_rows(spark: SparkSession, folder: str) -> DataFrame:
    posts = normalize.accepted(normalize.align_social(raw_posts(spark, folder), keep=["k"]), keep=["k"])
    answers = normalize.explode_answers(raw_answers(spark, folder), keep=["k", "turn"])
    zero = F.lit(0)
    return normalize.combine(
        posts.select(
            F.lit(0).alias("source"), "k", zero.cast("bigint").alias("turn"), zero.alias("answer_pos"),
            *normalize.CORPUS_FIELDS,
        ),
        answers.select(F.lit(1).alias("source"), "k", "turn", "answer_pos", *normalize.CORPUS_FIELDS),
    )


def merged_corpus(spark: SparkSession, folder: str) -> DataFrame:
    numbered = ranks.dense_ids(merged_rows(spark, folder), order_by=["source", "k", "turn", "answer_pos"])
    return numbered.select("id", *normalize.CORPUS_FIELDS)


def raw_adversarial(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as an adversarial export: some labels and models missing, some labels odd."""
    joined = documents_to_clean(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("k"),
        F.col("text").alias("generation"),
        F.when(F.col("toxic") == 1, "TRUE").when(F.col("quality") == 0, "original").alias("label"),
        F.when(F.col("quality") == 1, F.col("source")).when(F.col("toxic") == 0, " ").alias("model"),
    )


ADVERSARIAL_SQL = f"""raw_adv AS (
  SELECT d.doc_id AS k, {clean_sql('d.text')} AS text,
         CASE WHEN toxic = 1 THEN 'true' WHEN quality = 0 THEN 'original' END AS raw_label,
         CASE WHEN quality = 1 THEN d.source WHEN toxic = 0 THEN '' END AS model
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
adv_label AS (
  SELECT *, CASE WHEN raw_label IS NOT NULL THEN {label_sql('raw_label', "'human','0','false','no'")}
                 WHEN coalesce(model, '') <> '' THEN 'ai' ELSE 'human' END AS label
  FROM raw_adv WHERE {words_sql('text')} >= 5),
adversarial AS (
  SELECT k, text, label, coalesce(model, CASE WHEN label = 'human' THEN 'human' ELSE 'unknown_ai' END) AS source_model,
         'raid' AS platform, 'raid' AS dataset
  FROM adv_label WHERE label IS NOT NULL)"""


def adversarial_rows(spark: SparkSession, folder: str) -> DataFrame:
    aligned = normalize.align_adversarial(raw_adversarial(spark, folder), keep=["k"])
    return normalize.accepted(aligned, keep=["k"])


# --------------------------------------------------------------------------- text and normalization


@query(
    f"""SELECT page_id, {clean_sql('url')} AS clean_url, {clean_sql('html')} AS clean_html,
       {words_sql(clean_sql('html'))}::INT AS n_words FROM pages"""
)
def clean_page_text(spark, folder):
    pages = spread(table(spark, folder, "pages"), "page_id").select(
        "page_id", clean_text(F.col("url")).alias("clean_url"), clean_text(F.col("html")).alias("clean_html")
    )
    return pages.withColumn("n_words", word_count(F.col("clean_html")))


@query(
    f"""WITH c AS (SELECT doc_id, {clean_sql('text')} AS text FROM documents)
SELECT doc_id, text, {words_sql('text')}::INT AS n_words FROM c WHERE {words_sql('text')} >= 5"""
)
def min_words(spark, folder):
    cleaned = documents_to_clean(spark, folder).select("doc_id", clean_text(F.col("text")).alias("text"))
    return normalize.long_enough(cleaned).withColumn("n_words", word_count(F.col("text")))


@query(f"WITH {POSTS_SQL} SELECT * FROM posts")
def discover_columns(spark, folder):
    return normalize.accepted(normalize.align_social(raw_posts(spark, folder), keep=["k"]), keep=["k"])


@query(f"WITH {MERGED_SQL} SELECT source, k, turn, answer_pos, text, label, source_model, platform, dataset FROM merged")
def normalize_corpus(spark, folder):
    return merged_rows(spark, folder)


@query(f"WITH {ADVERSARIAL_SQL} SELECT * FROM adversarial")
def normalize_eval(spark, folder):
    return adversarial_rows(spark, folder)


@query(f"WITH {ANSWERS_SQL} SELECT * FROM answers")
def explode_answers(spark, folder):
    return normalize.explode_answers(raw_answers(spark, folder), keep=["k", "turn"])


@query(
    f"""WITH {ADVERSARIAL_SQL},
counts AS (SELECT raw_label, count(*) AS n FROM (
    SELECT role AS raw_label, {clean_sql('text')} AS text FROM conversations WHERE role NOT IN ('user', 'assistant'))
    WHERE {words_sql('text')} >= 5 GROUP BY raw_label
  UNION ALL
  SELECT raw_label, count(*) FROM adv_label WHERE label IS NULL GROUP BY raw_label)
SELECT raw_label, n, sum(n) OVER ()::BIGINT AS n_total FROM counts ORDER BY n DESC, raw_label LIMIT 10"""
)
def unknown_labels(spark, folder):
    role = F.col("role")
    turns = table(spark, folder, "conversations").select(
        "text", F.when(role == "user", "human").when(role == "assistant", "AI").otherwise(role).alias("label")
    )
    social = normalize.align_social(turns)
    adversarial = normalize.align_adversarial(raw_adversarial(spark, folder).drop("k"))
    return normalize.unknown_label_tally(social.unionByName(adversarial))


@query(
    f"""WITH {ADVERSARIAL_SQL},
p_raw AS (SELECT *, {clean_sql('raw_text')} AS text FROM (
  SELECT d.text AS raw_text, CASE WHEN quality = 1 THEN 'ai' WHEN quality = 0 THEN 'human' ELSE 'nan' END AS raw_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)),
p_label AS (SELECT *, {label_sql('raw_label')} AS label FROM p_raw WHERE {words_sql('text')} >= 5)
SELECT 'social' AS source, (SELECT count(*) FROM p_raw) AS n_read, (SELECT count(*) FROM p_raw) - count(*) AS n_short,
       count(*) FILTER (label IS NULL) AS n_unknown, count(label) AS n_accepted FROM p_label
UNION ALL
SELECT 'adversarial', (SELECT count(*) FROM raw_adv), (SELECT count(*) FROM raw_adv) - count(*),
       count(*) FILTER (label IS NULL), count(label) FROM adv_label"""
)
def corpus_tallies(spark, folder):
    """Rows read, too short, unknown and accepted, counted while both sources are written."""
    tallies = normalize.Tallies()
    social = tallies.align("social", raw_posts(spark, folder), keep=["k"])
    adversarial = tallies.align(
        "adversarial", raw_adversarial(spark, folder), normalize.align_adversarial,
        headers=normalize.ADVERSARIAL_HEADERS, keep=["k"],
    )
    writers.write_corpus(normalize.combine(social, adversarial), scratch_path(spark, "tallied"), "parquet")
    return tallies.report(spark)


@query(
    f"""WITH {MERGED_SQL},
long AS (SELECT 'label' AS dimension, label AS value FROM corpus
         UNION ALL SELECT 'dataset', dataset FROM corpus UNION ALL SELECT 'platform', platform FROM corpus)
SELECT dimension, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dimension), 6)::DOUBLE AS pct
FROM long GROUP BY dimension, value"""
)
def corpus_stats(spark, folder):
    return reports.counts_by(merged_rows(spark, folder)).withColumn("pct", F.round("pct", 6))


@query(
    f"""WITH {MERGED_SQL}
SELECT dataset, sum((label = 'ai')::INT)::BIGINT AS n_ai, sum((label = 'human')::INT)::BIGINT AS n_human, count(*) AS n,
       grouping(dataset)::INT AS is_total, round(100.0 * count(*) / (SELECT count(*) FROM corpus), 6)::DOUBLE AS pct
FROM corpus GROUP BY ROLLUP (dataset)"""
)
def composition(spark, folder):
    return reports.composition(merged_rows(spark, folder)).withColumn("pct", F.round("pct", 6))


# --------------------------------------------------------------------------- ids, splits, samples


@query("SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS id, doc_id, lang, n_chars FROM documents")
def dense_ids(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return ranks.dense_ids(rows, order_by=["lang", "doc_id"])


@query(
    f"""WITH {CORPUS_SQL}
SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7-' || id)) AS rank FROM corpus"""
)
def seeded_rank(spark, folder):
    return ranks.hash_rank(corpus_view(spark, folder).select("id", "label"), strata=["label"], seed=7)


@query(f"WITH {CORPUS_SQL}, {split_sql('corpus')} SELECT id, split FROM splits")
def stratified_split(spark, folder):
    return splits.stratified_split(corpus_view(spark, folder))


@query(
    f"""WITH {CORPUS_SQL}, {split_sql('corpus')}
SELECT split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM splits GROUP BY split"""
)
def split_counts(spark, folder):
    return reports.split_counts(splits.stratified_split(corpus_view(spark, folder))).withColumn(
        "pct", F.round("pct", 6)
    )


@query(
    f"""WITH {CORPUS_SQL}, {split_sql('corpus')},
train AS (SELECT c.id, c.label FROM corpus c JOIN splits s ON c.id = s.id WHERE split = 'train'),
smaller AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM train GROUP BY label)),
drawn AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id)) AS r FROM train)
SELECT id, label FROM drawn, smaller WHERE r <= m"""
)
def undersample(spark, folder):
    train = splits.in_split(splits.assign_split(corpus_view(spark, folder).select("id", "label")), splits.TRAIN)
    return sampling.undersample(train.select("id", "label"))


SAMPLE_SIZES = (100, 250, 500, 1000)


@query(
    f"""WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('42-' || doc_id)) AS r FROM documents)
SELECT n AS sample_size, id FROM r JOIN (SELECT unnest([{', '.join(map(str, SAMPLE_SIZES))}])::BIGINT AS n) ON r <= n"""
)
def scaling_samples(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return sampling.nested_samples(rows, SAMPLE_SIZES)


@query(
    f"""WITH {CORPUS_SQL}, {split_sql('corpus')},
train AS (SELECT c.label FROM corpus c JOIN splits s ON c.id = s.id WHERE split = 'train')
SELECT n_ai, n_human, round(n_ai::DOUBLE / n_human, 6) AS ratio FROM (
  SELECT sum((label = 'ai')::INT)::BIGINT AS n_ai, sum((label = 'human')::INT)::BIGINT AS n_human FROM train)"""
)
def class_ratio(spark, folder):
    # The split from a stored table, as one made elsewhere would be.
    corpus = corpus_view(spark, folder).select("id", "label")
    stored = materialize(splits.stratified_split(corpus), "splits")
    train = splits.in_split(splits.with_split(corpus, stored), splits.TRAIN)
    return reports.class_ratio(train).withColumn("ratio", F.round("ratio", 6))


# --------------------------------------------------------------------------- scenarios


def merged_with_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_split(merged_corpus(spark, folder))


_JOINED_SQL = f"{MERGED_SQL}, {split_sql('corpus')}, joined AS (SELECT c.*, split FROM corpus c JOIN splits s ON c.id = s.id)"


def _holdout_sql(column: str, value: str) -> str:
    return f"""WITH {_JOINED_SQL}
SELECT id, 'test' AS split FROM joined WHERE {column} = '{value}'
UNION ALL SELECT id, split FROM joined WHERE {column} <> '{value}' AND split IN ('train', 'val')"""


def _holdout(spark: SparkSession, folder: str, column: str, value: str) -> DataFrame:
    rows = merged_with_split(spark, folder)
    tested = splits.holdout_test(rows, column, value).withColumn("split", F.lit(splits.TEST))
    return tested.unionByName(splits.holdout_splits(rows, column, value))


@query(_holdout_sql("source_model", "chatgpt"))
def holdout_model(spark, folder):
    return _holdout(spark, folder, "source_model", splits.HOLDOUT_MODEL)


@query(_holdout_sql("platform", "qa_forum"))
def holdout_platform(spark, folder):
    return _holdout(spark, folder, "platform", splits.HOLDOUT_PLATFORM)


@query(
    f"""WITH {_JOINED_SQL}
SELECT 'cross_model_chatgpt' AS scenario, id, split FROM joined WHERE source_model <> 'chatgpt' AND split <> 'test'
UNION ALL
SELECT 'cross_platform_qa_forum', id, split FROM joined WHERE platform <> 'qa_forum' AND split <> 'test'"""
)
def reduced_splits(spark, folder):
    return splits.reduced_splits(merged_with_split(spark, folder))


_SCENARIOS_SQL = f"""{_JOINED_SQL}, {ADVERSARIAL_SQL},
scenarios AS (
  SELECT 'standard' AS scenario, id, label FROM joined WHERE split = 'test'
  UNION ALL SELECT 'cross_model_chatgpt', id, label FROM joined WHERE source_model = 'chatgpt'
  UNION ALL SELECT 'cross_platform_qa_forum', id, label FROM joined WHERE platform = 'qa_forum'
  UNION ALL SELECT 'short_text', id, label FROM joined WHERE split = 'test' AND {words_sql('text')} < 100
  UNION ALL SELECT 'adversarial_raid', row_number() OVER (ORDER BY k) - 1, label FROM adversarial)"""


def scenario_members(spark: SparkSession, folder: str) -> DataFrame:
    adversarial = ranks.dense_ids(adversarial_rows(spark, folder).select("k", "label"), order_by=["k"])
    return splits.scenarios(merged_with_split(spark, folder), adversarial)


@query(f"WITH {_SCENARIOS_SQL} SELECT scenario, id, label FROM scenarios")
def scenarios(spark, folder):
    return scenario_members(spark, folder)


@query(f"WITH {_SCENARIOS_SQL} SELECT scenario, label, count(*) AS n FROM scenarios GROUP BY scenario, label")
def scenario_counts(spark, folder):
    return reports.scenario_counts(scenario_members(spark, folder))


# --------------------------------------------------------------------------- vectors and neighbours


@query(
    f"""WITH {VECTORS_SQL}
SELECT id, unnest(range(len(u)))::INT AS pos, round(unnest(u), 6) AS value FROM vec"""
)
def l2_normalized(spark, folder):
    unit = vectors_view(spark, folder).select("id", l2_normalize(F.col("embedding")).alias("u"))
    return unit.select("id", F.posexplode("u").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {VECTORS_SQL}
SELECT a.id AS left_id, b.id AS right_id, round(list_inner_product(a.u, b.u), 6) AS score
FROM vec a JOIN vec b ON b.id = a.id + 1"""
)
def cosine_pairs(spark, folder):
    vectors = vectors_view(spark, folder)
    left = vectors.select(F.col("id").alias("left_id"), F.col("embedding").alias("a"))
    right = vectors.select(F.col("id").alias("right_id"), F.col("embedding").alias("b"))
    pairs = left.join(right, F.col("right_id") == F.col("left_id") + 1)
    return pairs.select("left_id", "right_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))


_SPLIT_VECTORS_SQL = f"""{VECTORS_SQL}, {split_sql('vec')},
labelled AS (SELECT v.*, split FROM vec v JOIN splits s ON v.id = s.id),
train AS (SELECT * FROM labelled WHERE split = 'train'),
asked AS (SELECT * FROM labelled WHERE split <> 'train')"""

_VOTING_SQL = f"{_SPLIT_VECTORS_SQL}, {knn_sql('asked', 'train', 10)}"
_NEIGHBOURS_SQL = "SELECT qid, tid, round(score, 6) AS score, rank::INT AS rank FROM nn"


def _rounded(neighbours: DataFrame) -> DataFrame:
    return neighbours.select("qid", "tid", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VOTING_SQL} {_NEIGHBOURS_SQL}")
def knn_broadcast(spark, folder):
    vectors = split_vectors(spark, folder)
    return _rounded(knn_join(held_out(vectors), candidates(vectors), 10, strategy="broadcast"))


# Small enough for a grid of several cells on the test tables.
GRID_BLOCK_BYTES = 128 * 1024


@query(f"WITH {_VOTING_SQL} {_NEIGHBOURS_SQL}")
def knn_block(spark, folder):
    vectors = split_vectors(spark, folder)
    return _rounded(
        knn_join(held_out(vectors), candidates(vectors), 10, strategy="block", block_bytes=GRID_BLOCK_BYTES)
    )


@query(f"WITH {_VOTING_SQL} {_NEIGHBOURS_SQL}")
def knn_pruned(spark, folder):
    vectors = split_vectors(spark, folder)
    return _rounded(
        knn_join(held_out(vectors), candidates(vectors), 10, strategy="pruned", block_bytes=GRID_BLOCK_BYTES)
    )


@query(f"WITH {_SPLIT_VECTORS_SQL}, {knn_sql('labelled', 'train', 10, 'AND q.id <> t.id')} {_NEIGHBOURS_SQL}")
def knn_self_excluded(spark, folder):
    vectors = split_vectors(spark, folder)
    return _rounded(knn_join(vectors, candidates(vectors), 10, exclude_self=True))


@query(
    f"""WITH {_SPLIT_VECTORS_SQL}, early AS (SELECT * FROM train WHERE id % 3 > 0), {knn_sql('asked', 'early', 10)},
searches AS (SELECT 1 AS step, * FROM nn UNION ALL SELECT 2, * FROM (
  SELECT q.id AS qid, t.id AS tid, list_inner_product(q.u, t.u) AS score, t.label, t.source_model,
         row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.u, t.u) DESC, t.id) AS rank
  FROM asked q JOIN train t ON true QUALIFY rank <= 10))
SELECT step, qid, tid, round(score, 6) AS score, label, rank::INT AS rank FROM searches"""
)
def knn_stored(spark, folder):
    """A store of two thirds of the candidates is searched, gets the rest, and is searched again."""
    vectors = split_vectors(spark, folder)
    early = F.col("id") % 3 > 0
    store = CandidateStore.create(candidates(vectors).filter(early), scratch_path(spark, "candidates"), carry=["label"])
    first = store.search(held_out(vectors), 10)
    store.append(candidates(vectors).filter(~early), "late")
    second = store.search(held_out(vectors), 10, ship_bytes=0, block_bytes=GRID_BLOCK_BYTES)
    steps = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return steps.select("step", "qid", "tid", F.round("score", 6).alias("score"), "label", "rank")


_BALANCED_SQL = """smaller AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM train GROUP BY label)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id)) AS r FROM train),
balanced AS (SELECT * EXCLUDE (r, m) FROM drawn, smaller WHERE r <= m),
balanced_asked AS (SELECT * FROM balanced UNION ALL SELECT * FROM asked)"""


@query(
    f"""WITH {_SPLIT_VECTORS_SQL}, {_BALANCED_SQL},
{knn_sql('balanced_asked', 'balanced', 10, 'AND q.id <> t.id')} {_NEIGHBOURS_SQL}"""
)
def knn_balanced(spark, folder):
    vectors = split_vectors(spark, folder)
    balanced = materialize(sampling.undersample(candidates(vectors)), "balanced")
    queries = balanced.unionByName(held_out(vectors))
    return _rounded(knn_join(queries, balanced, 10, exclude_self=True))


def voting(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = split_vectors(spark, folder)
    queries = held_out(vectors)
    return queries, knn_join(queries, candidates(vectors), 10, carry=["label", "source_model"])


_VOTES_SQL = f"""{_VOTING_SQL},
votes AS (SELECT qid AS id, sum((label = 'ai')::INT)::BIGINT AS ai_votes, count(*) AS total_votes FROM nn GROUP BY qid),
voted AS (SELECT id, ai_votes, total_votes,
                 CASE WHEN ai_votes >= total_votes - ai_votes THEN 'ai' ELSE 'human' END AS prediction,
                 ai_votes::DOUBLE / total_votes AS confidence FROM votes)"""


@query(f"WITH {_VOTES_SQL} SELECT id, ai_votes, total_votes, prediction, round(confidence, 6) AS confidence FROM voted")
def knn_vote(spark, folder):
    return classify.knn_vote(*voting(spark, folder)).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH {_VOTES_SQL}
SELECT qid, CASE WHEN prediction = 'ai' THEN 'AI-generated' ELSE 'Human-written' END AS verdict,
       round(confidence, 6) AS confidence,
       total_votes || ' similar texts found, ' || ai_votes || ' were AI-generated' AS summary, evidence
FROM voted JOIN (SELECT qid, string_agg(rank || ':' || tid || ':' || label, ',' ORDER BY rank) AS evidence
                 FROM nn GROUP BY qid) ON id = qid"""
)
def knn_evidence(spark, folder):
    _, neighbours = voting(spark, folder)
    found = classify.knn_evidence(neighbours)
    shown = F.transform("evidence", lambda e: F.concat_ws(":", e["rank"].cast("string"), e["tid"].cast("string"), e["label"]))
    return found.select("qid", "verdict", F.round("confidence", 6).alias("confidence"), "summary",
                        F.array_join(shown, ",").alias("evidence"))


@query(
    f"""WITH {_VOTING_SQL}, counts AS (SELECT qid, source_model, count(*) AS n FROM nn GROUP BY qid, source_model)
SELECT qid, source_model, n FROM counts QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, source_model) = 1"""
)
def knn_attribution(spark, folder):
    _, neighbours = voting(spark, folder)
    return classify.knn_attribution(neighbours)


# --------------------------------------------------------------------------- prompts


PROMPT_DIMENSIONS = 256
# Most label rows that are shipped to the texts, some 40 bytes each; beyond that the texts are shuffled.
SHIPPED_LABELS = 1_600_000


def prompt_corpus(spark: SparkSession, folder: str, *, store: bool = True) -> DataFrame:
    """All documents, cleaned, with their own label and source; without a label they are human.

    The embedding and the prompts read the texts, the split reads ids and labels only.  Without ``store`` texts
    are cleaned each time they are read, unless each reading would shuffle them.
    """
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("_ai"))
    docs = table(spark, folder, "documents")
    dealt = spread(docs, "doc_id")
    shipped = labels.count() <= SHIPPED_LABELS
    joined = dealt.join(F.broadcast(labels) if shipped else labels, "doc_id", "left")
    ai = F.coalesce("_ai", F.lit(False))
    corpus = joined.select(
        F.col("doc_id").alias("id"),
        clean_text(F.col("text")).alias("text"),
        F.when(ai, AI).otherwise(HUMAN).alias("label"),
        F.when(ai, F.col("source")).otherwise(HUMAN).alias("source_model"),
    )
    corpus = splits.assign_split(corpus)
    store = store or not shipped or dealt is not docs
    return materialize(corpus, "corpus", compression="zstd") if store else corpus


def prompt_inputs(spark: SparkSession, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """The split corpus and the vectors of its whole texts."""
    corpus = prompt_corpus(spark, folder, **options)
    return corpus, embed_missing(corpus, scratch_path(spark, "embeddings"), HashingEmbedder(PROMPT_DIMENSIONS))


_HEAD = "'You are a classifier that determines whether a social media post was written by a human or generated by AI.' || chr(10) || chr(10)"
_CUT = "(CASE WHEN length({0}) > 300 THEN substr({0}, 1, 300) || '...' ELSE {0} END)"
_BUCKET_SQL = "(concat('0x', substr(md5(term), 1, 8))::BIGINT % {0})"
# Term counts of whole cleaned texts by hash bucket, scaled to length one.
_DOCS_SQL = f"""cleaned AS (
  SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'ai' ELSE 'human' END AS label,
         CASE WHEN l.quality = 1 THEN d.source ELSE 'human' END AS source_model, {clean_sql('d.text')} AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
weights AS (
  SELECT id, {_BUCKET_SQL.format(PROMPT_DIMENSIONS)} AS b, count(*) AS n
  FROM (SELECT id, unnest(string_split(lower(text), ' ')) AS term FROM cleaned) WHERE term <> '' GROUP BY ALL),
dense AS (
  SELECT c.id, list(coalesce(n, 0)::DOUBLE ORDER BY r.b) AS v
  FROM cleaned c JOIN (SELECT unnest(range({PROMPT_DIMENSIONS})) AS b) r ON true
  LEFT JOIN weights w ON w.id = c.id AND w.b = r.b GROUP BY c.id),
sized AS (SELECT *, sqrt(list_inner_product(v, v)) AS len_v FROM dense),
docs AS (
  SELECT c.*, CASE WHEN len_v > 0 THEN list_transform(v, lambda x: x / len_v) ELSE v END AS u
  FROM cleaned c JOIN sized s ON c.id = s.id), {split_sql('docs')},
labelled AS (SELECT v.*, split FROM docs v JOIN splits s ON v.id = s.id),
train AS (SELECT * FROM labelled WHERE split = 'train'),
asked AS (SELECT * FROM labelled WHERE split <> 'train')"""


def _context_sql(queries: str, train: str) -> str:
    return f"""{knn_sql(queries, train, 5, 'AND q.id <> t.id')},
context AS (
  SELECT qid, string_agg('Example ' || rank || ' (label: ' || d.label || '):' || chr(10) || {_CUT.format('d.text')},
                         chr(10) || chr(10) ORDER BY rank) AS context
  FROM nn JOIN docs d ON nn.tid = d.id GROUP BY qid)"""


_RAG = f"""{_HEAD} || 'Here are some similar texts and their labels for reference:' || chr(10) || chr(10)
  || coalesce(context, '') || chr(10) || chr(10) || 'Now classify the following post as either ''ai'' or ''human''.'
  || chr(10) || chr(10) || 'Post: ' || text"""
_PLAIN = f"""{_HEAD} || 'Classify the following post as either ''ai'' or ''human''.'
  || chr(10) || chr(10) || 'Post: ' || text"""


def _records_sql(queries: str, train: str) -> str:
    return f"""{_context_sql(queries, train)},
records AS (
  SELECT id, split, 'with_rag' AS variant, {_RAG} AS instruction, label AS output
  FROM {queries} q LEFT JOIN context c ON q.id = c.qid
  UNION ALL SELECT id, split, 'without_rag', {_PLAIN}, label FROM {queries})"""


@query(f"SELECT doc_id, {_CUT.format('text')} AS text FROM documents")
def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", truncate(F.col("text")).alias("text"))


@query(f"WITH {_DOCS_SQL}, {_context_sql('labelled', 'train')} SELECT qid, context FROM context")
def rag_context(spark, folder):
    corpus, vectors = prompt_inputs(spark, folder)
    stored = training.labelled_vectors(corpus, vectors)
    neighbours = knn_join(stored, candidates(stored), prompts.SHOWN, exclude_self=True)
    return prompts.rag_context(neighbours, corpus)


@query(
    f"""WITH {_DOCS_SQL}, {_context_sql('labelled', 'train')}
SELECT id, {_RAG} AS instruction, label AS output FROM labelled q LEFT JOIN context c ON q.id = c.qid"""
)
def rag_prompts(spark, folder):
    corpus, vectors = prompt_inputs(spark, folder)
    stored = training.labelled_vectors(corpus, vectors)
    neighbours = knn_join(stored, candidates(stored), prompts.SHOWN, exclude_self=True)
    return prompts.rag_prompts(corpus, neighbours, corpus)


@query(f"WITH {CORPUS_SQL} SELECT id, {_PLAIN} AS instruction, label AS output FROM corpus")
def plain_prompts(spark, folder):
    return prompts.plain_prompts(corpus_view(spark, folder))


@query(f"WITH {_DOCS_SQL}, {_records_sql('labelled', 'train')} SELECT * FROM records")
def training_records(spark, folder):
    return training.training_records(*prompt_inputs(spark, folder))


@query(f"WITH {_DOCS_SQL}, {_BALANCED_SQL}, {_records_sql('balanced_asked', 'balanced')} SELECT * FROM records")
def balanced_records(spark, folder):
    return training.training_records(*prompt_inputs(spark, folder), balanced=True)


@query(
    f"""WITH {_DOCS_SQL}, {_BALANCED_SQL}, {_records_sql('balanced_asked', 'balanced')}
SELECT split, variant, output, count(*) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split, variant), 6)::DOUBLE AS pct
FROM records GROUP BY split, variant, output"""
)
def prompt_label_counts(spark, folder):
    records = training.training_records(*prompt_inputs(spark, folder), balanced=True)
    return reports.output_counts(records).withColumn("pct", F.round("pct", 6))


# --------------------------------------------------------------------------- predictors and metrics


@query(f"WITH {CORPUS_SQL}, {RANDOM_SQL} SELECT id, prediction, round(confidence, 9) AS confidence FROM predicted")
def random_baseline(spark, folder):
    return classify.random_baseline(corpus_view(spark, folder)).withColumn("confidence", F.round("confidence", 9))


def random_predictions(spark: SparkSession, folder: str) -> DataFrame:
    corpus = corpus_view(spark, folder)
    return corpus.select("id", "label", "source_model").join(classify.random_baseline(corpus), "id")


@query(f"WITH {CORPUS_SQL}, {RANDOM_SQL}, {metrics_sql('predicted', '')} SELECT {METRIC_COLUMNS} FROM result")
def metrics_overall(spark, folder):
    return metrics.metrics(random_predictions(spark, folder))


_BY_SOURCE_SQL = f"""WITH {{inputs}},
graded AS (SELECT source_model, 0 AS overall, label, prediction, confidence FROM predicted
           UNION ALL SELECT '', 1, label, prediction, confidence FROM predicted),
{metrics_sql('graded', 'overall, source_model')}
SELECT CASE WHEN overall = 0 THEN source_model END AS source_model, {METRIC_COLUMNS} FROM result"""


@query(_BY_SOURCE_SQL.format(inputs=f"{CORPUS_SQL}, {RANDOM_SQL}"))
def metrics_by_source(spark, folder):
    return metrics.metrics_by_source(random_predictions(spark, folder))


@query(
    f"""WITH {_VOTES_SQL},
predicted AS (SELECT a.split, a.label, v.prediction, v.confidence FROM asked a JOIN voted v ON a.id = v.id),
{metrics_sql('predicted', 'split')} SELECT split, 10 AS k, {METRIC_COLUMNS} FROM result"""
)
def metrics_by_split(spark, folder):
    return evaluation.knn_baseline(split_vectors(spark, folder))


@query(
    f"""WITH {CORPUS_SQL}, {RANDOM_SQL},
hist AS (SELECT confidence AS s, sum((label = 'ai')::INT) AS pos, sum((label <> 'ai')::INT) AS neg FROM predicted GROUP BY 1),
cum AS (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn,
               sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM hist)
SELECT round(s, 9) AS threshold, round(cn::DOUBLE / nn, 9) AS fpr, round(cp::DOUBLE / np, 9) AS tpr FROM cum
UNION ALL SELECT NULL, 0, 0"""
)
def roc_curve(spark, folder):
    curve = metrics.roc_curve(random_predictions(spark, folder))
    return curve.select(*[F.round(c, 9).alias(c) for c in ("threshold", "fpr", "tpr")])


def length_predictor(texts: list[str]) -> list[dict]:
    """A stand-in for a model: longer texts look more like ai."""
    return [
        {"prediction": AI if len(t) > 1000 else HUMAN, "confidence": len(t) / (len(t) + 1000.0)} for t in texts
    ]


@query(
    _BY_SOURCE_SQL.format(
        inputs=f"""{CORPUS_SQL},
predicted AS (SELECT source_model, label, CASE WHEN length(text) > 1000 THEN 'ai' ELSE 'human' END AS prediction,
                     length(text)::DOUBLE / (length(text) + 1000.0::DOUBLE) AS confidence FROM corpus)"""
    )
)
def evaluate_predictor(spark, folder):
    return evaluation.evaluate(classify.batch_predictor(length_predictor), corpus_view(spark, folder))


# --------------------------------------------------------------------------- embedding


EMBED_DIMENSIONS = 256

_TERMS_SQL = f"""terms AS (
  SELECT id, term, (concat('0x', substr(md5(term), 1, 8))::BIGINT % {EMBED_DIMENSIONS})::INT AS bucket
  FROM (SELECT doc_id AS id, unnest(string_split(lower({clean_sql('text')}), ' ')) AS term FROM documents)
  WHERE term <> '')"""
_TOTALS_SQL = f"""WITH {_TERMS_SQL}
SELECT d.doc_id AS id, count(DISTINCT bucket) AS n_buckets, count(bucket)::DOUBLE AS n_terms
FROM documents d LEFT JOIN terms t ON d.doc_id = t.id GROUP BY d.doc_id"""


def cleaned_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents_to_clean(spark, folder).select(
        F.col("doc_id").alias("id"), clean_text(F.col("text")).alias("text"), "lang"
    )


def embedding_totals(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        "id",
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("n_buckets"),
        F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("n_terms"),
    )


@query(f"WITH {_TERMS_SQL} SELECT id, bucket, count(*)::DOUBLE AS weight FROM terms GROUP BY id, bucket")
def hash_embed(spark, folder):
    vectors = embed(cleaned_documents(spark, folder), HashingEmbedder(EMBED_DIMENSIONS), batched=True)
    parts = vectors.select("id", F.posexplode("embedding").alias("bucket", "weight"))
    return parts.filter(F.col("weight") > 0).withColumn("weight", F.col("weight").cast("double"))


@query(_TOTALS_SQL)
def embed_resume(spark, folder):
    """A first run over one language, then a run over everything that only does the rest."""
    rows = cleaned_documents(spark, folder)
    store = scratch_path(spark, "embeddings")
    embedder = HashingEmbedder(EMBED_DIMENSIONS)
    embed_missing(rows.filter(F.col("lang") == "en"), store, embedder)
    return embedding_totals(embed_missing(rows, store, embedder, chunks=2))


def interrupted_embedder(texts: list[str]) -> np.ndarray:
    """A service that refuses some texts."""
    if any(len(t) % 50 == 7 for t in texts):
        raise OSError("the service is down")
    return HashingEmbedder(EMBED_DIMENSIONS)(texts)


@query(_TOTALS_SQL.replace("AS n_terms", "AS n_terms, 1::BIGINT AS n_vectors"))
def embed_interrupted(spark, folder):
    """A run that fails in the middle, and one that goes on with what is missing: one vector per text."""
    rows = cleaned_documents(spark, folder)
    store = scratch_path(spark, "embeddings")
    with suppress(PythonException):
        embed_missing(rows, store, interrupted_embedder, batch_size=4, save_every=64, attempts=2, wait=0)
    # As a callable, so that it is the Python form that goes on.
    done = embed_missing(rows, store, lambda texts: HashingEmbedder(EMBED_DIMENSIONS)(texts))
    totals = embedding_totals(done)
    return totals.groupBy("id", "n_buckets", "n_terms").agg(F.count("*").alias("n_vectors"))


# --------------------------------------------------------------------------- streams


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them."""
    schema = table(spark, folder, name).schema
    # A stream does not take a plain path that is a file, but takes a pattern that matches one.
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")


def finish(stream, spark: SparkSession, path: str) -> DataFrame:
    stream.awaitTermination()
    return spark.read.parquet(path)


@query(
    f"""WITH c AS (SELECT doc_id, {clean_sql('text')} AS text, source FROM documents)
SELECT doc_id, text, 'human' AS label, source AS source_model, 'unknown' AS platform, 'multisocial' AS dataset
FROM c WHERE {words_sql('text')} >= 5"""
)
def stream_normalized(spark, folder):
    path = scratch_path(spark, "stream-corpus")
    raw = stream_table(spark, folder, "documents")
    return finish(stream_normalize(raw, path, scratch_path(spark, "state"), keep=("doc_id",)), spark, path)


@query(_TOTALS_SQL)
def stream_embedded(spark, folder):
    path = scratch_path(spark, "stream-embeddings")
    raw = stream_table(spark, folder, "documents")
    rows = raw.select(F.col("doc_id").alias("id"), clean_text(F.col("text")).alias("text"))
    query = stream_embed(rows, HashingEmbedder(EMBED_DIMENSIONS), path, scratch_path(spark, "state"))
    return embedding_totals(finish(query, spark, path))


_STREAM_SCORE_SQL = f"""WITH {VECTORS_SQL}, {split_sql('vec')},
train AS (SELECT v.* FROM vec v JOIN splits s ON v.id = s.id WHERE split = 'train'), {knn_sql('vec', 'train', 10)}
SELECT qid AS id, sum((label = 'ai')::INT)::BIGINT AS ai_votes, count(*) AS total_votes,
       CASE WHEN 2 * sum((label = 'ai')::INT) >= count(*) THEN 'ai' ELSE 'human' END AS prediction,
       round(sum((label = 'ai')::INT)::DOUBLE / count(*), 6) AS confidence FROM nn GROUP BY qid"""


def _stream_scored(spark: SparkSession, folder: str, **options) -> DataFrame:
    train = candidates(split_vectors(spark, folder))
    arriving = stream_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("embedding"),
    )
    path = scratch_path(spark, "stream-scores")
    done = finish(stream_score(arriving, train, path, scratch_path(spark, "state"), **options), spark, path)
    return done.select("id", "ai_votes", "total_votes", "prediction", F.round("confidence", 6).alias("confidence"))


@query(_STREAM_SCORE_SQL)
def stream_scored(spark, folder):
    return _stream_scored(spark, folder)


@query(_STREAM_SCORE_SQL)
def stream_scored_by_batch(spark, folder):
    """The form for candidate tables that are too large to ship."""
    return _stream_scored(spark, folder, broadcast_bytes=0)


@query(f"WITH {CORPUS_SQL}, {split_sql('corpus')} SELECT id, split FROM splits")
def split_increments(spark, folder):
    """The split of a corpus that arrives in three parts, one of them twice."""
    corpus = corpus_view(spark, folder).select("id", "label")
    growing = GrowingSplit(spark, scratch_path(spark, "split"))
    for part in (0, 1, 1, 2):
        growing.add(corpus.filter(F.col("id") % 3 == part), f"part{part}")
    return growing.assign(corpus).select("id", "split")


@query("SELECT row_number() OVER (ORDER BY doc_id % 3, lang, doc_id) - 1 AS id, doc_id, lang FROM documents")
def dense_ids_increments(spark, folder):
    """Dense ids of documents that arrive in three parts, one of them twice."""
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    growing = GrowingIds(spark, scratch_path(spark, "numbered"))
    for part in (0, 1, 1, 2):
        growing.add(rows.filter(F.col("doc_id") % 3 == part), f"part{part}", ["lang", "doc_id"])
    return growing.rows("id BIGINT, doc_id BIGINT, lang STRING")


@query(_BY_SOURCE_SQL.format(inputs=f"{CORPUS_SQL}, {RANDOM_SQL}"))
def stream_metrics_by_source(spark, folder):
    """Metrics of predictions that arrive in several files, one micro-batch each."""
    path = scratch_path(spark, "predictions")
    predictions = random_predictions(spark, folder).select("id", "label", "source_model", "prediction", "confidence")
    predictions.repartition(3, "id").write.parquet(path)
    arriving = spark.readStream.schema(predictions.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state = GrowingMetrics(spark, scratch_path(spark, "metrics"))
    stream_metrics(arriving, state, scratch_path(spark, "state")).awaitTermination()
    return state.by_source()


# --------------------------------------------------------------------------- checks


@query(
    """SELECT count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS n_both,
       count(*) FILTER (e.vec_id IS NULL) AS n_left_only, count(*) FILTER (d.doc_id IS NULL) AS n_right_only,
       0::BIGINT AS n_repeated,
       count(*) FILTER (e.vec_id IS NULL OR d.doc_id IS NULL) = 0 AS ok
FROM documents d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id"""
)
def check_alignment(spark, folder):
    left = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return checks.check_alignment(left, table(spark, folder, "embeddings").select(F.col("vec_id").alias("id")))


@query(
    """SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS n_records,
       count(*) FILTER (l.doc_id IS NOT NULL AND e.vec_id IS NULL) AS n_missing,
       count(*) FILTER (l.doc_id IS NULL) AS n_unexpected, 0::BIGINT AS n_repeated,
       count(*) FILTER (l.doc_id IS NULL OR e.vec_id IS NULL) = 0 AS ok
FROM labels l FULL OUTER JOIN embeddings e ON l.doc_id = e.vec_id"""
)
def check_predictions(spark, folder):
    records = table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return checks.check_predictions(records, table(spark, folder, "embeddings").select(F.col("vec_id").alias("id")))


@query(
    f"""WITH {_SPLIT_VECTORS_SQL}, {knn_sql('train', 'train', 5)}
SELECT count(*) AS n_rows, count(*) FILTER (tid = qid AND score > 0.99) AS n_self,
       round(count(*) FILTER (tid = qid AND score > 0.99)::DOUBLE / count(*), 6) AS share,
       count(*) = count(*) FILTER (tid = qid AND score > 0.99) AS ok FROM nn WHERE rank = 1"""
)
def check_self_match(spark, folder):
    found = checks.check_self_match(candidates(split_vectors(spark, folder)))
    return found.withColumn("share", F.round("share", 6))


# --------------------------------------------------------------------------- raw files


@query(f"WITH {POSTS_SQL} SELECT * FROM posts")
def csv_sources(spark, folder):
    """The posts as CSV files in two layouts, one of them compressed, read back and aligned."""
    posts = raw_posts(spark, folder)
    path = scratch_path(spark, "raw-csv")
    labelled = posts.filter(F.col("Class").isNotNull())
    renamed = posts.filter(F.col("Class").isNull()).select(
        F.col("Class").alias("LABEL"), F.col("CONTENT").alias("Text"), F.col("Generator").alias("model"), "k",
        F.col("Network").alias("source_platform"),
    )
    writing = {"header": True, "quote": '"', "escape": '"', "quoteAll": True, "compression": "gzip"}
    labelled.write.options(**{**writing, "compression": "none"}).csv(path)
    renamed.write.mode("append").options(**writing).csv(path)
    tables = read_csv_folder(spark, path)
    aligned = [normalize.accepted(normalize.align_social(t, keep=["k"]), keep=["k"]) for t in tables]
    return normalize.combine(*aligned).withColumn("k", F.col("k").cast("bigint"))


@query(f"WITH {ANSWERS_SQL} SELECT text, label, source_model, platform, dataset FROM answers")
def json_sources(spark, folder):
    """The answer records as JSON lines, read back and exploded."""
    path = scratch_path(spark, "raw-json")
    raw_answers(spark, folder).write.json(path)
    return normalize.explode_answers(read_answers(spark, path)).drop("answer_pos")


# --------------------------------------------------------------------------- written and read back


@query(f"WITH {MERGED_SQL} SELECT id, text, label, source_model, platform, dataset FROM corpus")
def corpus_written(spark, folder):
    path = scratch_path(spark, "corpus-json")
    writers.write_corpus(merged_corpus(spark, folder), path)
    return readers.read_corpus(spark, path)


@query(f"WITH {ADVERSARIAL_SQL} SELECT * FROM adversarial")
def adversarial_csv(spark, folder):
    """The adversarial export as a CSV file of its own."""
    path = scratch_path(spark, "adversarial-csv")
    raw_adversarial(spark, folder).write.options(header=True, quote='"', escape='"', quoteAll=True).csv(path)
    aligned = normalize.align_adversarial(readers.read_csv(spark, path), keep=["k"])
    return normalize.accepted(aligned, keep=["k"]).withColumn("k", F.col("k").cast("bigint"))


_SPLITS_WRITTEN_SQL = f"WITH {CORPUS_SQL}, {split_sql('corpus')} SELECT id, split FROM splits"


@query(_SPLITS_WRITTEN_SQL)
def splits_written(spark, folder):
    path = scratch_path(spark, "splits")
    writers.write_splits(splits.stratified_split(corpus_view(spark, folder)), path)
    return readers.read_splits(spark, path).select("id", "split")


@query(_SPLITS_WRITTEN_SQL)
def split_map_written(spark, folder):
    """The split as JSON objects, read back at their separators."""
    path = scratch_path(spark, "split-map")
    writers.write_split_map(splits.stratified_split(corpus_view(spark, folder)), path)
    return readers.read_split_map(spark, path)


@query(f"WITH {_SCENARIOS_SQL} SELECT scenario, id FROM scenarios")
def scenarios_written(spark, folder):
    path = scratch_path(spark, "scenarios")
    writers.write_scenarios(scenario_members(spark, folder).select("scenario", "id"), path)
    return spark.read.parquet(path).select(F.col("scenario").cast("string").alias("scenario"), "id")


@query(f"WITH {_DOCS_SQL}, {_records_sql('labelled', 'train')} SELECT split, variant, instruction, output FROM records")
def instructions_written(spark, folder):
    path = scratch_path(spark, "instructions")
    # The records hold each text twice; another copy beside them is more disk than cleaning again is work.
    records = training.training_records(*prompt_inputs(spark, folder, store=False))
    writers.write_instructions(records, path, compression="gzip")
    return readers.read_instructions(spark, path).select("split", "variant", "instruction", "output")


@query(_BY_SOURCE_SQL.format(inputs=f"{CORPUS_SQL}, {RANDOM_SQL}"))
def metrics_written(spark, folder):
    path = scratch_path(spark, "metrics-json")
    found = metrics.metrics_by_source(random_predictions(spark, folder))
    writers.write_metrics(found, path)
    return spark.read.schema(found.schema).json(path)


@query(
    f"""WITH {CORPUS_SQL}, {split_sql('corpus')},
train AS (SELECT c.id, c.label FROM corpus c JOIN splits s ON c.id = s.id WHERE split = 'train'),
smaller AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM train GROUP BY label)),
drawn AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || id)) AS r FROM train)
SELECT id FROM drawn, smaller WHERE r <= m"""
)
def ids_written(spark, folder):
    path = scratch_path(spark, "ids")
    writers.write_ids(undersample(spark, folder), path)
    return spark.read.parquet(path)


@query(_TOTALS_SQL)
def embeddings_written(spark, folder):
    path = scratch_path(spark, "vectors")
    embed(cleaned_documents(spark, folder), HashingEmbedder(EMBED_DIMENSIONS), batched=True).write.parquet(path)
    return embedding_totals(readers.read_embeddings(spark, path))


@query("SELECT doc_id, text, lang, doc_id % 10 = 0 AS held_out FROM documents")
def dataset_exported(spark, folder):
    """Two splits flattened into one folder of JSON lines; a second export leaves it alone."""
    path = scratch_path(spark, "export")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 10 == 0).alias("held_out"))
    parts = {"train": docs.filter(~F.col("held_out")), "test": docs.filter("held_out")}
    writers.export_dataset(parts, path)
    writers.export_dataset({"test": parts["test"]}, path)
    return spark.read.schema(docs.schema).json(path)
