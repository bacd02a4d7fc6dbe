"""A counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings, each weighed by the logarithm of how often
it occurs.  Labelled sentences that name a group of people are read a second time with the
name swapped for others of its kind, or for none at all, and every change of the score is
penalised while the weights are fitted.  Neutral mentions of a group then do not raise the
score, even if the labelled texts happen to tie it to abuse.

Features are counted and chosen by Spark on a bounded sample of labelled documents, the
weights (one per chosen feature) are fitted on the driver, and every whole text is scored in
its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.batches import slices
from textlab.llm.resampling import labelled_sample
from textlab.storage import materialize

#: Labelled documents that are used at most.
MAX_LABELLED = 10_000
#: Features that the model weighs at most, besides the identity terms.
MAX_FEATURES = 1_024
#: A feature must occur in so many labelled documents.
LEAST_DOCUMENTS = 4
#: A feature's share of toxic texts must be so many standard errors from the share of all.
LEAST_GAP = 3.0
#: Lengths of word beginnings that are features, besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Strength of the counterfactual penalty, per labelled sentence and swap, and of the plain one.
COUNTERFACTUAL = 4.0
RIDGE = 0.5
#: Score from which a text is predicted to be toxic.
THRESHOLD = 0.3
#: Words whose features a task remembers.
_CACHE_WORDS = 500_000

# Names for groups of people, by kind.  Within a kind they are swapped.
IDENTITY_TERMS = {
    "gender": ("woman", "women", "man", "men", "girl", "girls", "boy", "boys", "female", "male", "trans", "transgender"),
    "religion": ("muslim", "muslims", "christian", "christians", "jew", "jews", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    "origin": ("black", "white", "asian", "african", "european", "latino", "arab", "immigrant", "immigrants", "foreigner"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "age": ("old", "young", "elderly", "teenager"),
}
_TERMS = {t for terms in IDENTITY_TERMS.values() for t in terms}
_WORDS = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?\n]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    """The word and its beginnings, those marked by a caret."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


class Model:
    """Weights of features, and of a text without any of them."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self._at = {f: i for i, f in enumerate(features)}
        self._known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> Counter:
        """How often each weighed feature occurs, by its number."""
        found: Counter = Counter()
        known = self._known
        for word, n in Counter(words(text)).items():
            active = known.get(word)
            if active is None:
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                active = known[word] = tuple(self._at[f] for f in features_of(word) if f in self._at)
            for i in active:
                found[i] += n
        return found

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[i] * np.log1p(n) for i, n in self.counts(text).items())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    def weight(self, feature: str) -> float:
        return float(self.weights[self._at[feature]]) if feature in self._at else 0.0


def is_held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many labelled texts have each feature, and how many toxic ones, per task."""
    seen: Counter = Counter()
    toxic: Counter = Counter()
    for rows in slices(batches):
        for label, text in zip(rows.column("_label").to_pylist(), rows.column("_text").to_pylist()):
            found = {f for w in set(words(text)) for f in features_of(w)}
            seen.update(found)
            if label:
                toxic.update(found)
    names = list(seen)
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict(
            {"feature": part, "n": [seen[f] for f in part], "toxic": [toxic[f] for f in part]}
        )


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many sentences of labelled texts each identity term stands, per task."""
    found: Counter = Counter()
    for rows in slices(batches):
        for text in rows.column("_text").to_pylist():
            if text and _TERMS & set(words(text)):
                for sentence in _SENTENCE_END.split(text):
                    found.update(_TERMS & set(words(sentence)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"]
    )


def fit_weights(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    labels: np.ndarray,
    vocabulary: list[str],
    mentions: dict[str, int],
    counterfactual: float = COUNTERFACTUAL,
    ridge: float = RIDGE,
) -> Model:
    """Newton's method on the penalised logistic loss.

    ``rows``, ``columns`` and ``values`` say how often which document has which feature of the
    vocabulary, ``mentions`` in how many labelled sentences an identity term stands.  A swap
    takes the features of one term away and adds those of another, so the change of the logit
    is linear in the weights, and its square a quadratic penalty.
    """
    n = len(vocabulary)
    x = np.zeros((len(labels), n + 1), np.float32)
    x[rows, columns] = np.log1p(values)
    x[:, n] = 1
    at = {w: i for i, w in enumerate(vocabulary)}
    penalty = np.diag(np.append(np.full(n, ridge), 1e-6))
    change = {t: np.array([at[f] for f in features_of(t) if f in at]) for t in _TERMS}
    for terms in IDENTITY_TERMS.values():
        for term in (t for t in terms if mentions.get(t)):
            strength = counterfactual * mentions[term]
            for other in (None, *(t for t in terms if t != term)):  # none: the sentence without the term
                swap = np.zeros(n + 1)
                swap[change[term]] += 1
                if other:
                    swap[change[other]] -= 1
                used = np.flatnonzero(swap)
                share = 1.0 if other is None else 1 / (len(terms) - 1)
                penalty[np.ix_(used, used)] += strength * share * np.outer(swap[used], swap[used])
    w = np.zeros(n + 1)
    share = np.clip(labels.mean(), 1e-4, 1 - 1e-4) if len(labels) else 0.5
    w[n] = np.log(share / (1 - share))
    loss = np.inf
    for _ in range(30):
        logit = np.clip(x @ w.astype(np.float32), -30, 30)
        p = 1 / (1 + np.exp(-logit))
        now = float(np.sum(np.log1p(np.exp(-np.where(labels == 1, logit, -logit)))) + w @ penalty @ w / 2)
        if loss - now < 1e-6 * max(1.0, now):
            break
        loss = now
        gradient = x.T @ (p - labels) + penalty @ w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + penalty
        w = w - np.linalg.solve(curve, gradient)
    return Model(vocabulary, w[:n], float(w[n]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    max_features: int = MAX_FEATURES,
    counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """Fit on at most ``max_labelled`` rows of ``labels`` (0 or 1) that are not held out.

    The sample is drawn by a hash of the id.  Without labels of both kinds every text gets
    the same score.
    """
    spark = docs.sparkSession
    ids, marks = labelled_sample(labels.filter(~is_held_out(F.col(id_col))), id_col, label_col, max_labelled)
    sample = spark.createDataFrame(list(zip(ids.tolist(), marks.tolist())), "_id bigint, _label bigint")
    source = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample is bounded by max_labelled, two numbers a row.
    chosen = materialize(source.join(F.broadcast(sample), "_id").select("_label", "_text"), "labelled")
    total, toxic = chosen.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not 0 < toxic < total:
        share = min(max(toxic / total, 1e-4), 1 - 1e-4) if total else 0.5
        return Model([], np.empty(0), float(np.log(share / (1 - share))))
    seen = chosen.mapInArrow(_feature_counts, "feature string, n bigint, toxic bigint").groupBy("feature")
    seen = seen.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= LEAST_DOCUMENTS)
    # How far a feature's share of toxic texts is from the share of all, in standard errors.
    share = toxic / total
    gap = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = seen.filter(gap >= LEAST_GAP).orderBy(gap.desc(), "feature").limit(max_features).collect()
    vocabulary = sorted({r[0] for r in best} | _TERMS)
    plain = Model(vocabulary, np.zeros(len(vocabulary)), 0.0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.int64())
        for rows in slices(batches):
            found = [plain.counts(t) for t in rows.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_label"),
                    pa.array([list(f) for f in found], kinds),
                    pa.array([list(f.values()) for f in found], kinds),
                ],
                ["label", "features", "counts"],
            )

    coded = chosen.mapInArrow(encode, "label bigint, features array<bigint>, counts array<bigint>").collect()
    rows = np.repeat(np.arange(len(coded)), [len(r[1]) for r in coded])
    columns, values = (np.array([v for r in coded for v in r[i]], np.int64) for i in (1, 2))
    marked = np.array([r[0] for r in coded])
    named = chosen.mapInArrow(_mentions, "term string, n bigint").groupBy("term").agg(F.sum("n")).collect()
    return fit_weights(rows, columns, values, marked, vocabulary, {r[0]: r[1] for r in named}, counterfactual)


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; ``predicted`` is 1 from ``THRESHOLD`` on.

    Nothing but the text enters the score.  Null and empty texts get the score of a text
    without any weighed feature; rows that repeat an id are scored each.  An empty table gives
    an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            scores = [model.score(t) for t in rows.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), pa.array(scores, pa.float64())], ["_id", "score"]
            )

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    scored = source.mapInArrow(run, f"_id {kind}, score double")
    return scored.select(
        F.col("_id").alias(id_col),
        is_held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
