"""Toxicity scores from weak supervision.

1. Voters. From labelled training documents, words and word beginnings that mark toxic
   texts become lexicon and pattern voters (by a log-odds score with its error); a voter
   says *toxic* where it occurs and abstains elsewhere. One voter says *clean* where no
   other has anything to say. Near copies count once.
2. Label model. Each voter has an accuracy, estimated by expectation-maximisation over
   the votes from a weak prior; abstaining says nothing. Voters that agree
   more than their accuracies explain are correlated; a vote counts by one over one plus
   its voter's correlations, so ten spellings of one pattern are not ten witnesses.
3. Classifier. A logistic regression on the voters' counts is trained on the posterior
   labels and scores every whole text.

Labels come only from rows whose crc32 of the id as text leaves another remainder than 1 by
3; of more than ``LABELLED`` those of small id hash, up to a threshold set from their count, which bounds the fit. Language,
source and id never enter a score.

Edge cases: a null or empty text has no votes and the score of that; several labels of one
document count as toxic if one says so; without toxic or clean training labels there are no
voters and every score is the share of toxic labels (0 without labels); repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import stored

LABELLED = 40_000
VOTERS = 600
BEGINNINGS = (4, 5, 6, 7)
SURE = 3.3
SEEN = 3
PURE = 0.9
STRENGTH = 20.0
#: Correlation, given the class, from which two voters count as tied; below it lies what languages and lengths bring about.
TIED = 0.5
WORD = re.compile(r"\w+")
NOTHING = "nothing listed"
KNOWN = 300_000


def features(word: str) -> list[str]:
    """The word itself and, for longer words, its beginnings."""
    return ["=" + word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def is_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) != 1


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of the text's 3-word windows, which near copies mostly share."""
    for batch in batches:
        least = []
        for text in batch.column("text"):
            words = WORD.findall((text.as_py() or "").lower())
            least.append(min((xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) >> 1 for k in range(max(1, len(words) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "copy"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad, good = Counter(), Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            found = {f for w in set(WORD.findall((text.as_py() or "").lower())) for f in features(w)}
            (bad if toxic.as_py() else good).update(found)
        names = list(bad | good)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())],
            names=["feature", "bad", "good"],
        )


class Votes:
    """Voter numbers of texts; words that were looked up are kept in a table of bounded size."""

    def __init__(self, voters: list[str]):
        self.number = {v: k for k, v in enumerate(voters)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> dict[int, int]:
        found = Counter(WORD.findall((text or "").lower()))
        known, number, out = self.known, self.number, {}
        if len(known) > KNOWN:
            known.clear()
        for w, n in found.items():
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(number[f] for f in features(w) if f in number)
            for k in hit:
                out[k] = out.get(k, 0) + n
        return out or {number[NOTHING]: 1}


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled training documents, one of each set of near copies with equal label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & is_training(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known)
    n = known.count()
    # the part of all hashes that holds ``most`` rows, less four standard deviations of their number
    part = min(1.0, max(0.0, most - 4 * math.sqrt(most)) / max(n, 1)) if n > most else 1.0
    some = stored(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = slim.join(F.broadcast(some), "doc_id")  # at most ``most`` rows of two numbers
    rows = rows.mapInArrow(_copies, "doc_id long, text string, toxic int, copy long")
    return rows.groupBy("copy", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic")


def mine_voters(rows: DataFrame, bad: int, good: int, voters: int = VOTERS) -> tuple[list[str], np.ndarray]:
    """The surest toxic words and beginnings by log-odds over its standard error, at most ``voters``, and how often each is right in training."""
    counts = rows.mapInArrow(_tally, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = bad / (bad + good)
    a, b = F.col("bad") + F.lit(share), F.col("good") + F.lit(1 - share)
    odds = F.log(a / (F.lit(bad + 1.0) - a)) - F.log(b / (F.lit(good + 1.0) - b))
    seen = counts.filter((F.col("bad") >= SEEN) & (a < bad + 1.0)).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    seen = seen.withColumn("right", (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1))
    best = seen.filter((F.col("z") >= SURE) & (F.col("bad") >= PURE * (F.col("bad") + F.col("good")))).orderBy(F.desc("z"), "feature").limit(voters)
    best = best.collect()
    return [r["feature"] for r in best] + [NOTHING], np.array([r["right"] for r in best] + [1 - share])


def label_model(votes: DataFrame, voters: list[str], right: np.ndarray, prior: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies and discounts for correlation, by expectation-maximisation over (on array<int>) rows.

    ``prior`` is the known share of toxic texts, ``right`` the voters' accuracies on training
    labels, which count as ``STRENGTH`` observations. The driver keeps numbers per voter and per
    pair of voters; the votes stay in Spark.
    """
    m = len(voters)
    sign = np.array([-1.0 if v == NOTHING else 1.0 for v in voters])
    guess = np.clip(right, 0.55, 0.995)
    accuracy, discount = guess.copy(), np.ones(m)
    pair = F.explode("on").alias("j")
    both = votes.select("on", pair).select("j", F.explode("on").alias("k")).filter("j < k").groupBy("j", "k").agg(F.count(F.lit(1)).alias("n")).collect()
    once = {r["j"]: r["n"] for r in votes.select(pair).groupBy("j").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = votes.count()
    for step in range(rounds):
        weight = F.array(*[F.lit(float(x)) for x in sign * discount * np.log(accuracy / (1 - accuracy))])
        logit = F.aggregate(F.transform("on", lambda k: F.get(weight, k)), F.lit(math.log(prior / (1 - prior))), lambda x, y: x + y)
        q = votes.select("on", (1 / (1 + F.exp(-logit))).alias("q"))
        sums = q.select(pair, "q").groupBy("j").agg(F.sum("q").alias("q")).collect()
        for r in sums:
            j, n = r["j"], once[r["j"]]
            agreed = r["q"] if sign[j] > 0 else n - r["q"]
            accuracy[j] = min(0.995, max(0.55, (agreed + STRENGTH * guess[j]) / (n + STRENGTH)))
        if step == 1:
            discount = _discounts(both, once, total, accuracy, sign, prior, m)
    return accuracy, discount


def _discounts(both, once, total, accuracy, sign, prior, m) -> np.ndarray:
    """1 / (1 + sum of the ties to other voters), ties being correlations beyond what accuracies explain."""
    rate = np.zeros((2, m))
    for j, n in once.items():
        toxic = accuracy[j] if sign[j] > 0 else 1 - accuracy[j]
        rate[1, j] = min(1.0, n * toxic / (total * prior))
        rate[0, j] = min(1.0, n * (1 - toxic) / (total * (1 - prior)))
    tied = np.zeros(m)
    for r in both:
        j, k, seen = r["j"], r["k"], r["n"] / total
        if sign[j] != sign[k]:
            continue
        alone = prior * rate[1, j] * rate[1, k] + (1 - prior) * rate[0, j] * rate[0, k]
        spread = math.sqrt(max(1e-12, once[j] / total * (1 - once[j] / total) * once[k] / total * (1 - once[k] / total)))
        tie = max(0.0, (seen - alone) / spread)
        if tie > TIED:
            tied[j] += tie
            tied[k] += tie
    return 1 / (1 + tied)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, cap: int = 3) -> tuple[list[str], np.ndarray, float]:
    """Voters, their weights per occurrence (up to ``cap`` occurrences) and the intercept."""
    rows = stored(training_rows(docs, labels, most))
    seen = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = seen.get(True, 0), seen.get(False, 0)
    share = bad / max(1, bad + good)
    edge = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if not bad or not good:
        return [NOTHING], np.zeros(1), edge if bad + good else -math.inf
    voters, right = mine_voters(rows, bad, good)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(voters)
        for batch in batches:
            found = [votes.of(t.as_py()) for t in batch.column("text")]
            on = [sorted(f) for f in found]
            names = [[str(k) for k in o for _ in range(min(cap, f[k]))] for o, f in zip(on, found)]
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["on", "names"])

    votes = stored(rows.select("text").mapInArrow(vote, "on array<int>, names array<string>"))
    accuracy, discount = label_model(votes, voters, right, share)
    sign = np.array([-1.0 if v == NOTHING else 1.0 for v in voters])
    weight = F.array(*[F.lit(float(x)) for x in sign * discount * np.log(accuracy / (1 - accuracy))])
    logit = F.aggregate(F.transform("on", lambda k: F.get(weight, k)), F.lit(edge), lambda x, y: x + y)
    q = 1 / (1 + F.exp(-logit))
    soft = votes.select("names", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), q.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - q).alias("w")))).alias("s"))
    counted = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(voters))], "names", "features").transform(soft.select("names", "s.label", "s.w"))
    model = LogisticRegression(weightCol="w", regParam=1e-5, maxIter=60, standardization=False).fit(stored(counted.select("features", "label", "w")))
    return voters, model.coefficients.toArray(), float(model.intercept)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, cap: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted per document."""
    voters, weights, intercept = fit(docs, labels, cap=cap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(voters)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                x = intercept + sum(weights[k] * min(cap, n) for k, n in votes.of(text.as_py()).items())
                out.append(0.0 if x == -math.inf else 1 / (1 + math.exp(-max(-500.0, min(500.0, x)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    held = F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    out = slim.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
