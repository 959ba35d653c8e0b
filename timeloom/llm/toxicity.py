"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkit import LOWER, U, chunks, cores, slices

#: Labelled rows that a model is fitted on at most: those with the least hash of their id.
FIT_ROWS = 20_000
#: Size of the model: voters at most, the surest first; rows that a voter must occur in at least.
VOTERS, SUPPORT = 384, 5
#: Lengths in bytes of the word beginnings that pattern voters look at.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether the id belongs to the rows that no fit may see."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def features(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature): hashes of lower-cased words without outer punctuation and of their beginnings."""
    for words in chunks(texts, LOWER):
        which, start, end = cores(words)
        row = words.row[which]
        yield row, words.hashes(start, end)
        for n in STEMS:
            longer = end - start > n
            yield row[longer], words.hashes(start[longer], start[longer] + n) + U(n)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, n1, n0: in how many toxic and other texts of a slice a feature occurs."""
    for rows in slices(batches):
        label, found = rows["label"].to_numpy(np.int64), []
        for row, feature in features(rows["text"]):
            if len(row):
                order = np.lexsort((feature, row))
                row, feature = row[order], feature[order]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])))
                found.append((row[new], feature[new]))
        if found:
            row, feature = map(np.concatenate, zip(*found))
            order = np.lexsort((row, feature))
            row, feature = row[order], feature[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])))
            row, feature = row[new], feature[new]
            first = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1])))
            n1 = np.add.reduceat(label[row], first)
            yield pd.DataFrame({"feature": feature[first].view(np.int64), "n1": n1, "n0": np.diff(np.append(first, len(feature))) - n1})


def _hits(texts, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, words): how often each voter (ascending hashes) occurs in each text; features in all."""
    n, counts = len(texts), np.zeros((len(texts), len(voters)), np.int32)
    words = np.zeros(n, np.int64)
    table = np.zeros(1 << 16, bool)
    table[(voters & U(0xFFFF)).astype(np.int64)] = True
    for k, (row, feature) in enumerate(features(texts)):
        if k % (1 + len(STEMS)) == 0:
            words += np.bincount(row, minlength=n)
        if len(voters):
            some = np.flatnonzero(table[(feature & U(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(voters, feature[some]), len(voters) - 1)
            hit = voters[at] == feature[some]
            np.add.at(counts, (row[some[hit]], at[hit]), 1)
    return counts, words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _blocks(n: int, rows: int = 1024) -> Iterator[slice]:
    return (slice(at, at + rows) for at in range(0, n, rows))


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior probability that each row is toxic, by expectation maximisation.

    A voter that fires speaks for the class in which it fires more often and abstains otherwise; one more voter speaks where
    none fires, and the given label is a voter of unknown accuracy too. What a firing voter says is divided by one plus its
    positive correlations with the other voters within the classes, so that voters that always agree count as one. Rows are
    taken a block at a time, so beside the votes (a byte each) only matrices of voters by voters are held.
    """
    n, given = len(votes), label.astype(np.float64)
    silent = 1.0 - votes.any(1)
    block = lambda s: votes[s].astype(np.float64)
    square = lambda weight: sum((block(s).T * weight[s]) @ block(s) for s in _blocks(n))
    fired, both = votes.sum(0, dtype=np.float64), square(np.ones(n))
    post = np.clip(given, 0.05, 0.95)
    for _ in range(rounds):
        toxic, other = post.sum(), (1 - post).sum()
        smooth = lambda one, zero: ((one + 0.1) / (toxic + 0.2), (zero + 0.1) / (other + 0.2))
        in_toxic = sum(post[s] @ block(s) for s in _blocks(n))
        rate1, rate0 = smooth(in_toxic, fired - in_toxic)
        of_toxic = square(post)
        spread = lambda gram, sums, rate, mass: gram - np.outer(sums, rate) - np.outer(rate, sums) + mass * np.outer(rate, rate)
        cov = spread(of_toxic, in_toxic, rate1, toxic) + spread(both - of_toxic, fired - in_toxic, rate0, other)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        weight = np.log(rate1 / rate0) / (1 + np.clip(corr, 0, 1).sum(1))
        (none1, none0), (yes1, yes0) = (smooth(post @ x, (1 - post) @ x) for x in (silent, given))
        said = np.concatenate([block(s) @ weight for s in _blocks(n)]) if n else np.zeros(0)
        logit = np.log((toxic + 1) / (other + 1)) + said + silent * np.log(none1 / none0)
        post = _sigmoid(logit + given * np.log(yes1 / yes0) + (1 - given) * np.log((1 - yes1) / (1 - yes0)))
    return post


@dataclass
class Model:
    """A fitted linear classifier over voters; the arrays are small and travel with the tasks."""

    voters: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def inputs(fired: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Which voters fire, how often they fire together, and that as a share of the words, a row for each text."""
        return np.column_stack([fired, np.log1p(total), np.minimum(1, 20 * total / np.maximum(words, 1))]).astype(np.float64)

    def scores(self, texts) -> np.ndarray:
        counts, words = _hits(texts, self.voters)
        part = lambda s: self.inputs(counts[s] > 0, counts[s].sum(1), words[s]) @ self.weights + self.bias
        return _sigmoid(np.concatenate([part(s) for s in _blocks(len(words))])) if len(words) else np.zeros(0)


def _regression(x, n: int, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the bias. x(slice) gives rows of the inputs."""
    rows = lambda s: np.column_stack([x(s), np.ones(len(y[s]))])
    width = rows(slice(0, 1)).shape[1]
    penalty, w = np.full(width, ridge), np.zeros(width)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        bend, slope = np.diag(penalty), -penalty * w
        for s in _blocks(n):
            own = rows(s)
            p = _sigmoid(own @ w)
            bend += (own.T * (p * (1 - p))) @ own
            slope += own.T @ (y[s] - p)
        w += np.linalg.solve(bend, slope)
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, voters: int = VOTERS) -> Model:
    """A model from the labelled rows of which held_out() is false, at most ``fit_rows`` of them.

    docs: doc_id, text. labels: doc_id, toxic (0, 1 or null; contradicting rows of one id count by majority, a tie as toxic).
    Lexicon voters are words, pattern voters are word beginnings, which occur in toxic rows surely more often than in others:
    the lower 95 % bound of the logarithm of their odds ranks them. Of several rows of one doc_id the greatest text counts
    once; null ids and ids without a text are not fitted on. Without labels of both classes, and for empty tables, the model
    scores all texts alike, at the share of toxic rows. Other columns are not looked at. What reaches the driver is a bit for
    each voter and two numbers of each of the ``fit_rows`` rows.
    """
    rows = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "label_id")
    sample = cut(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    texts = cut(texts.groupBy("label_id", "label").agg(F.max("text").alias("text")))
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    share = (n1 + 0.5) / (n1 + n0 + 1) if n1 + n0 else 0.0
    flat = Model(np.zeros(0, np.uint64), np.zeros(2), float(np.log(max(share, 1e-6) / (1 - share))))
    if not n1 or not n0:
        return flat
    counts = texts.mapInPandas(_counts, "feature bigint, n1 bigint, n0 bigint").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    surely = odds - 1.96 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.filter(F.col("n1") >= SUPPORT).withColumn("surely", surely).filter("surely > 1.5").orderBy(F.desc("surely"), "feature").limit(voters)
    chosen = np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches, most=1 << 20):
            found, words = _hits(rows["text"], chosen)
            yield pd.DataFrame({"label": rows["label"], "words": words, "total": found.sum(1), "fired": [x.tobytes() for x in np.packbits(found > 0, axis=1)]})

    # collected rows come in the order of partitions; sums of floating-point numbers must not depend on it
    fitted = sorted(tuple(r) for r in texts.mapInPandas(rows_of, "label int, words bigint, total bigint, fired binary").collect())
    if not fitted:
        return flat
    label, words, total, fired = zip(*fitted)
    packed = np.frombuffer(b"".join(map(bytes, fired)), np.uint8).reshape(len(fitted), -1)
    votes = np.unpackbits(packed, axis=1, count=len(chosen)) if len(chosen) else np.zeros((len(fitted), 0), np.uint8)
    total, words = np.array(total, np.int64), np.array(words, np.int64)
    posterior = label_model(votes, np.array(label))
    w = _regression(lambda s: Model.inputs(votes[s], total[s], words[s]), len(votes), posterior)
    return Model(chosen, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column: each whole text's score, 0 to 1.

    Null texts count as empty; each row is scored by its own text alone, so repeated rows, null ids and other columns change
    nothing. A column of docs called ``name`` is replaced: take a free name to keep it.
    """

    def run(texts: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"text": texts})
        parts = [model.scores(x["text"]) for x in slices([rows], most=1 << 20)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (1 from a score of 0.7, ties included).

    Repeated rows stay, a null doc_id counts as the empty text for held_out, null texts are scored as empty ones, whole texts
    of any length are scored; other columns go, whatever their names; an empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
