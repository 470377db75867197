"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Terms - whole words, word beginnings, beginnings of two words - are mined from labelled training rows and dealt into
LEXICONS lexicons by a hash, so that each has terms of every language and form. Voters are the lexicons, each voting
"toxic" where one of its terms stands, and patterns that need no term (shouting, exclamation runs). A generative model
says how a class makes votes: each voter has, in each class, a vote rate (its accuracy) that depends on the vote of at
most one other voter, the one it is most correlated with beyond what the class explains. Rates and the tree of
dependencies are estimated from the votes of labelled and unlabelled rows alone; labels choose the terms, set the share
of the toxic class and bring scores to their scale at the end. A linear classifier on the counts of single terms is
trained on the posteriors, so 0.3 reads as a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import in_chunks, table, unit_hash, unused
from tarnsift.sources.shared import stored

#: Labelled rows that the model is fitted on, about, and unlabelled ones whose votes take part; rows are taken by a hash of their id.
TRAINING_ROWS, UNLABELLED_ROWS = 8000, 8000
#: Terms that may become voters.
TERMS = 240
PREFIXES = (3, 4, 5, 6, 7, 8)

LETTERS = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"[^\W\d_a-zß-öø-ÿ]{6,}")
#: What a voter's correlation with the class is drawn to, by the weight of about a hundredth of a pair of voters.
BELIEF = 0.6
#: Lexicons that terms are dealt into.
LEXICONS = 16
#: The first two vote; the others sum up the terms' hits and are for the classifier alone.
PATTERNS = ("shouting", "exclamations", "any_term", "two_terms", "dense", "very_dense", "no_term")
VOTING = 2


def terms_of(text: str | None) -> set[str]:
    """Words as "=word", beginnings of longer words as "^pref", and as "2pref" those that begin two words of the text."""
    words = Counter(LETTERS.findall((text or "").lower()))
    out = {"=" + w for w in words if len(w) > 2}
    for n in PREFIXES:
        starts: Counter = Counter()
        for w, k in words.items():
            if len(w) > n:
                starts[w[:n]] += k
        out.update("^" + p for p in starts)
        out.update("2" + p for p, k in starts.items() if k > 1)
    return out


def _doc_terms(batches):
    for pdf in in_chunks(batches):
        for toxic, text in zip(pdf["toxic"], pdf["text"]):
            t = list(terms_of(text))
            if t:
                yield pd.DataFrame({"term": t, "pos": np.full(len(t), int(toxic)), "neg": np.full(len(t), 1 - int(toxic))})


def mine_terms(training: DataFrame, most: int = TERMS) -> list[str]:
    """Terms of at least 3 toxic documents whose documents are mostly toxic, too often for chance among all such terms, the surest first."""
    counts = training.mapInPandas(_doc_terms, "term string, pos int, neg int").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = stored(counts.where("pos > 2"), "terms")
    share = training.agg(F.avg("toxic")).first()[0]
    rate = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.col("pos") * F.log(rate / share) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    found = counts.withColumn("gain", F.round(gain, 6)).where((rate >= 0.8) & (F.col("gain") >= math.log(counts.count() + 1) + 0.5))
    return [r["term"] for r in found.orderBy(F.col("gain").desc(), "term").limit(most).collect()]


class Voters:
    """Finds terms in texts with one automaton; a worker builds it once."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.terms = terms
        self.doubles = [i for i, t in enumerate(terms) if t[0] == "2"]
        self.find = ahocorasick.Automaton()
        by_string: dict[str, list[tuple[int, bool]]] = {}
        for i, t in enumerate(terms):
            by_string.setdefault(t[1:], []).append((i, t[0] == "="))
        for s, v in by_string.items():
            self.find.add_word(s, (len(s), v))
        if terms:
            self.find.make_automaton()

    def features(self, text: str | None) -> np.ndarray:
        """Hits of all terms (counts), then of the patterns (0 or 1)."""
        text = text or ""
        low = text.lower()
        hits = np.zeros(len(self.terms) + len(PATTERNS), np.float32)
        if self.terms:
            for end, (size, voters) in self.find.iter(low):
                start = end - size + 1
                if start and low[start - 1].isalpha():
                    continue
                open_end = end + 1 < len(low) and low[end + 1].isalpha()
                for i, whole in voters:
                    if whole != open_end:
                        hits[i] += 1
        for i in self.doubles:
            hits[i] = max(hits[i] - 1, 0)
        total = self._words(hits)
        words = 1 + low.count(" ") + low.count("\n")
        share = 100 * total / words
        hits[len(self.terms) :] = (sum(map(str.isupper, SHOUT.findall(text))) >= 3, text.count("!!") >= 3, total >= 1, total >= 2, share >= 0.5 and total >= 2, share >= 1.5 and total >= 2, total == 0)
        return hits

    def _words(self, hits: np.ndarray) -> float:
        """Words hit; a word and its beginnings are one, so the largest count of nested terms counts."""
        best: dict[str, float] = {}
        for i in np.flatnonzero(hits[: len(self.terms)]):
            root = self.terms[i][1:5]
            best[root] = max(best.get(root, 0.0), float(hits[i]))
        return sum(best.values())


def votes_of(hits: np.ndarray, terms: list[str]) -> np.ndarray:
    """A vote of each lexicon and of the patterns that vote, from the hits of terms and patterns."""
    lexicon = np.array([zlib.crc32(t.encode()) % LEXICONS for t in terms], dtype=np.int64)
    by_lexicon = [(hits[:, : len(terms)][:, lexicon == k] > 0).any(axis=1) for k in range(LEXICONS)]
    return np.column_stack([*by_lexicon, hits[:, len(terms) : len(terms) + VOTING] > 0]).astype(float)


class LabelModel:
    """share: of the toxic class; parent: of each voter, or itself if none; rates[y, u, j]: how often voter j votes in class y
    when its parent votes u (the same for both u without a parent)."""

    def __init__(self, share: float, parent: np.ndarray, rates: np.ndarray):
        self.share, self.parent, self.rates = share, parent, rates

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        above = votes[:, self.parent]
        odds = np.full(len(votes), np.log(self.share) - np.log1p(-self.share))
        for u in (0, 1):
            yes, no = np.log(self.rates[1, u] / self.rates[0, u]), np.log((1 - self.rates[1, u]) / (1 - self.rates[0, u]))
            odds += ((above == u) * (votes * yes + (1 - votes) * no)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _rates(votes: np.ndarray, above: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Vote rates by class and parent's vote, each drawn by two rows' weight towards the rate of the class alone."""
    out = np.empty((2, 2, votes.shape[1]))
    for y in (0, 1):
        w = classes[:, y]
        plain = (w @ votes + 0.01) / (w.sum() + 0.02)
        for u in (0, 1):
            there = w[:, None] * (above == u)
            out[y, u] = (np.einsum("ij,ij->j", there, votes) + 2 * plain) / (there.sum(axis=0) + 2)
    return out


def _from_moments(rows: np.ndarray, count: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(vote rates by class, correlations that the class leaves unexplained), from how often pairs of voters agree: apart from
    dependent pairs, correlations are the product of what each voter has with the class. The product is fitted to all pairs
    by least absolute deviations, which the few dependent pairs do not move; pairs that nearly always agree (0.8 and more), as
    a word and its beginning do, are dependent to begin with. Voters are taken to be better than chance, and a voter without any
    independent pair to have the correlation BELIEF with the class."""
    w = count / count.sum()
    mean = w @ rows
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = ((rows * w[:, None]).T @ rows - np.outer(mean, mean)) / np.outer(sd, sd)
    off = ~np.eye(len(mean), dtype=bool)
    with_class = np.sqrt(np.clip(np.where(off, corr, 0).sum(axis=1) / max(len(mean) - 1, 1), 1e-3, 0.9))
    for _ in range(100):
        weight = (off & (corr < 0.8)) / (np.abs(corr - np.outer(with_class, with_class)) + 0.01)
        fitted = ((weight * corr) @ with_class + BELIEF) / (weight @ (with_class * with_class) + 1)
        with_class = 0.5 * with_class + 0.5 * np.clip(fitted, 1e-3, 0.98)
    apart = with_class * sd / np.sqrt(share * (1 - share))
    rates = np.clip(np.stack([mean - share * apart, mean + (1 - share) * apart]), 1e-4, 1 - 1e-4)
    return rates, np.where(off, np.abs(corr - np.outer(with_class, with_class)), 0)


def _dependencies(rest: np.ndarray, least: float) -> np.ndarray:
    """The parent of each voter, or itself: the tree of greatest correlation left, without the branches under `least`."""
    m = len(rest)
    parent, best, at, out = np.arange(m), np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, bool)
    j = 0
    for _ in range(m - 1):
        out[j] = True
        nearer = rest[j] > best
        best[nearer], at[nearer] = rest[j][nearer], j
        j = int(np.where(out, -np.inf, best).argmax())
        if best[j] >= least:
            parent[j] = at[j]
    return parent


def label_model(votes: np.ndarray, share: float, rounds: int = 40, least: float = 0.1) -> LabelModel:
    """The generative model of 0/1 votes, without labels: the tree of dependencies, and rates to begin with, from the moments of
    pairs of voters; then EM for the rates along the tree. Pairs depend if at least `least`, and five standard errors, of
    their correlation is left."""
    rows, count = np.unique(votes, axis=0, return_counts=True)
    share = min(max(share, 1e-4), 1 - 1e-4)
    own = np.arange(votes.shape[1])
    rates, rest = _from_moments(rows, count, share)
    parent = _dependencies(rest, max(least, 5 / math.sqrt(len(votes))))
    alone = parent == own
    above = np.where(alone, 0, rows[:, parent])
    # to begin with, only the voters that follow no other
    posterior = LabelModel(share, np.arange(alone.sum()), np.repeat(rates[:, None, alone], 2, axis=1)).posterior(rows[:, alone])
    model = None
    for _ in range(rounds):
        rates = _rates(rows, above, np.stack([(1 - posterior) * count, posterior * count], axis=1))
        rates[:, 1, alone] = rates[:, 0, alone]
        model = LabelModel(share, parent, np.clip(rates, 1e-5, 1 - 1e-5))
        new = model.posterior(rows)
        done = np.abs(new - posterior).max() < 1e-6
        posterior = new
        if done:
            break
    return model


def logistic(x: np.ndarray, y: np.ndarray, l2, rounds: int = 50) -> np.ndarray:
    """Newton's method; y may be probabilities; the last coefficient is the intercept and isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    shrink = np.append(np.broadcast_to(l2, len(b) - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    """terms: voters' terms; b: coefficients; scale: (slope, offset) to the labels' scale; base: share of toxic labels."""

    def __init__(self, terms: list[str], b: np.ndarray | None, scale: tuple[float, float], base: float):
        self.terms, self.b, self.scale, self.base = terms, b, scale, base

    def score(self, hits: np.ndarray) -> np.ndarray:
        if self.b is None:
            return np.full(len(hits), self.base)
        z = np.log1p(hits) @ self.b[:-1] + self.b[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS, most_unlabelled: int = UNLABELLED_ROWS) -> Model:
    """labels: doc_id, toxic of the rows to learn from (one row for a doc_id counts, nulls are passed over). Without labels
    of both kinds the score is the labels' share of toxic, or 0."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    taken = own.where(unit_hash("doc_id", F.lit("fit")) < F.lit(most_rows / max(n, 1))).limit(2 * most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    some = unit_hash("doc_id", F.lit("unlabelled")) < F.lit(most_unlabelled / max(docs.count(), 1))
    seen = texts.join(F.broadcast(taken), "doc_id", "left").where(F.col("toxic").isNotNull() | some)
    training = stored(seen.groupBy("text").agg(F.max("toxic").alias("toxic")), "training")
    labelled = training.where("toxic is not null")
    share = labelled.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return Model([], None, (1.0, 0.0), float(share or 0.0))
    terms = mine_terms(labelled)

    def rows(batches):
        voters = Voters(terms)
        for pdf in in_chunks(batches):
            yield pd.DataFrame({"toxic": pdf["toxic"].astype("Int32"), "hits": [voters.features(t).tolist() for t in pdf["text"]]})

    # bounded by the two numbers of training rows; in one order, so that sums don't depend on the tasks' order
    voted = training.mapInPandas(rows, "toxic int, hits array<float>").groupBy("toxic", "hits").agg(F.count("*").alias("n")).orderBy("hits", "toxic").toPandas()
    voted = voted.loc[voted.index.repeat(voted["n"])]
    hits, gold = np.stack(voted["hits"].to_numpy()).astype(float), voted["toxic"].to_numpy(dtype=float, na_value=np.nan)
    votes = votes_of(hits, terms)
    posterior = label_model(votes, float(share)).posterior(votes)
    x = np.log1p(hits)
    b = logistic(x, posterior, l2=np.where(np.arange(x.shape[1]) < len(terms), 20.0, 0.5))  # single terms add to what the patterns say
    known = ~np.isnan(gold)
    slope, offset = logistic((x @ b[:-1] + b[-1])[known, None], gold[known], l2=1e-2)
    return Model(terms, b, (max(float(slope), 1e-3), float(offset)), float(share))


def score(docs: DataFrame, model: Model, column: str = "score", text: bool = True) -> DataFrame:
    """docs with a score column (0 to 1; null and empty texts like a text without any vote), which replaces one of that name;
    without their text, unless it is wanted back from the workers."""
    kept = [f for f in docs.schema.fields if f.name.lower() != column.lower() and (text or f.name != "text")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    names = [f.name for f in kept]

    def run(batches):
        voters = Voters(model.terms)
        for pdf in in_chunks(batches):
            if len(pdf):
                yield pdf[names].assign(**{column: model.score(np.stack([voters.features(t) for t in pdf["text"]]))})

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, "text"])]).mapInPandas(run, f"{fields}`{column}` double")


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained_on(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labels that aren't held out."""
    return fit(docs.where(~_held_out()), labels.where(~_held_out()))


THRESHOLD = 0.3


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, by a model of the labels that aren't held out."""
    column = unused(docs, "toxicity")
    return score(docs, trained_on(docs, labels), column).where(F.col(column) < threshold).drop(column)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_on(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), "text"), model, text=False)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
