"""Language identification by error-correcting output codes over hashed letter n-grams.

Every language has a codeword of +1 and -1. For each bit a binary n-gram classifier (log-odds of 2- and 3-byte grams,
hashed) predicts the side; its margin for a text is the mean log-odds over the text's grams. Decoding picks the
codeword with the least logistic loss, bits weighted by how far apart they hold the languages they were trained on.
A text whose two best codewords lose nearly the same is flagged as ambiguous.

All labelled rows are used: the classifiers need only the gram counts of each language, a table of languages x grams.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import in_chunks, table

GRAM_BITS = 14
#: Most languages that a model is fitted for.
LANGUAGES = 1000
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    """Lower-case letters of the text, runs of anything else as one space; empty if it has no letter."""
    if not text:
        return b""
    norm = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {norm} ".encode() if any(map(str.isalpha, set(norm))) else b""


def gram_counts(norm: bytes, bits: int = GRAM_BITS) -> np.ndarray:
    b = np.frombuffer(norm, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:] + np.uint32(1 << 26)
    grams = np.concatenate([two, three]) * np.uint32(2654435769) >> np.uint32(32 - bits)
    return np.bincount(grams, minlength=1 << bits)


def codewords(n: int) -> np.ndarray:
    """n x bits of +-1. Up to 7 languages every split of them is a bit; beyond, random bits far apart, the same at each run."""
    if n <= 7:
        return np.array([[1 if i == 0 or not m >> (i - 1) & 1 else -1 for m in range(1, 1 << (n - 1))] for i in range(n)], dtype=np.float64)
    rng, bits = np.random.default_rng(n), int(np.ceil(10 * np.log2(n)))
    made = (rng.choice([-1.0, 1.0], (n, bits)) for _ in range(100))
    return max(made, key=lambda c: -np.max(c @ c.T - 2 * bits * np.eye(n)))


def _count(batches, known: list[str], bits: int):
    total = np.zeros((len(known), 1 << bits), np.int64)
    row = {x: i for i, x in enumerate(known)}
    for pdf in in_chunks(batches):
        for lang, text in zip(pdf["lang"], pdf["text"]):
            norm = letters(text)
            if norm:
                total[row[lang]] += gram_counts(norm, bits)
    i, g = np.nonzero(total)
    if len(i):
        yield pd.DataFrame({"lang": [known[x] for x in i], "gram": g, "n": total[i, g]})


class Codes:
    """known: languages; words: codewords; weights: grams x bits of log-odds, scaled; trust: weight of each bit."""

    def __init__(self, known: list[str], counts: np.ndarray):
        self.known = known
        self.words = codewords(len(known)) if len(known) > 1 else np.ones((len(known), 1))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        side = [[share[self.words[:, j] == s].mean(axis=0) if (self.words[:, j] == s).any() else share.mean(axis=0) for s in (1, -1)] for j in range(self.words.shape[1])]
        odds = np.stack([np.log(a) - np.log(b) for a, b in side], axis=1)
        held = (share @ odds) * self.words  # margin that a language's own grams have, towards its side
        scale = np.maximum(np.abs(held).mean(axis=0), 1e-9)
        self.weights = (odds / scale).astype(np.float32)
        trust = np.maximum(held.min(axis=0) / scale, 0.05)
        self.trust = trust / trust.sum()

    def decode(self, margins: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, ambiguous) of rows of margins; few grams make a text less certain."""
        sharp = 8 * np.minimum(1, np.sqrt(np.maximum(grams, 1) / 40))[:, None]
        loss = np.stack([(np.logaddexp(0, -margins * w) * self.trust).sum(axis=1) for w in self.words], axis=1) * sharp
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top[:, -1], top[:, -1] - second < 0.2


def learn(labelled: DataFrame, bits: int = GRAM_BITS) -> Codes | None:
    """Codes from rows with text and lang (nulls are passed over); None if there are none. A row for each language comes to the
    driver, and languages x grams counts; more than LANGUAGES values of lang are refused, as they cannot be languages."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    known = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(known) > LANGUAGES:
        raise ValueError(f"lang holds more than {LANGUAGES} values")
    if not known:
        return None
    counted = rows.mapInPandas(lambda it: _count(it, known, bits), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(known), 1 << bits))
    counts[[known.index(x) for x in counted["lang"]], counted["gram"]] = counted["n"]
    return Codes(known, counts)


def _predict(batches, codes: Codes | None, bits: int):
    for pdf in in_chunks(batches):
        n = len(pdf)
        lang, score, unsure, code = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool), [None] * n
        if codes is not None:
            texts = pdf["text"].tolist()
            for s in range(0, n, 256):
                norms = [letters(t) for t in texts[s : s + 256]]
                full = [i for i, x in enumerate(norms) if x]
                if not full:
                    continue
                x = np.stack([gram_counts(norms[i], bits) for i in full]).astype(np.float32)
                grams = x.sum(axis=1)
                margins = (x @ codes.weights) / grams[:, None]
                best, p, ambiguous = codes.decode(margins.astype(np.float64), grams)
                at = np.array(full) + s
                lang[at], score[at], unsure[at] = np.array(codes.known, object)[best], p, ambiguous
        yield pdf.drop(columns="text").assign(lang_pred=lang, score=score, ambiguous=unsure)


def identify(docs: DataFrame, codes: Codes | None, bits: int = GRAM_BITS) -> DataFrame:
    """docs without text, with lang_pred, score (0 to 1) and ambiguous, which replace columns of these names. Null texts and
    texts without a letter: `und`, 0."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("text", "lang_pred", "score", "ambiguous")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.select("text", *[F.col(f"`{f.name}`") for f in kept]).mapInPandas(lambda it: _predict(it, codes, bits), f"{fields}lang_pred string, score double, ambiguous boolean")


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    codes = learn(docs.where(~held_out))
    return identify(docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text"), codes)
