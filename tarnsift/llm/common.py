"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a mapper works on at once; bounds the memory of a Python worker.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def repeats(df: DataFrame, column: str) -> bool:
    """Whether the column holds a value twice, or a null."""
    return df.groupBy(column).count().where(F.col(column).isNull() | (F.col("count") > 1)).limit(1).count() > 0


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(*cols) -> F.Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit integers; works on uint64 arrays and wraps around."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word bytes -> 64-bit hash, kept for the words seen lately."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def hashed_words(text: str | None, words: WordHashes, lower: bool = False) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ in order. A long text is cut into words slice by slice, so that beside the
    text and 8 bytes for each word only one slice's words are held."""
    data = (text or "").encode("utf-8")
    if lower:
        data = data.lower()
    parts, at = [], 0
    while len(data) - at > CHUNK_BYTES:
        space = _SPACE.search(data, at + CHUNK_BYTES)
        if space is None:
            break
        parts.append(words.of(data[at : space.start()].split()))
        at = space.start()
    last = words.of(data[at:].split())
    return np.concatenate([*parts, last]) if parts else last


def in_chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Cuts pandas batches into pieces of about `limit` characters of text, whole rows each."""
    for pdf in batches:
        sizes = pdf[text].str.len().fillna(0).to_numpy(dtype=np.int64)
        ends = np.cumsum(sizes) // limit
        for cut in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(ends)) + 1):
            if len(cut):
                yield pdf.iloc[cut]


def shared_lines(left: list[str], right: list[str]) -> list[bool]:
    """Which lines of left stand in a longest common subsequence with right. Bit-parallel, a big integer for each line."""
    common = set(left) & set(right)
    out = [False] * len(left)
    if not common:
        return out
    a = [i for i, x in enumerate(left) if x in common]
    b = [x for x in right if x in common]
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    rows, state = [], full
    for i in a:
        rows.append(state)
        u = state & where[left[i]]
        state = ((state + u) | (state - u)) & full
    j = len(b)  # zeros of a state below bit j: the length of the subsequence with the first j lines
    length = lambda s, k: k - (s & ((1 << k) - 1)).bit_count()
    for i, before in zip(reversed(a), reversed(rows)):
        if j == 0:
            break
        u = before & where[left[i]]
        after = ((before + u) | (before - u)) & full
        if length(after, j) == length(before, j):
            continue
        here = length(after, j)
        while length(after, j - 1) == here:
            j -= 1
        out[i] = True
        j -= 1
    return out
