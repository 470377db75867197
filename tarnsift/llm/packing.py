"""Best-fit packing of tokenized documents into fixed-length training sequences.

Vector best-fit: every sequence keeps three residual capacities (tokens, documents, attention cost) and a
piece goes to the open sequence, fitting under every constraint, that scores best: the weighted dot product of
the piece's demand and the residuals (`rule="dot"`), or the weighted norm of what would be left (`rule="norm"`).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import in_chunks, table
from tarnsift.sources.shared import stored

CAPACITY = 2048
#: Weights of residual tokens, documents and attention cost in a bin's score.
WEIGHTS = (1.0, 0.02, 0.05)
#: Pieces that one packing task places; what tasks leave open at their ends is about one sequence each.
GROUP = 4096

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, ids binary"


#: Chunks of text whose tokens can be found piece by piece with the tokenizer's model alone: Latin letters, digits and
#: ASCII punctuation but the apostrophe, for which normalizing is lower-casing and cutting is by kind of character.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in a byte-level vocabulary: themselves, or those from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class _Kept(dict):
    """A dict that makes missing values and keeps the last `limit` or twice as many; those used lately outlive a turn."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TokenCache:
    """Token ids of texts as little-endian uint32 bytes. White space is dropped by the tokenizer and nothing is joined across
    it, so the ids of a text are those of its chunks between white space; chunks and their pieces seen lately are kept.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.pieces = _Kept(self._piece, limit)
        self.chunks = _Kept(self._chunk, limit)
        probe = "Été-42 naïve, (Rue) x_y?!"
        self.plain = all(self._by_pieces(w) == self.encode(w) for w in probe.split())

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])

    def _by_pieces(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p] for p in PIECE.findall(chunk.lower())])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        return self._by_pieces(text) if self.plain and PLAIN.fullmatch(text) else self.encode(text)

    def document(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):  # special tokens may stand against white space: leave them to the tokenizer
            return self.encode(text)
        return b"".join(map(self.chunks.__getitem__, text.encode("utf-8").split()))


def _tokenize(batches, path: str, capacity: int, eos: int, with_ids: bool):
    import os
    import zlib

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache, end = TokenCache(path), np.array([eos], dtype="<u4").tobytes()
    for pdf in in_chunks(batches):
        out: list[tuple] = []
        for doc_id, key, text in zip(pdf["doc_id"], pdf["row_key"], pdf["text"]):
            ids = cache.document(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                out.append((doc_id, key, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
        made = pd.DataFrame(out, columns=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "ids"])
        made["doc_id"] = made["doc_id"].astype("Int64")
        for i in range(0, len(made), 20_000):
            yield made.iloc[i : i + 20_000]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, eos: int = 0, with_ids: bool = True) -> DataFrame:
    """Tokenizes whole texts (null: empty), ends each with `eos` and cuts only documents longer than `capacity`.

    Repeated rows are documents of their own (row_key tells them apart). An empty text is the end token alone.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_key"), "text")
    return rows.mapInPandas(lambda it: _tokenize(it, tokenizer, capacity, eos, with_ids), PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int | None = None, attention: int | None = None, rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length, longest first. Every open bin that holds the piece under all three limits is scored, and
    the best takes it; of equals the one opened first. A bin is closed once nothing that is left fits its tokens or documents.
    """
    most_docs, most_cost = float(max_docs or capacity), float(attention or capacity * capacity)
    w_tok, w_doc, w_att = weights
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min(initial=capacity))
    name, left, docs, cost = np.zeros(64, np.int64), np.zeros(64), np.zeros(64), np.zeros(64)  # of the open bins, the first `n`, in order of opening
    n = made = 0
    for i in order:
        need = float(lengths[i])
        at = np.flatnonzero((left[:n] >= need) & (docs[:n] < most_docs) & (cost[:n] + need * need <= most_cost))
        if len(at):
            tok, doc, att = left[at], docs[at], cost[at]
            if rule == "norm":
                r = (tok - need) / capacity, (most_docs - doc - 1) / most_docs, (most_cost - att - need * need) / most_cost
                score = w_tok * r[0] * r[0] + w_doc * r[1] * r[1] + w_att * r[2] * r[2]
            else:
                score = w_tok * need / capacity * tok / capacity + w_doc / most_docs * (most_docs - doc) / most_docs + w_att * need * need / most_cost * (most_cost - att) / most_cost
            b = at[score.argmin()]
        else:
            if n == len(name):
                name, left, docs, cost = (np.concatenate([x, np.zeros_like(x)]) for x in (name, left, docs, cost))
            b = n
            name[b], left[b], docs[b], cost[b] = made, capacity, 0, 0
            n, made = n + 1, made + 1
        bins[i], offsets[i] = name[b], capacity - left[b]
        left[b] -= need
        docs[b] += 1
        cost[b] += need * need
        if left[b] < least or docs[b] >= most_docs:
            for x in (name, left, docs, cost):
                x[b : n - 1] = x[b + 1 : n]
            n -= 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, attention: int | None = None, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. Each task packs the pieces of one hash group of about `group` rows;
    the number of groups follows the number of pieces, so no task grows with the input.

    max_docs: documents a sequence may hold (default: no more than its tokens); attention: most of the sum of squared
    piece lengths (default: capacity squared). A piece that no limit lets in beside others gets its own sequence.
    """
    groups = max(1, round(parts.count() / group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row_key", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, max_docs, attention, rule)
        first = int(pdf["pack_group"].iloc[0]) << 32
        return pdf.assign(sequence_id=bins + first, offset=offsets)

    keyed = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    return keyed.groupBy("pack_group").applyInPandas(place, f"{fields}, sequence_id long, offset long").drop("pack_group")


def pack_documents(docs: DataFrame, tokenizer: str, **limits) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32, sequence_id, offset for whole documents. The pieces are written
    once to the shared folder: their row keys and their number have to stay the same for the packing that follows.
    """
    return pack(stored(pieces(docs, tokenizer, with_ids=False).drop("ids"), "pieces"), **limits)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
