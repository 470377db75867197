"""Merkle fingerprints: a tree over a document's sections, paragraphs and phrases.

Paragraphs are lines. An empty line closes a section, and so does a line whose own hash says so, about one in SECTION, so
that texts without empty lines have sections too and an edit moves no border but its own. The root hashes the sections'
hashes, these the paragraphs', and a paragraph's hash is of its bytes' hash and of the codes of its phrases, so roots are
equal exactly for equal texts and the tree commits to its leaves. The fingerprint is the root and, after a colon, the tree
below it: sections apart by "|", each its hash and then its paragraphs apart by ".", each of these its hash and 4
characters for every phrase (up to four words, ended by punctuation; 24 bits of a hash). Two fingerprints are compared
without the texts, from the root down: branches of equal hashes are skipped, and what stands between them on either side
are the places of the edits. Likeness is counted on the same way down: equal sections count whole, then equal paragraphs
of the others, then equal phrases of what is left.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import repeats, shared_lines, table
from tarnsift.llm.ordered import in_order, triples

PHRASE = re.compile(rb"(?:[^\s.,;:!?]{1,24} ?){1,4}[.,;:!?]*")


def _phrases(paragraph: bytes) -> bytes:
    """24 bits for every phrase."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    phrases = PHRASE.findall(paragraph)
    codes = np.fromiter(map(digest, phrases), np.uint64, len(phrases))
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :3]).tobytes()


#: Characters of a section's or paragraph's hash below the root: 48 bits; one line in so many closes a section.
NODE, SECTION = 8, 8


def _paragraph(line: bytes, codes: bytes) -> bytes:
    return hashlib.sha256(b"P" + hashlib.sha256(line).digest() + codes).digest()


def fingerprint(text: str | None) -> str:
    sections: list[tuple[bytes, str]] = []
    digests, leaves = [], []

    def close() -> None:
        digest = hashlib.sha256(b"S" + b"".join(digests)).digest()
        sections.append((digest, ".".join([_short(digest), *leaves])))
        digests.clear()
        leaves.clear()

    for line in (text or "").encode("utf-8").split(b"\n"):
        codes = _phrases(line)
        digests.append(_paragraph(line, codes))
        leaves.append(_short(digests[-1]) + base64.urlsafe_b64encode(codes).decode())
        if not line or digests[-1][0] % SECTION == 0:
            close()
    if digests:
        close()
    root = hashlib.sha256(b"R" + b"".join(d for d, _ in sections)).hexdigest()
    return root + ":" + "|".join(x for _, x in sections)


def _short(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest[: NODE * 3 // 4]).decode()


def tree(print_: str) -> list[tuple[str, list[str]]]:
    """(hash, paragraphs) of every section; a paragraph is its hash and its phrases' codes."""
    sections = (x.split(".") for x in print_.partition(":")[2].split("|"))
    return [(head, paragraphs) for head, *paragraphs in sections]


_EMPTY = _short(_paragraph(b"", b""))


def _weight(paragraph: str) -> int:
    """What a paragraph counts: its phrases and, unless it is empty, itself."""
    return (len(paragraph) - NODE) // 4 + (paragraph[:NODE] != _EMPTY)


def _apart(left: list[str], right: list[str]) -> tuple[list[int], list[int]]:
    """Places of either list that are left when equal hashes have been paired off, wherever they stand."""
    there: dict[str, list[int]] = {}
    for j, h in enumerate(right):
        there.setdefault(h, []).append(j)
    alone, met = [], set()
    for i, h in enumerate(left):
        if there.get(h):
            met.add(there[h].pop())
        else:
            alone.append(i)
    return alone, [j for j in range(len(right)) if j not in met]


def _bag(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all phrases of these paragraphs, and how often each stands there."""
    packed = base64.urlsafe_b64decode("".join(p[NODE:] for p in paragraphs))
    wide = np.zeros((len(packed) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return np.unique(wide.view("<u4").ravel(), return_counts=True)


def likeness(a: str, b: str) -> float:
    """Share of phrases and whole paragraphs that two trees have in common: 2 * common / (both counts), where sections and then
    paragraphs of equal hashes are paired off first, and phrases are compared only in paragraphs that are left. 1 for equal
    texts only: others have one more in neither."""
    if a[:64] == b[:64]:
        return 1.0
    left, right = tree(a), tree(b)
    whole = sum(_weight(p) for side in (left, right) for _, paragraphs in side for p in paragraphs)
    if not all(any(_weight(p) for _, paragraphs in side for p in paragraphs) for side in (left, right)):
        return 0.0
    for _ in ("sections", "paragraphs"):
        one, other = _apart([h for h, _ in left], [h for h, _ in right])
        below = lambda side, at: [p for i in at for p in side[i][1]]
        mine, theirs = below(left, one), below(right, other)
        left, right = [(p[:NODE], [p]) for p in mine], [(p[:NODE], [p]) for p in theirs]
    apart = sum(_weight(p) for p in [*mine, *theirs])
    (u, n), (v, m) = _bag(mine), _bag(theirs)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    common = whole - apart + 2 * int(np.minimum(n[i], m[j]).sum())
    return float(min(common / whole, whole / (whole + 1)))


def _unmatched(left: list[str], right: list[str]) -> tuple[list[int], list[int]]:
    """Places of either list that stand outside a longest common subsequence of the two."""
    start = next((i for i, (x, y) in enumerate(zip(left, right)) if x != y), min(len(left), len(right)))
    most = min(len(left), len(right)) - start
    end = next((i for i in range(most) if left[-1 - i] != right[-1 - i]), most)
    middle, other = left[start : len(left) - end], right[start : len(right) - end]
    mine = shared_lines(middle, other)
    common = iter([x for x, same in zip(middle, mine) if same])
    come, wanted = [], next(common, None)
    for i, x in enumerate(other):
        if x == wanted:
            wanted = next(common, None)
        else:
            come.append(start + i)
    return [start + i for i, same in enumerate(mine) if not same], come


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(section, paragraph) places of `a` that `b` lacks, and of `b` that `a` lacks. Sections and then, inside sections that
    stand at the same place between equal ones, paragraphs are aligned by their hashes, so what an insertion moves is equal."""
    if a[:64] == b[:64]:
        return [], []
    left, right = tree(a), tree(b)
    mine, theirs = _unmatched([h for h, _ in left], [h for h, _ in right])
    paragraphs = lambda sections, at: [((s, p), x[:NODE]) for s in at for p, x in enumerate(sections[s][1])]
    one, other = paragraphs(left, mine), paragraphs(right, theirs)
    gone, come = _unmatched([h for _, h in one], [h for _, h in other])
    return [one[i][0] for i in gone], [other[i][0] for i in come]


def _edited(batches):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_paragraphs"]
    out = []
    size = 0
    for _, (row, own), after in triples(batches, lambda r: fingerprint(r.text)):
        nxt, nxt_print = after
        half = len(row.text) // 2
        edited = row.text[: len(row.text) - half] + nxt.text[:half]
        edited_print = fingerprint(edited)
        out.append((row.doc_id, len(row.text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own, edited_print, likeness(own, edited_print), likeness(own, nxt_print), len(differing(own, edited_print)[0])))
        size += len(own) + len(edited_print)
        if size > 4_000_000:
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form: the last half of its code points replaced by the first as
    many of the next document (ascending doc_id, the first after the last; rows of one doc_id by a hash of the text).

    edited_paragraphs: paragraphs of the text that the edited form lacks, found by the two fingerprints alone. Null text:
    empty; an only document is its own next. Null doc_id comes first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("order_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keys = ["order_id"]
    if repeats(docs, "doc_id"):
        rows, keys = rows.withColumn("order_text", F.xxhash64("text")), ["order_id", "order_text"]
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs int"
    return in_order(rows, keys, wrap=True, text="text").mapInPandas(_edited, fields)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
