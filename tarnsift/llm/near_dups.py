"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Sketch of t bins in at most 2t rounds: in round i < t every shingle is thrown into one bin by a hash and leaves
(i, hash) there; round t + j throws all shingles into bin j, so each bin is filled at last. A bin keeps its least
value, thus later rounds matter only to bins still empty. Two sets agree in a bin with their Jaccard similarity as
probability, concentrated as if bins were independent. With 36 bands of 5 bins a pair at similarity 0.8 shares no
band with probability 6e-7.

Equal sets form one class and only its representative goes on. Links: (1) in each bucket of a band everyone is
checked against the bucket's least member and components are built; (2) in buckets that still hold more than one
component, only the members outside the largest one are dealt to every block of the bucket; those of it stay in one block.
Members whose sketches allow a link across components are checked against the whole block, and a block returns only
links that join components. Every check is exact, on the full shingle sets; a bucket of copies of one text costs one
check a member, one odd member among them one more row for each block, and no step emits a row for each pair of a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm.common import WordHashes, hashed_words, in_chunks, mix64, repeats, table, unused
from tarnsift.llm.graph import components
from tarnsift.llm.substrings import _grams, _runs
from tarnsift.sources.shared import stored

BANDS, ROWS = 36, 5
#: Members of a bucket, and their shingles, that are compared with one another in one go.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Members that one copy of a bucket's least text is joined with.
HUB = 4096
#: Text bytes that are signed at once; their shingles take about forty times as much memory meanwhile. A longer text is
#: signed alone, from 8 bytes for each of its words.
SIGNED_BYTES = 3 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words cut at ASCII white space."""
    tokens = hashed_words(text, words, lower=True)
    if not len(tokens):
        return np.empty(0, np.uint64)
    return np.unique(_grams(tokens, min(width, len(tokens))))


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of `bins` 16-bit values for each non-empty set."""
    best = np.full(len(sets) * bins, _NONE, np.uint64)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    look = 1
    for i in range(2 * bins):
        if not len(items):
            break
        key = mix64(items + np.uint64((i * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64)))
        at = ((key >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(best, owner * bins + at, np.uint64(i << 32) | key & np.uint64(0xFFFFFFFF))
        if i + 1 == look:
            open_sets = (best.reshape(-1, bins) == _NONE).any(axis=1)[owner]
            items, owner = items[open_sets], owner[open_sets]
            look += max(1, look // 3)
    return (mix64(best) & np.uint64(0xFFFF)).astype("<u2").reshape(-1, bins)


def _sign(batches, width: int, bins: int):
    import xxhash

    words = WordHashes()
    for pdf in in_chunks(batches, limit=SIGNED_BYTES):
        sets = [shingle_set(t, width, words) for t in pdf["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        made = sketches([sets[i] for i in full], bins)
        h1, h2, sketch = ([None] * len(sets) for _ in range(3))
        for row, i in enumerate(full):
            d = xxhash.xxh3_128_intdigest(sets[i].tobytes())
            h1[i], h2[i] = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
            sketch[i] = made[row].tobytes()
        yield pd.DataFrame({"node": pdf["node"], "doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "h1": pd.array(h1, "Int64"), "h2": pd.array(h2, "Int64"), "sketch": sketch})


def _confirm(batches, width: int, percent: int):
    """The pairs whose full sets overlap enough; rows come sorted by a, so its set is made once a run."""
    words = WordHashes()
    last, left = None, None
    for pdf in batches:
        good = np.zeros(len(pdf), bool)
        for i, (a, text_a, text_b) in enumerate(zip(pdf["a"], pdf["text_a"], pdf["text_b"])):
            if a != last:
                last, left = a, shingle_set(text_a, width, words)
            right = shingle_set(text_b, width, words)
            both = len(np.intersect1d(left, right, assume_unique=True))
            good[i] = 100 * both >= percent * (len(left) + len(right) - both)
        yield pdf.loc[good, ["a", "b"]]


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs: a, b, members of their bucket. The least text of a large bucket is a key of many rows: it is dealt in salted copies."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / HUB)).alias("salt"))
    least = salted.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    half = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return half.join(least, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInPandas(lambda it: _confirm(it, width, percent), "a long, b long")


def _cells(pdf: pd.DataFrame):
    cells = pdf["cell"].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]])
    return zip(cuts[:-1], cuts[1:])


def _worth_checking(batches, bands: int, rows: int, percent: int, floor: int):
    """Of each cell (a block of a bucket, or two) the members that have a partner in another component whose size and sketch
    allow the similarity and whom they meet in no earlier band."""
    for pdf in _runs(batches, "cell"):
        comp, size, band = (pdf[c].to_numpy() for c in ("comp", "n_shingles", "band_no"))
        side, same = pdf["side"].to_numpy(), pdf["same"].to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), "<u2").reshape(len(pdf), bands * rows)
        wanted = np.zeros(len(pdf), bool)
        for s, e in _cells(pdf):
            ids = np.arange(s, e)
            lefts, rights = (ids, ids) if same[s] else sorted((ids[side[s:e] == 0], ids[side[s:e] == 1]), key=len)
            for i in lefts:
                others = rights[comp[rights] != comp[i]]
                big, small = np.maximum(size[others], size[i]), np.minimum(size[others], size[i])
                others = others[100 * small >= percent * big]
                if not len(others):
                    continue
                equal = sketch[others] == sketch[i]
                first_band = equal.reshape(len(others), bands, rows).all(axis=2).argmax(axis=1)
                others = others[(equal.sum(axis=1) >= floor) & (first_band == band[i])]
                wanted[others] = True
                wanted[i] |= len(others) > 0
        if wanted.any():
            yield pdf.loc[wanted, ["cell", "node", "comp"]]


def _links_in_cell(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a cell, checked on the full sets: each set against all others by the members of
    its shingles. Pairs inside a component, and links that join nothing new, are left out."""
    sizes = np.array([len(x) for x in sets])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(which, kind="stable")
    holders, start = owner[by], np.concatenate([[0], np.cumsum(np.bincount(which))])
    ends = np.cumsum(sizes)
    _, group = np.unique(comp, return_inverse=True)
    links = []
    for i in np.argsort(np.bincount(group)[group], kind="stable"):  # the small components look for the large ones
        if (group == group[i]).sum() * 2 > len(group):
            continue  # the others have looked, or will look, for this component's members
        mine = which[ends[i] - sizes[i] : ends[i]]
        both = np.bincount(np.concatenate([holders[start[t] : start[t + 1]] for t in mine]), minlength=len(sets))
        good = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (group != group[i]))
        while len(good):
            j = good[0]
            links.append((min(node[i], node[j]), max(node[i], node[j])))
            group[group == group[j]] = group[i]
            good = good[group[good] != group[i]]
    return links


def _links_across(batches, width: int, percent: int):
    words = WordHashes()
    for pdf in _runs(batches, "cell"):
        node, comp, texts = pdf["node"].to_numpy(), pdf["comp"].to_numpy(), pdf["text"].to_numpy()
        links = []
        for s, e in _cells(pdf):
            if e - s > 1:
                links += _links_in_cell(node[s:e], comp[s:e], [shingle_set(t, width, words) for t in texts[s:e]], percent)
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])


def _node(odd: bool) -> F.Column:
    """What tells documents apart: the id, or if ids repeat or are null, a hash of id and text."""
    return F.xxhash64("doc_id", "text") if odd else F.col("doc_id").cast("long")


def _grouped(docs: DataFrame, odd: bool, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """node, doc_id, n_shingles, component_id, root (the node that stands for its group) for every row."""
    bins = bands * rows
    keyed = docs.select(_node(odd).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(keyed.mapInPandas(lambda it: _sign(it, width, bins), "node long, doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "signatures")

    classes = stored(signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("node").alias("node"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    banded = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * rows) + 1, F.lit(2 * rows))))).alias("band_no", "band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1")
    members = stored(banded.join(buckets, "band").select("band", "band_no", "node", "a", "members"), "members")

    pairs = stored(members.where("node > a").groupBy("a", F.col("node").alias("b")).agg(F.max("members").alias("members")), "pairs")
    named = members.select("node").distinct()
    texts = stored(keyed.select("node", "text").join(named, "node", "left_semi").dropDuplicates(["node"]) if odd else keyed.select("node", "text").join(named, "node", "left_semi"), "texts")
    links = stored(_confirmed(pairs, texts, width, percent), "links")
    roots = components(links)

    # what is left: buckets that hold several components
    labelled = members.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "a")
    several = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    held = stored(labelled.join(several, "band", "left_semi").join(classes.select("node", "n_shingles", "sketch"), "node"), "held")
    share = 1 - (100 - percent) / 100
    floor = max(rows, math.floor(bins * share - 6.5 * math.sqrt(bins * share * (1 - share))))
    of_comp = held.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.max("members").alias("members"))
    largest = F.max(F.struct("n", "s", "comp"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    salts = F.ceil(F.col("members") / BLOCK).cast("int")  # a band of many members is joined in salted parts
    bands_ = of_comp.groupBy("band").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("members").alias("members")).select(
        "band", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("main.comp").alias("main"), blocks(F.col("main.n"), F.col("main.s")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("others")
    )
    placed = held.withColumn("salt", F.pmod(F.xxhash64("node", "band"), salts).cast("int")).join(bands_, ["band", "salt"]).withColumn("odd", F.col("comp") != F.col("main")).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("odd"), F.col("others")).otherwise(F.col("mains"))).cast("int"))
    # an odd member meets every block of the largest component (kind 0) and every block of odd ones (kind 1)
    meet = lambda kind, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("block")))
    dealt = placed.withColumn("other", F.explode(F.when(F.col("odd"), F.concat(meet(0, F.col("mains")), meet(1, F.col("others")))).otherwise(meet(0, F.col("others")))))
    kind, block = F.col("other.kind"), F.col("other.block")
    first = F.when(kind == 0, F.when(F.col("odd"), block).otherwise(F.col("own"))).otherwise(F.least("own", block))
    second = F.when(kind == 0, F.when(F.col("odd"), F.col("own")).otherwise(block)).otherwise(F.greatest("own", block))
    spread = dealt.select(
        "node", "comp", "n_shingles", "sketch", "band_no", ((kind == 1) & (F.col("own") == block)).alias("same"),
        F.when(kind == 0, F.col("odd").cast("int")).otherwise((F.col("own") > block).cast("int")).alias("side"), F.xxhash64("band", kind, first, second).alias("cell"),
    )
    worth = spread.repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda it: _worth_checking(it, bands, rows, percent, floor), "cell long, node long, comp long")
    with_text = worth.join(texts, "node").repartition("cell").sortWithinPartitions("cell", "node")
    more = stored(with_text.mapInPandas(lambda it: _links_across(it, width, percent), "a long, b long").distinct(), "links2")
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    labels = classes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"), "least")
    if odd:
        labels = labels.join(labels.groupBy("root").agg(F.min("least").alias("component")), "root").drop("least")
    else:
        labels = labels.select("h1", "h2", "root", F.col("root").alias("component"))
    alone = F.col("n_shingles") == 0
    return signed.drop("sketch").join(labels, ["h1", "h2"], "left").select(
        "node", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"),
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is its component's least) for every row.

    Texts without words, and null texts, have an empty set and link with nothing. Rows that repeat a doc_id, or have
    none, are documents of their own; a component of null ids only has component_id null and keeps its rows.
    """
    found = _grouped(docs, repeats(docs, "doc_id"), width, percent, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, one for each group of near duplicates; texts without words all stay, repeated rows once."""
    odd = repeats(docs, "doc_id")
    node = unused(docs, "node")
    stays = _grouped(docs, odd, width, percent, bands, rows).where("node = root").select(F.col("node").alias(node))
    keyed = docs.withColumn(node, _node(odd))
    return (keyed.dropDuplicates([node]) if odd else keyed).join(stays.distinct() if odd else stays, node, "left_semi").drop(node)


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Links by counting common shingles of every two different sets; components by walking along links.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM t WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT doc_id, n, list_sort(list(g)) AS gs FROM s JOIN n USING (doc_id) GROUP BY ALL), u AS (SELECT min(doc_id) AS d, n, gs FROM c GROUP BY n, gs), us AS (SELECT d, n, unnest(gs) AS g FROM u),
 p AS (SELECT a.d AS a, b.d AS b, a.n AS na, b.n AS nb, count(*) AS common FROM us a JOIN us b ON a.g = b.g AND a.d < b.d AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)), e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT d AS x, d AS y FROM u UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), m AS (SELECT x AS d, min(y) AS root FROM r GROUP BY 1),
 f AS (SELECT c.doc_id, c.n, root FROM c JOIN u ON c.n = u.n AND c.gs = u.gs JOIN m ON m.d = u.d)
SELECT t.doc_id, coalesce(f.n, 0) AS n_shingles, coalesce(root, t.doc_id) AS component_id, coalesce(root, t.doc_id) = t.doc_id AS kept FROM t LEFT JOIN f ON t.doc_id = f.doc_id
"""
