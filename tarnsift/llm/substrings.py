"""Removal of word passages that occur earlier in the corpus, by relative Lempel-Ziv parsing.

The reference of a document is all text before it (smaller doc_id, or an earlier start in the same document), in blocks
that are indexed by content: in every window of `window` words the `gram`-word run with the least hash is the window's
anchor, so equal windows have equal anchors, and a block is the context of one anchor (a word in about seven starts one).
A window is entered once, at its first occurrence - of the blocks one mapper holds, then of all - and an equal window
later on copies from there. The parse of a document goes left to right and is greedy: a factor starts at the first window
that has a source (document, word) and grows as long as each next window's source is the next word of the same document;
where that ends, the windows that straddle the end are looked up like any other, so one of them may start the next factor
there, which then counts from the end of the one before. Factors are at least `window` words long in the reference, tile
the words covered by repeated windows, and each is as long as its source goes on.

Steps: (1) find anchors that occur more than once, (2) of those, compare the windows around them with the blocks of the
same anchor and keep each one's source, (3) parse every document. Each mapper first settles repeats among the documents
it holds itself; of a passage that a third of all documents share, each mapper sends one row on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnsift.llm.common import WordHashes, hashed_words, in_chunks, mix64, repeats, table
from tarnsift.sources.shared import stored

WINDOW, GRAM = 20, 8
_LEAST = -(1 << 63)


def _grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` words from every position."""
    n = len(hashes) - gram + 1
    total = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(gram):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix64(total)


def _windows(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Hash of the `window` words from every position, of gram hashes that together cover them."""
    n = len(grams) - (window - gram)
    total = np.zeros(n, np.uint64)
    factor = 0xA24BAED4963EE407
    for j in [*range(0, window - gram, gram), window - gram]:
        total += mix64(grams[j : j + n] * np.uint64(factor))
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix64(total)


#: Bits of a position that stand below a gram hash, so that one minimum finds the least hash and its leftmost place.
_PLACE = 24


def _anchors(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor's position for every window start; never decreases. The least of 2, 4, 8, ... neighbours, then of the width."""
    width = window - gram + 1
    n = len(grams) - width + 1
    if len(grams) >> _PLACE:
        return np.arange(n) + (np.lib.stride_tricks.sliding_window_view(grams >> np.uint64(_PLACE), width)).argmin(axis=1)
    least = grams >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:n], least[width - span :][:n])
    return (least[:n] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def _find(batches, window: int, gram: int):
    """(route, gram hash, document, position, known): anchors; known: it has occurred twice among this chunk's documents.
    Of those only the first keeps the gram hash as its route, the others need no further lookup and go anywhere."""
    words = WordHashes()
    rng = np.random.default_rng(0)
    for pdf in in_chunks(batches):
        gram_hash, doc, tie, pos = [], [], [], []
        for d, t, text in zip(pdf["d"], pdf["tie"], pdf["text"]):
            tokens = hashed_words(text, words)
            if len(tokens) < window:
                continue
            g = _grams(tokens, gram)
            at = np.unique(_anchors(g, window, gram))
            gram_hash.append(g[at])
            pos.append(at)
            doc.append(np.full(len(at), d, np.int64))
            tie.append(np.full(len(at), t, np.int64))
        if not pos:
            continue
        gram_hash = np.concatenate(gram_hash)
        _, first, which, count = np.unique(gram_hash, return_index=True, return_inverse=True, return_counts=True)
        known = count[which] > 1
        is_first = np.zeros(len(gram_hash), bool)
        is_first[first] = True
        route = np.where(is_first, gram_hash, rng.integers(0, 1 << 64, len(gram_hash), np.uint64))
        out = pd.DataFrame({"route": route.view(np.int64), "gram_hash": gram_hash.view(np.int64), "d": np.concatenate(doc), "tie": np.concatenate(tie), "pos": np.concatenate(pos).astype(np.int32), "known": known})
        for i in range(0, len(out), 100_000):
            yield out.iloc[i : i + 100_000]


def _runs(batches, key: str):
    """Regroups sorted batches so that no run of equal keys is cut."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        if held and k[-1] == held[-1][key].iloc[-1]:
            held.append(pdf)
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if held or cut:
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _shared(batches):
    """The anchors that are known or have company under their route; rows come sorted by route and gram hash, and only the
    last one is held back."""
    columns = ["route", "gram_hash", "d", "tie", "pos", "known"]
    last = None  # the row before, if it waits for company
    before = None  # its route and gram hash
    for pdf in batches:
        if not len(pdf):
            continue
        r, g = pdf["route"].to_numpy(), pdf["gram_hash"].to_numpy()
        same = np.zeros(len(pdf), bool)
        eq = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
        same[1:] |= eq
        same[:-1] |= eq
        if before == (r[0], g[0]):
            same[0] = True
            if last is not None:
                yield last
        before, last = (r[-1], g[-1]), None
        keep = same | pdf["known"].to_numpy()
        if not keep[-1]:
            last = pdf.iloc[-1:][["d", "tie", "pos"]]
        if keep.any():
            yield pdf.loc[keep, ["d", "tie", "pos"]]


#: A stretch of windows that have an earlier occurrence: places at .. at + n - 1 from the row's first window, and where the first one's source starts.
_COPY = np.dtype([("at", "u1"), ("n", "u1"), ("pos", "<i4"), ("d", "<i8")])
_ROWS = "route long, gram_hash long, d long, tie long, low int, done int, windows binary, copies binary"
_FACTORS = "d long, tie long, start int, n int, source_d long, source_pos int, gram_hash long, window_hash long"
#: Different windows of one anchor that a task holds; of the rest each goes on by its own hash.
HELD = 200_000


def _first_of(key: np.ndarray, window_hash: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row the place of the first equal (key, window_hash) in order of doc, tie and start: its own, if it is that one."""
    order = np.lexsort((start, tie, doc, window_hash, key))
    k, w = key[order], window_hash[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    out = np.empty(len(k), np.int64)
    out[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return out


def _stretches(row: np.ndarray, start: np.ndarray, source_d: np.ndarray, source_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of windows of one row that follow one another and whose sources do as well."""
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (source_d[1:] != source_d[:-1]) | (source_pos[1:] != source_pos[:-1] + 1)
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(row)))


def _pieces(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of the first counts[0] values, of the next counts[1], and so on."""
    packed, ends = values.tobytes(), (values.itemsize * np.cumsum(counts)).tolist()
    return [packed[x:y] for x, y in zip([0, *ends], ends)]


def _compare_here(batches, window: int, gram: int):
    """A row for every shared anchor: its windows that no document of this chunk has before it, and as bits of `done` those that
    have, with their sources as `copies`."""
    words = WordHashes()
    rng = np.random.default_rng(0)
    for pdf in in_chunks(batches):
        parts = []
        for d, t, text, wanted in zip(pdf["d"], pdf["tie"], pdf["text"], pdf["anchors"]):
            g = _grams(hashed_words(text, words), gram)
            at = _anchors(g, window, gram)
            starts = np.flatnonzero(np.isin(at, np.asarray(wanted)))
            parts.append((g[at[starts]], _windows(g, window, gram)[starts], np.full(len(starts), d, np.int64), np.full(len(starts), t, np.int64), starts, at[starts]))
        if not parts:
            continue
        key, wh, doc, tie, start, at = (np.concatenate(x) for x in zip(*parts))
        source = _first_of(key, wh, doc, tie, start)
        first = source == np.arange(len(key))
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
        heads, row = np.flatnonzero(head), np.cumsum(head) - 1
        place = start - start[heads][row]
        done = np.add.reduceat(np.where(first, 0, 1 << place), heads)
        left = np.add.reduceat(first.astype(np.int64), heads)
        again = np.flatnonzero(~first)
        s, n = _stretches(row[again], start[again], doc[source[again]], start[source[again]])
        copies = np.empty(len(s), _COPY)
        copies["at"], copies["n"], copies["pos"], copies["d"] = place[again[s]], n, start[source[again[s]]], doc[source[again[s]]]
        lists = _pieces(wh[first], left)
        copied = _pieces(copies, np.bincount(row[again[s]], minlength=len(heads)))
        route = np.where(left > 0, key[heads], rng.integers(0, 1 << 64, len(heads), np.uint64))
        out = pd.DataFrame({"route": route.view(np.int64), "gram_hash": key[heads].view(np.int64), "d": doc[heads], "tie": tie[heads], "low": start[heads].astype(np.int32), "done": done.astype(np.int32), "windows": lists, "copies": copied})
        for i in range(0, len(out), 50_000):
            yield out.iloc[i : i + 50_000]


def _compare_all(batches, window: int, gram: int, most: int = HELD):
    """Stretches of windows that have an earlier occurrence: n from `start` on, with the source of the first. Rows come sorted by
    route, document and place; of a route that goes on in the next batch only different windows are held, with their sources,
    and of an anchor that many documents have before unlike words no more than about `most`: from then on a window that is
    neither among those held nor earlier in its batch goes on alone, with n = 0, its anchor and its hash."""
    width = window - gram + 1
    held, held_route = (np.empty(0, np.int64),) * 5, None
    for pdf in batches:
        if not len(pdf):
            continue
        route, grams, d, tie, low, done = (pdf[c].to_numpy().astype(np.int64) for c in ("route", "gram_hash", "d", "tie", "low", "done"))
        count = pdf["copies"].map(len).to_numpy() // _COPY.itemsize
        copies, of = np.frombuffer(b"".join(pdf["copies"]), _COPY), np.repeat(np.arange(len(pdf)), count)
        found = [(of, low[of] + copies["at"], copies["n"], copies["d"], copies["pos"])]
        sizes = pdf["windows"].map(len).to_numpy() // 8
        rows = np.repeat(np.arange(len(pdf)), sizes)
        bits = (done[:, None] >> np.arange(width)) & 1 == 0  # the windows listed are the lowest bits not done
        start = low[rows] + np.nonzero(bits & (np.cumsum(bits, axis=1) <= sizes[:, None]))[1]
        before = held if held_route == route[0] else (np.empty(0, np.int64),) * 5
        n0 = len(before[0])
        full = n0 >= most
        key, wh, doc, ties, at = (np.concatenate(x) for x in zip(before, (grams[rows], np.frombuffer(b"".join(pdf["windows"]), np.int64), d[rows], tie[rows], start)))
        source = _first_of(key, wh, doc, ties, at)
        own = np.arange(len(key))
        again = own[n0:][source[n0:] != own[n0:]]
        s, n = _stretches(rows[again - n0], at[again], doc[source[again]], at[source[again]])
        again = again[s]
        found.append((rows[again - n0], at[again], n, doc[source[again]], at[source[again]]))
        alone = own[n0:][(source[n0:] == own[n0:]) & (route[rows] == held_route)] if full else own[:0]
        goes_on = (source == own) & np.concatenate([np.full(n0, route[0] == route[-1]), route[rows] == route[-1]])
        goes_on[alone] = False
        held, held_route = tuple(x[goes_on] for x in (key, wh, doc, ties, at)), route[-1]
        row, start, n, source_d, source_pos = (np.concatenate(x) for x in zip(*found))
        none = np.zeros(len(row) + len(alone), np.int64)
        mine = lambda x, y: np.concatenate([x, y])
        if len(none):
            yield pd.DataFrame({
                "d": mine(d[row], doc[alone]), "tie": mine(tie[row], ties[alone]), "start": mine(start, at[alone]).astype(np.int32), "n": mine(n, none[: len(alone)]).astype(np.int32), "source_d": mine(source_d, none[: len(alone)]),
                "source_pos": mine(source_pos, none[: len(alone)]).astype(np.int32), "gram_hash": mine(none[: len(row)], key[alone]), "window_hash": mine(none[: len(row)], wh[alone]),
            })


def _met_alone(windows: DataFrame) -> DataFrame:
    """Of windows that went on alone those with an earlier one of equal anchor and hash, as stretches of one with the first as source."""
    order = W.partitionBy("gram_hash", "window_hash").orderBy("d", "tie", "start")
    met = windows.select("d", "tie", "start", F.row_number().over(order).alias("place"), F.first(F.struct("d", "start")).over(order).alias("first"))
    return met.where("place > 1").select("d", "tie", "start", F.lit(1).alias("n"), F.col("first.d").alias("source_d"), F.col("first.start").alias("source_pos"))


def parse(start: np.ndarray, n: np.ndarray, source_d: np.ndarray, source_pos: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors (start, length, source document, source start) in words, from stretches of n windows at `start`: stretches that go
    on where the one before ends, at the source as well, are one; a factor that overlaps the one before starts at its end."""
    order = np.argsort(start, kind="stable")
    start, n, source_d, source_pos = (np.asarray(x, np.int64)[order] for x in (start, n, source_d, source_pos))
    head = np.ones(len(start), bool)
    head[1:] = (start[1:] != start[:-1] + n[:-1]) | (source_d[1:] != source_d[:-1]) | (source_pos[1:] != source_pos[:-1] + n[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    end = start[last] + n[last] + window - 1
    begin = start[first]
    begin[1:] = np.maximum(begin[1:], end[:-1])
    return begin, end - begin, source_d[first], source_pos[first] + begin - start[first]


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carried: tuple[str, ...] = (), held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """(documents as d, tie, text and, numbered, the carried columns; d, tie, copies of those with repeated windows: stretches of
    windows and their sources). Both joins with the texts take the same columns, so the texts are shuffled once."""
    twice = repeats(docs, "doc_id")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("tie"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    anchors = keyed.dropDuplicates(["d", "tie"]) if twice else keyed
    found = anchors.select("d", "tie", "text").mapInPandas(lambda it: _find(it, window, gram), "route long, gram_hash long, d long, tie long, pos int, known boolean")
    shared = found.repartition("route").sortWithinPartitions("route", "gram_hash").mapInPandas(_shared, "d long, tie long, pos int")
    wanted = shared.groupBy("d", "tie").agg(F.collect_list("pos").alias("anchors"))
    here = anchors.join(wanted, ["d", "tie"]).mapInPandas(lambda it: _compare_here(it, window, gram), _ROWS)
    compared = stored(here.repartition("route").sortWithinPartitions("route", "d", "tie", "low").mapInPandas(lambda it: _compare_all(it, window, gram, held), _FACTORS), "copies")
    copies = compared.where("n > 0").drop("gram_hash", "window_hash").unionByName(_met_alone(compared.where("n = 0")))
    one = F.collect_list(F.struct("start", "n", "source_d", "source_pos"))
    return keyed, copies.groupBy("d", "tie").agg(one.alias("c")).select("d", "tie", *[F.col(f"c.{x}").alias(x) for x in _SOURCES])


_SOURCES = ["start", "n", "source_d", "source_pos"]
_CUT = ["n_words", "n_removed", "kept_sha256", "kept_text", "factor_starts", "factor_lengths", "source_ids", "source_starts"]


def _cut(batches, window: int, with_text: bool):
    import hashlib

    nothing = (np.empty(0, np.int64),) * 4
    for pdf in in_chunks(batches):
        out = []
        for text, *copies in zip(pdf["text"], *[pdf[c] for c in _SOURCES]):
            words = text.encode("utf-8").split()
            starts, lengths, source_d, source_pos = parse(*copies, window) if copies[0] is not None and len(copies[0]) else nothing
            if len(starts):
                edge = np.zeros(len(words) + 1, np.int8)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + lengths, -1)
                words_kept = [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist()) if not gone]
            else:
                words_kept = words
            kept = b" ".join(words_kept)
            out.append((len(words), int(lengths.sum()), hashlib.sha256(kept).hexdigest(), (kept.decode("utf-8") if len(starts) else text) if with_text else None,
                        starts.tolist(), lengths.tolist(), [None if x == _LEAST else x for x in source_d.tolist()], source_pos.tolist()))
        yield pd.concat([pdf.drop(columns=["tie", "text", *_SOURCES]).reset_index(drop=True), pd.DataFrame(out, columns=_CUT)], axis=1)


def _removed(docs: DataFrame, window: int, gram: int, with_text: bool, carried: tuple[str, ...] = (), held: int = HELD) -> DataFrame:
    keyed, hits = repeated_windows(docs, window, gram, carried, held)
    extra = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carried))
    fields = f"d long, {extra}n_words long, n_removed long, kept_sha256 string, kept_text string, factor_starts array<long>, factor_lengths array<long>, source_ids array<long>, source_starts array<long>"
    return keyed.join(hits, ["d", "tie"], "left").mapInPandas(lambda it: _cut(it, window, with_text), fields)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, held: int = HELD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, and the factors removed: factor_starts, factor_lengths (words),
    source_ids, source_starts (the document and word each is copied from) per row.

    Null text: no words. Texts under `window` words lose nothing. Null doc_id counts as the smallest. Rows with equal
    doc_id and text are one document and get its result each; rows that share only the doc_id are ordered by a hash of
    the text. kept_text is the text itself if nothing goes, else the kept words joined by one space.
    """
    return _removed(docs, window, gram, with_text, held=held).select(F.when(F.col("d") != _LEAST, F.col("d")).alias("doc_id"), *_CUT)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows and columns of docs with the kept text as text; n_chars, if there is one, counts it anew."""
    carried = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    out = _removed(docs, window, gram, True, carried)
    place = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(carried)} | {"text": F.col("kept_text").alias("text"), "n_chars": F.char_length("kept_text").cast("long").alias("n_chars")}
    return out.select(*[place[c] for c in docs.columns])


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM t),
 k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT *, unnest(range(1, n - 18)) AS s FROM n WHERE n > 19)),
 r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS place FROM k) WHERE place > 1),
 gone AS (SELECT DISTINCT doc_id, s + i AS p FROM r, range(20) x(i)), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM n),
 kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS k, count(gone.p) AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1)
SELECT n.doc_id, n.n AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id
"""
