"""Each operator against brute force on a small table with nulls, empty and repeated texts, copies, and columns of clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnsift.llm.fingerprints import PHRASE, differing, edited_fingerprints, fingerprint, likeness, tree
from tarnsift.llm.graph import components
from tarnsift.llm.languages import codewords, identify, learn
from tarnsift.llm import mixing, near_dups
from tarnsift.llm.mixing import mix, mixed, sized
from tarnsift.llm.near_dups import keep_one, near_duplicates, sketches
from tarnsift.llm.packing import best_fit, pack_documents, pieces
from tarnsift.llm.substrings import _runs, parse, remove_repeats, without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, node string, copies int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "the", "ß"]
    out = [None, "", "   ", "one", "one", "Two words", "\t\n"]
    passage = " ".join(r.choices(vocabulary, k=30))
    for _ in range(25):
        words = r.choices(vocabulary, k=r.randint(1, 90))
        if r.random() < 0.4:
            words[r.randrange(len(words)):0] = passage.split()
        out.append(" ".join(words))
    for t in out[10:20]:
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        out += [t, " ".join(words), t.upper()]
    return out + ["repeat " * 70, "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    sources = ["a", "b", "B", None, "ä"]
    rows = [(i, t, "en", sources[i % 5] if i % 3 else "a", 0, 7, 0.5, "n", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_groups(items, width):
    sets = {i: shingles(t, width) for i, t in items}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    want = brute_groups(rows(docs), width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, width).collect()}
    assert got == want
    kept = keep_one(docs, width)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_buckets_of_several_components_are_searched_whole(spark, monkeypatch):
    """Texts that share most bins but link only along a chain, in blocks of a few members."""
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(near_dups, "HUB", 2)
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    items = []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(120), r.choice([3, 8, 11, 14, 20])):
            words[at] = f"x{r.randrange(40)}"
        items.append((i, " ".join(words)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), 2).collect()}
    assert got == brute_groups(items, 2) and 2 < len({c for _, c in got.values()}) < 60


def test_near_duplicates_of_nothing_and_of_odd_ids(spark, empty, docs):
    assert near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "A b c"), (2, None), (None, None)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(odd, 2).collect())
    assert got == collections.Counter({(1, 2, 1, True): 3, (None, 2, 1, False): 1, (2, 0, 2, True): 1, (None, 0, None, True): 1})
    assert keep_one(odd, 2).count() == 4


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 400, np.uint64)
    a, b, tiny = base[:360], base[40:], base[:1]
    s = sketches([a, b, tiny, a], 180)
    assert (s[0] == s[3]).all() and abs((s[0] == s[1]).mean() - 0.8) < 0.12 and s.shape == (4, 180)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_components_around_hubs(spark, monkeypatch):
    from tarnsift.llm import graph

    monkeypatch.setattr(graph, "HUB", 5)
    r = random.Random(3)
    links = [(7, i) for i in range(8, 60)] + [(i, 200) for i in range(60, 90)] + [(r.randint(300, 330), r.randint(300, 360)) for _ in range(30)] + [(59, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {(x["node"], x["root"]) for x in components(spark.createDataFrame(links, "a long, b long")).collect()} == {(n, find(n)) for n in root if find(n) != n}


def brute_removed(items, window=20):
    seen, out = set(), {}
    for i, t in items:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_substrings(docs, empty):
    want = brute_removed(rows(docs))
    found = remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want
    assert all(sum(r["factor_lengths"]) == r["n_removed"] for r in found)
    assert check_factors(rows(docs), found) > 10
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.where("n_chars <> char_length(text)").count() == 0
    assert remove_repeats(empty).count() == 0


def check_factors(items, found, window=20):
    """Factors are copies of earlier text, do not overlap, and end where their source stops going on; returns their number."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in items}
    n = 0
    for r in found:
        own, end = words[r["doc_id"]], 0
        for start, length, d, pos in zip(r["factor_starts"], r["factor_lengths"], r["source_ids"], r["source_starts"]):
            assert start >= end and length > 0 and (d, pos) < (r["doc_id"], start) and own[start : start + length] == words[d][pos : pos + length]
            end, n = start + length, n + 1
    return n


@pytest.mark.parametrize("seed", [0, 1])
def test_parsing_of_texts_made_of_shared_passages(spark, seed):
    """Adjacent, overlapping and self-repeating copies, over several mappers."""
    r = random.Random(seed)
    passages = [[f"p{r.randrange(30)}" for _ in range(r.randint(15, 70))] for _ in range(8)]
    items = []
    for i in range(60):
        text = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            at = r.randint(0, 12)
            text += p[at : len(p) - r.randint(0, 12)] if r.random() < 0.7 else [f"u{r.randrange(9999)}" for _ in range(r.randint(1, 9))]
        items.append((i, " ".join(text)))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(6, "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", [10_000, 7][seed])  # runs of one anchor over many batches
    found = remove_repeats(df).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found} == brute_removed(items)
    assert check_factors(items, found) > 60


@pytest.mark.parametrize("held", [40, 10**9])
def test_a_run_of_words_in_all_documents(spark, held):
    """One anchor whose windows are unlike in most documents, some copies among them: whatever a task may hold, results are equal."""
    r = random.Random(7)
    run = [f"licence{i}" for i in range(8)]
    tails = [[f"t{r.randrange(10**6)}" for _ in range(14)] for _ in range(40)]
    items = [(i, " ".join([*(f"h{r.randrange(10**6)}" for _ in range(3)), *run, *(r.choice(tails) if r.random() < 0.3 else [f"x{r.randrange(10**6)}" for _ in range(14)])])) for i in range(400)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(5, "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    found = remove_repeats(df, held=held).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in found} == brute_removed(items)
    assert check_factors(items, found) > 50


def test_what_a_task_holds_of_one_anchor_is_bounded():
    """250 000 rows of one route with unlike windows, in the memory of `most` of them."""
    import tracemalloc

    import pandas as pd

    from tarnsift.llm.substrings import _compare_all

    n, size = 250_000, 5000
    made = lambda i: pd.DataFrame({"route": 1, "gram_hash": 1, "d": np.arange(i, i + size), "tie": 0, "low": np.int32(0), "done": np.int32(0), "windows": [np.arange(13 * j, 13 * j + 13).tobytes() for j in range(i, i + size)], "copies": [b""] * size})
    tracemalloc.start()
    alone = sum(len(x) for x in _compare_all((made(i) for i in range(0, n, size)), 20, 8, most=20_000))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20 and alone > 0.9 * 13 * n
    tracemalloc.stop()


def test_greedy_parse_merges_what_goes_on_and_cuts_at_the_end_of_a_source():
    got = [x.tolist() for x in parse(np.array([12, 0, 5, 40]), np.array([3, 5, 4, 1]), np.array([1, 9, 9, 7]), np.array([50, 100, 105, 0]))]
    assert got == [[0, 28, 40], [28, 6, 20], [9, 1, 7], [100, 66, 0]]


def test_runs_are_regrouped_over_many_batches():
    import pandas as pd

    keys = [1, 1, 2] + [3] * 40 + [4, 5, 5]
    made = [pd.DataFrame({"k": keys[i : i + 3]}) for i in range(0, len(keys), 3)]
    got = [x["k"].tolist() for x in _runs(iter(made), "k")]
    assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:])) and [x.count(3) for x in got if 3 in x] == [40]


def test_substrings_of_repeated_rows(spark):
    t = " ".join(f"v{i}" for i in range(25))
    got = remove_repeats(spark.createDataFrame([(5, t), (5, t), (None, t)], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got.collect()) == [(0, 0), (5, 25), (5, 25)]


def test_mixing_meets_targets(docs, empty):
    out = mix(sized(docs)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(r["size"] for r in out)
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: sum(r["size"] for r in by[s]) for s in order}
    left, open_, target = 1.5 * total, set(order), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        for s in over:
            target[s] = 2.0 * size[s]
            open_.remove(s)
        left = 1.5 * total - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        assert {r["source_size"] for r in by[s]} == {size[s]} and abs(by[s][0]["target"] - target[s]) < 1e-6
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(5, min(r["size"] for r in by[s] if r["size"]))
    again = {(r["doc_id"], r["taken"]) for r in mix(sized(docs.repartition(5))).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}
    assert mix(sized(empty)).count() == 0
    copies = collections.Counter(r["doc_id"] for r in mixed(docs).collect())
    assert copies == collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in out if r["taken"]})


def test_mixing_carries_through_many_sizes_and_keeps_names_that_clash(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 16)
    r = random.Random(6)
    names = ("n", "k", "rank", "cell", "spot", "ahead", "row", "in_cell")
    items = [(i if i % 9 else None, "ab"[i % 3 > 0], r.choice([0, r.randint(1, 400)]), *range(8)) for i in range(900)]
    docs = spark.createDataFrame(items, "doc_id long, source string, size long, " + ", ".join(f"{n} int" for n in names)).withColumn("target", F.lit("gone"))
    out = mix(docs, weights=(3, 2), share=0.8).collect()
    assert len(out) == 900 and all(x["rank"] == 2 and x["row"] == 6 and x["taken"] in (0, x["size"], 2 * x["size"]) for x in out)
    for s in "ab":
        own = [x for x in out if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 2


def test_mixing_of_repeated_ids(spark):
    same = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert mixed(same).count() == 3 and mixed(same).columns == same.columns


def test_fingerprints(docs, empty):
    items = rows(docs)
    got = {r["doc_id"]: r for r in edited_fingerprints(docs).collect()}
    assert len(got) == len(items)
    for k, (i, t) in enumerate(items):
        t, n = t or "", items[(k + 1) % len(items)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert got[i]["fingerprint"] == fingerprint(t) and got[i]["edited_fingerprint"] == fingerprint(e)
        assert got[i]["near_next"] == likeness(fingerprint(t), fingerprint(n)) and 0 <= got[i]["near_edited"] <= 1
    assert edited_fingerprints(empty).count() == 0
    assert edited_fingerprints(docs.where("doc_id = 30")).first()["near_next"] == 1.0


def test_edits_are_located():
    a = "first line here\nsecond line here\n\nthird line there\nfourth"
    places = lambda x, y: differing(fingerprint(x), fingerprint(y))
    assert places(a, a) == ([], []) and likeness(fingerprint(a), fingerprint(a)) == 1.0
    assert places(a, a.replace("third", "3rd")) == ([(1, 0)], [(1, 0)])
    assert places(a, "a new line\n" + a) == ([], [(0, 0)]) and places("a new section\n\n" + a, a) == ([(0, 0), (0, 1)], [])
    assert places(a, a.replace("third", " third")) == ([(1, 0)], [(1, 0)]) and places(a, a.replace("line here\ns", "line here\t\ns")) == ([(0, 0)], [(0, 0)])
    assert 0 < likeness(fingerprint(a), fingerprint(" " + a)) < 1 and 0 < likeness(fingerprint("x y"), fingerprint("x y\n\n")) < 1
    assert fingerprint("a\nb") != fingerprint("a b") and fingerprint(None) == fingerprint("")
    assert likeness(fingerprint("x y z"), fingerprint("p q r")) == 0.0


def test_likeness_counts_equal_phrases_and_paragraphs():
    """Pairing sections and paragraphs off first changes no count; sections occur in texts without empty lines."""
    r = random.Random(6)
    bag = lambda lines: collections.Counter(("p", p) for x in lines for p in PHRASE.findall(x.encode())) + collections.Counter(("l", x) for x in lines if x)
    for _ in range(100):
        pool = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randint(0, 12))) for _ in range(12)]
        a, b = ([r.choice(pool) for _ in range(r.randint(1, 30))] for _ in range(2))
        x, y = bag(a), bag(b)
        whole, common = x.total() + y.total(), 2 * (x & y).total()
        got = likeness(fingerprint("\n".join(a)), fingerprint("\n".join(b)))
        assert a == b or abs(got - (min(common / whole, whole / (whole + 1)) if x and y else 0.0)) < 1e-12
    lines = [f"line {i} of a text, with words." for i in range(400)]
    sizes = [len(ps) for _, ps in tree(fingerprint("\n".join(lines)))]
    assert sum(sizes) == 400 and 25 < len(sizes) < 100
    moved = tree(fingerprint("\n".join([*lines[:200], "one more line", *lines[200:]])))
    assert sum(h not in {h for h, _ in tree(fingerprint("\n".join(lines)))} for h, _ in moved) <= 2


def test_edits_are_located_as_by_comparing_the_lines():
    r = random.Random(9)
    for _ in range(200):
        a = [r.choice(["one", "two two", "three 3", ""]) for _ in range(r.randint(1, 8))]
        b = list(a)
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = [r.choice(["new", "other", ""])] * r.randint(0, 2)
        gone, come = differing(fingerprint("\n".join(a)), fingerprint("\n".join(b)))
        keep = lambda x, out: [line for i, line in enumerate(x) if i not in out]
        flat = lambda x: {(s, p): k for k, (s, p) in enumerate((s, p) for s, (_, ps) in enumerate(tree(fingerprint("\n".join(x)))) for p in range(len(ps)))}
        fa, fb = flat(a), flat(b)
        assert keep(a, {fa[g] for g in gone}) == keep(b, {fb[c] for c in come}) or a == b
        assert (gone, come) == ([], []) or a != b


def test_pieces_match_the_tokenizer(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = collections.defaultdict(list)
    for r in pieces(docs, TOKENIZER, capacity=64).collect():
        got[r["doc_id"]].append(r)
    for i, text in rows(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(got[i], key=lambda r: r["piece"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4")] == ids
        assert [(r["piece"], r["start"]) for r in own] == [(k, 64 * k) for k in range(len(own))] and all(r["length"] == 64 for r in own[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own)
    assert pack_documents(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_docs": 3}, {"attention": 2 * 64 * 64 // 3, "rule": "dot"}])
def test_packing_keeps_every_limit(docs, limits):
    packed = pack_documents(docs.unionByName(docs.limit(5)), TOKENIZER, **limits)
    by = collections.defaultdict(list)
    for r in packed.collect():
        by[r["sequence_id"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) <= 2048
        assert len(own) <= limits.get("max_docs", 2048)
        assert len(own) == 1 or sum(r["length"] ** 2 for r in own) <= limits.get("attention", 2048**2)


def test_best_fit_is_tight():
    lengths = np.random.default_rng(0).integers(1, 2049, 4000)
    bins, _ = best_fit(lengths)
    assert np.bincount(bins, lengths).max() <= 2048 and bins.max() + 1 <= 1.02 * max(np.ceil(lengths.sum() / 2048), (lengths > 1024).sum())


def test_languages(spark, empty):
    r = random.Random(1)
    words = {"en": ["the", "and", "with", "house", "thing"], "fr": ["les", "eau", "oui", "était", "que"], "de": ["und", "schön", "nicht", "haus", "ein"]}
    make = lambda lang: " ".join(r.choices(words[lang], k=30))
    train = spark.createDataFrame([(make(x), x) for x in words for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    codes = learn(train)
    test = spark.createDataFrame([(make(x), x) for x in words for _ in range(5)] + [(None, "und"), ("", "und"), ("123 !!", "und")], "text string, want string")
    got = identify(test, codes).collect()
    assert all(x["lang_pred"] == x["want"] and 0 <= x["score"] <= 1 for x in got)
    assert learn(empty.withColumn("lang", F.lit("en"))) is None and identify(test, None).first()["lang_pred"] == "und"
    clash = identify(test.withColumn("Score", F.lit("x")).withColumn("ambiguous", F.lit(3)), codes)
    assert clash.columns == ["want", "lang_pred", "score", "ambiguous"] and clash.count() == 18
    one = learn(train.where("lang = 'fr'"))
    assert identify(test.limit(1), one).first()["lang_pred"] == "fr"
    for n in (2, 4, 7, 30):
        c = codewords(n)
        assert len({tuple(x) for x in c}) == n


def test_languages_against_brute_force_over_grams():
    """The learned weights, margins and losses, from plain dictionaries of byte grams."""
    import math

    from tarnsift.llm.languages import Codes, gram_counts, letters

    r = random.Random(4)
    words = {"a": ["ala", "bel", "cor"], "b": ["dun", "ell", "fir"], "c": ["gor", "hal", "ber"]}
    make = lambda lang: " ".join(r.choices(words[lang], k=12))
    train = [(make(x), x) for x in words for _ in range(6)]

    def grams(text):
        b = letters(text)
        place = lambda g: (((g[0] * 257 + g[1]) if len(g) == 2 else ((g[0] * 257 + g[1]) * 257 + g[2] + (1 << 26))) % 2**32 * 2654435769 % 2**32) >> 18
        return collections.Counter(place(b[i : i + n]) for n in (2, 3) for i in range(len(b) - n + 1))

    total = {x: sum((grams(t) for t, lang in train if lang == x), collections.Counter()) for x in words}
    counts = np.zeros((3, 1 << 14))
    for t, lang in train:
        counts[sorted(words).index(lang)] += gram_counts(letters(t))
    codes = Codes(sorted(words), counts)
    share = {x: {g: (total[x][g] + 0.5) / (sum(total[x].values()) + 0.5 * (1 << 14)) for g in range(1 << 14)} for x in words}
    for x in words:
        text = make(x)
        own = grams(text)
        loss = {lang: 0.0 for lang in words}
        for j in range(codes.words.shape[1]):
            side = lambda g, s: np.mean([share[y][g] for y, c in zip(sorted(words), codes.words[:, j]) if c == s])  # noqa: E731,B023
            odds = {g: math.log(side(g, 1)) - math.log(side(g, -1)) for g in range(1 << 14)}
            held = {y: sum(share[y][g] * odds[g] for g in odds) * c for y, c in zip(sorted(words), codes.words[:, j])}
            scale = np.mean([abs(h) for h in held.values()])
            margin = sum(n * odds[g] for g, n in own.items()) / sum(own.values()) / scale
            trust = max(min(held.values()) / scale, 0.05)
            for y, c in zip(sorted(words), codes.words[:, j]):
                loss[y] += trust * math.log1p(math.exp(-margin * c))
        n = gram_counts(letters(text))
        best, p, _ = codes.decode((n @ codes.weights / n.sum())[None, :].astype(float), np.array([n.sum()]))
        assert sorted(words)[best[0]] == min(loss, key=loss.get) == x and p[0] > 0.5
