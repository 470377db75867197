"""Texts above the size that one mapper works on at once, and the pipeline's odd rows."""

import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from tarnsift.llm import substrings
from tarnsift.llm.common import CHUNK_BYTES, WordHashes, hashed_words
from tarnsift.llm.fingerprints import fingerprint, likeness
from tarnsift.llm.near_dups import shingle_set
from tarnsift.llm.packing import pieces


def long_text(words=1_600_000):
    draw = random.Random(1)
    pool = [f"word{i}{' ' * (i % 3)}" for i in range(5000)]
    text = " ".join(draw.choices(pool, k=words))
    assert len(text) > CHUNK_BYTES
    return text


def test_words_of_a_text_that_is_cut_into_slices():
    text = long_text()
    whole = WordHashes().of(text.encode().split())
    assert np.array_equal(hashed_words(text, WordHashes()), whole)
    assert np.array_equal(hashed_words("x" * (CHUNK_BYTES + 5), WordHashes()), WordHashes().of([b"x" * (CHUNK_BYTES + 5)]))
    assert len(shingle_set(text, 2, WordHashes())) == len(set(zip(whole[:-1].tolist(), whole[1:].tolist())))


def test_anchors_of_more_words_than_a_place_has_bits(monkeypatch):
    grams = substrings._grams(np.random.default_rng(0).integers(0, 1 << 63, 4000).astype(np.uint64), 8)
    monkeypatch.setattr(substrings, "_PLACE", 12)
    packed = substrings._anchors(grams, 20, 8)
    monkeypatch.setattr(substrings, "_PLACE", 11)
    assert len(grams) >> 11 and np.array_equal(np.flatnonzero(packed != substrings._anchors(grams, 20, 8)), [])


def test_a_long_text_is_fingerprinted_and_packed_whole(spark):
    text = long_text(1_300_000) + "\n" + "\n".join(f"line {i} of many" for i in range(20_000))
    edited = text.replace("line 777 of many", "line 777 was changed")
    a, b = fingerprint(text), fingerprint(edited)
    assert a[:64] != b[:64] and likeness(a, b) > 0.99 and likeness(a, fingerprint("other words, all of them")) < 0.01
    short = " ".join(text.split()[:300_000])
    df = spark.createDataFrame([(1, short)], "doc_id long, text string")
    got = pieces(df, public_tokenizers.path("word_bpe_49k.json")).orderBy("piece").collect()
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["length"] for r in got])[:-1]) and all(r["length"] == 2048 for r in got[:-1]) and sum(r["length"] for r in got) > 300_000


def test_stages_on_odd_rows_clashing_names_and_no_rows(spark, tmp_path):
    draw = random.Random(2)
    text = " ".join(f"w{draw.randint(0, 99)}" for _ in range(60))
    rows = [(1, text), (1, text), (2, None), (None, text + " more"), (None, None), (3, ""), (4, "\t\n "), (5, "idiot scum"), (6, "x" * 30_000)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, copies int, toxicity double, node string, row string, c0 int, text_a string, size long"
    full = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, k, 0.5, "n", "r", k, "a", 7) for k, (i, t) in enumerate(rows)], fields)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for no, docs in enumerate((full, full.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{no}-{name}")
            made = spark.read.parquet(f"{tmp_path}/{no}-{name}")
            if name != "packing":
                assert made.columns == full.columns, name
                docs = made
        assert (made.count() > 0) == (no == 0)
