import hashlib

import pytest
from pyspark.sql import functions as F

from tarnsift.operators import evidence as E


def test_merkle_of_one_and_three(spark):
    sha = lambda b: hashlib.sha256(b).digest()

    def root(leaves):
        level = [sha(x) for x in leaves]
        for _ in range(32):
            level = level + [bytes(32)] if len(level) % 2 else level
            level = [sha(level[i] + level[i + 1]) for i in range(0, len(level), 2)]
        return level[0].hex()

    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "p"), ("b", 2, "q"), ("b", 3, "r")], "g string, i int, c string")
    got = {r["g"]: r["root"] for r in E.merkle_root(df, ("g",), ["i"], "c").collect()}
    assert got == {"a": root([b"x"]), "b": root([b"p", b"q", b"r"])}


def test_canonical_json_is_strict(spark):
    df = spark.createDataFrame([("\x1f\"é", None, True)], "b string, a long, c boolean")
    assert E.canonical_json(df, ["b", "a", "c"]).first()["canonical"] == '{"a":null,"b":"\\u001f\\"é","c":true}'
    with pytest.raises(ValueError):
        E.canonical_json(df.withColumn("f", F.lit(1.0)), ["f"])


def test_inventory_states(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3")], "path string, sha256 string")
    have = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in E.compare_inventories(want, have).collect()} == {"a": "match", "b": "mismatch", "c": "duplicate", "d": "unlisted"}


def test_gate_names_the_first_fault(spark):
    base = dict(q_anchor=[1, 2], delta_sha256="a" * 64, delta_bytes=1, has_key=True, has_signature=True, signature_ok=True, rsu_id=1, round=2, signed_rsu=1, signed_round=2)
    rows = [base, base | {"signed_round": 1}, base | {"signed_rsu": 0, "signed_round": 1}, base | {"delta_sha256": "x"}, base | {"has_key": None}]
    df = spark.createDataFrame(rows, "q_anchor array<int>, delta_sha256 string, delta_bytes int, has_key boolean, has_signature boolean, signature_ok boolean, rsu_id int, round int, signed_rsu int, signed_round int")
    assert [r["reason"] for r in E.admission_gate(df, 2).collect()] == ["ok", "stale_round", "cross_rsu", "bad_digest", "missing_material"]


def test_secrets_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a":[{"api_key":"k1"}],"password":"****"}'), (2, "not json"), (3, None)], "id int, t string")
    assert [tuple(r) for r in E.scan_json(df, "id", "t").collect()] == [(1, "$.a[0].api_key")]


def test_the_null_group_has_a_root(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, "y")], "id int, g string, t string")
    got = {r["g"]: r for r in E.merkle_root(df, ("g",), ["id"], "t", 4).collect()}
    assert got[None]["leaves"] == 2 and got["a"]["leaves"] == 1 and got[None]["root"] != got["a"]["root"]


def test_a_root_equals_folding_by_hand_and_none_has_the_zero_root(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(E, "CHUNK_LEVELS", 2)
    sha = lambda b: hashlib.sha256(b).digest()

    def by_hand(texts, depth):
        level = [sha(t.encode()) for t in texts] or [bytes(32)]
        for _ in range(depth):
            level += [bytes(32)] * (len(level) % 2)
            level = [sha(level[i] + level[i + 1]) for i in range(0, len(level), 2)]
        return level[0].hex()

    sizes = {"a": 1, "b": 2, "c": 5, "d": 23}
    rows = [(g, i, f"{g}{i}") for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    groups = spark.createDataFrame([(g,) for g in "abcde"], "g string")
    got = {r["g"]: (r["root"], r["leaves"]) for r in E.merkle_root(df, ("g",), ["i"], "t", 8, groups).collect()}
    assert got == {g: (by_hand([t for h, _, t in rows if h == g], 8), sizes.get(g, 0)) for g in "abcde"}
    assert tuple(E.merkle_root(df.limit(0), (), ["i"], "t", 8).select("root", "leaves").first()) == (by_hand([], 8), 0)
    assert E.merkle_root(df.where("g = 'd'"), (), ["i"], "t", 8).first()["root"] == got["d"][0]


def test_only_canonical_bytes_pass(spark):
    texts = ['{"a":[1,2],"s":"x"}', '{"a":[1, 2],"s":"x"}', '{"s":"x","a":[1,2]}', '{"a":[1,2],"s":"x"', '{"a":[1,2],"s":"x","z":1}', '{"a":null,"s":"\\u001f"}', '{"a":null,"s":"\\u001F"}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["ok"] for r in df.select("i", E.is_canonical(F.col("t"), "a array<long>, s string").alias("ok")).orderBy("i").collect()] == [True, False, False, False, False, True, False, False]


# Two published records and their digests.
DP_RECORD = {"schema": "DPRecordV1", "round_idx": 1, "mechanism": "laplace", "clip_l1": 100000, "epsilon": "1.5", "delta": "0", "accountant": "RDP", "extra": ""}
SIGNED = {
    "schema": "ClientUpdateSignedV1", "did": "did:example:vehicle-1001", "rsu_id": 1, "round_idx": 1, "policy_id": "policy_v8b_rsu", "update_commit_sha256": "92439dd4e7652a0414d2cd9d220e8d2767ed71f9005327223fc5d12b7a5065c3",
    "dp_record_sha256": "e88109685a5ca83c72a3066eee3c13d2c316a77ecdee4ebbdeffe4491dcd8397", "nonce": 42, "timestamp": 1700000000, "data_fingerprint_sha256": "",
}
DIGESTS = ["e88109685a5ca83c72a3066eee3c13d2c316a77ecdee4ebbdeffe4491dcd8397", "faf7fbc91ec335368fa8c1c2479a05ad32bb0be820b71d531bd330724cc51ba0"]


def test_canonical_text_of_any_record(spark):
    import json

    texts = [json.dumps(x, indent=2) for x in (DP_RECORD, SIGNED)]
    odd = {"b": [1, {"y": None, "x": [True, -5, "a/b\u0001é\n\"{1.5}"]}], "a": {}, "Z": [], "big": 10**25}
    more = [json.dumps(odd), '{"a": 1.5}', '{"a": 1e3}', '{"a": 1, "a": 2}', "{", None, '["1.5", 2]']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + more)], "i int, t string")
    got = [(r["c"], r["d"]) for r in rows.select("i", E.canonical_text(F.col("t")).alias("c"), E.text_digest(F.col("t")).alias("d")).orderBy("i").collect()]
    assert [d for _, d in got[:2]] == DIGESTS
    assert got[2][0] == json.dumps(odd, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [c for c, _ in got[3:]] == [None, None, None, None, None, '["1.5",2]']


def test_secrets_six_deep_and_stale_phrases(spark):
    import json

    deep = {"a": [[{"b": {"c": [{"api_key": "k", "password": "***", "secret": None, "mnemonic": 5}]}}]], "api_key": {"access_token": True}}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, '["secret"]'), (3, '{"secret": 1, "secret": 2}'), (4, "5"), (5, "")], "id int, t string")
    assert sorted(tuple(r) for r in E.scan_json(df, "id", "t").collect()) == [(1, "$.a[0][0].b.c[0].api_key"), (1, "$.a[0][0].b.c[0].mnemonic"), (1, "$.api_key.access_token")]
    text = spark.createDataFrame([(1, "DO NOT PUBLISH YET, a PRIVATE STAGING PACKAGE :contentReference[oaicite:1]{index=1}"), (2, None), (3, "publish")], "id int, t string")
    assert sorted(tuple(r) for r in E.scan_text(text, "id", "t").collect()) == [(1, "content_reference", 1), (1, "stale_phrase", 2)]



def test_a_scan_stores_once_for_many_depths_and_goes_on_below(spark, monkeypatch):
    import json

    def deep(n):
        """A list in an object at every depth; every third object holds a password."""
        return {"k": [deep(n - 1)] if n else 7, "n": None, **({"password": n} if n % 3 == 0 else {"Api-Key": "***"})}

    def paths(x, at="$"):
        inside = [(f"{at}.{k}", k, v) for k, v in x.items()] if isinstance(x, dict) else [(f"{at}[{i}]", None, v) for i, v in enumerate(x)]
        return [p for p, k, _ in inside if k == "password"] + [p for q, _, v in inside if isinstance(v, (dict, list)) for p in paths(v, q)]

    made, plain = [], E.stored
    monkeypatch.setattr(E, "stored", lambda *a, **b: made.append(1) or plain(*a, **b))
    docs = [deep(n) for n in (0, 2, 3, 4, 9, 10)] + [[], {}, [[{"secret": {}}, {"secret": [1]}, {"secret": 1}]]]
    want = sorted((i, p) for i, x in enumerate(docs) for p in (paths(x) if i < 8 else ["$[0][2].secret"]))
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id int, t string")
    assert sorted(tuple(r) for r in E.scan_json(df, "id", "t").collect()) == want
    assert len(made) == 3
    made.clear()
    assert E.scan_json(df.where("id < 3"), "id", "t").count() == 4 and len(made) == 1
    assert E.scan_json(df.limit(0), "id", "t").count() == 0
