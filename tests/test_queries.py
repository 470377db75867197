"""A part of the registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tarnsift.plans.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("TARNSIFT_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
NAMES = ["split_audit", "group_split", "class_complete_group_split", "collapse_status", "binary_metrics", "roc_auc", "best_f1_grid", "terminal_split", "rolling_strict", "round_rollup", "append_deltas", "participation", "sign_flip_test", "merkle_root", "finality_latency"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def text(v):
    return "null" if v is None or v != v else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_a_class_of_several_files_still_has_files_of_its_own(spark, monkeypatch):
    from tarnsift.plans import protocol_queries

    monkeypatch.setattr(protocol_queries, "FILE_ROWS", 5, raising=False)
    got = QUERIES["read_class_files"](spark, DATA).collect()
    assert len(got) == 5 and all(r["one_class_a_file"] and r["n"] > 5 for r in got)


@pytest.mark.parametrize("name, label, classes", [("train_detector", "label", 1), ("train_multiclass", "list_position(['A-F', 'A-O', 'BENIGN', 'R-F', 'R-O'], family) - 1", 5)])
def test_a_detector_grows_all_rounds_as_sql_does(spark, duck, monkeypatch, name, label, classes):
    from tarnsift.operators import boosting as B
    from tarnsift.plans import evaluation_queries as Q
    from tarnsift.plans.data_queries import SPLIT, split_flows

    made, train = [], getattr(Q, name)
    monkeypatch.setattr(Q, name, lambda *a, **k: made.append((train(*a, **k), a[0])) or made[0][0])
    got = QUERIES[name](spark, DATA).toPandas()
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).df())
    fitted, read = made[0]
    flows = split_flows(spark, DATA)
    assert read.count() == flows.where("split = 'train'").count() and fitted.settings.subsample == 1
    assert len(fitted.trees[0]) == 100 and any(f >= 0 for per in fitted.trees[0] for t in per for f in t["feature"][31:63])  # cuts at depth 6
    want = duck.execute(f"WITH RECURSIVE {SPLIT}, {Q.rounds_sql(fitted.settings, classes, label)} SELECT row_id, m FROM scored").df().set_index("row_id")["m"]
    margins = B.margins(flows, fitted).select("row_id", "_m").toPandas().set_index("row_id")["_m"]
    assert len(margins) == len(want) and all(abs(x - y) < 1e-9 for i, m in margins.items() for x, y in zip(m, want[i]))
