"""Line dedup against brute force."""

import hashlib
import random

from tarnsift.llm.lines import repeated_lines, without_repeated_lines

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_chars=20, min_docs=3):
    """[(doc_id, n_lines, n_dropped, text)] of (doc_id, text) rows."""
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        order = lambda x: -(10**18) if x is None else x
        left = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or d == max(holders[key(x)], key=order)]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def made(df, **sizes):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in without_repeated_lines(df, **sizes).collect()), key=repr)


def test_random_documents_equal_brute_force(spark):
    draw = random.Random(3)
    pool = [f"{' ' * draw.randint(0, 2)}Line number {i} of the common pool{chr(9) * draw.randint(0, 1)}" for i in range(40)] + ["", "short", "LINE NUMBER 7 OF THE COMMON POOL", "é" * 20, "É" * 20, " " + "x" * 19, "x" * 19]
    rows = [(d, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 12)))) for d in range(200)]
    rows += [(None, pool[0]), (None, pool[1]), (500, None), (501, ""), (502, "\n"), (503, "\n\n" + pool[3] + "\r\n"), (7, "another text of the same id\n" + pool[2]), rows[9], rows[9]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert made(df) == brute(rows)
    assert made(df, min_chars=5, min_docs=2) == brute(rows, 5, 2)


def test_a_line_of_all_documents_stays_in_the_last(spark):
    hot = "The same licence line stands in every document"
    rows = [(i, f"{hot}\nown line of document number {i}\n{hot.upper()} ") for i in range(3000)]
    got = made(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and sum(x[2] for x in got) == 2 * 2999


def test_long_texts_empty_tables_and_names_that_clash(spark):
    long = "\n".join(["a line that stands in all three documents"] * 200_000 + [f"line {i} of the long document" for i in range(200_000)])
    rows = [(1, long), (2, "a line that stands in all three documents"), (3, "A line that stands in all three documents")]
    assert len(long) > 8 << 20 and made(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    clash = spark.createDataFrame([(1, "x", 5, "k", 1, 2), (2, None, None, None, None, None)], "doc_id long, text string, n_lines int, row string, h1 int, gone int")
    out = without_repeated_lines(clash).orderBy("doc_id").collect()
    assert [(r["row"], r["h1"], r["gone"], r["n_lines"], r["text"]) for r in out] == [("k", 1, 2, 1, "x"), (None, None, None, 1, "")]
    assert without_repeated_lines(clash.limit(0)).count() == 0 == repeated_lines(clash.limit(0)).count()


def test_query_equals_its_sql(spark):
    import os

    import duckdb
    import pytest

    from tarnsift.llm.registry import ORACLE_SQL, QUERIES

    data = os.environ.get("TARNSIFT_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLE_SQL['op11_lines']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op11_lines"](spark, data).collect()) == want
    assert hashlib.sha256(b"").hexdigest() != want[0][3]
