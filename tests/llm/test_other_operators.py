"""Top-k search, chat formatting, pages, toxicity, ordered neighbours and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnsift.llm.chat import FORGED, read_back, training_examples
from tarnsift.llm.ordered import in_order, triples
from tarnsift.llm.common import shared_lines
from tarnsift.llm.pages import blocks, extract, main_text
from tarnsift.llm import topk
from tarnsift.llm.topk import pivot_vectors, distances, places, share_evaluated, top_k, whole_vectors
from tarnsift.llm.toxicity import LabelModel, Model, fit, label_model, score


def test_top_k_with_ties_nulls_and_repeats(spark):
    r = random.Random(0)
    rows = [(i, [float(r.choice([-1, 0, 0.5, 1])) / 8 for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0]), (240, [float("nan")] * 4), (260, [float("inf"), 0.0, 0.0, 0.0]), (7, rows[7][1])]
    v = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for x in top_k(v.where("vec_id % 20 = 0"), v, 10, candidates=30, query_rows=3).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = [(i, np.floor(np.float64(np.float32(e)) * 64)) for i, e in rows if e and i not in (220, 240, 260)]
    for q, x in whole:
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for i, y in whole if i != q))[:10]
            assert [(k, i, s) for k, i, s in sorted(got[q])] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {q for q, _ in whole if q % 20 == 0}
    few = v.where("vec_id < 3")
    assert top_k(few, few, 20).count() == 6 and top_k(few.limit(0), few, 20).count() == 0


def test_top_k_of_repeated_queries_and_of_one_id_with_two_vectors(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-9, 9)) for _ in range(3)]) for i in range(30)]
    rows += [rows[0]] * 2 + [rows[5]] * 40 + [(20, [9.0, -9.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in top_k(v.where("vec_id % 20 = 0"), v, 8, candidates=20, query_rows=2).collect()]
    want = []
    for q, x in {(i, tuple(x)) for i, x in rows if i % 20 == 0}:
        best = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q)[:8]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want) and len(got) == 24


def test_large_components_stay_exact(spark):
    v = spark.createDataFrame([(0, [3.0e8, 1.0]), (1, [3.0e8, 3.0]), (2, [3.0e8, 2.0])], "vec_id long, v array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_k(v.where("vec_id = 0"), v, 2).orderBy("rank").collect()] == [(1, 9 * 10**16 + 3), (2, 9 * 10**16 + 2)]


def test_pivots_bound_every_score_and_eliminate_candidates(spark):
    r = np.random.default_rng(7)
    x = np.floor(64 * r.standard_normal((600, 16)) / 4)
    pivots = pivot_vectors(x, 12)
    assert len(pivots) == 12 and len(pivot_vectors(np.repeat(x[:2], 9, axis=0), 12)) == 2
    p = places(distances(x, pivots), (x * x).sum(1), pivots)
    least = np.abs(distances(x, pivots)[:, None, :] - distances(x, pivots)[None, :, :]).max(axis=2)  # the best of single pivots
    squares = (x * x).sum(1)
    assert (p @ p.T + 1e-6 * squares.max() >= x @ x.T).all() and (p @ p.T <= (squares[:, None] + squares[None, :] - least**2) / 2 + 1e-3).all()
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, v array<double>")
    assert share_evaluated(v.where("vec_id % 20 = 0"), v, 5) < 0.5


def test_the_first_pass_leaves_out_every_row_of_the_querys_id(spark):
    rows = [(0, [9.0, 9.0]), (0, [9.0, 8.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = top_k(v.where("vec_id = 0"), v, 2).orderBy("query_id", "score").collect()
    assert sorted((x["vec_id"], x["score"]) for x in got) == [(1, 17), (1, 18), (2, 26), (2, 27)]


def test_top_k_equals_its_sql_on_repeated_queries(spark, tmp_path):
    import duckdb

    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    spark.createDataFrame(rows + [rows[20], rows[20], (40, [0.5] * 6)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.op4_topk(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(topk.ORACLE_SQL).fetchall()) and len(got) == 6 * 20


def test_chat_reads_back(spark):
    turns = FORGED + [(1, 0, "system", "a\\b<|im_end|>\\|"), (1, 1, "user", None), (1, 2, "assistant", "r<|x\n"), (1, 3, "assistant", "\\\\<\\|"), (1, 4, "user", "tail"), (2, None, None, "q"), (3, 0, "us\ner\\n", ""), (3, 1, "assistant", ""), (3, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in read_back(training_examples(df)).collect()}
    for c in (-1, 1, 2, 3):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = training_examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [e["trainable"] for e in examples] == [True, True, False]
    assert training_examples(df.limit(0)).count() == 0


PAGE = '<html><head><title>T</title></head><body><header>Site</header><nav><a>x</a></nav><div class="cookie-notice">We use</div>{}<aside>more</aside><footer>&copy;</footer></body></html>'


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<p>a<br>b  c\n d</p>", "a b c d"), ("<b>x<i>y</b> z", "xy z"), ("a < b", "a < b"),
    (PAGE.format("<article><h1>H &lt;1&gt;</h1><p>one <span class='ad'>buy</span>two</p><form>f</form><section id='comments'><p>no</p></section></article>"), "H <1>\none two"),
    (PAGE.format("<main><article><header><h1>H</h1></header><ul><li>1<li>2</ul></article></main>"), "H\n1\n2"), ("<script>var a='</p>';</script><style>p{}</style><p>k</p><!-- <p>no</p> -->", "k"),
])
def test_main_text(html, want):
    assert main_text(blocks(html), None) == want


@pytest.mark.parametrize("html,want", [
    ('<div class="site-content right-sidebar"><p>x</p><article><p>a</p></article></div>', "a"), ('<div class="sidebar"><article>a</article></div>', "a"), ("<form><main>a</main></form>", "a"),
    ('<article><section id="related-work"><p>r</p></section><p id="notice-period">n</p><div class="ad">no</div><div class="cookie-notice">no</div></article>', "r\nn"),
    ('<article>a</article><div class="related"><article>teaser</article></div>', "a"), ('<p>body</p><div id="comments"><article class="comment">c</article></div>', "body"), ("<aside><article>a</article></aside>", "a"),
    ('<div>one <span class="ad">no<div>no</div></span> two</div>', "one\ntwo"), ("<main>a</main><main hidden>no</main>", "a"),
])
def test_names_drop_neither_the_article_nor_parts_of_it(html, want):
    assert main_text(blocks(html), None) == want


def test_the_neighbour_decides_doubtful_blocks():
    page = lambda body: blocks(f'<article><p>{body}</p><div class="box-share-x">Tell a friend</div><p id="search-{body[0]}">{body[0]}</p></article>')
    assert main_text(page("a story of its own"), page("b another story")) == "a story of its own\na"


def test_differencing_removes_the_frame_and_keeps_copies(spark):
    page = lambda *body: "<div>Top</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>Bottom</div>"
    rows = [(1, "http://h/a/1", page("first story", "shared no")), (2, "http://h/a/2", page("second story here")), (3, "http://other/x", page("alone")), (4, None, None), (5, "http://c/1", page("same text")), (6, "http://c/2", page("same text")), (7, "http://[bad", "<p>q</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    assert got == {1: "first story\nshared no", 2: "second story here", 3: "Top\nalone\nBottom", 4: "", 5: "Top\nsame text\nBottom", 6: "Top\nsame text\nBottom", 7: "q"}
    assert extract(df.limit(0)).count() == 0 and extract(df.unionByName(df)).count() == 14


def test_the_frame_goes_however_large_and_copies_are_told_by_what_is_left(spark):
    page = lambda *body: "<div>A very long menu of the site</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>An even longer footer of the site</div>"
    long = "A paragraph that is long enough to be the article of a page, and stands on two of them."
    rows = [(1, "http://h/a/1", page("short")), (2, "http://h/a/2", page("brief")), (3, "http://p/1", page(long, "seen 7 times")), (4, "http://p/2", page(long, "seen 9 times"))]
    rows += [(5, "http://q/a/1", page("opens")), (6, "http://q/b/1", page(long, "by Ann")), (7, "http://q/b/2", page(long, "Bob wrote it")), (8, "http://q/c", page("closes"))]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "short" and got[2] == "brief" and got[5] == "opens" and got[8] == "closes"
    assert long in got[3] and long in got[4] and got[6] == f"{long}\nby Ann" and got[7] == f"{long}\nBob wrote it"


def test_deep_markup_is_followed_to_its_end():
    deep = 30_000
    assert main_text(blocks("<div>" * deep + "<nav>menu</nav>in" + "</i></p>" * deep + "</div>" * deep + "<p>out"), None) == "in\nout"


def test_whole_pages_against_what_they_were_made_of(spark):
    """Pages of two hosts, half of them without an article mark; the text is known, and so is what decides it."""
    r = random.Random(8)
    line = lambda: " ".join(r.choices(["grey", "Öl", "river", "of", "seven", "night", "&amp;", "walk"], k=r.randint(2, 9)) + [str(r.randrange(10**6))])
    rows, want = [], {}
    for i in range(40):
        host, marked = f"h{i % 2}.example", i % 4 < 2
        body = [line() for _ in range(r.randint(1, 6))]
        frame = [f"Menu of {host}", f"Foot of {host}"]
        inner = "".join(f"<p> {b.replace(' ', chr(10), 1)}</p>" for b in body)
        inner = f"<article>{inner}</article>" if marked else f"<div>{inner}</div>"
        rows.append((i, f"https://{host}/{'abc'[i % 3]}/{i:02}", f"<html><head><title>t</title></head><body><div>{frame[0]}</div><nav>skip {line()}</nav>{inner}<aside>{line()}</aside><div>{frame[1]}</div><script>x</script></body></html>"))
        want[i] = ("\n".join(b.replace("&amp;", "&") for b in body), None if marked else 2)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x["page_id"]: (x["text"], x["differenced"]) for x in extract(df).collect()} == want


def test_shared_lines_is_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(300):
        a, b = (r.choices("abcd", k=r.randint(0, 9)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = [x for x, k in zip(a, shared_lines(a, b)) if k]
        rest = iter(b)
        assert len(got) == best[-1][-1] and all(x in rest for x in got)


def test_neighbours_in_order(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "k long").repartition(7)
    got = in_order(df, ["k"], buckets=9, wrap=True).mapInPandas(lambda it: (__import__("pandas").DataFrame([(c[0].k, n[0].k)], columns=["k", "n"]) for _, c, n in triples(it, lambda r: None)), "k long, n long")
    assert sorted(tuple(r) for r in got.collect()) == [(i, (i + 1) % 101) for i in range(101)]


def test_toxicity_learns_words_and_leaves_others(spark):
    r = random.Random(2)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    make = lambda bad: " ".join(r.choices(words, k=40) + r.choices(["idiot", "scumbag", "moronic"], k=4) * bad)
    rows = [(i, make(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = {x["doc_id"]: x["s"] for x in score(docs, model, "s").collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows) and got[1000] == got[1001] < 0.3
    assert fit(docs, labels.where("toxic = 0")).score(np.zeros((1, 8)))[0] == 0.0 and score(docs.limit(0), model, "s").count() == 0


def test_label_model_finds_the_classes_from_votes_alone():
    rng = np.random.default_rng(0)
    n = 8000
    y = rng.random(n) < 0.3
    vote = lambda hit, miss: np.where(y, rng.random(n) < hit, rng.random(n) < miss)
    v = [vote(0.9, 0.04), vote(0.8, 0.02), vote(0.7, 0.05), vote(0.75, 0.03), vote(0.6, 0.02), vote(0.3, 0.3)]
    v.insert(3, np.where(rng.random(n) < 0.97, v[2], ~v[2]))
    votes = np.stack(v, axis=1).astype(float)
    model = label_model(votes, 0.3)
    assert {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p != j} == {frozenset((2, 3))}
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.98
    alone = [0, 1, 4, 5, 6]
    assert np.allclose(model.rates[1, 0, alone], [0.9, 0.8, 0.75, 0.6, 0.3], atol=0.04) and np.allclose(model.rates[0, 0, alone], [0.04, 0.02, 0.03, 0.02, 0.3], atol=0.04)
    many = label_model(votes[:, [2, 2, 2, 2, 0, 1, 4, 5]], 0.3)  # one voter four times counts about once
    once = label_model(votes[:, [2, 0, 1, 4, 5]], 0.3)
    assert abs(once.posterior(np.array([[1.0, 0, 0, 0, 0]])) - many.posterior(np.array([[1.0, 1, 1, 1, 0, 0, 0, 0]])))[0] < 0.05


def test_posteriors_by_enumerating_all_votes():
    from itertools import product

    rng = np.random.default_rng(3)
    parent = np.array([0, 0, 1, 3])
    rates = rng.uniform(0.05, 0.95, (2, 2, 4))
    rates[:, 1, [0, 3]] = rates[:, 0, [0, 3]]
    model = LabelModel(0.2, parent, rates)
    joint = {}
    for v in product((0, 1), repeat=4):
        for y in (0, 1):
            p = model.share if y else 1 - model.share
            for j in range(4):
                r = rates[y, v[parent[j]] if parent[j] != j else 0, j]
                p *= r if v[j] else 1 - r
            joint[v, y] = p
    assert abs(sum(joint.values()) - 1) < 1e-9
    for v in product((0, 1), repeat=4):
        assert abs(model.posterior(np.array([v], float))[0] - joint[v, 1] / (joint[v, 0] + joint[v, 1])) < 1e-9


def test_scores_replace_a_column_of_their_name_and_leave_texts_behind(spark):
    docs = spark.createDataFrame([(1, "x", "clash"), (2, None, "clash")], "doc_id long, text string, Score string")
    got = score(docs, Model([], None, (1.0, 0.0), 0.25), text=False)
    assert got.columns == ["doc_id", "score"] and {r["score"] for r in got.collect()} == {0.25}


def test_pipeline_end_to_end(spark, tmp_path):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(60)]
    texts += [texts[0], texts[1] + " x", None, ""] + [" ".join(r.choices(words, k=20)) + " idiot moron scum idiot" for _ in range(16)]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
        kept.append({x["doc_id"] for x in docs.collect()})
    assert kept[0] == set(range(64)) and kept[1] == set(range(64)) - {60, 61} and kept[2] == kept[1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == kept[3] and max(x["offset"] + x["length"] for x in packed) <= 2048
