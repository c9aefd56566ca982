"""Functions and operators on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import text, urls
from fathomline.operators import assist, graph, ltr
from fathomline.operators import search as S
from fathomline.plans.parse import expand, parse
from fathomline.streaming.jobs import limiter


def test_parse_takes_operators_apart():
    q = parse('"open source" site:Example.com lang:EN intitle:guide -spam apples OR pears OR plums the red filetype:PDF has:https before:2024-01-02')
    assert q.phrases == ["open source"] and q.site == "example.com" and q.lang == "en" and q.intitle == "guide"
    assert q.not_terms == ["spam"] and q.or_groups == [["apples", "pears", "plums"]] and q.terms == ["red"]
    assert q.filetypes == ["pdf"] and q.https and q.before == "2024-01-02" and q.fuzzy


@pytest.mark.parametrize("raw", ["", None, "   ", "OR", "-", '""', "the of and"])
def test_parse_of_nothing(raw):
    q = parse(raw)
    assert q.terms in ([], ["or"], ["-"]) or q.terms == ['""']


def test_expand_adds_synonyms_once():
    assert expand(parse("javascript js")) == ["ecmascript"]
    assert "ml" in expand(parse("machine learning"))


def test_url_functions(spark):
    d = spark.createDataFrame([("HTTP://Ex.com:80/a/b/?utm_source=x&b=2&a=1#f",), ("https://www.a.co.uk/",), ("nonsense",), (None,)], "u string")
    r = d.select(urls.normalize(F.col("u")), urls.registrable(F.col("u")), urls.should_crawl(F.col("u"))).collect()
    assert [x[0] for x in r] == ["http://ex.com/a/b?a=1&b=2", "https://www.a.co.uk/", "nonsense", None]
    assert r[1][1] == "co.uk" and r[0][2] is True and r[2][2] is False


def test_text_functions_of_empty_and_null(spark):
    d = spark.createDataFrame([("",), (None,), ("!!!",)], "t string")
    r = d.select(text.word_count(F.col("t")), text.semantic_density(F.col("t")), text.signature(F.col("t"))).collect()
    assert (r[0][0], r[0][1], r[0][2]) == (0, 0.0, "") and r[1][2] is None or r[1][0] in (None, -1)


def test_ring_moves_few_keys(spark):
    keys = spark.createDataFrame([(f"domain{i}.com",) for i in range(200)], "d string")
    node = lambda n: spark.createDataFrame([(f"node{i}",) for i in range(n)], "node string")
    a = {r[0]: r[1] for r in graph.owners(keys, "d", node(5)).collect()}
    b = {r[0]: r[1] for r in graph.owners(keys, "d", node(6)).collect()}
    moved = [k for k in a if a[k] != b[k]]
    assert len(a) == 200 and all(b[k] == "node5" for k in moved) and 0 < len(moved) < 100


def test_digest_does_not_depend_on_order(spark):
    rows = [("d", f"x{i}") for i in range(300)]
    one = graph.digests(spark.createDataFrame(rows, "d string, x string"), "d", F.col("x")).collect()
    two = graph.digests(spark.createDataFrame(rows[::-1] + rows[:5], "d string, x string"), "d", F.col("x")).collect()
    assert one == two and one[0]["n"] == 300


def test_pagerank_prefers_the_popular(spark):
    e = spark.createDataFrame([("a", "c", False), ("b", "c", False), ("c", "a", False)], "from_id string, to_id string, is_cross boolean")
    r = {x[0]: x[1] for x in graph.pagerank(e).collect()}
    assert r["c"] == max(r.values()) and r["b"] == min(r.values())


def test_diversity_moves_the_third_of_a_domain(spark):
    d = spark.createDataFrame([(i, "a" if i < 5 else "b", 10.0 - i) for i in range(7)], "id int, dom string, score double")
    r = {x["id"]: x["place"] for x in S.diversify(d, F.col("dom"), [F.desc("score")]).collect()}
    assert sorted(r, key=r.get) == [0, 1, 5, 6, 2, 3, 4]


def test_learned_ranking_orders_pairs():
    g = np.random.default_rng(0)
    w, lo = g.normal(1, 1, (300, 4)), g.normal(0, 1, (300, 4))
    m = ltr.train(w, lo)
    assert ltr.pairwise_accuracy(m, w, lo) > 0.8


def test_snippet_and_summary():
    body = "First words of a page. The river and the mill stand together here. Another line follows."
    s, marks = assist.snippet(body, ["river", "mill"])
    assert "river" in s and [s[a:b].lower() for a, b in marks] == ["river", "mill"]
    assert assist.summarize("Short one.") == "Short one." and assist.snippet("", ["x"]) == ("", [])


def test_spelling(spark):
    v = spark.createDataFrame([("lantern", 9), ("latter", 3)], "term string, n long")
    r = assist.suggestions(spark.createDataFrame([("lantren",), ("lantern",), ("x1",)], "word string"), v).collect()
    assert [(x[0], x[1]) for x in r] == [("lantren", "lantern")]


def test_rate_limit_blocks_and_starts_again():
    step = limiter(2, 10, 60)
    state, out = (0, 0.0, 0.0), []
    for at in (1, 2, 3, 4, 64, 65):
        state, ok = step(state, at)
        out.append(ok)
    assert out == [True, True, False, False, True, True] and state[0] == 2
