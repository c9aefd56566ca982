"""Plans and repairs: texts stay out of shuffles, hot keys spread, odd inputs end well."""

import random
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from fathomline import catalog, io
from fathomline.functions import scoring, text, urls
from fathomline.operators import assist, ltr
from fathomline.operators import graph as G
from fathomline.operators import search as S
from fathomline.operators.index import Index, held
from fathomline.operators.instant import answer
from fathomline.plans.parse import parse
from fathomline.plans.planner import plan
from fathomline.sources import files, html
from fathomline.streaming import jobs

ROW_BY_ROW = [
    "token_statistics", "entities", "text_labels", "readability", "text_scores", "fingerprints", "content_signatures", "document_scores", "rescored", "ingest_gate", "duplicate_gate", "identities", "page_summaries",
    "search_all_terms", "search_any_term", "search_fields", "search_phrase", "search_excluding", "rank_fusion", "domain_diversity", "planned_search", "planned_terms", "hashed_embeddings", "result_descriptions", "page_entities", "full_scores",
]
#: Queries without SQL and what checks them instead.
CHECKED = {"distinct_results": "greedy pass", "planned_search": "planner tests", "planned_terms": "planner tests", "page_summaries": "summary tests", "learned_scores": "held-out gate", "rate_limited": "limiter tests", "instant_answers": "answers below"}


def exchanged(df) -> list[str]:
    """Columns that the exchanges of a plan carry."""
    plan_ = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: \[([^\]]*)\]", plan_)
    return [c.split("#")[0].strip() for x in found for c in x.split(",")]


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_no_text_in_a_shuffle(name, spark, sf):
    assert not {"content", "form", "html"} & set(exchanged(catalog.QUERIES[name](spark, sf)))


def test_every_query_has_sql_or_a_check():
    assert {n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL} == set(CHECKED)


def test_pages_are_the_latest_rows_also_when_too_many_are_replaced(spark, sf, monkeypatch):
    want = {r["id"]: r["crawled_at"] for r in spark.read.parquet(f"{sf}/docs.parquet").groupBy("id").agg(F.max("crawled_at").alias("crawled_at")).collect()}
    for most in (io.MOST_REPLACED, 0):
        monkeypatch.setattr(io, "MOST_REPLACED", most)
        io._REPLACED.clear()
        got = [(r["id"], r["crawled_at"]) for r in io.pages(spark, sf, "crawled_at").collect()]
        assert len(got) == len(want) and dict(got) == want
    io._REPLACED.clear()


def test_pages_and_index_survive_a_cleared_folder(spark, sf):
    import shutil

    from fathomline.operators import index as I

    n, hits = io.pages(spark, sf).count(), I.page_index(spark, sf).search(["the"]).count()
    for folder, _ in io._REPLACED.values():
        shutil.rmtree(folder.removeprefix("file:"))
    for x in I._BUILT.values():
        shutil.rmtree(x.folder.removeprefix("file:"))
    assert io.pages(spark, sf).count() == n and I.page_index(spark, sf).search(["the"]).count() == hits


def test_filters_reach_the_scan(spark, sf):
    d = io.pages(spark, sf, "content", "domain").where("domain = 'x'")
    assert "EqualTo(domain,x)" in d._jdf.queryExecution().toString()


def test_numbers_within_a_hot_group(spark):
    d = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.hash("id").alias("at"), "id")
    got = io.numbered(d, ["k"], ["at", "id"]).groupBy("k").agg(F.min("number"), F.max("number"), F.count_distinct("number"), F.count("*")).collect()
    assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in got) and max(r[4] for r in got) == 20_000
    last = io.numbered(d, ["k"], ["at", "id"]).where("k = 'hot'").orderBy("number").collect()
    assert [r["at"] for r in last] == sorted(r["at"] for r in last)


def test_upsert_delete_vectors_snapshot(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert sorted(map(tuple, io.upsert(a, b, "id").collect())) == [(1, "x"), (2, "z"), (3, "w")] and [r["id"] for r in io.delete(a, b, "id").collect()] == [1]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "id int, e array<double>")
    assert io.checked_vectors(v, "e", 2).count() == 1
    with pytest.raises(Exception, match="dimension"):
        io.checked_vectors(v, "e", 3).collect()
    io.snapshot({"a": a}, str(tmp_path))
    assert io.restore(spark, str(tmp_path), ["a"])["a"].count() == 2
    with pytest.raises(ValueError):
        io.restore(spark, str(tmp_path), ["../a"])


def test_index_equals_the_scan_and_spreads_a_hot_term(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"d{i}", " ".join(["the"] * 3 + [f"w{r.randrange(30)}" for _ in range(20)]), None if i % 7 else "w1 title") for i in range(400)]
    d = spark.createDataFrame(rows, "id string, content string, title string")
    x = Index.build(d, str(tmp_path), ("content", "title"))
    scan = {r["id"]: r["score"] for r in S.bm25(d, "id", "content", ["w1", "w2"], need=2).collect()}
    got = {r["id"]: r["score"] for r in x.search(["w1", "w2"], need=2).collect()}
    assert set(got) == set(scan) and all(got[i] == pytest.approx(scan[i]) for i in scan)
    p = x.postings(["the"]).where("field = 'content'")
    assert p.count() == 400 and p.select(F.input_file_name()).distinct().count() > 1
    assert "PartitionFilters: [isnotnull(bucket" in x.postings(["w1"])._jdf.queryExecution().toString() or "bucket" in x.postings(["w1"])._jdf.queryExecution().toString()
    assert {r["id"] for r in held(x, ["w1", "title"], ("content", "title")).collect()} == {i for i, c, t in rows if t}
    assert x.search(["nowhere"]).count() == 0


def test_rank_of_no_edges_and_of_a_ring(spark):
    e = "from_id string, to_id string, is_cross boolean"
    assert G.pagerank(spark.createDataFrame([], e)).count() == 0
    ring = G.pagerank(spark.createDataFrame([("a", "b", False), ("b", "c", False), ("c", "a", False)], e)).collect()
    assert [r["rank"] for r in ring] == [1.0, 1.0, 1.0]


def test_words_of_a_query_are_cut_like_texts(spark):
    d = spark.createDataFrame([("a", "", "", "a state of the art lamp, don't ask"), ("b", "", "", "c++ guide"), ("c", "", "", "other")], "id string, title string, description string, content string")
    assert [r["id"] for r in S.phrase(d, "content", "state-of-the-art").collect()] == ["a"] and S.phrase(d, "content", "Don't").count() == 1 and S.phrase(d, "content", " - ").count() == 0
    assert [r["id"] for r in plan(d, parse("c++")).collect()] == ["b"]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    write = jobs.batch_writer(str(tmp_path / "out"))
    for number, rows in ((0, 5), (1, 3), (1, 3)):
        write(spark.range(rows), number)
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).count() == 8


def test_limits_of_a_stream_end(spark, sf):
    schema = io.table(spark, sf, "events").schema
    out = jobs.run_once(jobs.limited(jobs.read(spark, sf, "events.parquet", schema), "user_id", "ts", 5, 3600, 7200), "update")
    n = out.agg(F.sum(F.col("accepted") + F.col("rejected"))).first()[0]
    assert n == io.table(spark, sf, "events").where("user_id is not null and ts is not null").count()


def test_urls_safe_allowed_sharded(spark):
    bad = ["http://localhost/x", "http://127.0.0.1/", "http://10.1.2.3/", "http://192.168.0.1", "http://172.20.1.1/", "http://169.254.169.254/latest", "http://0.0.0.0/", "http://printer.local/", "http://[::1]/", "http://[fe80::1]/", "http://[fd00:ec2::254]/", "nonsense", None]
    good = ["https://e.example/", "http://8.8.8.8/", "http://172.32.0.1/", "https://user@e.example:8080/x", "http://[2001:db8::1]/"]
    d = spark.createDataFrame([(u, u in good) for u in bad + good], "u string, want boolean")
    assert d.where(urls.is_safe(F.col("u")) != F.col("want")).collect() == []
    x = spark.createDataFrame([("https://a/x", "A", True), ("https://a/no/x", "a", False), ("https://b/x", "b", False), (None, None, False)], "u string, d string, want boolean")
    assert x.where(urls.is_allowed(F.col("u"), F.col("d"), ["b"], ["https://a/no"], ["a"]) != F.col("want")).count() == 0

    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h % 7

    names = ["amberwick.example", "", "ü.example", "東"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "d string").select(urls.shard(F.col("d"), 7)).collect()] == [fnv(n) for n in names]


def test_instant_answers_and_numbers():
    now = datetime(2024, 12, 20, 9, 5)
    want = {"15% of 80": "12", "what is 12.5 percent of 8?": "1", "sqrt 16": "4", "square root of 2": "1.41421", "2+3*4": "14", "(1+2)^2 / 0": "9", "7 % 0": "7", "-3--4": "1", "2^3^2": "512", "1/3": "0.333333",
            "10 km to miles": "6.21371", "100 c to f": "212", "32 fahrenheit in celsius": "0", "days until christmas": "5", "days until new year": "12", "what time is it": "09:05", "what day is it": "2024-12-20"}
    assert {q: answer(q, now) for q in want} == want
    assert [answer(q, now) for q in (None, "", "lamp", "2024", "(1+2", "1 km to lbs", "days until never", "sqrt -1", "1+", "9^9^9^9")] == [None] * 10


def test_ranking_invariants(spark):
    page = "id string, title string, description string, content string"
    rows = [("title", "brass lantern", "", "notes on lamps"), ("body", "notes", "", "a brass lantern on a lamp"), ("row", "x", "", "an old brass lantern hangs here"), ("apart", "x", "", "an old lantern of brass hangs here")]
    d = spark.createDataFrame(rows, page)
    order = [r["id"] for r in plan(d, parse("brass lantern")).collect()]
    assert order[0] == "title" and order.index("row") < order.index("apart")
    one = spark.createDataFrame([(0.9, 0.1), (0.2, 0.9)], "static double, spam double")
    got = [r[0] for r in one.select(S.final_score(F.lit(1.0), F.col("static") * (1 - 0.8 * F.col("spam")), F.lit(0.5))).collect()]
    assert got[0] > got[1]  # clean before spam
    f = spark.createDataFrame([("2024-05-31",), ("2023-06-01",), (None,)], "at string").select(S.fresh(F.col("at").cast("timestamp"), F.lit("2024-06-01").cast("timestamp"), F.lit(90.0)).alias("f"))
    a, b, none = (r["f"] for r in f.collect())
    assert a > b and none == 0.5  # fresh before old


def test_related_and_page_windows():
    assert assist.related_searches(["car", "repair"], ["auto", "vehicle", "auto", "motor", "van"], ["a", "b", "c", "d"], "car repair") == ["auto repair", "vehicle repair", "motor repair", "a", "b", "c"]
    assert assist.page_window(0, 0) == (0, 10, 100) and assist.page_window(3, 80) == (100, 50, 350) and assist.page_window(999, 50) == (49_900, 50, 5000)


def test_multipliers(spark):
    tiers = spark.createDataFrame([("trusted", 1.0), ("warning", 0.8), ("throttled", 0.5), ("quarantined", 0.0), ("banned", 0.0), ("else", 1.0)], "t string, w double")
    assert tiers.where(S.tier_multiplier(F.col("t")) != F.col("w")).count() == 0
    d = spark.createDataFrame([(0.9, 0.9, 0.7, 0.7, 0.6, 0.7)], "authority double, url_q double, readability double, quality double, eeat double, seo double")
    got = d.select(*[S.intent_multiplier(k).alias(k) for k in ("navigational", "informational", "transactional", "local")]).first()
    assert tuple(round(x, 6) for x in got) == (1.8, 1.5, 1.2, 1.0)


def test_stuffed_equals_counting(spark):
    r = random.Random(2)
    rows = []
    for i in range(200):
        n, k = r.randint(40, 600), r.randint(15, 40)
        ws = [r.choice(["lamp", "the", "ab"])] * k + [f"w{r.randrange(400)}" for _ in range(n)]
        r.shuffle(ws)
        rows.append((i, ws))

    def want(ws):
        return len(ws) > 50 and any(c > 20 and c / len(ws) > 0.05 for w in set(ws) if len(w) > 2 and w != "the" for c in [ws.count(w)])

    got = dict(map(tuple, spark.createDataFrame(rows, "i int, w array<string>").select("i", scoring.stuffed(F.col("w"))).collect()))
    assert got == {i: want(ws) for i, ws in rows} and any(got.values()) and not all(got.values())


def test_truncation(spark):
    rows = ["short", "word " * 30, "x" * 100, "", "a" * 50 + " " + "b" * 60]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.truncated(F.col("t"), 60)).collect()]

    def want(s):
        if len(s) <= 60:
            return s
        cut = next((i for i in range(60, 40, -1) if s[i] == " "), 60)
        return s[:cut] + "..."

    assert got == [want(x) for x in rows]


def test_preferences_need_enough_pairs_and_a_held_out_win(spark):
    r = random.Random(4)
    good = [([x + 0.3], [x]) for x in (r.random() for _ in range(300))]
    model, sure = ltr.promoted(good, 20)
    assert model and sure > 0.5 and ltr.promoted(good[:150]) == ([], None)
    clicks = spark.createDataFrame([("q", f"u{i}", i % 5) for i in range(400)], "query string, url string, clicks int")
    feats = spark.createDataFrame([(f"u{i}", [float(i % 5)]) for i in range(400)], "url string, features array<double>")
    pairs = ltr.preference_sample(clicks, feats)
    assert 200 < len(pairs) < 400 * 8 and all(w[0] > x[0] for w, x in pairs) and ltr.promoted(pairs, 20)[1] > 0.9


PAGE = """<html><head><meta name=robots content="nofollow"><meta name=viewport content="width=device-width"><style>@media print{} a{display:flex}</style><script src=a.js defer></script><link rel=stylesheet href=x.css>
<link rel="apple-touch-icon" href=i.png></head><body><article><h1>Head</h1><h4>Deep</h4><p>One two three four five six seven eight nine ten brown dog runs on, and more words follow here.</p></article>
<figure><img src=a.png alt="x" width=10 height=2 title="T"><figcaption>A caption</figcaption></figure><img src=b.png alt="brown dog sleeps" loading=lazy>
<div itemscope itemtype="https://schema.org/Recipe"><span itemprop=name>Soup</span><meta itemprop=yield content="4"></div><div itemscope itemtype="https://o.example/t/x"><i itemprop=a>b</i></div>
<p style="font-size: 9px">s</p><a style="width: 20px" href=/x>t</a></body></html>"""


def test_page_metrics_images_and_items():
    p = html.parse_page(PAGE, "https://e.example/", "NOINDEX")
    assert (p["noindex"], p["nofollow"], p["robots"]) == (True, True, "nofollow, noindex") and html.robots_flags(None, "none") == ("none", True, True)
    one, two = p["images"]
    assert (one["context"], one["title"], one["width"], one["height"]) == ("A caption", "T", 10, 2) and "brown dog runs" in two["context"] and p["image_text"].startswith("x T A caption brown dog")
    assert p["items"] == [{"type": "Recipe", "properties": {"name": "Soup", "yield": "4"}}] and p["schema_type"] == "Recipe" and p["structured_text"] == "Recipe name: Soup yield: 4" and p["heading_text"] == "Head"
    assert html.schema_type([{"type": "X"}, {"type": "Person"}, {"type": "Article"}]) == "Article" and html.schema_type([{"type": "X"}, {"type": "Y"}]) == "X" and html.schema_type([]) == ""
    assert (p["scripts"], p["stylesheets"], p["resources"], p["lazy"], p["deferred"], p["viewport"]) == (1, 1, 4, True, True, "width=device-width")
    assert (p["media_queries"], p["flexible"], p["touch_icons"], p["small_fonts"], p["small_targets"]) == (True, True, True, 1, 1)
    assert html.parse_page(None)["viewport"] is None


def test_files(spark):
    pdf = b"%PDF (Hello \\(nested (brackets)\\) text) BT (hidden words) ET <48656c6c6f20686578> (\x01\x02\x03\x04) << /a >>"
    assert files.pdf_text(pdf) == "Hello (nested (brackets)) text Hello hex" and files.pdf_text(None) == "" and files.plain_text(b"a\xff \n b") == "a� b"
    d = spark.createDataFrame([("https://e/a-b.pdf", "application/pdf", bytearray(pdf)), ("https://e/x.txt", "text/plain; charset=x", bytearray(b" a  b ")), ("https://e/i.png", "image/png", bytearray(b"x")), ("u", None, None)], "url string, content_type string, data binary")
    assert {(r["title"], r["content"]) for r in files.texts(d).collect()} == {("a b", "Hello (nested (brackets)) text Hello hex"), ("x", "a b")}
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert [files.retry_after(h, now) for h in (None, "7", "0", "9999", "Mon, 01 Jan 2024 00:01:00 GMT", "soon")] == [30.0, 7.0, 1.0, 300.0, 60.0, 30.0]
