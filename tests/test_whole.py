"""Cases in which an operator once did less than its whole job."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from fathomline import catalog
from fathomline.functions import urls
from fathomline.io import pages
from fathomline.operators import search as S
from fathomline.plans.parse import parse
from fathomline.plans.planner import plan


def greedy(rows):
    """rows: (id, url, digest) in order."""
    seen_urls, digests, out = set(), set(), []
    for i, u, h in rows:
        if (u or "") in seen_urls or (h and h in digests):
            continue
        seen_urls.add(u or "")
        digests.add(h)
        out.append(i)
    return out


@pytest.mark.parametrize("tail", [0, 40, 20_000])
def test_distinct_results_equal_the_greedy_pass(spark, tail):
    r = random.Random(5)
    rows = [(i, r.choice([None, *(f"u{k}" for k in range(80))]), r.choice([None, "", *(f"h{k}" for k in range(90))])) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, url_norm string, content_hash string").repartition(5)
    assert [x["id"] for x in S.distinct_results(d, [F.col("id")], tail=tail).collect()] == greedy(rows)


def test_distinct_results_go_beyond_five_thousand(spark):
    d = spark.range(7000).select("id", F.col("id").cast("string").alias("url_norm"), F.lit("").alias("content_hash"))
    assert S.distinct_results(d, [F.col("id")]).count() == 7000


def test_distinct_results_of_all_pages_by_quality(spark, sf):
    d = pages(spark, sf, "url", "content_hash", "quality_score").select("id", urls.normalize(F.col("url")).alias("u"), "content_hash", "quality_score").collect()
    best = lambda x: (-x[3] if x[3] is not None and x[3] == x[3] else float("inf"), x[0])
    assert [x["id"] for x in catalog.QUERIES["distinct_results"](spark, sf).collect()] == greedy([x[:3] for x in sorted(d, key=best)])


PAGE = "id string, title string, description string, content string"


def planned(spark, rows, text):
    return {x["id"]: x["score"] for x in plan(spark.createDataFrame(rows, PAGE), parse(text)).collect()}


def test_plan_finds_terms_across_fields(spark):
    rows = [("one", "", "", "a lantern by the harbour"), ("across", "lantern", "", "the harbour"), ("half", "", "", "lantern only"), ("none", "", "", "words")]
    r = planned(spark, rows, "lantern harbour")
    assert set(r) == {"one", "across"}


def test_plan_raises_terms_in_a_row_and_near_words(spark):
    rows = [("row", "", "", "old lantern harbour town"), ("apart", "", "", "lantern old harbour town"), ("near", "", "", "lantern old harbour lanterns"), ("only near", "", "", "lanterns old harbours x")]
    r = planned(spark, rows, "lantern harbour")
    assert set(r) == {"row", "apart", "near"} and r["row"] - r["apart"] == pytest.approx(3.0) and r["near"] > r["apart"]


def test_plan_relaxes_only_when_nothing_is_found(spark):
    rows = [("a", "", "", "lantern"), ("b", "", "", "the blue door"), ("c", "", "", "harbour")]
    assert set(planned(spark, rows, "lantern harbour")) == {"a", "c"}
    assert set(planned(spark, rows, 'lantern harbour "blue door"')) == {"b"}


@pytest.mark.parametrize("files", [0, 1, 120])
def test_streams_read_a_table_in_a_folder_of_files(spark, tmp_path, files):
    """Also more files than a batch takes, of which the first is the latest by days."""
    import datetime
    import os

    from fathomline.io import table
    from fathomline.streaming import jobs

    rows = [(k // 2, datetime.datetime(2024, 6, 1) - datetime.timedelta(days=k), f"a{k % 3}") for k in range(240)]
    folder = tmp_path / "search_clicks.parquet"
    schema = "event_id long, ts timestamp_ntz, action_kind string"
    if files:
        import pyarrow as pa
        import pyarrow.parquet as pq

        folder.mkdir()
        for n in range(files):
            part = rows[n * len(rows) // files : (n + 1) * len(rows) // files]
            pq.write_table(pa.table({"event_id": [r[0] for r in part], "ts": pa.array([r[1] for r in part], pa.timestamp("us")), "action_kind": [r[2] for r in part]}), folder / f"part-{n:05}.parquet")
            os.utime(folder / f"part-{n:05}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    else:
        spark.createDataFrame([], schema).write.parquet(str(folder))
    assert catalog.QUERIES["stream_first_seen"](spark, str(tmp_path)).first()["events"] == (120 if files else 0)
    hours = catalog.QUERIES["stream_hourly_counts"](spark, str(tmp_path))
    assert sorted(map(tuple, hours.collect())) == (sorted((t, a, 1) for _, t, a in rows) if files else [])
    # every row as its own user: the rate limits see each message of the folder
    limited = jobs.limited(jobs.read(spark, str(tmp_path), "search_clicks.parquet", table(spark, str(tmp_path), "search_clicks").schema), "event_id", "ts", late="1000 days")
    assert sum(r["accepted"] for r in jobs.run_once(limited, "update").collect()) == (240 if files else 0)
