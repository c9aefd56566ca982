"""Queries on the query language, assistance, learned ranking and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline import lexicons as X
from fathomline.catalog import PAGES, query, words
from fathomline.catalog.analytics import EV
from fathomline.io import pages, table
from fathomline.operators import assist
from fathomline.operators import feedback as B
from fathomline.plans.intent import intent
from fathomline.plans.parse import parse
from fathomline.plans.planner import plan
from fathomline.streaming import jobs


def _holds(p: str) -> str:
    p = p.replace("'", "''")
    return f"contains(q, '{p}')" if " " in p else f"contains(' ' || regexp_replace(q, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' {p} ')"


def _any(ps) -> str:
    return "(" + " OR ".join(map(_holds, ps)) + ")"


@query(f"""WITH d AS (SELECT DISTINCT query FROM search_clicks WHERE query IS NOT NULL), w AS (SELECT query, lower(trim(query, ' ')) AS q FROM d), v AS (SELECT *, list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '' AND NOT list_contains({words(sorted(X.QUERY_STOP_WORDS))}, x)) AS t, {" + ".join(f"{_holds(p)}::INT" for p in X.TRANSACTIONAL)} AS n FROM w),
 i AS (SELECT query, CASE WHEN len(t) = 1 AND list_contains({words(X.BRANDS)}, t[1]) THEN 'navigational|0.9' WHEN regexp_matches(q, '^[a-z0-9-]+\\.(com|org|net|io|co|dev|app|ai)$') THEN 'navigational|0.95' WHEN {_any(X.NAVIGATIONAL)} THEN 'navigational|0.8' WHEN {_any(X.LOCAL)} THEN 'local|0.85'
 WHEN n > 0 THEN 'transactional|' || least(0.5 + n * 0.15, 0.9) WHEN {" OR ".join(f"starts_with(q, '{p}')" for p in X.INFORMATIONAL)} THEN 'informational|0.85' WHEN len(t) >= 3 THEN 'informational|0.6' ELSE 'informational|0.3' END AS x FROM v)
 SELECT query, split_part(x, '|', 1) AS kind, round(split_part(x, '|', 2)::DOUBLE, 4) AS confidence FROM i""")
def query_intents(spark, sf):
    d = table(spark, sf, "search_clicks").where("query is not null").select("query").distinct()
    return d.select("query", intent(F.col("query")).alias("i")).select("query", "i.*")


def _answerable(spark, sf, d):
    """Pages but those of quarantined peers, a table of machines."""
    bad = table(spark, sf, "peers").where("quarantined").select(F.col("peer_id").alias("origin_peer_id")).distinct()
    return d.join(F.broadcast(bad), "origin_peer_id", "left_anti")


@query()
def planned_search(spark, sf):
    """A query with a phrase, an operator and an exclusion, through the planner."""
    d = pages(spark, sf, *table(spark, sf, "docs").columns)
    return plan(_answerable(spark, sf, d), parse('lantern OR harbour "the simple" lang:en has:https -glacier after:2024-01-10'))


@query()
def planned_terms(spark, sf):
    """A query of two terms through the planner, wherever in a page they stand."""
    d = pages(spark, sf, *table(spark, sf, "docs").columns)
    return plan(_answerable(spark, sf, d), parse("lantern harbour"))


_SURFACE = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}]+'), lambda x: strlen(x) >= 3)"

#: The engine of the SQL compares bytes: letters beyond ASCII become one byte each.
_PLAIN = "translate({0}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿßœæ', '0123456789ABCDEFGHIJKLMNOPQRSTUV')"


@query(f"""WITH {PAGES}, v AS (SELECT term, count(*) AS n FROM (SELECT unnest({_SURFACE.format("concat_ws(' ', title, description)")}) AS term FROM p) GROUP BY 1 ORDER BY n DESC, term LIMIT 100000), {EV},
 w AS (SELECT DISTINCT unnest(string_split_regex(query, '[^\\p{{L}}]+')) AS word FROM ev), u AS (SELECT word FROM w WHERE strlen(word) >= 3 AND word NOT IN (SELECT term FROM v)),
 c AS (SELECT word, term AS suggestion, CAST(levenshtein({_PLAIN.format("word")}, {_PLAIN.format("term")}) AS INTEGER) AS distance, n FROM u JOIN v ON levenshtein({_PLAIN.format("word")}, {_PLAIN.format("term")}) BETWEEN 1 AND 2 AND length(term) <= 32)
 SELECT word, suggestion, distance FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, suggestion) = 1""")
def spelling_suggestions(spark, sf):
    """The nearest dictionary word of each unknown word of the queries."""
    vocab = assist.vocabulary(pages(spark, sf, "title", "description"), "title", "description")
    w = B.events(table(spark, sf, "search_clicks")).select(F.explode(F.split("query", r"[^\p{L}]+")).alias("word"))
    return assist.suggestions(w, vocab)


@query()
def page_summaries(spark, sf):
    return assist.summaries(pages(spark, sf, "title", "content"), "id", "title", "content")


@query("SELECT date_trunc('hour', ts) AS hour, action_kind, count(*) AS n FROM search_clicks WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_hourly_counts(spark, sf):
    """Event-time hourly counts by a stream over the click files."""
    s = table(spark, sf, "search_clicks").schema
    counted = jobs.hourly_counts(jobs.read(spark, sf, "search_clicks.parquet", s).where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "action_kind")
    return jobs.run_once(counted.select(F.col("window.start").alias("hour"), "action_kind", "n"), "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT CAST(count(DISTINCT event_id) AS BIGINT) AS events FROM search_clicks WHERE ts IS NOT NULL")
def stream_first_seen(spark, sf):
    """Events of a stream, each id once, however late it comes again and in whatever batch."""
    s = table(spark, sf, "search_clicks").schema
    e = jobs.read(spark, sf, "search_clicks.parquet", s).where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_once(jobs.first_seen(e, "ts", "event_id", None).select("event_id")).agg(F.count("*").alias("events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = jobs.sessions(e, "ts", "user_id")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def rate_limited(spark, sf):
    """Messages a user may and may not send at five an hour, by keyed stream state."""
    s = table(spark, sf, "events").schema
    return jobs.run_once(jobs.limited(jobs.read(spark, sf, "events.parquet", s), "user_id", "ts", 5, 3600, 7200), "update")
