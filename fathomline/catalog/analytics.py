"""Queries on retrieval, ranking, vectors, links, clicks, trends and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import PAGES, query
from fathomline.catalog.documents import TOK
from fathomline.functions import urls
from fathomline.io import latest, pages, table
from fathomline.lexicons import GENERIC_ANCHORS
from fathomline.operators import feedback as B
from fathomline.operators import graph as G
from fathomline.operators import search as S
from fathomline.operators.index import page_index
from fathomline.plans.parse import parse
from fathomline.plans.planner import filters

TERMS = ["harbour", "lantern"]
_T = ", ".join(f"'{t}'" for t in TERMS)


def _bm25_sql(field: str, need: int, name: str) -> str:
    """CTEs that end in ``name`` (id, matched, score)."""
    parts = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / avg))" for i in range(len(TERMS)))
    ts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(TERMS))
    ds = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(TERMS)))
    m = " + ".join(f"(t{i} > 0)::INT" for i in range(len(TERMS)))
    return f"{name}_w AS (SELECT id, {TOK.format(f'coalesce({field}, {chr(39)*2})')} AS w FROM p), {name}_d AS (SELECT id, len(w) AS len, {ts} FROM {name}_w), {name}_n AS (SELECT count(*) AS n, avg(len) FILTER (len > 0) AS avg, {ds} FROM {name}_d), {name} AS (SELECT id, {m} AS matched, {parts} AS score FROM {name}_d, {name}_n WHERE {m} >= {need})"


@query(f"WITH {PAGES}, {_bm25_sql('content', 2, 'r')} SELECT id, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, id LIMIT 10")
def search_all_terms(spark, sf):
    """Top ten by BM25 of pages that hold all terms."""
    r = page_index(spark, sf).search(TERMS, need=len(TERMS))
    return r.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {PAGES}, {_bm25_sql('content', 1, 'r')} SELECT id, CAST(matched AS INTEGER) AS matched, round(score, 6) AS score FROM r")
def search_any_term(spark, sf):
    return S.bm25(pages(spark, sf, "content"), "id", "content", TERMS).select("id", "matched", F.round("score", 6).alias("score"))


@query(f"WITH {PAGES}, {_bm25_sql('title', 1, 'a')}, {_bm25_sql('description', 1, 'b')}, {_bm25_sql('content', 1, 'c')}, x AS (SELECT id, score * 5.0 AS score FROM a UNION ALL SELECT id, score * 1.5 FROM b UNION ALL SELECT id, score FROM c) SELECT id, round(sum(score), 6) AS score FROM x GROUP BY id")
def search_fields(spark, sf):
    return page_index(spark, sf).search(TERMS, boosts=S.BOOSTS).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {PAGES} SELECT id FROM p WHERE contains(' ' || array_to_string({TOK.format('content')}, ' ') || ' ', ' the simple lantern ')")
def search_phrase(spark, sf):
    return S.phrase(pages(spark, sf, "content"), "content", "the simple lantern").select("id")


@query(f"WITH {PAGES} SELECT id FROM p WHERE list_contains({TOK.format('content')}, 'lantern') AND NOT (list_contains({TOK.format('content')}, 'harbour') OR list_contains({TOK.format(chr(99)+chr(111)+'alesce(title, '+chr(39)*2+')')}, 'harbour') OR list_contains({TOK.format('coalesce(description, '+chr(39)*2+')')}, 'harbour'))")
def search_excluding(spark, sf):
    d = pages(spark, sf, "title", "description", "content")
    return S.excluded(d.where(F.array_contains(S.tokens(F.col("content")), "lantern")), ["harbour"]).select("id")


@query(f"WITH {PAGES} SELECT id, url FROM p WHERE domain = 'amberwick.example' AND language = 'en' AND is_https AND country = 'US' AND contains(url, 'notes') AND crawled_at BETWEEN '2024-01-15' AND '2024-03-01'")
def search_filters(spark, sf):
    """Field filters alone: site, language, country, scheme, words of the url, dates."""
    d = pages(spark, sf, "url", "domain", "language", "country", "is_https", "crawled_at")
    q = parse("site:amberwick.example lang:en country:us inurl:notes has:https after:2024-01-15 before:2024-03-01")
    return filters(d, q).select("id", "url")


@query(f"""WITH {PAGES}, w AS (SELECT id, url, origin_peer_id AS o, {TOK.format("coalesce(title, '')")} AS t, {TOK.format("coalesce(content, '')")} AS c, {TOK.format("coalesce(description, '')")} AS d FROM p)
 SELECT id FROM w WHERE list_contains(t, 'the') AND list_contains(c, 'river') AND (ends_with(lower(url), '.html') OR ends_with(lower(url), '.htm')) AND list_has_any(list_concat(t, c, d), ['harbour', 'lantern', 'bridge']) AND NOT list_has_any(list_concat(t, c, d), ['glacier']) AND coalesce(o, '') <> (SELECT coalesce(min(peer_id), '') FROM peers)""")
def search_operators(spark, sf):
    """Operators on words: in the title, in the text, file types, one of several, none of these, not of a peer."""
    peer = table(spark, sf, "peers").agg(F.min("peer_id")).first()[0] or ""
    q = parse(f"intitle:the intext:river filetype:html filetype:htm -peer:{peer} harbour OR lantern OR bridge -glacier")
    return filters(pages(spark, sf, "url", "title", "description", "content", "origin_peer_id"), q).select("id")


@query(f"WITH {PAGES}, v AS (SELECT unnest({TOK.format('title')}) AS term FROM p), c AS (SELECT term, count(*) AS n FROM v GROUP BY 1) SELECT term, n, CAST(levenshtein(term, 'lanturn') AS INTEGER) AS distance FROM c WHERE levenshtein(term, 'lanturn') <= 2")
def fuzzy_vocabulary(spark, sf):
    """Words of titles within two edits of a misspelt one: fuzzy expansion and spelling candidates."""
    v = pages(spark, sf, "title").select(F.explode(S.tokens(F.col("title"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return S.fuzzy_terms(v, "lanturn").select("term", "n", "distance")


_COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / nullif(sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0)"


@query(f"SELECT b.vec_id, round({_COS}, 5) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) AND b.vec_id <> a.vec_id AND {_COS} > 0 ORDER BY round({_COS}, 5) DESC, b.vec_id LIMIT 10")
def cosine_nearest(spark, sf):
    """The ten nearest vectors of one, by exact cosine over all rows."""
    from fathomline.operators.vectors import cosine

    e = table(spark, sf, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    x = e.crossJoin(F.broadcast(q)).where("vec_id <> q").select("vec_id", F.round(cosine(F.col("embedding"), F.col("v")), 5).alias("similarity"))  # one query vector
    return x.where("similarity > 0").orderBy(F.desc("similarity"), "vec_id").limit(10)


@query(f"WITH {PAGES}, t AS (SELECT unnest(list_distinct({TOK.format('content')})) AS term FROM p WHERE content IS NOT NULL), n AS (SELECT count(*) AS n FROM p WHERE content IS NOT NULL) SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term")
def term_idf(spark, sf):
    d = pages(spark, sf, "content").where("content is not null")
    t = d.select(F.explode(F.array_distinct(S.tokens(F.col("content")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    x = t.crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
    return x.select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"""WITH {PAGES}, {_bm25_sql('content', 1, 'c')}, {_bm25_sql('title', 1, 'h')}, a AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM c QUALIFY r <= 100), b AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM h QUALIFY r <= 100)
 SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.7 / (60 + a.r), 0) + coalesce(0.3 / (60 + b.r), 0), 8) AS score FROM a FULL JOIN b ON a.id = b.id""")
def rank_fusion(spark, sf):
    """Reciprocal rank fusion of the top hundred by content and by title."""
    top = lambda f: page_index(spark, sf).search(TERMS, boosts={f: 1.0}).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(100)
    return S.reciprocal_rank_fusion(top("content"), top("title"), "id").select("id", F.round("score", 8).alias("score"))


@query(f"""WITH {PAGES}, {_bm25_sql('content', 1, 'c')}, t AS (SELECT id, domain, url, round(score, 6) AS score FROM c JOIN p USING (id) ORDER BY 4 DESC, id LIMIT 40),
 n AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn, array_to_string(list_slice(string_split(regexp_replace(regexp_replace(regexp_extract(lower(url), '://([^/?#]*)', 1), ':[0-9]+$', ''), '^www\\.', ''), '.'), -2, -1), '.') AS dom, score FROM t),
 k AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY rn) AS nth FROM n) SELECT id, CAST(row_number() OVER (ORDER BY (rn > 10)::INT, (rn <= 10 AND nth > 2)::INT, rn) AS INTEGER) AS place FROM k""")
def domain_diversity(spark, sf):
    """Forty results, at most two a registrable domain among the first ten."""
    d = pages(spark, sf, "url")
    r = page_index(spark, sf).search(TERMS).select("id", F.round("score", 6).alias("score")).join(d.select("id", "url"), "id").orderBy(F.desc("score"), "id").limit(40)
    return S.diversify(r, urls.registrable(F.col("url")), [F.desc("score"), F.col("id")]).select("id", "place")


@query(f"WITH {PAGES} SELECT id, round(CASE WHEN crawled_at IS NULL THEN 0.5 ELSE least(1.0, greatest(0.1, 0.5 + 0.5 * exp(-ln(2) / 90 * (epoch(TIMESTAMP '2024-06-01') - floor(epoch(crawled_at))) / 86400))) END, 6) AS fresh, round(greatest(0, quality_score_ok * (quality_score_ok * 0.92 + 0.16 * CASE WHEN crawled_at IS NULL THEN 0.5 ELSE least(1.0, greatest(0.1, 0.5 + 0.5 * exp(-ln(2) / 90 * (epoch(TIMESTAMP '2024-06-01') - floor(epoch(crawled_at))) / 86400))) END)), 6) AS final FROM (SELECT *, CASE WHEN isnan(quality_score) OR quality_score NOT BETWEEN 0 AND 1 OR quality_score IS NULL THEN 0.5 ELSE quality_score END AS quality_score_ok FROM p)")
def final_scores(spark, sf):
    d = pages(spark, sf, "crawled_at", "quality_score")
    q = F.when(F.col("quality_score").isNull() | F.isnan("quality_score") | ~F.col("quality_score").between(0, 1), 0.5).otherwise(F.col("quality_score"))
    fr = S.fresh(F.col("crawled_at").cast("timestamp"), F.lit("2024-06-01").cast("timestamp"), F.lit(90.0))
    return d.select("id", F.round(fr, 6).alias("fresh"), F.round(S.final_score(q, q, fr), 6).alias("final"))


E1 = "e AS (SELECT to_id, from_id, arg_max(is_cross, (coalesce(discovered_at, TIMESTAMP '1970-01-01'), coalesce(anchor_text, ''), is_cross)) AS is_cross FROM link_edges GROUP BY 1, 2)"


@query(f"WITH {E1}, i AS (SELECT to_id AS node, count(*) AS inbound FROM e GROUP BY 1), o AS (SELECT from_id AS node, count(*) AS outbound FROM e GROUP BY 1) SELECT coalesce(i.node, o.node) AS node, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound FROM i FULL JOIN o ON i.node = o.node")
def link_counts(spark, sf):
    e = G.edges(table(spark, sf, "link_edges"))
    i, o = e.groupBy(F.col("to_id").alias("node")).agg(F.count("*").alias("inbound")), e.groupBy(F.col("from_id").alias("node")).agg(F.count("*").alias("outbound"))
    return i.join(o, "node", "full_outer").select("node", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


@query(f"""WITH RECURSIVE {E1}, g AS (SELECT from_id, to_id, CASE WHEN is_cross THEN 1.5 ELSE 1.0 END / count(*) OVER (PARTITION BY from_id) AS w FROM e), nd AS (SELECT from_id AS node FROM g UNION SELECT to_id FROM g), n AS (SELECT count(*)::DOUBLE AS n FROM nd),
 {", ".join(f"r{i} AS (SELECT node, " + ("1.0 / (SELECT n FROM n)" if i == 0 else f"0.15 / (SELECT n FROM n) + 0.85 * coalesce((SELECT sum(r.rank * g.w) FROM g JOIN r{i - 1} r ON r.node = g.from_id WHERE g.to_id = nd.node), 0)") + " AS rank FROM nd)" for i in range(4))}
 SELECT node, round(rank / (SELECT max(rank) FROM r3), 6) AS rank FROM r3""")
def pagerank_three_rounds(spark, sf):
    r = G.pagerank(G.edges(table(spark, sf, "link_edges")), rounds=3)
    return r.select("node", F.round("rank", 6).alias("rank"))


@query(f"""WITH RECURSIVE {E1}, g AS (SELECT from_id, to_id, CASE WHEN is_cross THEN 1.5 ELSE 1.0 END / count(*) OVER (PARTITION BY from_id) AS w FROM e), nd AS (SELECT from_id AS node FROM g UNION SELECT to_id FROM g), n AS (SELECT count(*)::DOUBLE AS n FROM nd),
 r AS (SELECT node, 1.0::DOUBLE / (SELECT n FROM n) AS rank, 0 AS round, 1.0::DOUBLE AS moved FROM nd
  UNION ALL SELECT node, rank, round, sum(abs(rank - old)) OVER () AS moved FROM (SELECT a.node, any_value(a.round) + 1 AS round, any_value(a.rank) AS old, 0.15 / (SELECT n FROM n) + 0.85 * coalesce(sum(b.rank * g.w), 0) AS rank FROM r a LEFT JOIN g ON g.to_id = a.node LEFT JOIN r b ON b.node = g.from_id WHERE a.moved >= 1e-6 AND a.round < 20 GROUP BY a.node))
 SELECT node, round(rank / max(rank) OVER (), 6) AS rank FROM r WHERE round = (SELECT max(round) FROM r)""")
def pagerank(spark, sf):
    return G.pagerank(G.edges(table(spark, sf, "link_edges"))).select("node", F.round("rank", 6).alias("rank"))


_E2 = "e AS (SELECT to_id, from_id, arg_max({'a': anchor_text}, (coalesce(discovered_at, TIMESTAMP '1970-01-01'), coalesce(anchor_text, ''), is_cross)).a AS anchor_text FROM link_edges GROUP BY 1, 2)"


@query(f"""WITH {_E2}, a AS (SELECT to_id, trim(anchor_text) AS t, lower(trim(anchor_text)) AS low FROM e WHERE trim(anchor_text) <> ''), g AS (SELECT to_id, low, count(*) AS n, min(t) AS t FROM a WHERE low NOT IN ({", ".join(f"'{x}'" for x in GENERIC_ANCHORS)}) GROUP BY 1, 2),
 w AS (SELECT *, sum(strlen(t) + 1) OVER (PARTITION BY to_id ORDER BY n DESC, low ROWS UNBOUNDED PRECEDING) AS size FROM g) SELECT to_id, string_agg(t, ' ' ORDER BY n DESC, low) AS anchors FROM w WHERE size - 1 <= 500 GROUP BY 1""")
def anchor_texts(spark, sf):
    return G.anchor_texts(G.edges(table(spark, sf, "link_edges")))


@query("""WITH n AS (SELECT DISTINCT peer_id AS node FROM peers), r AS (SELECT ('0x' || substr(sha256(node || '#' || chr(i::INTEGER)), 1, 8))::BIGINT AS point, node FROM n, range(0, 64) t(i)),
 d AS (SELECT DISTINCT domain FROM docs WHERE domain IS NOT NULL), h AS (SELECT domain, ('0x' || substr(sha256(domain), 1, 8))::BIGINT AS h FROM d)
 SELECT domain, coalesce((SELECT arg_min(node, (point, node)) FROM r WHERE point >= h.h), (SELECT arg_min(node, (point, node)) FROM r)) AS node FROM h""")
def ring_owners(spark, sf):
    """The peer that owns each domain on a consistent ring of 64 points a peer."""
    d = table(spark, sf, "docs").where("domain is not null").select("domain").distinct()
    return G.owners(d, "domain", table(spark, sf, "peers").select(F.col("peer_id").alias("node")).distinct())


@query("""WITH i AS (SELECT DISTINCT domain, id || chr(31) || content_hash AS item FROM docs WHERE domain IS NOT NULL AND content_hash IS NOT NULL), p AS (SELECT domain, substr(sha256(item), 1, 2) AS part, count(*) AS n, sha256(string_agg(item, '' ORDER BY item)) AS h FROM i GROUP BY 1, 2)
 SELECT domain, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY part)) AS digest FROM p GROUP BY 1""")
def replica_digests(spark, sf):
    """A digest per domain of its pages and hashes: replicas with equal digests hold the same."""
    d = table(spark, sf, "docs").where("domain is not null and content_hash is not null")
    return G.digests(d, "domain", F.concat("id", F.char(F.lit(31)), "content_hash"))


EV = "ev AS (SELECT * REPLACE (lower(trim(query)) AS query) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST) AS rn FROM search_clicks) WHERE rn = 1 AND trim(query) <> '' AND url IS NOT NULL)"
CT = EV + ", ct AS (SELECT query, url, count(*) FILTER (action_kind = 'impression') AS impressions, count(*) FILTER (action_kind = 'click') AS clicks, count(*) FILTER (action_kind = 'pogo') AS pogos, count(*) FILTER (action_kind = 'dwell') AS dwells, CAST(coalesce(sum(dwell_ms) FILTER (action_kind = 'dwell'), 0) AS BIGINT) AS dwell_ms, arg_max(position_no, (ts, event_id)) AS position FROM ev GROUP BY 1, 2)"


@query(f"WITH {CT} SELECT query, url, impressions, clicks, pogos, dwells, dwell_ms, position, round(CASE WHEN impressions > 0 THEN clicks / impressions / greatest(1 / (1 + 0.5 * ln(CASE WHEN coalesce(position, 0) = 0 THEN 1 ELSE position END + 1.0)), 0.01) ELSE 0.0 END, 6) AS ctr, round(CASE WHEN dwells > 0 THEN dwell_ms / dwells / 1000 ELSE 0.0 END, 6) AS avg_dwell_s, round(CASE WHEN clicks > 0 THEN pogos / clicks ELSE 0.0 END, 6) AS pogo_rate FROM ct")
def click_counters(spark, sf):
    c = B.ctr(B.counters(B.events(table(spark, sf, "search_clicks"))))
    return c.select("query", "url", "impressions", "clicks", "pogos", "dwells", "dwell_ms", "position", *[F.round(x, 6).alias(x) for x in ("ctr", "avg_dwell_s", "pogo_rate")])


@query(f"WITH {CT} SELECT regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), ':\\d+$', ''), '^www\\.', '') AS domain, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(CASE WHEN sum(impressions) > 0 THEN sum(clicks) / sum(impressions) ELSE 0.0 END, 6) AS ctr, round(CASE WHEN sum(dwells) > 0 THEN sum(dwell_ms) / sum(dwells) / 1000 ELSE 0.0 END, 6) AS dwell_s FROM ct GROUP BY 1")
def domain_feedback(spark, sf):
    d = B.by_domain(B.counters(B.events(table(spark, sf, "search_clicks"))))
    return d.select("domain", "impressions", "clicks", F.round("ctr", 6).alias("ctr"), F.round("dwell_s", 6).alias("dwell_s"))


@query(f"WITH {EV} SELECT query, count(*) AS n FROM ev WHERE action_kind = 'click' GROUP BY 1 ORDER BY n DESC, query LIMIT 20")
def popular_queries(spark, sf):
    e = B.events(table(spark, sf, "search_clicks")).where("action_kind = 'click'")
    return e.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query(f"WITH {CT}, u AS (SELECT query, clicks FROM ct WHERE clicks > 0), g AS (SELECT query, count(*) AS urls, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM u GROUP BY 1), z AS (SELECT a.query, count(*) AS preferences FROM u a JOIN u b ON a.query = b.query AND a.clicks > b.clicks GROUP BY 1) SELECT g.query, urls, pairs, coalesce(preferences, 0) AS preferences FROM g LEFT JOIN z ON g.query = z.query")
def preference_pairs(spark, sf):
    return B.preference_counts(B.counters(B.events(table(spark, sf, "search_clicks"))))


HR = EV + ", hr AS (SELECT query AS name, date_trunc('hour', ts) AS hour, count(*) AS n FROM ev WHERE ts IS NOT NULL GROUP BY 1, 2), mx AS (SELECT max(hour) AS h FROM hr)"


@query(f"WITH {HR} SELECT name, CAST(sum(n) FILTER (hour = h) AS BIGINT) AS current, round(sum(n) / count(DISTINCT hour), 6) AS average, round(sum(n) FILTER (hour = h) / greatest(sum(n) / count(DISTINCT hour), 0.1), 6) AS velocity FROM hr, mx WHERE hour <= h AND hour > h - INTERVAL 168 HOUR GROUP BY name, h HAVING coalesce(sum(n) FILTER (hour = h), 0) > 0")
def trending_queries(spark, sf):
    """Queries of the last hour by their count over the mean of a week's hours."""
    h = B.hourly(B.events(table(spark, sf, "search_clicks")).where("ts is not null"), "query")
    top = h.agg(F.max("hour").alias("top"))
    t = B.trending(h.crossJoin(F.broadcast(top)), F.col("top"))
    return t.select("name", "current", F.round("average", 6).alias("average"), F.round("velocity", 6).alias("velocity"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reported_at, reason, detail NULLS FIRST) AS rn FROM spam_reports) SELECT lower(trim(domain)) AS domain, count(*) AS reports, count(DISTINCT reporter_id) AS reporters, count(*) >= 5 AS flagged, count(DISTINCT reporter_id) >= 3 AS agreed FROM r WHERE rn = 1 AND domain IS NOT NULL GROUP BY 1")
def domain_reports(spark, sf):
    r = latest(table(spark, sf, "spam_reports"), "id", F.asc("reported_at"), F.asc("reason"), F.asc_nulls_first("detail")).where("domain is not null")
    return r.groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.count("*").alias("reports"), F.count_distinct("reporter_id").alias("reporters"), (F.count("*") >= 5).alias("flagged"), (F.count_distinct("reporter_id") >= 3).alias("agreed"))


@query(f"WITH {PAGES}, g AS (SELECT coalesce(origin_peer_id, '') AS peer, count(*) AS n, count(DISTINCT domain) AS domains FROM p GROUP BY 1), t AS (SELECT peer_id, max(trust_score) AS trust FROM peers GROUP BY 1) SELECT peer, n, domains, coalesce(trust, 0.5) AS trust FROM g LEFT JOIN t ON peer = peer_id")
def peer_leaderboard(spark, sf):
    g = pages(spark, sf, "origin_peer_id", "domain").groupBy(F.coalesce("origin_peer_id", F.lit("")).alias("peer")).agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"))
    t = table(spark, sf, "peers").groupBy(F.col("peer_id").alias("peer")).agg(F.max("trust_score").alias("trust"))
    return g.join(t, "peer", "left").select("peer", "n", "domains", F.coalesce("trust", F.lit(0.5)).alias("trust"))


@query("WITH d AS (SELECT id, content_hash, crawled_at, lag(content_hash) OVER (PARTITION BY id ORDER BY crawled_at, content_hash) AS was FROM docs WHERE content_hash IS NOT NULL AND crawled_at IS NOT NULL) SELECT id, count(*) AS crawls, count(*) FILTER (was IS NOT NULL AND was <> content_hash) AS changes, max(crawled_at) AS last FROM d GROUP BY 1")
def content_changes(spark, sf):
    return B.change_log(table(spark, sf, "docs").where("content_hash is not null and crawled_at is not null").select("id", "content_hash", "crawled_at"), "id", "content_hash", "crawled_at")


@query(f"WITH {PAGES}, d AS (SELECT domain, count(*) AS n FROM p WHERE domain IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n, domain) AS i FROM d) SELECT count(*) AS domains, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r")
def domain_gini(spark, sf):
    """Gini coefficient of pages per domain, from the histogram of the counts."""
    d = pages(spark, sf, "domain").where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))
    h = d.groupBy("n").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2)
    a = h.agg(F.sum("m").alias("k"), F.sum(F.col("ranks") * F.col("n")).alias("s"), F.sum(F.col("n") * F.col("m")).alias("t"))
    return a.select(F.col("k").alias("domains"), F.round(2 * F.col("s") / (F.col("k") * F.col("t")) - (F.col("k") + 1) / F.col("k"), 6).alias("gini"))


_RING = "r AS (SELECT ('0x' || substr(sha256(node || '#' || chr(i::INTEGER)), 1, 8))::BIGINT AS point, node FROM n, range(0, 64) t(i))"


@query(f"""WITH d AS (SELECT DISTINCT domain, ('0x' || substr(sha256(domain), 1, 8))::BIGINT AS h FROM docs WHERE domain IS NOT NULL), n AS (SELECT DISTINCT peer_id AS node FROM peers), {_RING}, gone AS (SELECT min(node) AS g FROM n), r2 AS (SELECT * FROM r WHERE node <> (SELECT g FROM gone)),
 o AS (SELECT domain, coalesce((SELECT arg_min(node, (point, node)) FROM r WHERE point >= d.h), (SELECT arg_min(node, (point, node)) FROM r)) AS old, coalesce((SELECT arg_min(node, (point, node)) FROM r2 WHERE point >= d.h), (SELECT arg_min(node, (point, node)) FROM r2)) AS new FROM d)
 SELECT domain, old, new, CAST(floor((row_number() OVER (PARTITION BY old, new ORDER BY domain) - 1) / 50) AS BIGINT) AS batch FROM o WHERE old <> new""")
def ownership_moves(spark, sf):
    """Domains that change their owner when one peer leaves."""
    d = table(spark, sf, "docs").where("domain is not null").select("domain").distinct()
    n = table(spark, sf, "peers").select(F.col("peer_id").alias("node")).distinct()
    gone = n.agg(F.min("node").alias("g"))
    return G.moves(d, "domain", n, n.join(F.broadcast(gone), F.col("node") == F.col("g"), "left_anti"))


@query(f"""WITH {PAGES}, t AS (SELECT id, {TOK.format('content')} AS w FROM p), e AS (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t), f AS (SELECT * FROM e WHERE term IN ({_T})), g AS (SELECT a.id, min(abs(a.pos - b.pos)) AS d FROM f a JOIN f b ON a.id = b.id AND a.term < b.term GROUP BY 1)
 SELECT t.id, round(coalesce(1 / (1 + d), 0), 6) AS proximity, round(len(list_filter([{_T}], lambda x: list_contains(w, x))) / {len(TERMS)}, 6) AS overlap FROM t LEFT JOIN g ON t.id = g.id WHERE w IS NOT NULL""")
def term_proximity(spark, sf):
    d = pages(spark, sf, "content").where("content is not null")
    o = d.select("id", F.round(S.term_overlap(TERMS, S.tokens(F.col("content"))), 6).alias("overlap"))
    return S.proximity(d, "id", "content", TERMS).select("id", F.round("proximity", 6).alias("proximity")).join(o, "id")


@query(f"""WITH {PAGES}, t AS (SELECT id, unnest({TOK.format("coalesce(content, '')")}) AS term FROM p), c AS (SELECT id, term, count(*) AS n FROM t GROUP BY 1, 2), u AS (SELECT DISTINCT term FROM c),
 h AS (SELECT term, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(list_filter(string_split(term, ''), lambda x: x <> ''), lambda x: unicode(x)::UHUGEINT)), lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM u),
 k AS (SELECT id, (h % 384)::INT AS k, sum(CASE WHEN (h // 4294967296) % 2 = 1 THEN -n ELSE n END) AS v FROM c JOIN h USING (term) GROUP BY 1, 2), g AS (SELECT id, sqrt(sum(v * v)) AS len, max({{'v': abs(v), 'k': -k}}) AS top FROM k GROUP BY 1)
 SELECT p.id, 384 AS dim, CASE WHEN coalesce(len, 0) > 0 THEN 1.0 ELSE 0.0 END AS norm, CASE WHEN len > 0 THEN CAST(-top.k AS INTEGER) END AS peak, CASE WHEN len > 0 THEN round(top.v / len, 4) END AS peak_value FROM p LEFT JOIN g ON p.id = g.id""")
def hashed_embeddings(spark, sf):
    """Feature-hash vectors of the pages: dimension, length, and where and how high each peaks."""
    from fathomline.operators.vectors import dot, embed

    e = embed(pages(spark, sf, "content"), "id", "content")
    x = e.withColumn("norm", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 4))
    top = F.array_max(F.transform("embedding", lambda v, i: F.struct(F.abs(v).alias("v"), (-i).alias("k"))))
    at = F.when(F.col("norm") > 0, top)
    return x.select("id", F.size("embedding").alias("dim"), "norm", (-at["k"]).alias("peak"), F.round(at["v"].cast("double"), 4).alias("peak_value"))


@query()
def distinct_results(spark, sf):
    """All pages by quality (none and NaN last) without repeats of a url or a content."""
    d = pages(spark, sf, "url", "content_hash", "quality_score").select("id", urls.normalize(F.col("url")).alias("url_norm"), "content_hash", "quality_score")
    worth = F.coalesce(F.nanvl("quality_score", F.lit(None).cast("double")), F.lit(float("-inf")))
    return S.distinct_results(d, [-worth, F.col("id")]).drop("quality_score")
