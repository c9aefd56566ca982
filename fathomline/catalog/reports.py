"""Queries on domains, placement, entities, replicas, crawl rules and assistance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fathomline import lexicons as X
from fathomline.catalog import ORACLE_SQL, PAGES, hits, query, words
from fathomline.catalog.analytics import CT, E1, EV, HR, TERMS, _bm25_sql
from fathomline.catalog.documents import TOK, U2
from fathomline.functions import text, urls
from fathomline.io import delete, numbered, pages, table, union_all, upsert
from fathomline.operators import assist, entities, instant
from fathomline.operators import feedback as B
from fathomline.operators import graph as G
from fathomline.operators import search as S
from fathomline.operators.index import held, page_index

AS_OF = "2024-06-01"


def _peers(spark, sf):
    return table(spark, sf, "peers").select(F.col("peer_id").alias("node")).distinct()


@query(f"WITH {PAGES} SELECT DISTINCT domain FROM p WHERE domain <> '' ORDER BY domain LIMIT 100000")
def distinct_domains(spark, sf):
    """The domains of all pages, the first 100,000 (a facet)."""
    return pages(spark, sf, "domain").where("domain <> ''").select("domain").distinct().orderBy("domain").limit(100_000)


@query(f"WITH {PAGES} SELECT count(*) FILTER (coalesce(origin_peer_id, '') = '') AS local, count(*) FILTER (coalesce(origin_peer_id, '') <> '') AS remote FROM p")
def document_origins(spark, sf):
    far = F.coalesce("origin_peer_id", F.lit("")) != ""
    return pages(spark, sf, "origin_peer_id").agg(F.sum((~far).cast("long")).alias("local"), F.sum(far.cast("long")).alias("remote"))


_PLACED = """d AS (SELECT DISTINCT domain, ('0x' || substr(sha256(domain), 1, 8))::BIGINT AS h FROM docs WHERE domain IS NOT NULL), n AS (SELECT DISTINCT peer_id AS node FROM peers),
 r AS (SELECT ('0x' || substr(sha256(node || '#' || chr(i::INTEGER)), 1, 8))::BIGINT AS point, node FROM n, range(0, 64) t(i)),
 f AS (SELECT domain, node, min((point - h + 4294967296) % 4294967296) AS far FROM d, r GROUP BY 1, 2), k AS (SELECT domain, node, row_number() OVER (PARTITION BY domain ORDER BY far, node) AS nth FROM f QUALIFY nth <= 3)"""


@query(f"WITH {_PLACED} SELECT domain, max(node) FILTER (nth = 1) AS owner, string_agg(node, '|' ORDER BY nth) AS holders, bool_or(node = (SELECT min(node) FROM n)) AS is_local FROM k GROUP BY 1")
def domain_assignments(spark, sf):
    """Owner and holders (three copies) of each domain, and whether the peer of least name is one of them."""
    d = table(spark, sf, "docs").where("domain is not null").select("domain").distinct()
    me = _peers(spark, sf).agg(F.min("node").alias("me"))  # one row
    x = G.replica_owners(d, "domain", _peers(spark, sf)).crossJoin(F.broadcast(me))
    return x.select("domain", F.col("nodes")[0].alias("owner"), F.array_join("nodes", "|").alias("holders"), F.array_contains("nodes", F.col("me")).alias("is_local"))


@query(f"WITH {_PLACED} SELECT node, count(*) AS held, count(*) FILTER (nth = 1) AS owned FROM k GROUP BY 1")
def owned_domains(spark, sf):
    """How many domains each peer owns and holds."""
    d = table(spark, sf, "docs").where("domain is not null").select("domain").distinct()
    x = G.replica_owners(d, "domain", _peers(spark, sf)).select(F.posexplode("nodes").alias("nth", "node"))
    return x.groupBy("node").agg(F.count("*").alias("held"), F.sum((F.col("nth") == 0).cast("long")).alias("owned"))


@query(f"WITH {PAGES} SELECT domain, count(*) AS n FROM p WHERE domain <> '' GROUP BY 1 ORDER BY n DESC, domain LIMIT 50")
def top_domains(spark, sf):
    return pages(spark, sf, "domain").where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(50)


def _authority_sql() -> str:
    ranks, clicks = ORACLE_SQL["pagerank_three_rounds"], ORACLE_SQL["domain_feedback"]
    return f"""WITH {PAGES}, {E1}, rk AS ({ranks}), fb AS ({clicks}), d AS (SELECT id, domain, CASE WHEN isnan(quality_score) THEN 0 ELSE coalesce(quality_score, 0) END AS q FROM p WHERE domain <> ''),
 b AS (SELECT domain, count(*) AS pages, sum(coalesce(rank, 0)) / count(*) AS rank, sum(q) / count(*) AS quality FROM d LEFT JOIN rk ON id = node GROUP BY 1),
 l AS (SELECT t.domain, count(DISTINCT s.domain) AS backlinks FROM e JOIN d t ON t.id = e.to_id JOIN d s ON s.id = e.from_id WHERE is_cross AND s.domain <> t.domain GROUP BY 1),
 x AS (SELECT b.*, coalesce(backlinks, 0) AS backlinks, coalesce(impressions, 0) AS seen, least(coalesce(ctr, 0) * 2, 1) * 0.5 + least(coalesce(dwell_s, 0) / 120, 1) * 0.5 AS beh FROM b LEFT JOIN l USING (domain) LEFT JOIN fb USING (domain)),
 y AS (SELECT *, least(pages / 100, 1) * 0.5 + least(backlinks / 50, 1) * 0.5 AS st FROM x)
 SELECT domain, pages, backlinks, round(rank, 5) AS rank, round(quality, 5) AS quality, round(greatest(0, least(1, CASE WHEN seen > 10 THEN rank * 0.25 + quality * 0.20 + st * 0.15 + beh * 0.25 + least(backlinks / 50, 1) * 0.15 ELSE rank * 0.35 + quality * 0.25 + st * 0.40 END))::DOUBLE, 5) AS score FROM y"""


def _ranks(spark, sf):
    return G.pagerank(G.edges(table(spark, sf, "link_edges")), rounds=3).select("node", F.round("rank", 6).alias("rank"))


def _feedback(spark, sf):
    f = B.by_domain(B.counters(B.events(table(spark, sf, "search_clicks"))))
    return f.select("domain", "impressions", F.round("ctr", 6).alias("ctr"), F.round("dwell_s", 6).alias("dwell_s"))


@query(_authority_sql())
def domain_authority(spark, sf):
    """Score of each domain from its pages, ranks after three rounds, links from other domains and clicks."""
    a = G.authority(pages(spark, sf, "domain", "quality_score"), G.edges(table(spark, sf, "link_edges")), _ranks(spark, sf), _feedback(spark, sf))
    return a.select("domain", "pages", "backlinks", *[F.round(c, 5).alias(c) for c in ("rank", "quality", "score")])


@query(f"WITH {PAGES}, {E1}, rk AS ({ORACLE_SQL['pagerank_three_rounds']}), i AS (SELECT to_id, count(*) AS inbound FROM e GROUP BY 1) SELECT id, coalesce(rank, 0) AS pagerank, coalesce(inbound, 0) AS inbound FROM p LEFT JOIN rk ON id = node LEFT JOIN i ON id = to_id")
def link_write_back(spark, sf):
    """Rank and number of inbound links written to each page."""
    i = G.edges(table(spark, sf, "link_edges")).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("inbound"))
    x = pages(spark, sf).join(_ranks(spark, sf).withColumnRenamed("node", "id"), "id", "left").join(i, "id", "left")
    return x.select("id", F.coalesce("rank", F.lit(0.0)).alias("pagerank"), F.coalesce("inbound", F.lit(0)).alias("inbound"))


_LINKS = "WITH q0 AS (SELECT id AS page, unnest(links) AS l FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, indexed_at DESC NULLS LAST, quality_score DESC NULLS LAST) AS rn FROM docs WHERE id IS NOT NULL) WHERE rn = 1), p AS (SELECT page AS id, l.url AS url, l.is_external AS cross_site FROM q0 WHERE NOT coalesce(l.nofollow, false) AND l.url IS NOT NULL)"
_NORM = ORACLE_SQL["url_normalize"]


def _recorded_sql() -> str:
    """The normalising SQL over the links in place of the pages."""
    rest = _NORM.split(PAGES + ", ", 1)[1].replace("SELECT id, url, lower(regexp_extract", "SELECT id, cross_site, url, lower(regexp_extract").replace("n AS (SELECT id, url, scheme,", "n AS (SELECT id, cross_site, url, scheme,")
    head, tail = rest.rsplit(" SELECT id, CASE WHEN", 1)
    return f"{_LINKS}, {head}, o AS (SELECT id, cross_site, CASE WHEN{tail}) SELECT id AS from_id, url_norm AS to_url, bool_or(cross_site) AS is_cross, count(*) AS times FROM o GROUP BY 1, 2"


@query(_recorded_sql())
def recorded_links(spark, sf):
    """The followed links of each page to normalised URLs, each once."""
    x = pages(spark, sf, "links").select("id", F.explode("links").alias("l")).where(~F.coalesce("l.nofollow", F.lit(False)) & F.col("l.url").isNotNull())
    x = x.select(F.col("id").alias("from_id"), urls.normalize(F.col("l.url")).alias("to_url"), F.col("l.is_external").alias("c"))
    return x.groupBy("from_id", "to_url").agg(F.bool_or("c").alias("is_cross"), F.count("*").alias("times"))


_KIND = "CASE WHEN mine.id IS NULL THEN 'missing' ELSE 'diverged' END"


@query(f"""WITH {PAGES}, early AS (SELECT id, arg_min(content_hash, crawled_at) AS h FROM docs WHERE id IS NOT NULL AND domain IS NOT NULL AND content_hash IS NOT NULL AND crawled_at < TIMESTAMP '2024-02-15' GROUP BY 1)
 SELECT p.id, {_KIND} AS kind FROM p LEFT JOIN early AS mine ON mine.id = p.id WHERE domain IS NOT NULL AND content_hash IS NOT NULL AND (mine.id IS NULL OR mine.h <> content_hash)""")
def replica_differences(spark, sf):
    """Pages that a replica of mid-February lacks or holds with another hash."""
    d = table(spark, sf, "docs").where("id is not null and domain is not null and content_hash is not null and crawled_at < timestamp_ntz'2024-02-15'")
    mine = d.groupBy("id").agg(F.min_by(F.struct("domain", "content_hash"), "crawled_at").alias("x")).select("id", "x.*")
    theirs = pages(spark, sf, "domain", "content_hash").where("domain is not null and content_hash is not null")
    return G.differences(mine, theirs, "domain", "id", "content_hash")


@query(f"WITH {EV}, t AS (SELECT max(ts) AS top FROM ev) SELECT query, count(*) AS n FROM ev, t WHERE ts > top - INTERVAL 24 HOUR GROUP BY 1")
def recent_volume(spark, sf):
    """How often each query was met in the last 24 hours of the table."""
    e = B.events(table(spark, sf, "search_clicks"))
    x = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("top")))).where("ts > top - interval 24 hours")  # one row
    return x.groupBy("query").agg(F.count("*").alias("n"))


@query(f"WITH t AS ({ORACLE_SQL['trending_queries']}) SELECT name, current, velocity FROM t WHERE velocity > 2")
def query_spikes(spark, sf):
    from fathomline.catalog.analytics import trending_queries

    return trending_queries(spark, sf).where("velocity > 2").select("name", "current", "velocity")


_POP = f"pop AS (SELECT query, count(*) AS n FROM ev WHERE action_kind = 'click' GROUP BY 1 ORDER BY n DESC, query LIMIT 200), tr AS (SELECT name, velocity FROM ({ORACLE_SQL['trending_queries']}) ORDER BY velocity DESC, name LIMIT 50)"


@query(f"WITH {EV}, {_POP}, u AS (SELECT query, 0 AS source, -n::DOUBLE AS ord FROM pop UNION ALL SELECT name, 1, -velocity FROM tr), g AS (SELECT query, min(row(source, ord)) AS k FROM u WHERE starts_with(query, 'p') GROUP BY 1) SELECT query FROM g ORDER BY k, query LIMIT 10")
def autocomplete(spark, sf):
    """Popular queries that begin with p, then trending ones."""
    from fathomline.catalog.analytics import trending_queries

    e = B.events(table(spark, sf, "search_clicks")).where("action_kind = 'click'")
    return assist.autocomplete(e.groupBy("query").agg(F.count("*").alias("n")), trending_queries(spark, sf), "p", 10)


@query(f"WITH {PAGES} SELECT id, CASE WHEN regexp_matches(lower(domain), '\\.(uk|ac|eu|su)$') THEN CASE regexp_extract(lower(domain), '\\.([a-z]{{2}})$', 1) WHEN 'uk' THEN 'GB' WHEN 'ac' THEN 'SH' ELSE '' END WHEN regexp_matches(lower(domain), '\\.[a-z]{{2}}$') THEN upper(regexp_extract(lower(domain), '\\.([a-z]{{2}})$', 1)) ELSE coalesce(map_extract_value(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in text.COUNTRY_OF_LANGUAGE.items())}}}, language), '') END AS country FROM p")
def page_countries(spark, sf):
    return pages(spark, sf, "domain", "language").select("id", text.country(F.col("domain"), F.col("language")).alias("country"))


@query(f"WITH {PAGES} SELECT id, round(exp(-0.6931471805599453 / 90 * (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(crawled_at))) / 86400), 6) AS decay FROM p WHERE crawled_at IS NOT NULL")
def page_decay(spark, sf):
    days = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("crawled_at").cast("timestamp"))) / 86400
    return pages(spark, sf, "crawled_at").where("crawled_at is not null").select("id", F.round(text.decay(days, 90.0), 6).alias("decay"))


_CUT = "CASE WHEN length({0}) <= {1} THEN {0} WHEN contains(substr({0}, {1} - 18, 20), ' ') THEN substr({0}, 1, {1} - 19 + length(regexp_extract(substr({0}, {1} - 18, 20), '^(.*) [^ ]*$', 1))) || '...' ELSE substr({0}, 1, {1}) || '...' END"


@query(f"WITH {PAGES}, t AS (SELECT id, coalesce(description, '') AS d FROM p) SELECT id, {_CUT.format('d', 60)} AS short, array_to_string(list_filter(string_split_regex(lower(d), '[^\\p{{L}}]+'), lambda x: strlen(x) >= 3), ' ') AS surface, CAST(len(list_distinct(list_filter(list_transform(string_split_regex(lower(d), '\\s+'), lambda x: regexp_replace(x, '^[.,!?;:\"''()\\[\\]{{}}]+|[.,!?;:\"''()\\[\\]{{}}]+$', '', 'g')), lambda x: strlen(x) >= 2))) AS BIGINT) AS features FROM t")
def text_pieces(spark, sf):
    """Truncated descriptions, their surface words and the number of their feature words."""
    d = F.coalesce("description", F.lit(""))
    return pages(spark, sf, "description").select("id", text.truncated(d, 60).alias("short"), F.array_join(text.surface_words(d), " ").alias("surface"), F.size(text.feature_words(d)).cast("long").alias("features"))


@query(f"WITH {PAGES} SELECT id, CASE WHEN coalesce(description, '') <> '' THEN {_CUT.format('description', 280)} ELSE {_CUT.format('content', 280)} END AS description FROM p WHERE coalesce(description, content) IS NOT NULL")
def result_descriptions(spark, sf):
    """What a result shows without a snippet: the description, else the text, to 280 characters."""
    d = F.when(F.coalesce("description", F.lit("")) != "", text.truncated(F.col("description"), 280)).otherwise(text.truncated(F.col("content"), 280))
    return pages(spark, sf, "description", "content").where("coalesce(description, content) is not null").select("id", d.alias("description"))


@query(f"WITH {PAGES} SELECT id, sha256(coalesce(title, '') || '. ' || coalesce(nullif(description, ''), '')) AS text_hash FROM p")
def embedding_texts(spark, sf):
    """Hash of what is embedded of a page: the title, a stop and the description."""
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("")))
    return pages(spark, sf, "title", "description").select("id", F.sha2(t, 256).alias("text_hash"))


@query("WITH d AS (SELECT DISTINCT domain FROM docs WHERE domain <> '') SELECT domain, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(list_filter(string_split(domain, ''), lambda c: c <> ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295::UBIGINT) % 16 AS INTEGER) AS shard FROM d")
def domain_shards(spark, sf):
    return table(spark, sf, "docs").where("domain <> ''").select("domain").distinct().select("domain", urls.shard(F.col("domain"), 16).alias("shard"))


@query(f"WITH {PAGES}, l AS (SELECT DISTINCT unnest(links).url AS url FROM p), h AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM l WHERE url IS NOT NULL) SELECT url, host <> '' AND host <> 'localhost' AND NOT ends_with(host, '.local') AND NOT regexp_matches(host, '^(127|10|0)\\.\\d+\\.\\d+\\.\\d+$|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2\\d|3[01])\\.') AS safe FROM h")
def safe_links(spark, sf):
    """Which link targets are no local hosts."""
    x = pages(spark, sf, "links").select(F.explode("links.url").alias("url")).where("url is not null").distinct()
    return x.select("url", urls.is_safe(F.col("url")).alias("safe"))


@query(f"WITH {PAGES}, d AS (SELECT domain FROM p WHERE domain <> '' GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 1) SELECT id, NOT (lower(coalesce(domain, '')) = 'amberwick.example' OR starts_with(coalesce(url, ''), 'http://') OR NOT (starts_with(coalesce(url, ''), 'https://'))) AS allowed FROM p")
def allowed_pages(spark, sf):
    """Pages that pass a denied domain, a denied and an allowed prefix."""
    ok = urls.is_allowed(F.col("url"), F.col("domain"), ["amberwick.example"], ["http://"], (), ["https://"])
    return pages(spark, sf, "url", "domain").select("id", ok.alias("allowed"))


@query(f"WITH {PAGES}, o AS (SELECT origin_peer_id AS peer, count(*) AS n FROM p WHERE origin_peer_id <> '' GROUP BY 1 ORDER BY n DESC, peer LIMIT 1) SELECT id, indexed_at FROM p, o WHERE origin_peer_id = peer ORDER BY indexed_at DESC NULLS LAST, id LIMIT 20")
def recent_of_peer(spark, sf):
    """The twenty pages last indexed of the peer with most pages."""
    d = pages(spark, sf, "origin_peer_id", "indexed_at").where("origin_peer_id <> ''")
    top = d.groupBy("origin_peer_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origin_peer_id").limit(1).select("origin_peer_id")
    return d.join(F.broadcast(top), "origin_peer_id", "left_semi").select("id", "indexed_at").orderBy(F.desc_nulls_last("indexed_at"), "id").limit(20)


@query(f"WITH {PAGES} SELECT id, content_hash FROM p WHERE domain = 'amberwick.example'")
def domain_ids(spark, sf):
    """Ids and hashes of one domain's pages; the filter reaches the scan."""
    return pages(spark, sf, "domain", "content_hash").where("domain = 'amberwick.example'").select("id", "content_hash")


@query(f"WITH {PAGES} SELECT id, url FROM p WHERE id = (SELECT min(id) FROM p)")
def page_lookup(spark, sf):
    """One page by its id."""
    d = pages(spark, sf, "url")
    return d.where(F.col("id") == d.agg(F.min("id")).first()[0])


@query(f"WITH {PAGES} SELECT id, url FROM p WHERE starts_with(id, 'a')")
def prefix_scan(spark, sf):
    return pages(spark, sf, "url").where(F.startswith("id", F.lit("a")))


@query("SELECT peer_id, round(0.85 + 0.30 * coalesce(max(trust_score), 0.5), 6) AS linear, CASE WHEN bool_or(coalesce(quarantined, false)) THEN 0.0 ELSE 1.0 END AS tier FROM peers GROUP BY 1")
def peer_multipliers(spark, sf):
    """What a result's peer multiplies its score by: linear in trust, and 0 in quarantine."""
    g = table(spark, sf, "peers").groupBy("peer_id").agg(F.coalesce(F.max("trust_score"), F.lit(0.5)).alias("t"), F.bool_or(F.coalesce("quarantined", F.lit(False))).alias("q"))
    return g.select("peer_id", F.round(0.85 + 0.30 * F.col("t"), 6).alias("linear"), S.tier_multiplier(F.when(F.col("q"), F.lit("quarantined")).otherwise(F.lit("trusted"))).alias("tier"))


@query(f"WITH {PAGES}, b AS (SELECT DISTINCT peer_id FROM peers WHERE quarantined) SELECT id, b.peer_id IS NOT NULL AS quarantined FROM p LEFT JOIN b ON origin_peer_id = b.peer_id")
def flagged_results(spark, sf):
    """Pages with the flag of their peer's quarantine."""
    bad = table(spark, sf, "peers").where("quarantined").select(F.col("peer_id").alias("origin_peer_id"), F.lit(True).alias("q")).distinct()
    return pages(spark, sf, "origin_peer_id").join(bad, "origin_peer_id", "left").select("id", F.coalesce("q", F.lit(False)).alias("quarantined"))


@query(f"WITH {PAGES} SELECT id FROM p WHERE crawled_at IS NULL OR crawled_at < TIMESTAMP '{AS_OF}' - INTERVAL 120 DAY")
def stale_pages(spark, sf):
    """Pages not fetched for 120 days, or never."""
    return pages(spark, sf, "crawled_at").where(f"crawled_at is null or crawled_at < timestamp_ntz'{AS_OF}' - interval 120 days").select("id")


@query(f"WITH {_PLACED}, me AS (SELECT min(node) AS me FROM n), t AS (SELECT DISTINCT domain FROM d) SELECT t.domain, CASE WHEN bool_or(k.node = me.me) THEN 'local' ELSE 'forward' END AS route FROM t JOIN k USING (domain), me GROUP BY 1")
def crawl_routes(spark, sf):
    """Domains that the peer of least name crawls itself, and those it hands on."""
    from fathomline.sources.crawl import routed

    d = table(spark, sf, "docs").where("domain is not null").select("domain").distinct()
    me = _peers(spark, sf).agg(F.min("node").alias("me"))  # one row
    return routed(G.replica_owners(d, "domain", _peers(spark, sf)).crossJoin(F.broadcast(me)), F.col("me")).select("domain", "route")


@query("""WITH d AS (SELECT domain, crawled_at, row_number() OVER (PARTITION BY domain ORDER BY crawled_at, id, indexed_at, quality_score) AS n FROM docs WHERE domain <> '' AND crawled_at IS NOT NULL), g AS (SELECT a.domain, epoch_us(a.crawled_at) - epoch_us(b.crawled_at) AS us FROM d a JOIN d b ON a.domain = b.domain AND a.n = b.n + 1)
 SELECT domain, count(*) AS gaps, round(min(us) / 1e6, 3) AS least_s, count(*) FILTER (us < 500000) AS too_near FROM g GROUP BY 1""")
def politeness_gaps(spark, sf):
    """Gaps between the fetches of a domain, and how many are under half a second."""
    d = table(spark, sf, "docs").where("domain <> '' and crawled_at is not null").select("domain", "crawled_at", "id", "indexed_at", "quality_score")
    from fathomline.sources.crawl import gaps

    return gaps(numbered(d, ["domain"], ["crawled_at", "id", "indexed_at", "quality_score"]), "domain", "crawled_at", 500_000)


@query(f"WITH {PAGES} SELECT id, crawled_at, CAST(count(*) OVER () - row_number() OVER (ORDER BY crawled_at DESC NULLS LAST, id) + 1 AS BIGINT) AS seq FROM p ORDER BY crawled_at DESC NULLS LAST, id LIMIT 50")
def live_feed(spark, sf):
    """The fifty pages last fetched, newest first, numbered from the oldest page on."""
    d = pages(spark, sf, "crawled_at")
    top = d.orderBy(F.desc_nulls_last("crawled_at"), "id").limit(50)
    from pyspark.sql import Window

    n = d.agg(F.count("*").alias("n"))  # one row; the window runs over fifty
    x = top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc_nulls_last("crawled_at"), "id"))).crossJoin(F.broadcast(n))
    return x.select("id", "crawled_at", (F.col("n") - F.col("rn") + 1).alias("seq"))


@query(f"WITH {PAGES}, l AS (SELECT id, list_slice(list_filter(list_transform(links, lambda x: x.url), lambda x: x IS NOT NULL AND strlen(x) <= 2048), 1, 100) AS us FROM p WHERE links IS NOT NULL) SELECT id, CAST(len(us) AS INTEGER) AS admitted, CAST(list_sum(list_transform(us, lambda x: strlen(x))) AS BIGINT) AS bytes FROM l WHERE len(us) > 0")
def gossip_batches(spark, sf):
    """The URLs that a page's announcement may carry: at most 2,048 bytes each and 100 in all."""
    from fathomline.sources.crawl import announced

    x = pages(spark, sf, "links").select("id", announced(F.col("links.url")).alias("us")).where(F.size("us") > 0)
    return x.select("id", F.size("us").alias("admitted"), F.aggregate("us", F.lit(0).cast("long"), lambda s, u: s + F.octet_length(u)).alias("bytes"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reported_at, reason, detail NULLS FIRST) AS a, row_number() OVER (PARTITION BY id ORDER BY reported_at DESC, reason DESC, detail DESC NULLS LAST) AS z FROM spam_reports) SELECT id, reason, reported_at FROM f WHERE z = 1")
def upserted_reports(spark, sf):
    """First reports, then the latest of each id written over them."""
    r = table(spark, sf, "spam_reports").select("id", "reason", "detail", "reported_at")
    at = F.struct("reported_at", "reason", "detail")
    first, last = (r.groupBy("id").agg(f(at).alias("x")).select("id", "x.*") for f in (F.min, F.max))
    return upsert(first, last, "id").select("id", "reason", "reported_at")


@query("WITH gone AS (SELECT DISTINCT label FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (SELECT label FROM gone) GROUP BY 1")
def kept_vectors(spark, sf):
    """Vectors left of each label when those that share the first one's label are deleted."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    first = e.orderBy("vec_id").limit(1).select("label")
    return delete(e, first, "label").groupBy("label").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reported_at, reason, detail NULLS FIRST) AS rn FROM spam_reports) SELECT coalesce(lower(trim(domain)), '') AS domain, count(*) AS total, count(*) FILTER (coalesce(status, 'pending') = 'pending') AS pending, max(reported_at) AS last FROM r WHERE rn = 1 GROUP BY 1")
def report_totals(spark, sf):
    """Reports of each domain: all, pending, the last."""
    r = table(spark, sf, "spam_reports").groupBy("id").agg(F.min(F.struct("reported_at", "reason", "detail", "domain", "status")).alias("x")).select("x.*")
    pending = F.coalesce("status", F.lit("pending")) == "pending"
    return r.groupBy(F.coalesce(F.lower(F.trim("domain")), F.lit("")).alias("domain")).agg(F.count("*").alias("total"), F.sum(pending.cast("long")).alias("pending"), F.max("reported_at").alias("last"))


@query(f"WITH {PAGES}, {_bm25_sql('content', 1, 'r')}, t AS (SELECT id, round(score, 6) AS score, coalesce(description, '') AS d, url, quality_score AS q, eeat_score AS e FROM r JOIN p USING (id) ORDER BY 2 DESC, id LIMIT 1) SELECT d AS answer, url AS source FROM t WHERE (q >= 0.4 OR e >= 0.3) AND strlen(d) >= 40")
def featured_snippets(spark, sf):
    """The answer of the best page to a sure informational query, if it is good and long enough."""
    r = page_index(spark, sf).search(TERMS).select("id", F.round("score", 6).alias("score"))
    d = pages(spark, sf, "url", "description", "quality_score", "eeat_score").withColumn("description", F.coalesce("description", F.lit("")))
    top = r.orderBy(F.desc("score"), "id").limit(1)
    return assist.featured(d.join(F.broadcast(top), "id"), "informational", 0.85)


@query(f"WITH {CT} SELECT query, count(*) AS urls, CAST(sum(clicks) AS BIGINT) AS clicks, max(clicks) AS most FROM ct GROUP BY 1 HAVING sum(clicks) > 0")
def clicks_by_query(spark, sf):
    c = B.counters(B.events(table(spark, sf, "search_clicks")))
    return c.groupBy("query").agg(F.count("*").alias("urls"), F.sum("clicks").alias("clicks"), F.max("clicks").alias("most")).where("clicks > 0")


@query()
def instant_answers(spark, sf):
    """Queries that are answered by themselves (percentages, arithmetic, units, dates)."""
    q = table(spark, sf, "search_clicks").where("query is not null").select("query").distinct()
    return q.select("query", instant.answers(F.col("query"), datetime(2024, 6, 1, 12)).alias("answer"))


def _list_sql(field: str, group: int, kind: str, chance: float, expr: str) -> str:
    return f"SELECT id, {group} AS g, unnest(range(len(ns))) AS i, '{kind}' AS type, unnest(ns) AS name, {chance} AS confidence FROM (SELECT id, {expr.format(field)} AS ns FROM t)"


def _ordered(expr: str, most: int) -> str:
    """Distinct items in order of their first place."""
    return f"list_slice(list_filter(({expr}), lambda x, i: list_position(({expr}), x) = i), 1, {most})"


def _entities_sql() -> str:
    person = _ordered(r"list_filter(regexp_extract_all({0}, '\b([A-Z][a-z]{{1,20}}\s+[A-Z][a-z]{{1,20}})\b', 1), lambda x: NOT regexp_matches(x, '^(The|This|That) '))", 20)

    def suffixed(ws, reach):
        each = ", ".join(rf"list_slice(regexp_extract_all({{0}}, '\b([A-Z][A-Za-z\s]{{{{1,{reach}}}}}{w})\b', 1), 1, 5)" for w in ws)
        return f"list_sort(list_distinct(list_transform(flatten([{each}]), lambda x: trim(x))))"

    topic = ", ".join(f"{{{{'n': -{hits('lower({0})', ws)}, 'name': '{name}'}}}}" for name, ws in X.TOPICS.items())
    topics = f"list_transform(list_slice(list_sort(list_filter([{topic}], lambda x: x.n < 0)), 1, 3), lambda x: x.name)"
    parts = []
    for n, (field, chances) in enumerate((("title", entities.IN_TITLE), ("content", entities.IN_TEXT))):
        for i, e in enumerate((person, suffixed(X.ORGANISATIONS, 40), suffixed(X.PLACES, 30), topics)):
            parts.append(_list_sql(field, 4 * n + i, entities.TYPES[i], chances[i], e))
    tech = r"list_filter(list_slice(regexp_extract_all({0}, '\b([A-Z][a-zA-Z]+(?:\.js|\.go|\.py|\.rs)?)\b', 1), 1, 20), lambda x: strlen(x) BETWEEN 3 AND 30)"
    parts.append(_list_sql("title || ' ' || content", 8, "technology", 0.4, tech))
    return f"t AS (SELECT id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM p), u AS ({' UNION ALL '.join(parts)}), f AS (SELECT id, type, name, min({{'g': g, 'i': i, 'c': confidence}}) AS fst FROM u WHERE strlen(name) >= 2 GROUP BY 1, 2, 3), ent AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY fst.g, fst.i, name) AS INTEGER) AS place, type, name, fst.c::DOUBLE AS confidence FROM f QUALIFY place <= 50)"


_ENT = f"WITH {PAGES}, {_entities_sql()}"
_KNOWN = "kd AS (SELECT type, lower(name) AS key, id, min(name) AS name FROM ent GROUP BY 1, 2, 3), known AS (SELECT type, key, min(name) AS name, least(count(*), 100) AS documents FROM kd GROUP BY 1, 2)"
_PAIRS = "few AS (SELECT id, place, lower(name) AS name FROM ent WHERE place <= 20), pr AS (SELECT least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, count(*) AS n FROM few x JOIN few y ON x.id = y.id AND x.place < y.place GROUP BY 1, 2)"


def _typed(spark, sf):
    return entities.typed(pages(spark, sf, "title", "content"))


@query(f"{_ENT} SELECT * FROM ent")
def page_entities(spark, sf):
    """Typed entities of each page with their chances, at most fifty."""
    return _typed(spark, sf)


@query(f"{_ENT}, {_KNOWN} SELECT * FROM known")
def entity_documents(spark, sf):
    return entities.documents_of(_typed(spark, sf))


@query(f"{_ENT}, {_PAIRS} SELECT * FROM pr")
def entity_pairs(spark, sf):
    return entities.companions(_typed(spark, sf))


@query(f"{_ENT}, {_KNOWN} SELECT type, key, name, documents FROM known WHERE contains(key, 'ridge') ORDER BY type, key LIMIT 20")
def entity_search(spark, sf):
    return entities.matching(entities.documents_of(_typed(spark, sf)), " Ridge", 20)


@query(f"""{_ENT}, {_KNOWN}, {_PAIRS}, one AS (SELECT * FROM known WHERE contains(key, 'the') ORDER BY (key = 'the') DESC, CASE WHEN key = 'the' THEN list_position({words(entities.TYPES)}, type) END, type, key LIMIT 1),
 nr AS (SELECT CASE WHEN a = 'the' THEN b ELSE a END AS other, n FROM pr WHERE (a = 'the' OR b = 'the') AND a <> b), n5 AS (SELECT other, n FROM nr WHERE other IN (SELECT key FROM known) ORDER BY n DESC, other LIMIT 5)
 SELECT name, type, documents, coalesce((SELECT string_agg(other, '|' ORDER BY n DESC, other) FROM n5), '') AS related FROM one WHERE documents >= 2""")
def entity_card(spark, sf):
    """The card of a name, and the five names it meets most."""
    e = _typed(spark, sf).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else _typed(spark, sf)
    return entities.card(entities.documents_of(e), entities.companions(e), '"the" lang:en -x')


def _signals(spark, sf):
    """All signals of each page, as columns."""
    from fathomline.catalog.documents import document_scores, readability, text_scores

    x = document_scores(spark, sf).join(text_scores(spark, sf), "id").join(readability(spark, sf).select("id", "readability"), "id").join(link_write_back(spark, sf), "id")
    return x.join(pages(spark, sf, "domain"), "id").join(domain_authority(spark, sf).select("domain", F.col("score").alias("authority")), "domain", "left")


#: Document-side features of learned ranking, in order; the lexical score comes first and is 0 without a query.
FEATURES = ("eeat", "quality", "pagerank", "authority", "url_q", "readability", "citation", "link", "seo", "credibility", "relevance", "freshness", "spam")


@query()
def learned_scores(spark, sf):
    """Pages by stumps trained on a bounded sample of all click preferences, kept only if they order held-out pairs; 0 otherwise."""
    from fathomline.operators import ltr

    x = _signals(spark, sf).select("id", F.array(F.lit(0.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]).alias("features")).checkpoint()
    by_url = pages(spark, sf, "url").where("url is not null").join(x, "id").groupBy("url").agg(F.min(F.struct("id", "features")).alias("r")).select("url", "r.features")
    clicks = B.counters(B.events(table(spark, sf, "search_clicks"))).select("query", "url", "clicks")
    model, _ = ltr.promoted(ltr.preference_sample(clicks, by_url))
    return x.select("id", F.round(ltr.predict(model, F.col("features")), 6).alias("score"))


@query(f"""WITH a AS ({ORACLE_SQL['document_scores']}), t AS ({ORACLE_SQL['text_scores']}), r AS ({ORACLE_SQL['readability']}), w AS ({ORACLE_SQL['link_write_back']}), {PAGES}, d AS ({ORACLE_SQL['domain_authority']}),
 x AS (SELECT a.*, t.citation, t.credibility, r.readability, w.pagerank, coalesce(d.score, 0) AS authority FROM a JOIN t USING (id) JOIN r USING (id) JOIN w USING (id) JOIN p USING (id) LEFT JOIN d ON d.domain = p.domain)
 SELECT id, round((0.5 + 2 * (0.15 * eeat + 0.10 * quality + 0.15 * pagerank + 0.10 * authority + 0.05 * url_q + 0.08 * readability + 0.08 * citation + 0.05 * link + 0.05 * seo + 0.05 * credibility + 0.06 * relevance)) * (1 - 0.8 * spam), 5) AS static,
 round((0.5 + 2 * (0.20 * eeat + 0.20 * quality + 0.20 * pagerank + 0.08 * readability + 0.08 * citation + 0.05 * link + 0.08 * seo + 0.05 * credibility + 0.06 * relevance)) * (1 - 0.8 * spam), 5) AS rescored FROM x""")
def full_scores(spark, sf):
    """Static and later scores from all of their eleven and nine signals."""
    from fathomline.functions import scoring

    c = F.col
    x = _signals(spark, sf)
    given = dict(eeat=c("eeat"), quality=c("quality"), pagerank=c("pagerank"), readability=c("readability"), citation=c("citation"), link=c("link"), seo=c("seo"), author=c("credibility"), relevance=c("relevance"))
    static = scoring.weighted(scoring.STATIC, c("spam"), authority=F.coalesce("authority", F.lit(0.0)), url=c("url_q"), **given)
    return x.select("id", F.round(static, 5).alias("static"), F.round(scoring.weighted(scoring.RESCORE, c("spam"), **given), 5).alias("rescored"))


@query(f"WITH {PAGES}, w AS (SELECT id, list_concat({TOK.format("coalesce(title, '')")}, {TOK.format("coalesce(description, '')")}, {TOK.format("coalesce(content, '')")}) AS w FROM p) SELECT id FROM w WHERE list_contains(w, '{TERMS[0]}') AND list_contains(w, '{TERMS[1]}')")
def terms_across_fields(spark, sf):
    """Pages that hold each of two terms in some field, from the written index."""
    return held(page_index(spark, sf), TERMS)


@query(f"WITH {PAGES}, t AS (SELECT DISTINCT unnest({TOK.format('content')}) AS term, id FROM p WHERE content IS NOT NULL) SELECT term, count(*) AS df FROM t WHERE term IN ('{TERMS[0]}', '{TERMS[1]}', 'the') GROUP BY 1")
def index_statistics(spark, sf):
    """Document frequencies read from the written index."""
    return page_index(spark, sf).postings([*TERMS, "the"]).where("field = 'content'").groupBy("term").agg(F.count("*").alias("df"))


def _markup(spark, sf):
    """(id, url, html) of pages as markup, made of the columns of docs: no table of raw pages is given."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    t, d, c = (safe(F.col(x)) for x in ("title", "description", "content"))
    d = F.replace(d, F.lit('"'), F.lit("&quot;"))
    head = F.concat(F.lit("<html lang='en'><head><title>"), t, F.lit('</title><meta name="description" content="'), d, F.lit("\"><meta name='viewport' content='width=device-width'><script src=a.js async></script><style>@media x{}</style></head>"))
    links = F.array_join(F.transform(F.coalesce("links", F.array()), lambda x: F.concat(F.lit("<a href='"), x["url"], F.lit("'>x</a>"))), "")
    body = F.concat(F.lit("<body><nav>menu entries</nav><article><h2>"), t, F.lit("</h2><p>"), c, F.lit("</p></article><footer>"), links, F.lit("</footer></body></html>"))
    return pages(spark, sf, "url", "title", "description", "content", "links").where("content is not null and url is not null").select("id", "url", F.concat(head, body).alias("html"))


_WS = "trim(regexp_replace({0}, '[ ' || chr(9) || chr(10) || chr(13) || ']+', ' ', 'g'), ' ')"


@query(f"""WITH {PAGES}, t AS (SELECT id, {_WS.format("coalesce(title, '')")} AS title, coalesce(description, '') AS description, {_WS.format("content")} AS body FROM p WHERE content IS NOT NULL AND url IS NOT NULL)
 SELECT id, title, description, title AS heading, length(trim(title || ' ' || body, ' ')) AS chars, 1 AS scripts, round(0.75::DOUBLE, 6) AS performance, round(0.8::DOUBLE, 6) AS mobile FROM t""")
def extracted_pages(spark, sf):
    """Pages through the HTML parser: title, description, main text, headings and scores."""
    from fathomline.functions import scoring
    from fathomline.sources.html import pages_from_html

    x = pages_from_html(_markup(spark, sf), "id").withColumnRenamed("scripts", "n_scripts")
    c = F.col
    perf = scoring.performance(F.lit(None), F.lit(100_000), c("resources"), c("lazy"), c("deferred"), c("n_scripts"))
    mob = scoring.mobile(c("viewport"), c("media_queries"), c("flexible"), c("touch_icons"), c("small_fonts"), c("small_targets"))
    return x.select("id", "title", "description", c("heading_text").alias("heading"), F.length("content").cast("long").alias("chars"), c("n_scripts").alias("scripts"), F.round(perf, 6).alias("performance"), F.round(mob, 6).alias("mobile"))


@query(f"WITH {PAGES}, l AS (SELECT id, unnest(links).url AS to_url FROM p WHERE content IS NOT NULL AND url IS NOT NULL) SELECT id, count(DISTINCT rtrim(string_split(to_url, '#')[1], '/')) AS links FROM l WHERE to_url LIKE 'http%' GROUP BY 1")
def extracted_links(spark, sf):
    """Distinct targets of each page's links through the HTML parser."""
    from fathomline.sources.html import pages_from_html

    return pages_from_html(_markup(spark, sf), "id").select("id", F.size("links").cast("long").alias("links")).where("links > 0")


_INFORMATIONAL = "(1.0 + CASE WHEN r.readability > 0.6 THEN 0.2 ELSE 0 END + CASE WHEN a.quality > 0.6 THEN 0.15 ELSE 0 END + CASE WHEN a.eeat > 0.5 THEN 0.15 ELSE 0 END)"


@query(f"""WITH b AS ({ORACLE_SQL['search_any_term']}), a AS ({ORACLE_SQL['document_scores']}), r AS ({ORACLE_SQL['readability']}), st AS ({ORACLE_SQL['full_scores']}), fs AS ({ORACLE_SQL['final_scores']}), pm AS ({ORACLE_SQL['peer_multipliers']}), {PAGES},
 x AS (SELECT p.id, p.url, round(greatest(0, b.score * (st.static * 0.92 + fs.fresh * 0.16) * {_INFORMATIONAL} * coalesce(pm.linear, 1.0) * coalesce(pm.tier, 1.0))::DOUBLE, 4) AS score
  FROM b JOIN p USING (id) JOIN a USING (id) JOIN r USING (id) JOIN st USING (id) JOIN fs USING (id) LEFT JOIN pm ON pm.peer_id = p.origin_peer_id)
 SELECT id, score FROM x ORDER BY score DESC, url, id LIMIT 20""")
def ranked_search(spark, sf):
    """The first twenty of an informational query: lexical relevance by static quality and freshness, intent and peer; ties by URL."""
    from fathomline.catalog.analytics import final_scores
    from fathomline.catalog.documents import document_scores, readability

    r = page_index(spark, sf).search(TERMS).select("id", F.round("score", 6).alias("bm25"))
    x = r.join(pages(spark, sf, "url", "origin_peer_id"), "id").join(document_scores(spark, sf).select("id", "quality", "eeat"), "id").join(readability(spark, sf).select("id", "readability"), "id")
    x = x.join(full_scores(spark, sf).select("id", "static"), "id").join(final_scores(spark, sf).select("id", "fresh"), "id").join(peer_multipliers(spark, sf).withColumnRenamed("peer_id", "origin_peer_id"), "origin_peer_id", "left")
    peer = F.coalesce("linear", F.lit(1.0)) * F.coalesce("tier", F.lit(1.0))
    score = S.final_score(F.col("bm25"), F.col("static"), F.col("fresh"), S.intent_multiplier("informational"), peer)
    return x.select("id", "url", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "url", "id").limit(20).select("id", "score")


_HASHED = ORACLE_SQL["hashed_embeddings"].split(" SELECT p.id, 384 AS dim", 1)[0]
_QUERY_VECTOR = f"qv AS (SELECT (h % 384)::INT AS k, sum(CASE WHEN (h // 4294967296) % 2 = 1 THEN -1 ELSE 1 END) AS v FROM h WHERE term IN ({', '.join(repr(t) for t in TERMS)}) GROUP BY 1)"


@query(f"""{_HASHED}, {_QUERY_VECTOR}, sim AS (SELECT k.id, round(sum(k.v * qv.v) / (any_value(g.len) * sqrt((SELECT sum(v * v) FROM qv))), 4) AS s FROM k JOIN qv USING (k) JOIN g ON g.id = k.id GROUP BY 1 HAVING s > 0), ve AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM sim QUALIFY r <= 100),
 lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({ORACLE_SQL['search_any_term']}) QUALIFY r <= 100)
 SELECT coalesce(lx.id, ve.id) AS id, round(coalesce(0.7 / (60 + lx.r), 0) + coalesce(0.3 / (60 + ve.r), 0), 8) AS score FROM lx FULL JOIN ve ON lx.id = ve.id""")
def hybrid_search(spark, sf):
    """Lexical and vector hits fused by reciprocal rank, a hundred of each."""
    from fathomline.operators.vectors import cosine, embed

    top = lambda x: x.orderBy(F.desc("score"), "id").limit(100)
    lexical = top(page_index(spark, sf).search(TERMS).select("id", F.round("score", 6).alias("score")))
    q = embed(spark.createDataFrame([("q", " ".join(TERMS))], "id string, content string"), "id", "content").select(F.col("embedding").alias("q"))
    near = embed(pages(spark, sf, "content"), "id", "content").crossJoin(F.broadcast(q))  # one query vector
    near = top(near.select("id", F.round(cosine(F.col("embedding"), F.col("q")), 4).alias("score")).where("score > 0"))
    return S.reciprocal_rank_fusion(lexical, near, "id").select("id", F.round("score", 8).alias("score"))
