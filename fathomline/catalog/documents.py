"""Queries on URLs, identities, texts and document scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline import lexicons as X
from fathomline.catalog import PAGES, hits, query, words
from fathomline.functions import scoring, text, urls
from fathomline.io import pages

ABS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
U = f"u AS (SELECT id, url, lower(regexp_extract(url, '{ABS}', 1)) AS scheme, regexp_extract(url, '{ABS}', 2) AS auth, regexp_extract(url, '{ABS}', 3) AS path, regexp_extract(url, '{ABS}', 4) AS q FROM p)"
U2 = U + r""", v AS (SELECT *, regexp_replace(regexp_replace(auth, ':\d+$', ''), '^www\.', '') AS host,
 list_filter(string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/'), lambda x: x <> '') AS segs,
 list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: {'k': regexp_extract(x, '^([^=]*)', 1), 'v': regexp_extract(x, '^[^=]*=(.*)$', 1)}) AS params FROM u)"""
TOK = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
STOPS = words(X.STOP_WORDS)


@query(f"""WITH {PAGES}, {U2} SELECT id, scheme, CASE WHEN auth <> '' THEN auth ELSE 'unknown' END AS domain, host AS click_domain,
 regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.\\-]*://', ''), '[/?#].*$', ''), ':\\d+$', '') AS report_domain,
 regexp_extract(lower(host), '([^.]+\\.[^.]+)$', 1) AS registrable FROM v""")
def url_domains(spark, sf):
    u = F.col("url")
    return pages(spark, sf, "url").select("id", urls.scheme(u).alias("scheme"), urls.domain(u).alias("domain"), urls.click_domain(u).alias("click_domain"), urls.report_domain(u).alias("report_domain"), urls.registrable(u).alias("registrable"))


@query(f"""WITH {PAGES}, {U2}, n AS (SELECT id, url, scheme,
 CASE scheme WHEN 'http' THEN regexp_replace(lower(auth), ':80$', '') WHEN 'https' THEN regexp_replace(lower(auth), ':443$', '') ELSE lower(auth) END AS host2,
 array_to_string(list_transform(list_sort(list_filter(params, lambda x: NOT list_contains({words(X.STRIPPED_PARAMS)}, lower(x.k)) AND NOT starts_with(lower(x.k), 'utm_'))), lambda x: x.k || '=' || x.v), '&') AS qs,
 CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS pp FROM v)
 SELECT id, CASE WHEN scheme = '' THEN url ELSE scheme || '://' || host2 || CASE WHEN pp = '' THEN '/' ELSE pp END || CASE WHEN coalesce(qs, '') <> '' THEN '?' || qs ELSE '' END END AS url_norm FROM n""")
def url_normalize(spark, sf):
    return pages(spark, sf, "url").select("id", urls.normalize(F.col("url")).alias("url_norm"))


SLUG = r"list_filter(list_transform(segs, lambda x: regexp_replace(lower(x), '\.[^.]*$', '')), lambda x: x <> '')"


@query(f"""WITH {PAGES}, {U2}, s AS (SELECT *, {SLUG} AS stems FROM v),
 r AS (SELECT *, len(segs) = 0 OR (len(list_filter(stems, lambda x: length(regexp_replace(x, '[^\\p{{L}}_\\-]', '', 'g')) / strlen(x) > 0.7)) > 0 AND len(list_filter(stems, lambda x: regexp_matches(x, '{urls.RANDOM}'))) = 0) AS readable FROM s)
 SELECT id, CAST(len(segs) AS BIGINT) AS depth, readable, round(greatest(0.0, 1.0 - (CASE WHEN len(segs) <= 2 THEN 0.0 WHEN len(segs) = 3 THEN 0.1 WHEN len(segs) = 4 THEN 0.2 ELSE 0.4 END
 + CASE WHEN len(params) > 0 THEN 0.15 ELSE 0 END + CASE WHEN len(list_filter(params, lambda x: list_contains({words(X.TRACKING_PARAMS)}, lower(x.k)))) > 0 THEN 0.1 ELSE 0 END
 + CASE WHEN NOT readable THEN 0.2 ELSE 0 END + CASE WHEN strlen(regexp_replace(path, '^/+|/+$', '', 'g')) > 100 THEN 0.15 ELSE 0 END))::DOUBLE, 6) AS url_score FROM r""")
def url_quality(spark, sf):
    u = F.col("url")
    return pages(spark, sf, "url").select("id", F.size(urls.segments(u)).cast("long").alias("depth"), urls.readable_slug(u).alias("readable"), F.round(urls.url_score(u), 6).alias("url_score"))


@query(f"""WITH {PAGES}, {U2} SELECT id, array_to_string(list_filter(list_transform(string_split_regex(path, '[/\\-_.]'), lambda x: lower(regexp_replace(x, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g'))), lambda x: strlen(x) >= 2), ' ') AS url_text,
 regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), '[-_]', ' ', 'g') AS url_title,
 scheme IN ('http', 'https') AND NOT regexp_matches(lower(path), '({"|".join(x.replace(".", chr(92) + ".") for x in X.SKIP_SUFFIXES)})$') AS crawlable FROM v""")
def url_words(spark, sf):
    u = F.col("url")
    return pages(spark, sf, "url").select("id", urls.url_text(u).alias("url_text"), urls.title_from_url(u).alias("url_title"), urls.should_crawl(u).alias("crawlable"))


@query(f"WITH {PAGES} SELECT id, substr(sha256(url), 1, 32) = id AS id_ok, coalesce(sha256(content) = content_hash, false) AS hash_ok, substr(sha256(origin_peer_id || '|' || url), 1, 32) AS report_id, id || chr(31) || sha256(content) AS replica, substr(sha256(url || '|1|10'), 1, 16) AS cache_key FROM p")
def identities(spark, sf):
    d = pages(spark, sf, "url", "content", "content_hash", "origin_peer_id")
    h = F.sha2("content", 256)
    return d.select("id", (urls.doc_id(F.col("url")) == F.col("id")).alias("id_ok"), F.coalesce(h == F.col("content_hash"), F.lit(False)).alias("hash_ok"), F.substring(F.sha2(F.concat("origin_peer_id", F.lit("|"), "url"), 256), 1, 32).alias("report_id"), F.concat("id", F.char(F.lit(31)), h).alias("replica"), urls.cache_key(F.col("url"), F.lit(1), F.lit(10)).alias("cache_key"))


@query(f"""WITH {PAGES}, t AS (SELECT id, content, {TOK.format('content')} AS w FROM p WHERE content IS NOT NULL)
 SELECT id, CAST(len(w) AS BIGINT) AS words, CASE WHEN len(w) > 0 THEN round(len(list_distinct(list_filter(w, lambda x: strlen(x) > 2 AND NOT list_contains({STOPS}, x)))) / len(w), 6) ELSE 0.0 END AS density,
 CAST(length(regexp_replace(content, '[ \t\n\r]+', ' ', 'g')) AS BIGINT) AS collapsed FROM t""")
def token_statistics(spark, sf):
    c = F.col("content")
    return pages(spark, sf, "content").where("content is not null").select("id", text.word_count(c).alias("words"), F.round(text.semantic_density(c), 6).alias("density"), F.length(text.collapse(c)).cast("long").alias("collapsed"))


@query(f"""WITH {PAGES}, t AS (SELECT id, {TOK.format('content')} AS w FROM p WHERE content IS NOT NULL), e AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t),
 g AS (SELECT id, word, count(*) AS count, min(pos) AS first FROM e WHERE strlen(word) > 2 AND NOT list_contains({STOPS}, word) GROUP BY 1, 2),
 s AS (SELECT id, word, count, round(count / sum(count) OVER (PARTITION BY id) * (1 / (1 + first / 100)) * least(strlen(word) / 10, 1.5), 9) AS score FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS rank FROM s) SELECT id, word, count, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def keywords_top(spark, sf):
    return text.top_keywords(pages(spark, sf, "content").where("content is not null"), "id", "content")


def _ngram_sql(n: int) -> str:
    return f"""WITH {PAGES}, t AS (SELECT id, {TOK.format('content')} AS w FROM p WHERE content IS NOT NULL), e AS (SELECT id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: list_slice(w, i, i + {n - 1}))) AS g FROM t WHERE len(w) >= {n}),
 c AS (SELECT id, array_to_string(g, ' ') AS ngram, count(*) AS count FROM e WHERE NOT list_has_any(g, {STOPS}) GROUP BY 1, 2 HAVING count(*) >= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, ngram) AS rank FROM c) SELECT id, ngram, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


@query(_ngram_sql(2))
def bigrams_top(spark, sf):
    return text.top_ngrams(pages(spark, sf, "content").where("content is not null"), "id", "content", 2)


@query(_ngram_sql(3))
def trigrams_top(spark, sf):
    return text.top_ngrams(pages(spark, sf, "content").where("content is not null"), "id", "content", 3)


def _suffixed_sql(ws, reach: int) -> str:
    each = ", ".join(rf"list_slice(regexp_extract_all(content, '\b([A-Z][A-Za-z\s]{{1,{reach}}}{w})\b', 1), 1, 5)" for w in ws)
    return f"array_to_string(list_sort(list_distinct(list_transform(flatten([{each}]), lambda x: trim(x)))), '|')"


@query(f"""WITH {PAGES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '\\b([A-Z][a-z]{{1,20}}\\s+[A-Z][a-z]{{1,20}})\\b', 1), lambda x: NOT regexp_matches(x, '^(The|This|That) ')))), '|') AS people,
 array_to_string(list_sort(list_distinct(flatten([{", ".join(f"list_slice(regexp_extract_all(content, '{p}'), 1, 10)" for p in X.DATE_PATTERNS)}]))), '|') AS dates,
 {_suffixed_sql(X.PLACES, 30)} AS places, {_suffixed_sql(X.ORGANISATIONS, 40)} AS organisations FROM p WHERE content IS NOT NULL""")
def entities(spark, sf):
    c = F.col("content")
    return pages(spark, sf, "content").where("content is not null").select("id", F.array_join(F.array_sort(text.all_people(c)), "|").alias("people"), F.array_join(text.dates(c), "|").alias("dates"), F.array_join(text.places(c), "|").alias("places"), F.array_join(text.organisations(c), "|").alias("organisations"))


_LANGS = ", ".join(f"{{'n': CASE WHEN {hits('head', m)} >= {least} THEN {hits('head', m)} ELSE 0 END, 'i': {-i}, 'c': '{c}'}}" for i, (c, least, m) in enumerate(X.LANGUAGE_PROFILES))
_TOPIC = ", ".join(f"{{'n': -{hits('low', ws)}, 'name': '{name}'}}" for name, ws in X.TOPICS.items())
_CLASS = ", ".join(f"CASE WHEN {hits('low', ws)} >= 2 THEN '{name}' END" for name, ws in sorted(X.CLASSES.items()))


@query(f"""WITH {PAGES}, b AS (SELECT id, content, lower(substr(content, 1, 2000)) AS head, lower(content) AS low FROM p WHERE content IS NOT NULL), z AS (SELECT *, list_filter([{_CLASS}], lambda x: x IS NOT NULL) AS cl, list_max([{_LANGS}]) AS best FROM b)
 SELECT id, CASE WHEN strlen(content) < 20 OR best.n = 0 THEN 'en' ELSE best.c END AS language, array_to_string(list_transform(list_slice(list_sort(list_filter([{_TOPIC}], lambda x: x.n < 0)), 1, 3), lambda x: x.name), ',') AS topics,
 CASE WHEN len(cl) = 0 THEN 'general' ELSE array_to_string(cl, ',') END AS classes FROM z""")
def text_labels(spark, sf):
    c = F.col("content")
    return pages(spark, sf, "content").where("content is not null").select("id", text.language(c).alias("language"), F.array_join(text.topics(c), ",").alias("topics"), F.array_join(text.classes(c), ",").alias("classes"))


@query(rf"""WITH {PAGES}, w AS (SELECT id, list_filter(list_transform(string_split_regex(content, '\s+'), lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda x: strlen(x) >= 2) AS w,
 len(list_filter(list_transform(string_split_regex(content, '[.!?]+\s+'), lambda x: trim(x)), lambda x: x <> '')) AS ns FROM p WHERE content IS NOT NULL),
 v AS (SELECT *, list_transform(w, lambda x: len(regexp_extract_all(x, '[aeiouy]+'))) AS vg FROM w),
 y AS (SELECT id, ns, w, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN strlen(w[i]) <= 2 THEN 1 ELSE greatest(CASE WHEN ends_with(w[i], 'e') AND vg[i] > 1 THEN vg[i] - 1 ELSE vg[i] END, 1) END) AS syl FROM v),
 m AS (SELECT id, ns, len(w) AS nw, CAST(coalesce(list_sum(syl), 0) AS BIGINT) AS ny, len(list_filter(syl, lambda x: x >= 3)) AS hard, len(list_filter(w, lambda x: strlen(x) >= 7)) AS lng FROM y),
 k AS (SELECT *, nw / nullif(ns, 0) AS wps, ny / nullif(nw, 0) AS spw FROM m),
 e AS (SELECT *, greatest(0.0, least(100.0, 206.835 - 1.015 * wps - 84.6 * spw)) AS ease FROM k)
 SELECT id, CAST(ns AS BIGINT) AS n_sentences, CAST(nw AS BIGINT) AS n_words, ny AS n_syllables, CASE WHEN ns > 0 AND nw > 0 THEN round(ease, 6) ELSE 0.0 END AS reading_ease, CASE WHEN ns > 0 AND nw > 0 THEN round(greatest(0.0, 0.39 * wps + 11.8 * spw - 15.59), 6) ELSE 0.0 END AS grade,
 CASE WHEN ns > 0 AND nw > 0 THEN round(least(greatest(0.5 + ease / 100 * 0.30 + CASE WHEN wps BETWEEN 10 AND 25 THEN 0.15 WHEN wps < 5 OR wps > 40 THEN -0.10 ELSE 0 END + CASE WHEN hard / nw < 0.15 THEN 0.10 WHEN hard / nw > 0.30 THEN -0.10 ELSE 0 END + CASE WHEN least(1.0, lng / (nw + 1) * 5) > 0.5 THEN 0.05 ELSE 0 END, 0), 1)::DOUBLE, 6) ELSE 0.0 END AS readability FROM e""")
def readability(spark, sf):
    d = text.readability(pages(spark, sf, "content").where("content is not null"), "content")
    return d.select("id", "n_sentences", "n_words", "n_syllables", "reading_ease", "grade", "readability")


@query(rf"""WITH {PAGES}, t AS (SELECT id, content, lower(content) AS low, lower(coalesce(title, '')) AS head FROM p WHERE content IS NOT NULL)
 SELECT id, round(least(1, least(len(regexp_extract_all(content, 'https?://[^\s<>"]+')) * 0.05, 0.30) + least(len(regexp_extract_all(content, '\[\d+\]')) * 0.05, 0.20) + least(len(regexp_extract_all(content, '\([A-Z][a-z]+(?:,?\s+(?:19|20)\d{{2}}|\s+et\s+al\.?)\)')) * 0.05, 0.20)
 + CASE WHEN contains(low, 'references' || chr(10)) OR contains(low, 'bibliography') OR contains(low, 'works cited') OR contains(low, 'sources' || chr(10)) THEN 0.15 ELSE 0 END + CASE WHEN {hits('low', X.SCHOLARLY)} >= 3 THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS citation,
 round(least(1, least({hits('low', X.CREDENTIALS)} * 0.15, 0.40) + least({hits('low', X.AFFILIATIONS)} * 0.10, 0.30) + CASE WHEN {hits('low', X.AUTHORITY)} > 0 THEN 0.20 ELSE 0 END)::DOUBLE, 6) AS credibility,
 round(least(1, greatest(0, 0.5 + least(({hits('low', X.TIME_SENSITIVE)} + 2 * {hits('head', X.TIME_SENSITIVE)}) * 0.03, 0.30) + least(least({hits('low', X.DATE_WORDS)}, 10) * 0.02, 0.20)
 - least(len(list_filter({words(X.EVERGREEN)}, lambda z: contains(low, z) OR contains(head, z))) * 0.05, 0.15)))::DOUBLE, 6) AS freshness FROM t""")
def text_scores(spark, sf):
    c, t = F.col("content"), F.coalesce(F.col("title"), F.lit(""))
    return pages(spark, sf, "title", "content").where("content is not null").select("id", F.round(text.citation_score(c), 6).alias("citation"), F.round(text.credibility_score(c), 6).alias("credibility"), F.round(text.freshness_score(t, c), 6).alias("freshness"))


FORM = r"trim(regexp_replace(regexp_replace(lower(content), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
SH = f"f AS (SELECT id, {FORM} AS form FROM p WHERE content IS NOT NULL), w AS (SELECT id, form, list_filter(string_split(form, ' '), lambda x: x <> '') AS w FROM f), s AS (SELECT id, form, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM w)"
FP = "CASE WHEN len(sh) = 0 THEN sha256(form) ELSE sha256(array_to_string(list_slice(list_sort(sh), 1, 20), '|')) END"


@query(f"WITH {PAGES}, {SH} SELECT id, CAST(len(sh) AS BIGINT) AS shingles, {FP} AS fingerprint FROM s")
def fingerprints(spark, sf):
    d = text.with_fingerprint(pages(spark, sf, "content").where("content is not null"), "content")
    return d.select("id", F.size("shingles").cast("long").alias("shingles"), "fingerprint")


@query(f"WITH {PAGES}, {SH}, g AS (SELECT id, {FP} AS fp FROM s), r AS (SELECT id, row_number() OVER (PARTITION BY fp ORDER BY id) AS rn, first_value(id) OVER (PARTITION BY fp ORDER BY id) AS kept FROM g) SELECT id, kept FROM r WHERE rn > 1")
def duplicate_gate(spark, sf):
    """Pages dropped because a page of smaller id has their fingerprint."""
    g = text.with_fingerprint(pages(spark, sf, "content").where("content is not null"), "content").select("id", F.col("fingerprint").alias("fp"))
    first = g.groupBy("fp").agg(F.min("id").alias("kept"))  # pre-aggregated: a hot fingerprint is never one task's window
    return g.join(first, "fp").where("id <> kept").select("id", "kept")


@query(f"""WITH {PAGES}, {SH}, o AS (SELECT s.id, s.sh, lead(s.id) OVER (PARTITION BY p.title ORDER BY s.id) AS other, lead(s.sh) OVER (PARTITION BY p.title ORDER BY s.id) AS osh FROM s JOIN p USING (id) WHERE p.title IS NOT NULL)
 SELECT id, other, round(CASE WHEN len(sh) = 0 AND len(osh) = 0 THEN 1.0 ELSE len(list_intersect(sh, osh)) / (len(sh) + len(osh) - len(list_intersect(sh, osh))) END, 6) AS similarity FROM o WHERE other IS NOT NULL""")
def title_neighbours_jaccard(spark, sf):
    """Shingle similarity of each page with the next one of the same title."""
    d = text.with_shingles(pages(spark, sf, "title", "content").where("content is not null and title is not null"), "content").select("id", "title", F.col("shingles").alias("sh"))
    w = Window.partitionBy("title").orderBy("id")
    d = d.withColumns({"other": F.lead("id").over(w), "osh": F.lead("sh").over(w)}).where("other is not null")
    return d.select("id", "other", F.round(text.jaccard(F.col("sh"), F.col("osh")), 6).alias("similarity"))


@query(f"""WITH {PAGES}, t AS (SELECT id, {TOK.format('content')} AS w FROM p WHERE content IS NOT NULL) SELECT id, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_transform(list_slice(range(1, len(w) + 1, greatest(len(w) // 20, 1)), 1, 20), lambda i: w[i]), ' ') END AS signature FROM t""")
def content_signatures(spark, sf):
    return pages(spark, sf, "content").where("content is not null").select("id", text.signature(F.col("content")).alias("signature"))


SCORES = f"""{PAGES}, {U2}, us AS (SELECT id, segs, params, path, {SLUG} AS stems FROM v),
 ur AS (SELECT *, len(segs) = 0 OR (len(list_filter(stems, lambda x: length(regexp_replace(x, '[^\\p{{L}}_\\-]', '', 'g')) / strlen(x) > 0.7)) > 0 AND len(list_filter(stems, lambda x: regexp_matches(x, '{urls.RANDOM}'))) = 0) AS readable FROM us),
 uq AS (SELECT id, greatest(0.0, 1.0 - (CASE WHEN len(segs) <= 2 THEN 0.0 WHEN len(segs) = 3 THEN 0.1 WHEN len(segs) = 4 THEN 0.2 ELSE 0.4 END + CASE WHEN len(params) > 0 THEN 0.15 ELSE 0 END + CASE WHEN len(list_filter(params, lambda x: list_contains({words(X.TRACKING_PARAMS)}, lower(x.k)))) > 0 THEN 0.1 ELSE 0 END
 + CASE WHEN NOT readable THEN 0.2 ELSE 0 END + CASE WHEN strlen(regexp_replace(path, '^/+|/+$', '', 'g')) > 100 THEN 0.15 ELSE 0 END))::DOUBLE AS url_q FROM ur),
 b AS (SELECT p.id, coalesce(title, '') AS title, lower(coalesce(title, '')) AS head, coalesce(description, '') AS dsc, coalesce(content, '') AS c, lower(coalesce(content, '')) AS low, coalesce(domain, '') AS domain, is_https, depth, coalesce(len(links), 0) AS nl, coalesce(len(list_filter(links, lambda x: x.is_external)), 0) AS ne, {TOK.format("coalesce(content, '')")} AS w, url_q FROM p JOIN uq USING (id)),
 k AS (SELECT *, len(w) AS words, CASE WHEN len(w) > 0 THEN len(list_distinct(list_filter(w, lambda x: strlen(x) > 2 AND NOT list_contains({STOPS}, x)))) / len(w) ELSE 0 END AS dens FROM b),
 e AS (SELECT id, unnest(w) AS word, words FROM k WHERE words > 50), sx AS (SELECT DISTINCT id FROM (SELECT id, word, count(*) AS n, any_value(words) AS words FROM e WHERE strlen(word) > 2 AND NOT list_contains({STOPS}, word) GROUP BY 1, 2) WHERE n > 20 AND n / words > 0.05),
 m AS (SELECT k.*, sx.id IS NOT NULL AS stuffed FROM k LEFT JOIN sx ON k.id = sx.id),
 sc AS (SELECT id, words, url_q, least(1, least({hits('low', X.EXPERIENCE)} * 0.05, 0.20) + least(len(list_filter({words(X.EXPERTISE)}, lambda z: contains(low, z) OR contains(head, z))) * 0.04, 0.25) + CASE WHEN words > 1000 THEN 0.15 WHEN words > 500 THEN 0.08 ELSE 0 END + CASE WHEN nl BETWEEN 3 AND 50 THEN 0.10 ELSE 0 END + CASE WHEN is_https THEN 0.10 ELSE 0 END + CASE WHEN regexp_matches(lower(domain), '\\.(edu|gov|org)$') THEN 0.15 ELSE 0 END + CASE WHEN {hits('low', X.SCAM)} = 0 THEN 0.05 ELSE 0 END)::DOUBLE AS eeat,
 least(1, greatest(0, CASE WHEN strlen(title) BETWEEN 10 AND 100 THEN 0.15 + CASE WHEN {hits('head', X.POOR_TITLES)} = 0 THEN 0.05 ELSE 0 END WHEN strlen(title) > 0 THEN 0.05 ELSE 0 END + CASE WHEN words >= 300 THEN 0.15 ELSE 0 END + CASE WHEN words >= 1000 THEN 0.10 ELSE 0 END - CASE WHEN words > 10000 THEN 0.05 ELSE 0 END + CASE WHEN words > 0 AND words < 100 THEN 0.03 ELSE 0 END + CASE WHEN contains(c, chr(10) || chr(10)) THEN 0.10 ELSE 0 END + CASE WHEN nl BETWEEN 1 AND 100 THEN 0.10 ELSE 0 END + CASE WHEN strlen(dsc) >= 50 THEN 0.05 ELSE 0 END + CASE WHEN dens BETWEEN 0.2 AND 0.6 THEN 0.10 WHEN dens > 0 THEN 0.03 ELSE 0 END + CASE WHEN depth <= 1 THEN 0.05 ELSE 0 END))::DOUBLE AS quality,
 (0.5 + CASE WHEN nl BETWEEN 3 AND 50 THEN 0.20 WHEN nl BETWEEN 1 AND 2 THEN 0.10 ELSE 0 END + CASE WHEN nl BETWEEN 1 AND 20 THEN 0.15 ELSE 0 END + CASE WHEN nl - ne > 0 AND ne > 0 THEN 0.10 ELSE 0 END + CASE WHEN depth BETWEEN 1 AND 3 THEN 0.05 ELSE 0 END)::DOUBLE AS link,
 (CASE WHEN strlen(title) BETWEEN 30 AND 60 THEN 0.25 WHEN strlen(title) BETWEEN 10 AND 100 THEN 0.10 ELSE 0 END + CASE WHEN strlen(dsc) BETWEEN 120 AND 160 THEN 0.25 WHEN strlen(dsc) >= 50 THEN 0.10 ELSE 0 END + CASE WHEN words >= 300 THEN 0.20 WHEN words >= 100 THEN 0.10 ELSE 0 END)::DOUBLE AS seo,
 least(1, least({hits('low', X.SPAM)} * 0.10 + {hits('head', X.SPAM)} * 0.15, 0.60) + CASE WHEN strlen(title) > 5 AND length(regexp_replace(title, '[^A-Z]', '', 'g')) / strlen(title) > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN length(regexp_replace(title, '[^!?]', '', 'g')) > 2 THEN 0.10 ELSE 0 END + CASE WHEN words < 50 THEN 0.15 WHEN words < 100 THEN 0.05 ELSE 0 END + CASE WHEN nl > 100 THEN 0.20 WHEN words > 0 AND nl > 0 AND nl / greatest(words, 1) > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN stuffed THEN 0.15 ELSE 0 END)::DOUBLE AS spam FROM m),
 rl AS (SELECT *, (0.30 * eeat + 0.30 * quality + 0.20 * link + 0.10 * seo + 0.10 * url_q) * (1 - 0.5 * spam) AS relevance FROM sc),
 st AS (SELECT *, (0.5 + 2 * (0.15 * eeat + 0.10 * quality + 0.05 * url_q + 0.05 * link + 0.05 * seo + 0.06 * relevance)) * (1 - 0.8 * spam) AS static FROM rl)"""
PAGE_COLUMNS = ("url", "domain", "title", "description", "content", "links", "depth", "is_https")


@query(f"WITH {SCORES} SELECT id, CAST(words AS BIGINT) AS words, round(eeat, 6) AS eeat, round(quality, 6) AS quality, round(link, 6) AS link, round(seo, 6) AS seo, round(url_q, 6) AS url_q, round(spam, 6) AS spam, round(relevance, 6) AS relevance, round(static, 6) AS static FROM st")
def document_scores(spark, sf):
    return scoring.document_scores(pages(spark, sf, *PAGE_COLUMNS))


@query(f"""WITH {SCORES}, f AS (SELECT id, {FORM} AS form FROM p WHERE content IS NOT NULL), w5 AS (SELECT id, form, list_filter(string_split(form, ' '), lambda x: x <> '') AS w FROM f), s5 AS (SELECT id, form, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM w5),
 fp AS (SELECT id, min(id) OVER (PARTITION BY {FP}) AS kept FROM s5)
 SELECT CASE WHEN trim(coalesce(p.content, '')) = '' THEN 'empty' WHEN fp.id <> fp.kept THEN 'duplicate' WHEN st.spam > 0.7 THEN 'spam' ELSE 'accepted' END AS reason, count(*) AS n, round(avg(st.quality), 6) AS avg_quality, round(avg(st.spam), 6) AS avg_spam FROM p JOIN st USING (id) LEFT JOIN fp ON p.id = fp.id GROUP BY 1""")
def ingest_gate(spark, sf):
    """Why pages are kept out (empty, duplicate, spam), in that order, with the average scores."""
    d = text.with_fingerprint(pages(spark, sf, *PAGE_COLUMNS), "content").withColumn("fp", F.when(F.col("content").isNotNull(), F.col("fingerprint")))
    x = scoring.document_scores(d.withColumn("empty", F.trim(F.coalesce("content", F.lit(""))) == ""), "empty", "fp")
    first = x.where("fp is not null").groupBy("fp").agg(F.min("id").alias("kept"))
    x = x.join(first, "fp", "left")
    reason = F.when(F.col("empty"), "empty").when(F.col("id") != F.col("kept"), "duplicate").when(F.col("spam") > 0.7, "spam").otherwise("accepted")
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.round(F.avg("spam"), 6).alias("avg_spam"))


@query(f"WITH {SCORES} SELECT id, round((0.5 + 2 * (0.20 * eeat + 0.20 * quality + 0.05 * link + 0.08 * seo + 0.06 * relevance)) * (1 - 0.8 * spam), 6) AS rescored FROM st WHERE words >= 300")
def rescored(spark, sf):
    """The later weights, for pages of 300 words or more (a stand-in for old generations)."""
    s = scoring.document_scores(pages(spark, sf, *PAGE_COLUMNS)).where("words >= 300")
    c = F.col
    return s.select("id", F.round(scoring.weighted(scoring.RESCORE, c("spam"), eeat=c("eeat"), quality=c("quality"), link=c("link"), seo=c("seo"), relevance=c("relevance")), 6).alias("rescored"))


@query(f"WITH {PAGES} SELECT id, indexed_at, url FROM p ORDER BY indexed_at DESC NULLS LAST, id LIMIT 20 OFFSET 10")
def recent_pages(spark, sf):
    """The third to fourth ten of the pages last indexed (top-k with offset)."""
    return pages(spark, sf, "url", "indexed_at").select("id", "indexed_at", "url").orderBy(F.desc_nulls_last("indexed_at"), "id").offset(10).limit(20)
