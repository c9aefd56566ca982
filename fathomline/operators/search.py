"""Inverted index, lexical retrieval, fusion and result shaping on frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import tokens
from fathomline.io import shared_checkpoints, union_all

K1, B = 1.2, 0.75
BOOSTS = {"title": 5.0, "description": 1.5, "content": 1.0}


def postings(docs: DataFrame, key: str, field: str) -> DataFrame:
    """(key, term, tf, len): one row per term of a document."""
    w = docs.select(key, tokens(F.coalesce(F.col(field), F.lit(""))).alias("w"))
    return w.select(key, F.size("w").alias("len"), F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def _weight(tf: Column, df: Column, length: Column, avg: Column) -> Column:
    """BM25 of one term, n documents in all."""
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def bm25(docs: DataFrame, key: str, field: str, terms: list[str], need: int = 1) -> DataFrame:
    """(key, matched, score) of documents with at least ``need`` of the terms.

    Only the query's terms survive the tokens, so the shuffle holds hits, not postings.
    """
    terms = list(dict.fromkeys(terms))
    w = docs.select(key, tokens(F.coalesce(F.col(field), F.lit(""))).alias("w"))
    d = w.select(key, F.size("w").alias("len"), *[_times("w", t).alias(f"t{i}") for i, t in enumerate(terms)])
    n = d.agg(F.count("*").alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    d = d.where(reduce(lambda a, b: a | b, [F.col(f"t{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(n))  # one row
    parts = []
    for i in range(len(terms)):
        parts.append(_weight(F.col(f"t{i}"), F.col(f"d{i}"), F.col("len"), F.col("avg")))
    matched = sum((F.when(F.col(f"t{i}") > 0, 1).otherwise(0) for i in range(len(terms))), F.lit(0))
    return d.select(key, matched.alias("matched"), sum(parts, F.lit(0.0)).alias("score")).where(F.col("matched") >= need)


def fielded(docs: DataFrame, key: str, terms: list[str], need: int = 1, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(key, score): boosted BM25 over several fields, each field on its own."""
    hits = [bm25(docs, key, f, terms, need).select(key, (F.col("score") * w).alias("score")) for f, w in boosts.items()]
    return union_all(*hits).groupBy(key).agg(F.sum("score").alias("score"))


def cross_field(docs: DataFrame, key: str, terms: list[str], fields=("title", "description", "content"), boost: float = 0.8) -> DataFrame:
    """(key, score) of documents that hold each of the terms in at least one of the fields, in whichever; BM25 summed over the fields."""
    terms = list(dict.fromkeys(terms))
    w = docs.select(key, *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"w{j}") for j, f in enumerate(fields)])
    at = [(i, j) for i in range(len(terms)) for j in range(len(fields))]
    d = w.select(key, *[F.size(f"w{j}").alias(f"len{j}") for j in range(len(fields))], *[_times(f"w{j}", terms[i]).alias(f"t{i}_{j}") for i, j in at])
    n = d.agg(F.count("*").alias("n"), *[F.avg(F.when(F.col(f"len{j}") > 0, F.col(f"len{j}"))).alias(f"avg{j}") for j in range(len(fields))], *[F.sum((F.col(f"t{i}_{j}") > 0).cast("long")).alias(f"d{i}_{j}") for i, j in at])
    every = reduce(lambda a, b: a & b, [sum((F.col(f"t{i}_{j}") for j in range(len(fields))), F.lit(0)) > 0 for i in range(len(terms))])
    d = d.where(every).crossJoin(F.broadcast(n))  # one row
    parts = [F.when(F.col(f"t{i}_{j}") > 0, _weight(F.col(f"t{i}_{j}"), F.col(f"d{i}_{j}"), F.col(f"len{j}"), F.col(f"avg{j}"))).otherwise(0.0) for i, j in at]
    return d.select(key, (boost * sum(parts, F.lit(0.0))).alias("score"))


def fuzzy(docs: DataFrame, key: str, field: str, terms: list[str], boost: float = 0.5) -> DataFrame:
    """(key, score): BM25 of the field's words within the edits that fuzzy_terms allows, each word by its own frequency."""
    edits = {t: 2 if len(t.encode()) >= 6 else 1 for t in terms if len(t.encode()) >= 4}
    if not edits:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    w = docs.select(key, tokens(F.coalesce(F.col(field), F.lit(""))).alias("w")).select(key, F.size("w").alias("len"), "w")
    n = w.agg(F.count("*").alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg"))

    def close(v: Column, t: str, k: int) -> Column:
        return (F.abs(F.length(v) - len(t)) <= k) & F.levenshtein(v, F.lit(t), k).between(0, k)

    # only words near a term leave the row
    x = w.select(key, "len", F.explode(F.filter("w", lambda v: reduce(lambda a, b: a | b, [close(v, t, k) for t, k in edits.items()]))).alias("word"))
    near = [F.when(close(F.col("word"), t, k), F.lit(t)) for t, k in edits.items()]
    x = x.select(key, "len", "word", F.explode(F.array_compact(F.array(*near))).alias("term")).groupBy(key, "term", "word").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    x = x.join(x.groupBy("term", "word").agg(F.count("*").alias("df")), ["term", "word"]).crossJoin(F.broadcast(n))  # one row
    return x.select(key, _weight(F.col("tf"), F.col("df"), F.col("len"), F.col("avg")).alias("score")).groupBy(key).agg((boost * F.sum("score")).alias("score"))


def query_tokens(text: str) -> list[str]:
    """The words of a query, cut as texts are."""
    return re.findall(r"[^\W_]+", text.lower())


def phrase(docs: DataFrame, field: str, text: str) -> DataFrame:
    """Documents that hold the words of text in a row."""
    norm = F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col(field), F.lit(""))), " "), F.lit(" "))
    words = " ".join(query_tokens(text))
    return docs.where(norm.contains(f" {words} ")) if words else docs.where(F.lit(False))


def excluded(docs: DataFrame, terms: list[str], fields=("title", "description", "content")) -> DataFrame:
    """Documents that hold none of the terms in any of the fields."""
    bad = reduce(lambda a, b: a | b, [F.arrays_overlap(tokens(F.coalesce(F.col(f), F.lit(""))), F.array(*[F.lit(t) for t in terms])) for f in fields])
    return docs.where(~F.coalesce(bad, F.lit(False)))


def fuzzy_terms(vocabulary: DataFrame, term: str) -> DataFrame:
    """Dictionary words within one edit of the term, two from six bytes on; none for short terms."""
    if len(term.encode()) < 4:
        return vocabulary.where(F.lit(False))
    k = 2 if len(term.encode()) >= 6 else 1
    return vocabulary.withColumn("distance", F.levenshtein("term", F.lit(term), k)).where(F.col("distance").between(0, k))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, key: str, wa: float = 0.7, wb: float = 0.3, k: int = 60) -> DataFrame:
    """(key, score) of two scored lists, each already cut to its top; the ranks run over those lists only."""
    def ranked(x: DataFrame, name: str) -> DataFrame:
        return x.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(name))

    j = ranked(a, "ra").join(ranked(b, "rb"), key, "full_outer")
    return j.select(key, (F.coalesce(wa / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(wb / (k + F.col("rb")), F.lit(0.0))).alias("score"))


def diversify(results: DataFrame, domain: Column, order: list[Column], top: int = 10, each: int = 2) -> DataFrame:
    """Adds place: at most ``each`` results a domain among the first ``top``; the rest of those follow right after. For one page of results."""
    r = results.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).withColumn("_dom", domain)
    r = r.withColumn("_nth", F.row_number().over(Window.partitionBy("_dom").orderBy("_rn")))
    late = (F.col("_rn") <= top) & (F.col("_nth") > each)
    return r.withColumn("place", F.row_number().over(Window.orderBy((F.col("_rn") > top).cast("int"), late.cast("int"), "_rn"))).drop("_rn", "_dom", "_nth")


def fresh(crawled: Column, as_of: Column, half_life: Column) -> Column:
    """0.5 + 0.5 of an exponential decay, within 0.1 and 1; 0.5 without a date."""
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(crawled)) / 86400
    v = F.least(F.greatest(0.5 + 0.5 * F.exp(-F.lit(0.6931471805599453) / half_life * days), F.lit(0.1)), F.lit(1.0))
    return F.when(crawled.isNull(), F.lit(0.5)).otherwise(v)


def intent_multiplier(kind: str, c=F.col) -> Column:
    if kind == "navigational":
        return 1.0 + F.when(c("authority") > 0.7, 0.5).otherwise(0.0) + F.when(c("url_q") > 0.8, 0.3).otherwise(0.0)
    if kind == "informational":
        return 1.0 + F.when(c("readability") > 0.6, 0.2).otherwise(0.0) + F.when(c("quality") > 0.6, 0.15).otherwise(0.0) + F.when(c("eeat") > 0.5, 0.15).otherwise(0.0)
    if kind == "transactional":
        return 1.0 + F.when(c("seo") > 0.6, 0.2).otherwise(0.0)
    return F.lit(1.0)


def tier_multiplier(tier: Column) -> Column:
    """What the tier of a result's peer multiplies its score by; unknown tiers leave it."""
    return F.when(tier == "warning", 0.8).when(tier == "throttled", 0.5).when(tier.isin("quarantined", "banned"), 0.0).otherwise(1.0)


def final_score(relevance: Column, static: Column, freshness: Column, *multipliers: Column) -> Column:
    m = static * 0.92 + freshness * 0.16
    for x in multipliers:
        m = m * x
    return F.greatest(F.lit(0.0), relevance * m)


def distinct_results(results: DataFrame, order: list[Column], url: str = "url_norm", digest: str = "content_hash", tail: int = 20_000) -> DataFrame:
    """Results in order without repeats of a url or a content, where a dropped result does not reserve its url. Of any number.

    order holds ascending columns (numbers are negated to descend) that tell all results apart. In each round the
    results that come first among those of their url and of their content are kept, and what shares a url or a
    content with them goes. When at most ``tail`` results are undecided, one task takes them in order.
    """
    shared_checkpoints(results.sparkSession)
    own = results.columns
    x = results.withColumns({"_at": F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]), "_url": F.coalesce(F.col(url), F.lit("")), "_digest": F.nullif(F.col(digest), F.lit(""))}).checkpoint()
    kept = []
    while (n := x.count()) > tail:
        firsts = [x.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("_at").alias(f"{c}_first")) for c in ("_url", "_digest")]
        y = x.join(firsts[0], "_url").join(firsts[1], "_digest", "left")
        y = y.withColumn("_keep", (F.col("_at") == F.col("_url_first")) & (F.col("_digest").isNull() | (F.col("_at") == F.col("_digest_first")))).select(*x.columns, "_keep").checkpoint()
        good = y.where("_keep").drop("_keep")
        kept.append(good)
        x = y.where("not _keep").drop("_keep").join(good.select("_url"), "_url", "left_anti").join(good.where("_digest is not null").select("_digest"), "_digest", "left_anti").select(*x.columns).checkpoint()

    def keep(pdf):
        urls, digests, good = set(), set(), []
        for u, h in zip(pdf["_url"], pdf["_digest"]):
            fresh = u not in urls and not (isinstance(h, str) and h in digests)
            if fresh:
                urls.add(u)
                digests.add(h)
            good.append(fresh)
        return pdf.loc[good, ["_rn"]]

    if n:
        x = x.withColumn("_rn", F.row_number().over(Window.orderBy("_at"))).checkpoint()
        rest = x.select("_rn", "_url", "_digest", F.lit(1).alias("_all")).groupBy("_all").applyInPandas(lambda pdf: keep(pdf.sort_values("_rn")), "_rn int")
        kept.append(x.join(rest, "_rn", "left_semi").drop("_rn"))
    return union_all(*(kept or [x])).orderBy("_at").select(*own)


def term_overlap(query_terms: list[str], words: Column) -> Column:
    """Share of the query's terms among the words."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(query_terms)])
    return F.size(F.array_intersect(q, words)) / F.greatest(F.size(q), F.lit(1))


def proximity(docs: DataFrame, key: str, field: str, terms: list[str]) -> DataFrame:
    """(key, proximity): 1 / (1 + mean least distance of the pairs of terms present); 0 with fewer than two.

    Distances come from one window over the terms' positions: the nearest place of each other term before a place.
    """
    w = docs.select(key, F.posexplode(tokens(F.coalesce(F.col(field), F.lit("")))).alias("pos", "term")).where(F.col("term").isin(terms))
    over = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pairs = []
    for t in dict.fromkeys(terms):
        last = F.max(F.when(F.col("term") == t, F.col("pos"))).over(over)
        pairs.append(w.withColumn("d", F.col("pos") - last).where((F.col("term") != t) & F.col("d").isNotNull()).select(key, F.least("term", F.lit(t)).alias("a"), F.greatest("term", F.lit(t)).alias("b"), "d"))
    g = union_all(*pairs).groupBy(key, "a", "b").agg(F.min("d").alias("d")).groupBy(key).agg(F.avg("d").alias("d"))
    return docs.select(key).join(g, key, "left").select(key, F.coalesce(1 / (1 + F.col("d")), F.lit(0.0)).alias("proximity"))
