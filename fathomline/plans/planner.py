"""From a ParsedQuery to a frame: filters reach the scan, scores come from the narrow columns that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import tokens
from fathomline.io import union_all
from fathomline.operators import search as S
from fathomline.plans.parse import ParsedQuery, expand


def filters(d: DataFrame, q: ParsedQuery) -> DataFrame:
    c = F.col
    if q.site:
        d = d.where(c("domain") == q.site)
    if q.lang:
        d = d.where(c("language") == q.lang)
    if q.country:
        d = d.where(c("country") == q.country)
    if q.https:
        d = d.where("is_https")
    if q.peer:
        d = d.where(c("origin_peer_id") == q.peer)
    if q.not_peers:
        d = d.where(~F.coalesce(c("origin_peer_id").isin(q.not_peers), F.lit(False)))
    if q.inurl:
        d = d.where(F.lower("url").contains(q.inurl))
    if q.filetypes:
        d = d.where(reduce(lambda a, b: a | b, [F.lower("url").endswith("." + e) for e in q.filetypes]))
    for bound, op in ((q.after, ">="), (q.before, "<=")):
        day = F.lit(bound).try_cast("date").cast("timestamp_ntz") if bound else None
        if day is not None:
            d = d.where(F.coalesce(c("crawled_at") >= day if op == ">=" else c("crawled_at") <= day, day.isNull()))  # a bound that isn't a date is no bound
    for field, word in (("title", q.intitle), ("content", q.intext)):
        for w in S.query_tokens(word or ""):
            d = d.where(F.array_contains(tokens(F.coalesce(c(field), F.lit(""))), w))
    for group in q.or_groups:
        words = [w for t in group for w in S.query_tokens(t)]
        d = d.where(F.arrays_overlap(tokens(F.concat_ws(" ", "title", "content", "description")), F.array(*[F.lit(t) for t in words])))
    if bad := [w for t in q.not_terms for w in S.query_tokens(t)]:
        d = S.excluded(d, bad)
    return d


def plan(docs: DataFrame, q: ParsedQuery, limit: int = 100) -> DataFrame:
    """(id, score), best first. All terms in one field, each term in some field, or any phrase; when nothing is found, any term does.

    The terms in a row, words near a term and synonyms raise the score of what is found, and find nothing themselves.
    Without terms and phrases the filters alone decide and every page scores 1. Phrases score a fixed boost.
    """
    d = filters(docs, q)
    terms = [w for t in q.terms for w in S.query_tokens(t)]  # cut as the texts are: "c++" is "c"
    n = len(set(terms))
    quoted = [S.phrase(d, field, p).select("id", F.lit(w).alias("score")) for p in q.phrases for field, w in (("title", 10.0), ("content", 6.0))]
    parts = list(quoted)
    if terms:
        parts.append(S.fielded(d, "id", terms, need=n))
        if n > 1:
            parts.append(S.cross_field(d, "id", terms))
            if union_all(*parts).isEmpty():
                parts = [S.fielded(d, "id", terms, need=1)]
    if not parts:
        return d.select("id", F.lit(1.0).alias("score")).orderBy("id").limit(limit)
    primary = union_all(*parts).groupBy("id").agg(F.sum("score").alias("score"))
    more = []
    if len(terms) > 1:
        more += [S.phrase(d, field, " ".join(terms)).select("id", F.lit(w).alias("score")) for field, w in (("title", 8.0), ("description", 4.0), ("content", 3.0))]
    if q.fuzzy and any(len(t.encode()) >= 4 for t in terms):
        more.append(S.fuzzy(d, "id", "content", terms))
    if extra := [t for s in expand(q) for t in s.split()]:
        more.append(S.fielded(d, "id", extra, boosts={"title": 0.3, "content": 0.2}))
    if more:
        extras = union_all(*more).groupBy("id").agg(F.sum("score").alias("extra"))
        primary = primary.join(extras, "id", "left").select("id", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
    return primary.orderBy(F.desc("score"), "id").limit(limit)
