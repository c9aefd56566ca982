"""Document scores as column expressions over the columns of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline import lexicons as X
from fathomline.functions import text as T


def _when(cond: Column, v: float) -> Column:
    return F.when(cond, v).otherwise(0.0)


def eeat(title: Column, content: Column, words: Column, n_links: Column, https: Column, domain: Column) -> Column:
    low, head = F.lower(content), F.lower(title)
    expert = sum((F.when(low.contains(w) | head.contains(w), 1).otherwise(0) for w in X.EXPERTISE), F.lit(0))
    s = F.least(T.hits(low, X.EXPERIENCE) * 0.05, F.lit(0.20)) + F.least(expert * 0.04, F.lit(0.25))
    s = s + F.when(words > 1000, 0.15).when(words > 500, 0.08).otherwise(0.0) + _when(n_links.between(3, 50), 0.10) + _when(https, 0.10)
    return T.clamp(s + _when(F.lower(domain).rlike(r"\.(edu|gov|org)$"), 0.15) + _when(T.hits(low, X.SCAM) == 0, 0.05))


def quality(title: Column, description: Column, content: Column, words: Column, n_links: Column, depth: Column, density: Column) -> Column:
    n, head = F.octet_length(title), F.lower(title)
    s = F.when(n.between(10, 100), F.lit(0.15) + _when(T.hits(head, X.POOR_TITLES) == 0, 0.05)).when(n > 0, 0.05).otherwise(0.0)
    s = s + _when(words >= 300, 0.15) + _when(words >= 1000, 0.10) - _when(words > 10000, 0.05) + _when((words > 0) & (words < 100), 0.03)
    s = s + _when(content.contains("\n\n"), 0.10) + _when(n_links.between(1, 100), 0.10) + _when(F.octet_length(description) >= 50, 0.05)
    return T.clamp(s + F.when(density.between(0.2, 0.6), 0.10).when(density > 0, 0.03).otherwise(0.0) + _when(depth <= 1, 0.05))


def links(n_links: Column, n_internal: Column, n_external: Column, depth: Column) -> Column:
    s = F.lit(0.5) + F.when(n_links.between(3, 50), 0.20).when(n_links.between(1, 2), 0.10).otherwise(0.0)
    return T.clamp(s + _when(n_links.between(1, 20), 0.15) + _when((n_internal > 0) & (n_external > 0), 0.10) + _when(depth.between(1, 3), 0.05))


def seo(title: Column, description: Column, words: Column) -> Column:
    t, d = F.octet_length(title), F.octet_length(description)
    s = F.when(t.between(30, 60), 0.25).when(t.between(10, 100), 0.10).otherwise(0.0) + F.when(d.between(120, 160), 0.25).when(d >= 50, 0.10).otherwise(0.0)
    return T.clamp(s + F.when(words >= 300, 0.20).when(words >= 100, 0.10).otherwise(0.0))


def spam(title: Column, content: Column, words: Column, n_links: Column, stuffed: Column) -> Column:
    low, head = F.lower(content), F.lower(title)
    s = F.least(T.hits(low, X.SPAM) * 0.10 + T.hits(head, X.SPAM) * 0.15, F.lit(0.60))
    capitals = F.length(F.regexp_replace(title, "[^A-Z]", "")) / F.octet_length(title)
    s = s + _when((F.octet_length(title) > 5) & (capitals > 0.5), 0.15) + _when(F.length(F.regexp_replace(title, "[^!?]", "")) > 2, 0.10)
    s = s + F.when(words < 50, 0.15).when(words < 100, 0.05).otherwise(0.0)
    s = s + F.when(n_links > 100, 0.20).when((words > 0) & (n_links > 0) & (n_links / F.greatest(words, F.lit(1)) > 0.5), 0.15).otherwise(0.0)
    return T.clamp(s + _when(stuffed, 0.15))


def stuffed(words: Column) -> Column:
    """Whether, of more than 50 words, one that the analyzer keeps is met over 20 times and in over 5 % of all.

    In the sorted words such a word stands again as many places on, so no counts need a shuffle.
    """
    n, sorted_ = F.size(words), F.array_sort(words)
    far = F.greatest(F.lit(20), F.floor(n / 20).cast("int"))
    rest = F.greatest(n - far, F.lit(0))
    again = F.zip_with(F.slice(sorted_, F.lit(1), rest), F.slice(sorted_, far + 1, rest), lambda a, b: (a == b) & (F.octet_length(a) > 2) & ~T.is_stop(a))
    return (n > 50) & F.exists(again, lambda x: x)


def relevance(e: Column, q: Column, lk: Column, so: Column, url: Column, sp: Column) -> Column:
    return (0.30 * e + 0.30 * q + 0.20 * lk + 0.10 * so + 0.10 * url) * (1 - 0.5 * sp)


STATIC = {"eeat": 0.15, "quality": 0.10, "pagerank": 0.15, "authority": 0.10, "url": 0.05, "readability": 0.08, "citation": 0.08, "link": 0.05, "seo": 0.05, "author": 0.05, "relevance": 0.06}
RESCORE = {"eeat": 0.20, "quality": 0.20, "pagerank": 0.20, "readability": 0.08, "citation": 0.08, "link": 0.05, "seo": 0.08, "author": 0.05, "relevance": 0.06}


def weighted(weights: dict[str, float], sp: Column, **signals: Column) -> Column:
    """(0.5 + 2 sum of weighted signals) (1 - 0.8 spam); signals not given count as 0."""
    total = sum((w * signals[k] for k, w in weights.items() if k in signals), F.lit(0.0))
    return (0.5 + 2 * total) * (1 - 0.8 * sp)


def document_scores(pages: DataFrame, *more: str) -> DataFrame:
    """(id, words, eeat, quality, link, seo, url, spam, relevance, static, more) of pages with their columns, row by row."""
    from fathomline.functions import urls

    nil = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = pages.withColumns({"title": nil("title"), "description": nil("description"), "content": nil("content"), "domain": nil("domain")})
    n = F.coalesce(F.size("links"), F.lit(0))
    d = d.withColumns({"n_links": F.greatest(n, F.lit(0)), "n_ext": F.greatest(F.coalesce(F.size(F.filter("links", lambda x: x["is_external"])), F.lit(0)), F.lit(0)), "words": T.word_count(F.col("content")), "density": T.semantic_density(F.col("content"))})
    d = d.withColumn("stuffed", stuffed(T.tokens(F.col("content"))))
    c = F.col
    d = d.withColumns({
        "eeat": eeat(c("title"), c("content"), c("words"), c("n_links"), c("is_https"), c("domain")),
        "quality": quality(c("title"), c("description"), c("content"), c("words"), c("n_links"), c("depth"), c("density")),
        "link": links(c("n_links"), c("n_links") - c("n_ext"), c("n_ext"), c("depth")),
        "seo": seo(c("title"), c("description"), c("words")),
        "url_q": urls.url_score(c("url")),
        "spam": spam(c("title"), c("content"), c("words"), c("n_links"), c("stuffed")),
    })
    d = d.withColumn("relevance", relevance(c("eeat"), c("quality"), c("link"), c("seo"), c("url_q"), c("spam")))
    d = d.withColumn("static", weighted(STATIC, c("spam"), eeat=c("eeat"), quality=c("quality"), link=c("link"), seo=c("seo"), url=c("url_q"), relevance=c("relevance")))
    return d.select("id", "words", *more, *[F.round(x, 6).alias(x) for x in ("eeat", "quality", "link", "seo", "url_q", "spam", "relevance", "static")])


def performance(ttfb_ms: Column, size_bytes: Column, resources: Column, lazy: Column, deferred: Column, scripts: Column) -> Column:
    """How fast a page loads, within 0 and 1; what isn't known counts neither way."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    t, b, r = z(ttfb_ms), z(size_bytes), z(resources)
    s = F.lit(0.5) + F.when(t <= 0, 0.0).when(t < 200, 0.15).when(t < 500, 0.10).when(t < 1000, 0.05).when(t > 2000, -0.10).otherwise(0.0)
    s = s + F.when(b <= 0, 0.0).when(b < 500 * 1024, 0.10).when(b < 1024 * 1024, 0.05).when(b > 5 * 1024 * 1024, -0.10).otherwise(0.0)
    s = s + F.when(r <= 0, 0.0).when(r < 30, 0.10).when(r < 60, 0.05).when(r > 100, -0.10).otherwise(0.0)
    return T.clamp(s + _when(F.coalesce(lazy, F.lit(False)), 0.05) + _when(F.coalesce(deferred, F.lit(False)), 0.05) - _when(z(scripts) > 20, 0.10))


def mobile(viewport: Column, media: Column, flexible: Column, icons: Column, fonts: Column, targets: Column) -> Column:
    """How well a page fits a small screen, within 0 and 1; viewport is null without such a tag."""
    yes = lambda c, w: _when(F.coalesce(c, F.lit(False)), w)
    s = F.lit(0.3) + _when(viewport.isNotNull(), 0.30) + yes(F.lower(viewport).contains("width=device-width"), 0.10)
    return T.clamp(s + yes(media, 0.10) + yes(flexible, 0.05) + yes(icons, 0.05) - yes(fonts > 5, 0.10) - yes(targets > 10, 0.10))
