"""Sources around a crawl: robots rules, sitemaps, plain texts, other engines' results."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GROUPS, MAX_RULES, MAX_DELAY, MAX_URLS = 100, 500, 60.0, 50_000


def parse_robots(text: str | None) -> tuple[list[dict], list[str]]:
    """(groups of agents, rules and delay, sitemaps)."""
    groups: list[dict] = []
    maps: list[str] = []
    last = ""
    for line in (text or "").splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent" and value:
            if last != "user-agent":
                if len(groups) >= MAX_GROUPS:
                    break
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
        elif key in ("allow", "disallow") and groups:
            if value and len(groups[-1]["rules"]) < MAX_RULES:
                groups[-1]["rules"].append((key == "allow", value))
        elif key == "crawl-delay" and groups:
            try:
                groups[-1]["delay"] = min(float(value), MAX_DELAY)
            except ValueError:
                pass
        elif key == "sitemap" and value:
            maps.append(value)
        if key:
            last = key
    return groups, maps


def rule_regex(pattern: str) -> str:
    end = pattern.endswith("$")
    body = ".*".join(re.escape(x) for x in (pattern[:-1] if end else pattern)[:1024].split("*"))
    return "^" + body + ("$" if end else "")


def allowed(groups: list[dict], agent: str, path: str) -> bool:
    """By the group of the longest agent name that is part of ours, else of *; the longest rule wins, on a tie the one that allows."""
    best, size = None, -1
    for g in groups:
        for a in g["agents"]:
            n = 0 if a == "*" else len(a) if a in agent.lower() else -1
            if n > size:
                best, size = g, n
    hits = [(len(p), ok) for ok, p in (best["rules"] if best else []) if re.match(rule_regex(p), path)]
    return max(hits)[1] if hits else True


def parse_sitemap(xml: str | None) -> tuple[list[dict], list[str]]:
    """(urls with lastmod, changefreq, priority; sitemaps of an index); empty for what isn't XML."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return [], []
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    rows = [{bare(c): (c.text or "").strip() for c in e} for e in root if bare(e) in ("url", "sitemap")]
    if bare(root) == "sitemapindex":
        return [], [r["loc"] for r in rows if r.get("loc")]
    return [{k: r.get(k, "") for k in ("loc", "lastmod", "changefreq", "priority")} for r in rows if r.get("loc")][:MAX_URLS], []


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, title): whole files with white space collapsed; the title from the file's name."""
    from fathomline.functions.urls import title_from_url

    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("content"))
    return t.withColumn("title", title_from_url(F.col("path")))


def other_results(spark: SparkSession, path: str, penalty: float = 0.7, most: int = 50) -> DataFrame:
    """Results of another engine in JSON, without empty urls, their scores lowered."""
    r = spark.read.schema("results array<struct<url: string, title: string, content: string, engine: string, score: double>>").json(path, multiLine=True)
    return r.select(F.inline("results")).where("url is not null and url <> ''").withColumn("score", F.col("score") * penalty).orderBy(F.desc("score"), "url").limit(most)


def shell_page(html: Column, content: Column, least: int = 200) -> Column:
    """Little text and the marks of a page that scripts fill in."""
    marks = ['id="root"', 'id="app"', "__NEXT_DATA__", "ng-app", "data-reactroot", "window.__INITIAL_STATE__"]
    found = F.lit(False)
    for m in marks:
        found = found | html.contains(m)
    return found & (F.octet_length(content) < least)


def recrawl(log: DataFrame, as_of: Column, stale_hours: int = 24, most: int = 50) -> DataFrame:
    """The pages to fetch again: days since the last fetch, weighted by how often they change (columns last, crawls, changes)."""
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last")) / 3600
    rate = F.least(F.col("changes") / F.greatest("crawls", F.lit(1)), F.lit(1.0))
    p = hours / 24 * (0.5 + 2 * (0.3 + 0.7 * rate))
    return log.where(hours > stale_hours).withColumn("priority", F.round(p, 6)).orderBy(F.desc("priority"), "id").limit(most)


def frontier(candidates: DataFrame, seen: DataFrame, key: str, order: Column, room: int) -> DataFrame:
    """Unseen urls, each once, the first to arrive, up to the room left in the queue."""
    fresh = candidates.join(seen.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(order).alias("at")).orderBy("at", key).limit(room)


def routed(holders, me):
    """Adds route: ``local`` where the peer ``me`` is among the holders (column nodes), else ``forward``."""
    return holders.withColumn("route", F.when(F.array_contains("nodes", me), "local").otherwise("forward"))


def gaps(fetches, by: str, at: str, least_us: int):
    """(by, gaps, least_s, too_near): gaps between fetches that are next to each other by their number, and how many are under the least allowed."""
    a = fetches.select(by, "number", F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    b = a.select(by, (F.col("number") + 1).alias("number"), F.col("us").alias("was"))
    x = a.join(b, [by, "number"]).select(by, (F.col("us") - F.col("was")).alias("gap"))
    return x.groupBy(by).agg(F.count("*").alias("gaps"), F.round(F.min("gap") / 1e6, 3).alias("least_s"), F.sum((F.col("gap") < least_us).cast("long")).alias("too_near"))


def announced(urls, most: int = 100, longest: int = 2048):
    """The URLs that an announcement may carry, in order."""
    return F.slice(F.filter(urls, lambda u: u.isNotNull() & (F.octet_length(u) <= longest)), 1, most)
