from pyspark.sql import functions as F

from fathomline.sources import crawl
from fathomline.sources.html import pages_from_html, parse_page

PAGE = """<html lang="en"><head><title>A &amp; B</title><meta name="description" content="d"><meta name=robots content="noindex, follow">
<script type="application/ld+json">{"@type": ["Article"], "headline": "H", "n": 3, "x": {"y": 1}}</script></head><body><nav>Menu</nav>
<div class="sidebar"><p>Ads, ads, ads</p></div><article id=content><h1>Head</h1><p>First, second, third words of the body text<p>More of the body, unclosed <b>bold</article>
<a href="/x#f">in</a><a href="/x">again</a><a href="https://o.example/" rel=nofollow>out</a><a href="mailto:a@b">m</a><img src="i.png" alt="alt"><footer>Foot</footer>"""


def test_page():
    p = parse_page(PAGE, "https://e.example/a/")
    assert p["title"] == "A & B" and p["description"] == "d" and p["noindex"] and not p["nofollow"] and p["lang"] == "en"
    assert p["content"].startswith("Head First, second") and "Menu" not in p["content"] and "Ads" not in p["content"]
    assert [(x["url"], x["is_external"], x["nofollow"]) for x in p["links"]] == [("https://e.example/x#f", False, False), ("https://o.example/", True, True)]
    assert p["items"] == [{"type": "Article", "properties": {"headline": "H", "n": "3"}}] and p["images"][0]["url"] == "https://e.example/a/i.png" and p["headings"] == [{"level": 1, "text": "Head"}]


def test_pages_frame_of_odd_rows(spark):
    d = spark.createDataFrame([("https://e.example/", PAGE), (None, None), ("u", ""), ("https://e.example/", "<<<>>></p></div>")], "url string, html string")
    assert pages_from_html(d).select("title", F.size("links")).count() == 4


def test_robots():
    g, maps = crawl.parse_robots("User-agent: *\nDisallow: /p\nAllow: /p/open$\nCrawl-delay: 999\nSitemap: https://e/s.xml\n\nUser-agent: own\nDisallow: /*.pdf$ # x")
    assert not crawl.allowed(g, "bot", "/private") and crawl.allowed(g, "bot", "/p/open") and not crawl.allowed(g, "bot", "/p/open/x")
    assert crawl.allowed(g, "OwnBot", "/private") and not crawl.allowed(g, "OwnBot", "/a.pdf") and maps == ["https://e/s.xml"] and g[0]["delay"] == 60.0
    assert crawl.allowed(crawl.parse_robots(None)[0], "x", "/")


def test_sitemap():
    urls, subs = crawl.parse_sitemap('<urlset xmlns="http://x"><url><loc>https://e/a</loc><priority>0.5</priority></url><url/></urlset>')
    assert urls == [{"loc": "https://e/a", "lastmod": "", "changefreq": "", "priority": "0.5"}] and subs == []
    assert crawl.parse_sitemap("<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>") == ([], ["s"]) and crawl.parse_sitemap("<a") == ([], [])


def test_frontier_and_recrawl(spark):
    c = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 9)], "url string, at int")
    assert [r[0] for r in crawl.frontier(c, spark.createDataFrame([("b",)], "url string"), "url", F.col("at"), 5).collect()] == ["a", "c"]
    log = spark.createDataFrame([("x", "2024-01-01", 4, 4), ("y", "2024-01-01", 4, 0), ("z", "2024-01-09", 1, 0)], "id string, last string, crawls int, changes int").withColumn("last", F.to_timestamp("last"))
    assert [r["id"] for r in crawl.recrawl(log, F.lit("2024-01-10").cast("timestamp")).collect()] == ["x", "y"]
