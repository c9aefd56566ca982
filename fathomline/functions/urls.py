"""URL and identity functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.lexicons import SKIP_SUFFIXES, STRIPPED_PARAMS, TRACKING_PARAMS

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 1))


def authority(url: Column) -> Column:
    """Host with port, as written."""
    return F.regexp_extract(url, ABSOLUTE, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, ABSOLUTE, 3)


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ABSOLUTE, 4), F.lit(""))


def domain(url: Column) -> Column:
    """Host with port; ``unknown`` when there is none."""
    a = authority(url)
    return F.when(a != "", a).otherwise(F.lit("unknown"))


def click_domain(url: Column) -> Column:
    """Host without port and without ``www.``."""
    return F.regexp_replace(F.regexp_replace(authority(url), r":\d+$", ""), r"^www\.", "")


def report_domain(url: Column) -> Column:
    """Scheme, path and port stripped, lower case."""
    x = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_replace(x, r"[/?#].*$", ""), r":\d+$", "")


def registrable(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(F.lower(click_domain(url)), r"([^.]+\.[^.]+)$", 1)


def params(url: Column) -> Column:
    """array<struct<k, v>> of the query, in order."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([^=]*)", 1).alias("k"), F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("v")))


def normalize(url: Column) -> Column:
    """Lower-cased scheme and host, no default port, no fragment, no tracking parameters, the rest sorted, no closing slash.

    A URL that isn't absolute is left as it is; escapes in parameters are kept as written.
    """
    s, host, p = scheme(url), F.lower(authority(url)), path(url)
    host = F.when(s == "http", F.regexp_replace(host, ":80$", "")).when(s == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    kept = F.filter(params(url), lambda x: ~F.lower(x["k"]).isin(STRIPPED_PARAMS) & ~F.lower(x["k"]).startswith("utm_"))
    q = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.when(s == "", url).otherwise(F.concat(s, F.lit("://"), host, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))


def should_crawl(url: Column) -> Column:
    ends = "(" + "|".join(x.replace(".", r"\.") for x in SKIP_SUFFIXES) + ")$"
    return scheme(url).isin("http", "https") & ~F.lower(path(url)).rlike(ends)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"), lambda x: x != "")


RANDOM = "^[0-9a-f]{8,}$|^[A-Za-z0-9+/=]{16,}$|^[0-9a-f]{8}-[0-9a-f]{4}-"


def readable_slug(url: Column) -> Column:
    """No random-looking segment, and one at least that is mostly letters and hyphens; true without segments."""
    stems = F.filter(F.transform(segments(url), lambda x: F.regexp_replace(F.lower(x), r"\.[^.]*$", "")), lambda x: x != "")
    fine = F.exists(stems, lambda x: F.length(F.regexp_replace(x, r"[^\p{L}_\-]", "")) / F.octet_length(x) > 0.7)
    return (F.size(segments(url)) == 0) | (fine & ~F.exists(stems, lambda x: x.rlike(RANDOM)))


def url_score(url: Column) -> Column:
    depth = F.size(segments(url))
    has = F.size(params(url)) > 0
    dirty = F.exists(params(url), lambda x: F.lower(x["k"]).isin(TRACKING_PARAMS))
    long_path = F.octet_length(F.regexp_replace(path(url), "^/+|/+$", "")) > 100
    minus = (
        F.when(depth <= 2, 0.0).when(depth == 3, 0.1).when(depth == 4, 0.2).otherwise(0.4)
        + F.when(has, 0.15).otherwise(0.0)
        + F.when(dirty, 0.1).otherwise(0.0)
        + F.when(~readable_slug(url), 0.2).otherwise(0.0)
        + F.when(long_path, 0.15).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.lit(1.0) - minus)


def url_text(url: Column) -> Column:
    """The words of a path: two bytes or more, trimmed of what isn't a letter, lower case."""
    parts = F.transform(F.split(path(url), r"[/\-_.]"), lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    return F.array_join(F.filter(parts, lambda x: F.octet_length(x) >= 2), " ")


def title_from_url(url: Column) -> Column:
    last = F.regexp_extract(url, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), "[-_]", " ")


def doc_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def cache_key(q: Column, page: Column, size: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", q, page.cast("string"), size.cast("string")), 256), 1, 16)


def shard(domain: Column, shards: int) -> Column:
    """Shard of a domain: 32-bit FNV-1a over its code points, modulo the shards."""
    codes = F.transform(F.split(domain, ""), lambda c: F.when(c == "", F.lit(None)).otherwise(F.ascii(c)))
    h = F.aggregate(F.array_compact(codes), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return (h % shards).cast("int")


_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def is_safe(url: Column) -> Column:
    """Whether a URL names a host that isn't local: no localhost, ``.local``, loopback, private, link-local or unspecified address."""
    auth = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    v6 = F.regexp_extract(auth, r"^\[([^\]%]*)", 1)
    a, b = (F.regexp_extract(auth, _V4, i).try_cast("int") for i in (1, 2))
    inner = (a == 127) | (a == 10) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 224) & (b == 0))
    inner6 = v6.isin("::1", "::", "fd00:ec2::254") | v6.rlike("^(f[cd]|fe[89ab]|ff.[12]:)")
    return F.coalesce((auth != "") & (auth != "localhost") & ~auth.endswith(".local") & ~F.coalesce(inner, F.lit(False)) & ~inner6, F.lit(False))


def is_allowed(url: Column, domain: Column, deny_domains=(), deny_prefixes=(), allow_domains=(), allow_prefixes=()) -> Column:
    """Denied domains, then denied prefixes, then the allowed ones where such are set."""
    d = F.lower(F.coalesce(domain, F.lit("")))
    u = F.coalesce(url, F.lit(""))
    begins = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.startswith(u, p)) if ps else F.lit(False)
    ok = ~d.isin(list(deny_domains)) if deny_domains else F.lit(True)
    ok = ok & ~begins(deny_prefixes)
    if allow_domains:
        ok = ok & d.isin(list(allow_domains))
    return ok & begins(allow_prefixes) if allow_prefixes else ok
