"""Helpers shared by the training-data operators: loading, sites, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.io import shared_checkpoints, table  # noqa: F401  (used by the operators)

#: White space as Python's ``str.isspace`` sees it, spelled out because Java's ``\s`` is ASCII only.
SPACE = r"[\s\u0085   -     　\u001c-\u001f]"


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port or a leading ``www.``; null when there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def site_of(domain: Column, url: Column) -> Column:
    """Site of a page: the cleaned domain, else the host of the URL (null when neither exists)."""
    d = F.regexp_replace(F.lower(F.regexp_replace(domain, f"^{SPACE}+|{SPACE}+$", "")), r"^www\.", "")
    return F.coalesce(F.when(d != "", d), host_of(url))
