"""Intent of a query as one column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline import lexicons as X


def holds(q: Column, phrase: str) -> Column:
    """A single word as a whole word, a phrase anywhere."""
    if " " in phrase:
        return q.contains(phrase)
    return F.concat(F.lit(" "), F.regexp_replace(q, r"[^\p{L}\p{N}]+", " "), F.lit(" ")).contains(f" {phrase} ")


def any_of(q: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [holds(q, p) for p in phrases])


def intent(query: Column) -> Column:
    """struct(kind, confidence), for queries without operators."""
    q = F.lower(F.trim(query))
    words = F.filter(F.split(q, r"\s+"), lambda w: (w != "") & ~w.isin(sorted(X.QUERY_STOP_WORDS)))
    n = sum((F.when(holds(q, p), 1).otherwise(0) for p in X.TRANSACTIONAL), F.lit(0))
    s = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.round(c if isinstance(c, Column) else F.lit(float(c)), 4).alias("confidence"))
    return (
        F.when((F.size(words) == 1) & F.get(words, F.lit(0)).isin(X.BRANDS), s("navigational", 0.9))
        .when(q.rlike(r"^[a-z0-9-]+\.(com|org|net|io|co|dev|app|ai)$"), s("navigational", 0.95))
        .when(any_of(q, X.NAVIGATIONAL), s("navigational", 0.8))
        .when(any_of(q, X.LOCAL), s("local", 0.85))
        .when(n > 0, s("transactional", F.least(0.5 + n * 0.15, F.lit(0.9))))
        .when(reduce(lambda a, b: a | b, [q.startswith(p) for p in X.INFORMATIONAL]), s("informational", 0.85))
        .when(F.size(words) >= 3, s("informational", 0.6))
        .otherwise(s("informational", 0.3))
    )
