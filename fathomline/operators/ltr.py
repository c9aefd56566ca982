"""Learned ranking: pairwise boosted stumps. Training pairs are a bounded sample; scoring is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.io import numbered

#: Pairs used in training at most, pairs without which nothing is trained, partners drawn for each result of a query.
MOST_PAIRS, LEAST_PAIRS, PARTNERS = 20_000, 200, 8


def train(winners, losers, rounds: int = 100, rate: float = 0.1, cuts: int = 20) -> list[tuple[int, float, float, float]]:
    """Stumps (feature, threshold, below, above) fitted to the residuals of the pairwise logistic loss.

    winners and losers are (pairs, features) arrays. All thresholds of a feature are tried at once from prefix sums.
    """
    import numpy as np

    x = np.vstack([winners, losers]).astype(float)
    n = len(winners)
    score = np.zeros(2 * n)
    grids = []
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        u = u if len(u) <= cuts else u[np.linspace(0, len(u) - 1, cuts).astype(int)]
        order = np.argsort(x[:, f], kind="stable")
        grids.append((u, order, np.searchsorted(x[order, f], u, side="right")))
    out = []
    for _ in range(rounds):
        push = 1 / (1 + np.exp(np.clip(score[:n] - score[n:], -50, 50)))
        r = np.concatenate([push, -push])
        best = (np.inf, 0, 0.0, 0.0, 0.0)
        for f, (u, order, k) in enumerate(grids):
            s = np.concatenate([[0.0], np.cumsum(r[order])])
            left, right, total = s[k], s[-1] - s[k], 2 * n
            gain = left**2 / np.maximum(k, 1) + right**2 / np.maximum(total - k, 1)
            gain[(k == 0) | (k == total)] = -1
            i = int(gain.argmax())
            if gain[i] >= 0 and -gain[i] < best[0]:
                best = (-gain[i], f, float(u[i]), left[i] / k[i], right[i] / (total - k[i]))
        if best[0] == np.inf:
            break
        _, f, t, lo, hi = best
        out.append((f, t, rate * lo, rate * hi))
        score += np.where(x[:, f] <= t, rate * lo, rate * hi)
    return out


def predict(model: list[tuple[int, float, float, float]], features: Column) -> Column:
    return sum((F.when(F.get(features, F.lit(f)) <= t, lo).otherwise(hi) for f, t, lo, hi in model), F.lit(0.0))


def pairwise_accuracy(model, winners, losers) -> float:
    import numpy as np

    def s(x):
        return sum(np.where(x[:, f] <= t, lo, hi) for f, t, lo, hi in model)

    return float((s(np.asarray(winners)) > s(np.asarray(losers))).mean())


def preference_sample(clicks: DataFrame, features: DataFrame, most: int = MOST_PAIRS, partners: int = PARTNERS) -> list[tuple[list[float], list[float]]]:
    """At most ``most`` (features of the more clicked, of the less clicked) of clicks (query, url, clicks) and features (url, features).

    Results of a query stand in the order of a hash; each meets the next ``partners`` of
    them, so that a query of any size gives pairs in proportion. Ties give none. The
    pairs kept are the first by hash.
    """
    c = clicks.where("clicks > 0").join(features, "url").withColumn("h", F.xxhash64("query", "url"))
    n = numbered(c, ["query"], ["h", "url"])
    ahead = n.select("query", F.explode(F.sequence(F.col("number") + 1, F.col("number") + partners)).alias("number"), F.col("clicks").alias("c1"), F.col("features").alias("f1"), F.col("h").alias("h1"))
    x = ahead.join(n.select("query", "number", "clicks", "features", "h"), ["query", "number"]).where("c1 <> clicks")
    won = F.col("c1") > F.col("clicks")
    x = x.select(F.xxhash64("h1", "h").alias("at"), F.when(won, F.col("f1")).otherwise(F.col("features")).alias("w"), F.when(won, F.col("features")).otherwise(F.col("f1")).alias("l"))
    return [(r["w"], r["l"]) for r in x.orderBy("at").limit(most).collect()]


def promoted(pairs: list[tuple[list[float], list[float]]], rounds: int = 100) -> tuple[list, float | None]:
    """(model, held-out accuracy): trained without every fifth pair and kept only if it orders more than half of those; empty otherwise or with too few pairs."""
    import numpy as np

    if len(pairs) < LEAST_PAIRS:
        return [], None
    w, x = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    held = np.arange(len(w)) % 5 == 4
    model = train(w[~held], x[~held], rounds)
    sure = pairwise_accuracy(model, w[held], x[held])
    return (model if sure > 0.5 else []), sure
