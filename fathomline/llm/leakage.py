"""Problem 9: evaluation texts inside training text.

Pigeonhole edit matching on words. Any window of ``min_words`` item words holds
at least ``errors + 1`` whole pieces when the item is cut into pieces of
``(min_words + 1) // (errors + 2)`` words, so a passage with at most ``errors``
word edits keeps one piece unchanged. Exact piece hits are found in each text,
and every window of the item about a hit that could still be within the budget
is verified with Myers' bit-parallel distance on words, which alone decides.

The items go to the tasks in blocks of at most ``BLOCK_WORDS`` words, so that
what is broadcast has a bound whatever the size of the test set.

Defined cases: null, empty and short texts or items give no rows; items that
share text are all reported; repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomline.io import union_all
from fathomline.llm.common import table

MIN_WORDS = 12
ERRORS = 1
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    if not text:
        return []
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def myers_distance(pattern: list[str], text: list[str], most: int) -> int:
    """Least edit distance between the pattern and any part of the text, or most + 1 when it is larger.

    Myers' algorithm; one bit of a Python integer per pattern word.
    """
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: no carry into the first bit
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return min(best, most + 1)


class Matcher:
    """The items of one block, cut into pieces."""

    def __init__(self, items: list[tuple], min_words: int = MIN_WORDS, errors: int = ERRORS):
        self.w, self.e = min_words, errors
        self.m = max(1, (min_words + 1) // (errors + 2))
        self.items = [(key, ws) for key, ws in items if len(ws) >= min_words]
        self.pieces: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self.heads: set[tuple[str, ...]] = set()
        for n, (_, ws) in enumerate(self.items):
            for at in range(0, len(ws) - self.m + 1, self.m):
                piece = tuple(ws[at : at + self.m])
                self.pieces.setdefault(piece, []).append((n, at))
                self.heads.add(piece[:2])

    def find(self, ws: list[str]) -> dict[int, tuple[int, int]]:
        """item number -> (longest unchanged run of words, least distance of a window)."""
        found: dict[int, tuple[int, int]] = {}
        if len(ws) < self.w - self.e:
            return found
        m, heads, pieces = self.m, self.heads, self.pieces
        done: dict[tuple[int, int], int] = {}  # of each diagonal, where the last run seen ends
        at = zip(ws, ws[1:]) if m > 1 else ((w,) for w in ws)
        for i, head in enumerate(at):
            if head in heads and (hits := pieces.get(tuple(ws[i : i + m]))):
                for n, j in hits:
                    if done.get((n, i - j), -1) <= i:
                        done[n, i - j] = self._verify(ws, i, n, j, found)
        return found

    def _verify(self, ws: list[str], i: int, n: int, j: int, found: dict[int, tuple[int, int]]) -> int:
        """Verifies the windows about a hit; returns where the unchanged run about it ends."""
        item = self.items[n][1]
        a, b, size, limit = i, j, len(ws), len(item)
        while a and b and ws[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        c, d = i + self.m, j + self.m
        while c < size and d < limit and ws[c] == item[d]:
            c, d = c + 1, d + 1
        run, best = found.get(n, (0, self.e + 1))
        run = max(run, c - a)
        for s in self._windows(ws, item, a, b, c, d):
            if best == 0:
                break
            x = a - (b - s)
            best = min(best, myers_distance(item[s : s + self.w], ws[max(0, x - self.e) : max(0, x) + self.w + 2 * self.e], self.e))
        if best <= self.e:
            found[n] = (run, best)
        return c

    def _windows(self, ws: list[str], item: list[str], a: int, b: int, c: int, d: int):
        """Starts of the item windows that can be within the budget of the text about the run ws[a:c] = item[b:d]; whole ones first."""
        first, last = max(0, d - self.w), min(b, len(item) - self.w)
        if c - a >= self.w:  # any window inside the run
            yield b
        elif self.e and (c - a) + self._beyond(ws, item, c, d, 1) + self._beyond(ws, item, a - 1, b - 1, -1) >= self.w - self.e:
            yield from range(first, last + 1)

    def _beyond(self, ws: list[str], item: list[str], c: int, d: int, step: int) -> int:
        """An upper bound of the item words matched past an end of the run with all errors spent there."""
        if self.e > 1:
            return self.w
        most = 0
        for u, v in ((step, step), (0, step), (step, 0)):
            x, y, k = c + u, d + v, 0
            while 0 <= x < len(ws) and 0 <= y < len(item) and k < self.w and ws[x] == item[y]:
                x, y, k = x + step, y + step, k + 1
            most = max(most, k)
        return most + 1


def _blocks(items: DataFrame, key: str, text: str):
    """The items in blocks of at most BLOCK_WORDS words, read partition by partition."""
    block, n = [], 0
    for row in items.select(F.col(key), F.col(text)).where(F.col(text).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        ws = words(row[1])
        block.append((row[0], ws))
        n += len(ws)
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, errors: int = ERRORS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, run, distance): texts that hold a window of the item with at most ``errors`` word edits.

    run is the longest unchanged run of words about a hit, distance the least
    number of edits of a window of ``min_words`` words (0: held unchanged).
    """
    spark = documents.sparkSession
    d = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    schema = f"k {d.schema['k'].dataType.simpleString()}, i {items.schema[item_key].dataType.simpleString()}, run int, distance int"
    item_type = to_arrow_type(items.schema[item_key].dataType)
    out = None
    for block in _blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import pyarrow as pa

            matcher = Matcher(shared.value, min_words, errors)
            for b in batches:
                ks, ii, runs, far = [], [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                    for n, (r, x) in matcher.find(words(t.as_py())).items():
                        ks.append(k), ii.append(matcher.items[n][0]), runs.append(r), far.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ii, item_type), pa.array(runs, pa.int32()), pa.array(far, pa.int32())], ["k", "i", "run", "distance"])

        got = d.mapInArrow(run, schema)
        out = got if out is None else union_all(out, got)
    if out is None:
        out = spark.createDataFrame([], schema)
    out = out.groupBy("k", "i").agg(F.max("run").alias("run"), F.min("distance").alias("distance"))
    return out.withColumnsRenamed({"k": key, "i": item_key})


def p9_found(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("distance = 0").select("doc_id", "item_id")


def p9_near(spark, sf_dir: str) -> DataFrame:
    """Texts that hold a window of an item with one changed, added or dropped word, and no unchanged one."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("distance > 0").select("doc_id", "item_id", "distance")


def p9_leaked_items(spark, sf_dir: str) -> DataFrame:
    """Which items leaked, in how many texts, whole windows and nearly whole ones."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.sum((F.col("distance") == 0).cast("long")).alias("texts"), F.sum((F.col("distance") > 0).cast("long")).alias("nearly"), F.max("run").alias("longest_run"))
