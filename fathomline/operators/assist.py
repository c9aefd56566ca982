"""Spelling, snippets and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.io import union_all

_WORD = re.compile(r"[^\W_]+")


def vocabulary(docs: DataFrame, *fields: str, most: int = 100_000) -> DataFrame:
    """(term, n): surface words of three bytes or more, the commonest ``most``."""
    text = F.lower(F.concat_ws(" ", *fields))
    w = docs.select(F.explode(F.filter(F.split(text, r"[^\p{L}]+"), lambda x: F.octet_length(x) >= 3)).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def suggestions(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, suggestion, distance): the nearest dictionary term, one edit before two, then the commoner.

    Words and terms meet on deletion variants of up to two letters, so no word meets the whole dictionary.
    """
    def deletions(c: str):
        idx = F.sequence(F.lit(1), F.length(c))
        one = F.transform(idx, lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        two = F.flatten(F.transform(one, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        return F.array_distinct(F.concat(F.array(c), one, two))

    unknown = words.select("word").distinct().where((F.octet_length("word") >= 3) & ~F.col("word").rlike("[0-9]")).join(vocab.select(F.col("term").alias("word")), "word", "left_anti")
    a = unknown.select("word", F.explode(deletions("word")).alias("v"))
    b = vocab.where("length(term) <= 32").select("term", "n", F.explode(deletions("term")).alias("v"))
    c = a.join(b, "v").select("word", "term", "n").distinct().withColumn("distance", F.levenshtein("word", "term", 2)).where("distance between 1 and 2")
    w = Window.partitionBy("word").orderBy("distance", F.desc("n"), "term")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("word", F.col("term").alias("suggestion"), "distance")


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if len(s.strip().encode()) > 10]


def snippet(body: str, terms: list[str], most: int = 280) -> tuple[str, list[tuple[int, int]]]:
    """The sentence with most term hits (closer hits first), the next one when it fits, and where the terms stand in it."""
    low = [t.lower() for t in terms if t]
    sents = split_sentences(body) or [body.strip()]

    def worth(s: str) -> float:
        at = sorted(p for t in low if (p := s.lower().find(t)) >= 0)
        near = 0 if len(at) < 2 else next((v for w, v in ((50, 5), (100, 3), (200, 1)) if at[-1] - at[0] < w), 0)
        return 10 * len(at) + near

    i = max(range(len(sents)), key=lambda k: (worth(sents[k]), -k))
    out = sents[i]
    if i + 1 < len(sents) and len(out) + 1 + len(sents[i + 1]) <= most:
        out += " " + sents[i + 1]
    if len(out) > most:
        cut = out.rfind(" ", most - 30, most)
        out = out[: cut if cut > 0 else most] + "..."
    marks = sorted((m.start(), m.end()) for t in set(low) for m in re.finditer(re.escape(t), out.lower()))
    return out, marks


def snippets(results: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Adds snippet; meant for one page of results."""
    @F.pandas_udf("string")
    def cut(s):
        return s.map(lambda x: snippet(x or "", terms)[0])

    return results.withColumn("snippet", cut(F.col(text)))


def summarize(text: str, title: str = "", n: int = 3) -> str:
    """The n sentences that share most words with the others and the title, earlier ones favoured, in their order.

    Overlaps are summed through an inverted index of words, not sentence by sentence.
    """
    sents = split_sentences(text)
    if len(sents) <= n:
        return text
    sets = [{w for w in _WORD.findall(s.lower()) if len(w.encode()) > 2} for s in sents]
    head = {w for w in _WORD.findall(title.lower()) if len(w.encode()) > 2}
    holders: dict[str, list[int]] = {}
    for i, ws in enumerate(sets):
        for w in ws:
            holders.setdefault(w, []).append(i)
    scores = []
    for i, ws in enumerate(sets):
        shared: dict[int, int] = {}
        for w in ws:
            for j in holders[w]:
                if j != i:
                    shared[j] = shared.get(j, 0) + 1
        s = sum(2 * c / (len(ws) + len(sets[j])) for j, c in shared.items())
        s += 2 * (2 * len(ws & head) / (len(ws) + len(head)) if ws and head else 0.0)
        s /= 1 + 0.1 * i
        scores.append(s * 0.5 if len(sents[i].split()) < 5 else s)
    best = sorted(sorted(range(len(sents)), key=lambda i: (-scores[i], i))[:n])
    return " ".join(sents[i] for i in best)


def summaries(docs: DataFrame, key: str, title: str, text: str, n: int = 3) -> DataFrame:
    """(key, summary), in Arrow batches; null texts give null."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [None if t is None else summarize(t, h or "", n) for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "summary"])

    d = docs.select(F.col(key).alias("k"), F.col(title).alias("h"), F.col(text).alias("t"))
    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, summary string").withColumnRenamed("k", key)


def autocomplete(popular: DataFrame, trending: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(query): popular queries (query, n) that begin with the prefix, the commonest first, then trending ones (name, velocity), each once."""
    p = prefix.strip().lower()
    top = popular.orderBy(F.desc("n"), "query").limit(200).select(F.lit(0).alias("source"), (-F.col("n")).cast("double").alias("at"), "query")
    hot = trending.orderBy(F.desc("velocity"), "name").limit(50).select(F.lit(1).alias("source"), (-F.col("velocity")).alias("at"), F.col("name").alias("query"))
    both = union_all(top, hot).where(F.startswith(F.lower("query"), F.lit(p)) if p else F.lit(False))
    return both.groupBy("query").agg(F.min(F.struct("source", "at")).alias("first")).orderBy("first", "query").limit(limit).select("query")


def featured(hits: DataFrame, kind: str, confidence: float) -> DataFrame:
    """(answer, source) of the best hit (description, url, quality_score, eeat_score, score, id) of a sure informational query, if it is good and long enough."""
    top = hits.orderBy(F.desc("score"), "id").limit(1)
    if kind != "informational" or confidence < 0.7:
        return top.where(F.lit(False)).select(F.col("description").alias("answer"), F.col("url").alias("source"))
    return top.where("(quality_score >= 0.4 or eeat_score >= 0.3) and octet_length(description) >= 40").select(F.col("description").alias("answer"), F.col("url").alias("source"))


def related_searches(terms: list[str], synonyms: list[str], topics: list[str], cleaned: str) -> list[str]:
    """Up to three rewrites with a synonym of the first term, then topics, six in all, none twice nor the query itself."""
    out: list[str] = []
    for s in synonyms if terms else []:
        again = " ".join([s, *terms[1:]])
        if len(out) < 3 and again != cleaned and again not in out:
            out.append(again)
    for t in topics:
        if len(out) < 6 and t != cleaned and t not in out:
            out.append(t)
    return out


def page_window(page: int, size: int) -> tuple[int, int, int]:
    """(offset, size, hits to fetch) of a page of results: ten a page unless given, fifty at most, and five pages ahead within 100 and 5,000."""
    size = 10 if size <= 0 else min(size, 50)
    offset = (max(page, 1) - 1) * size
    return offset, size, max(100, min(5000, offset + 5 * size))
