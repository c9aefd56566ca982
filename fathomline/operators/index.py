"""A written inverted index: postings by term, read back by the terms of a query only.

Postings are written once for a table as it is, in files by bucket of the term's
hash, sorted by term; a common term's postings are spread over several files of
its bucket. A search reads the buckets of its terms and, by the files' statistics,
little beside their rows; texts are not touched again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import urls
from fathomline.functions.text import tokens
from fathomline.io import exists, pages, shared_folder, table_state
from fathomline.operators.search import _weight

BUCKETS = 64
#: Parts over which a term's postings spread, by the hash of the document.
SPREAD = 8
#: Boosts of the fields of a page.
FIELDS = {"title": 5.0, "description": 1.5, "content": 1.0, "url_text": 0.8}
_BUILT: dict[tuple, Index] = {}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """Postings (bucket, term, field, id, tf, len) and lengths (field, n, avg) in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, docs: DataFrame, folder: str, fields=tuple(FIELDS), key: str = "id") -> Index:
        """Writes the index of documents; key is their id. Null fields are empty."""
        each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in fields])
        d = docs.select(F.col(key).alias("id"), F.explode(each).alias("x")).select("id", "x.field", "x.w", F.size("x.w").alias("len"))
        lengths = d.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avg"))
        lengths.coalesce(1).write.mode("overwrite").parquet(f"{folder}/lengths")
        t = d.select("id", "field", "len", F.explode("w").alias("term")).withColumns({"bucket": _bucket(F.col("term")), "part": F.pmod(F.xxhash64("id"), F.lit(SPREAD))})
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        # one shuffle: the grouping below is within its partitions
        t = t.repartition(tasks, "bucket", "part")
        p = t.groupBy("bucket", "part", "term", "field", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len")).drop("part")
        p.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        return cls(docs.sparkSession, folder)

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, field, id, tf, len) of the terms."""
        p = self.spark.read.parquet(f"{self.folder}/postings")
        at = {r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).collect()} if terms else set()  # the query's terms
        return p.where(F.col("bucket").isin(sorted(at)) & F.col("term").isin(terms)).drop("bucket")

    def search(self, terms: list[str], need: int = 1, boosts: dict[str, float] | None = None) -> DataFrame:
        """(id, score): boosted BM25 of the fields, each on its own; a field counts where it holds ``need`` of the terms."""
        terms = list(dict.fromkeys(terms))
        boosts = boosts or {"content": 1.0}
        p = self.postings(terms).where(F.col("field").isin(list(boosts)))
        df = p.groupBy("term", "field").agg(F.count("*").alias("df"))  # a row per term and field
        lengths = self.spark.read.parquet(f"{self.folder}/lengths")
        x = p.join(F.broadcast(df), ["term", "field"]).join(F.broadcast(lengths), "field")
        weight = F.create_map(*[F.lit(v) for kv in boosts.items() for v in kv])
        x = x.groupBy("id", "field").agg(F.count("*").alias("matched"), F.sum(_weight(F.col("tf"), F.col("df"), F.col("len"), F.col("avg"))).alias("s"))
        x = x.where(F.col("matched") >= need).select("id", (F.col("s") * weight[F.col("field")]).alias("s"))
        return x.groupBy("id").agg(F.sum("s").alias("score"))


def page_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the pages of a docs table, written once an application for the table as it is."""
    key = table_state(spark, f"{sf_dir}/docs.parquet")
    if key not in _BUILT or not exists(spark, f"{_BUILT[key].folder}/postings/_SUCCESS"):
        d = pages(spark, sf_dir, "title", "description", "content", "url").withColumn("url_text", urls.url_text(F.col("url")))
        _BUILT[key] = Index.build(d, shared_folder(spark))
    return _BUILT[key]


def held(index: Index, terms: list[str], fields=("title", "description", "content")) -> DataFrame:
    """(id): documents that hold each of the terms in some field."""
    each = [index.postings([t]).where(F.col("field").isin(list(fields))).select("id").distinct() for t in dict.fromkeys(terms)]
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), each)
