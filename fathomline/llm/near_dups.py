"""Problem 7: near-duplicate records across a collection too large for pairs.

Min-max hashing: under each random permutation of a document's 5-word shingles
both the least and the greatest value are kept, so half the hash evaluations
give a signature of the same length with no more variance. The signature is
banded; documents that agree on a band are verified on their whole shingle
sets. Documents with equal shingle sets form one class and enter once.

Buckets of more than ``HOT`` classes (a template's, say, whose pages share half
their text) are not paired as they are. Their members meet by an exact way
instead: shingles are ordered from rare to common among these members, and two
sets above the threshold must share one of the rarest of each (prefix filter).
Pages that share a template differ in their rare shingles and don't meet.

Defined cases: null content, null ids and texts of fewer than ``min_words``
words have no pairs; repeated rows of an id count once; ids are strings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.io import pages, union_all
from fathomline.llm.common import shared_checkpoints, table

SHINGLE = 5
THRESHOLD = 0.80
MIN_WORDS = 40
#: Permutations; the signature has two values of each.
PERMUTATIONS = 64
#: A pair at similarity 0.8 is missed by all 25 bands of 5 with a chance of 5e-5.
BAND = 5
HOT = 1_000

_WORD = re.compile(r"[^\W_]+")


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles; remembers word hashes."""

    def __init__(self, size: int = SHINGLE):
        import numpy as np
        import xxhash

        self.np, self.size = np, size
        self.seen: dict[str, int] = {}
        self.digest = xxhash.xxh3_64_intdigest
        self.mult = np.uint64(0x9E3779B97F4A7C15)

    def word(self, w: str) -> int:
        if len(self.seen) > 500_000:
            self.seen.clear()
        h = self.seen[w] = self.digest(w.encode("utf-8", "surrogatepass"))
        return h

    def of(self, ws: list[str]):
        np, seen = self.np, self.seen
        h = np.array([seen.get(w) or self.word(w) for w in ws], dtype=np.uint64)
        n = len(h) - self.size + 1
        if n < 1:
            return h[:0]
        s = h[:n].copy()
        for k in range(1, self.size):
            s *= self.mult
            s ^= s >> np.uint64(29)
            s += h[k : k + n]
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        return np.unique(s)


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def permutations():
    """Odd multipliers and offsets of the permutations of the 64-bit integers, fixed by a seed."""
    import numpy as np

    r = np.random.default_rng(20240607)
    a = r.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_max(shingles, a, b):
    """The signature: least values under all permutations, then the greatest."""
    import numpy as np

    x = shingles[None, :] * a[:, None]
    x += b[:, None]
    return np.concatenate([x.min(axis=1), x.max(axis=1)])


def _bands(sig, width: int):
    """One 64-bit key per band of width values; the band's number is mixed in."""
    import numpy as np

    n = len(sig) // width
    v = sig[: n * width].reshape(n, width)
    key = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        key = (key ^ v[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, c1, c2, bands): class hash and band keys of each row with enough words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        sh, (a, b) = Shingles(), permutations()
        for batch in batches:
            ids, c1, c2, flat = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = text_words(t.as_py())
                if len(ws) < min_words:
                    continue
                s = sh.of(ws)
                ids.append(i)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                c1.append((whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                c2.append((whole >> 64 & 0xFFFFFFFF) - (1 << 31))
                flat.append(_bands(min_max(s, a, b), BAND))
            n = len(flat[0]) if flat else 1
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(c1, pa.int64()), pa.array(c2, pa.int32()), bands], ["id", "c1", "c2", "bands"])

    d = docs.select("id", "content").where("id is not null and content is not null")
    return d.mapInArrow(run, "id string, c1 bigint, c2 int, bands array<bigint>")


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, content) of the given ids, each once."""
    return docs.select("id", "content").join(reps, "id", "left_semi").groupBy("id").agg(F.first("content").alias("content"))


def _shingled(texts: DataFrame) -> DataFrame:
    """(id, s): the whole shingle sets of texts."""

    def run(batches):
        import pyarrow as pa

        sh = Shingles()
        for batch in batches:
            sets = [sh.of(text_words(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view("int64") for x in sets], pa.list_(pa.int64()))], ["id", "s"])

    return texts.mapInArrow(run, "id string, s array<bigint>")


def _rare_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, id): the rarest shingles of each set, as many as two sets above the threshold cannot both lack."""
    x = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("key"))
    rarity = x.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")  # a shingle of one set meets nothing but keeps its place
    ranked = x.join(rarity, "key", "left").select("id", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), F.col("key").alias("key")).alias("r"))
    need = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    firsts = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list("r")).alias("rs"))  # the shingles of one text
    keys = firsts.select("id", F.explode(F.slice("rs", F.lit(1), need.cast("int"))).alias("r")).where("r.df > 1")
    return keys.select(F.col("r.key").alias("key"), "id")


def _in_one_bucket(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: ids that share a key, each pair once."""
    x = keys.select("key", F.col("id").alias("a"))
    y = keys.select("key", F.col("id").alias("b"))
    return x.join(y, "key").where("a < b").select("a", "b").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def classes_and_pairs(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of every document with enough words, and the similar pairs (a, b, similarity) of classes.

    class_id is the least id of those with the same shingle set; a and b are
    class ids, similarity is the exact Jaccard similarity, above the threshold.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    rows = signed(docs, min_words).checkpoint()
    reps = rows.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.first("bands").alias("bands"))
    members = rows.groupBy("id", "c1", "c2").agg(F.lit(1).alias("one")).select("id", "c1", "c2").join(reps.select("c1", "c2", "class_id"), ["c1", "c2"]).select("id", "class_id")
    keys = reps.select(F.explode("bands").alias("key"), F.col("class_id").alias("id"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # counted in part before the shuffle
    met = keys.join(shared, "key").checkpoint()
    pairs = _in_one_bucket(met.where(F.col("n") <= HOT))
    hot = met.where(F.col("n") > HOT).select("id").distinct().checkpoint()
    if not hot.isEmpty():
        rare = _rare_keys(_shingled(_texts_of(docs, hot)).checkpoint(), threshold)
        pairs = union_all(pairs, _in_one_bucket(rare)).distinct()
    pairs = pairs.checkpoint()
    sets = _shingled(_texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    sets = sets.checkpoint()
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    x = x.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return members, x.where(F.col("similarity") > threshold)


def near_duplicate_pairs(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs above the threshold, copies included."""
    members, pairs = classes_and_pairs(docs, threshold, min_words)
    pairs = pairs.select("a", "b")
    ma, mb = (members.select(F.col("class_id").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    across = pairs.join(ma, "a").join(mb, "b").select("id_a", "id_b")
    within = members.select("class_id", F.col("id").alias("id_a")).join(members.select("class_id", F.col("id").alias("id_b")), "class_id").where("id_a < id_b").select("id_a", "id_b")
    return union_all(across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")), within)


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, max_rounds: int = 50) -> DataFrame:
    """(id, class_id, links, group_id): one row per document.

    links is the number of other documents above the threshold, group_id the
    least id of those connected by such links. Labels spread by hooking to the
    least neighbour and jumping to the label's label, each round checkpointed.
    """
    members, pairs = classes_and_pairs(docs, threshold, min_words)
    pairs = pairs.select("a", "b").checkpoint()
    edges = union_all(pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).checkpoint()
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        hook = labels.join(near, "a", "left").select("a", "label", F.least("label", "other").alias("low"))
        jump = labels.select(F.col("a").alias("low"), F.col("label").alias("lower"))
        new = hook.join(jump, "low", "left").select("a", F.col("label").alias("old"), F.least("low", "lower").alias("label")).checkpoint()
        labels = new.select("a", "label")
        if new.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("group labels did not settle; raise max_rounds")
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    across = edges.join(sizes.select(F.col("class_id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    per_class = sizes.join(across.withColumnRenamed("a", "class_id"), "class_id", "left").join(labels.withColumnRenamed("a", "class_id"), "class_id", "left")
    per_class = per_class.select("class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("label", "class_id").alias("group_id"))
    return members.join(per_class, "class_id").select("id", "class_id", "links", "group_id")


def near_duplicate_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, other, similarity) over all pages, one row per id: each page of equal shingles with the least id of its class, and the pairs of such least ids above the threshold.

    Pages without a shingle are equal to each other and to no other page.
    """
    members, pairs = classes_and_pairs(docs, threshold, SHINGLE)
    void = docs.where("id is not null and content is not null").select("id").join(members.select("id"), "id", "left_anti")
    void = void.crossJoin(F.broadcast(void.agg(F.min("id").alias("class_id"))))  # one row
    copies = union_all(members, void).where("id <> class_id").select(F.col("class_id").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    return union_all(copies, pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity"))


def near_duplicate_pages(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_links(pages(spark, sf_dir, "content")).withColumn("similarity", F.round("similarity", 6))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "docs"))


def p7_groups(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "docs"))
