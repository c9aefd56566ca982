"""Problem 6: at most so many records per contributor, the best ones kept.

Distributed suitor b-matching. In each round every undecided record proposes to
all of its contributors; a contributor holds its best proposals up to the places
it has left and displaces the weaker ones. A record that all of its contributors
hold is matched for good: no better proposal is left that could displace it. The
places of matched records are gone; a record one of whose contributors has no
place left is refused and withdraws everywhere, so that what it displaced may be
held in the next round. Each round decides at least the best undecided record of
all, so the rounds end; the result is that of taking records from best to worst
whenever all their contributors have room. Records of one contributor each are
decided in the first round. Long chains of displacement, in which a round
decides few records, are finished by one task once the undecided proposals are
few (``FINISH``, an exact sequential pass).

Ranks among the proposals of a contributor come from a range partitioning on
(contributor, weight, id): however many proposals one contributor has, and
however many of one weight, they spread over tasks.

Defined cases: a record without contributors is not limited and is kept; null
contributors in a list are ignored; repeated rows of a record count once; null
or NaN weights come last; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.io import union_all
from fathomline.llm.common import shared_checkpoints, site_of, table

#: Undecided proposals that one task may finish, from the third round on.
FINISH = 100_000


def _held(proposals: DataFrame) -> DataFrame:
    """Adds held: whether the contributor holds the proposal, being among its best ``cap`` by (weight desc, id)."""
    order = ["contributor", F.desc_nulls_last("weight"), "id"]
    tasks = int(proposals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = proposals.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    p = p.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).checkpoint()
    runs = p.groupBy("contributor", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # one row per contributor and task
    earlier = F.sum("n").over(Window.partitionBy("contributor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("contributor", "part", "first", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    rank = F.col("earlier") + F.col("at") - F.col("first") + 1
    return p.join(runs, ["contributor", "part"]).withColumn("held", rank <= F.col("cap")).drop("at", "part", "first", "earlier")


def _finished(live: DataFrame) -> DataFrame:
    """(id) of the records that an exact sequential pass over the undecided proposals keeps, in one task."""

    def run(batches):
        import pandas as pd

        frames = list(batches)
        if not frames:
            return
        d = pd.concat(frames)
        room = dict(zip(d["contributor"], d["cap"]))
        kept = []
        best = d.groupby("id", sort=False).agg(contributors=("contributor", list), weight=("weight", "first")).reset_index()
        for i, cs, _ in best.sort_values(["weight", "id"], ascending=[False, True], na_position="last").itertuples(index=False):
            if all(room[c] > 0 for c in cs):
                kept.append(i)
                for c in cs:
                    room[c] -= 1
        yield pd.DataFrame({"id": pd.Series(kept, dtype=d["id"].dtype)})

    return live.select("id", "contributor", "weight", "cap").coalesce(1).mapInPandas(run, f"id {live.schema['id'].dataType.simpleString()}")


def suitor_matching(records: DataFrame, capacity: Column | int, finish: int = FINISH) -> DataFrame:
    """(id, kept) for records (id, contributors array<string>, weight double).

    capacity is an integer or a column over the frame's columns (for instance a
    joined one); it must be the same for all rows of a contributor. Of repeated
    rows of an id the one of greatest weight counts.
    """
    shared_checkpoints(records.sparkSession)
    cap = F.lit(capacity) if isinstance(capacity, int) else capacity
    w = F.when(~F.isnan("weight"), F.col("weight"))
    cs = F.array_sort(F.array_distinct(F.filter(F.coalesce("contributors", F.array()), lambda c: c.isNotNull())))
    base = records.select("id", w.alias("weight"), cs.alias("cs"), cap.cast("long").alias("cap")).groupBy("id")
    base = base.agg(F.max(F.struct("weight", "cs", "cap")).alias("r")).select("id", "r.*").checkpoint()
    live = base.select("id", F.explode("cs").alias("contributor"), "weight", "cap", F.size("cs").alias("degree"))
    kept, rounds = None, 0
    while True:
        rounds += 1
        answers = _held(live)
        matched = answers.groupBy("id").agg(F.bool_and("held").alias("held"), F.max("degree").alias("degree"))
        good = matched.where("held").select("id", F.lit(True).alias("kept")).checkpoint()
        kept = good if kept is None else union_all(kept, good)
        taken = live.join(good, "id", "left_semi").groupBy("contributor").agg(F.count("*").alias("taken"))
        rest = live.join(good, "id", "left_anti").join(taken, "contributor", "left").withColumn("cap", F.col("cap") - F.coalesce("taken", F.lit(0))).drop("taken")
        refused = rest.where("cap <= 0").select("id").distinct()
        live = rest.join(refused, "id", "left_anti").checkpoint()
        left = live.count()
        if left and rounds >= 3 and left <= finish:
            kept, left = union_all(kept, _finished(live).withColumn("kept", F.lit(True))), 0
        if not left:
            break
    return base.select("id", (F.size("cs") == 0).alias("free")).join(kept, "id", "left").select("id", (F.col("free") | F.coalesce("kept", F.lit(False))).alias("kept"))


def page_records(docs: DataFrame) -> DataFrame:
    """(id, contributors, weight) of pages: each id by its row of latest crawled_at, weights outside 0 to 1 void."""
    q = F.col("quality_score")
    d = docs.where("id is not null").select("id", site_of(F.col("domain"), F.col("url")).alias("site"), F.when(~F.isnan(q) & q.between(0, 1), q).alias("weight"), F.struct(F.coalesce(F.col("crawled_at").cast("string"), F.lit("")).alias("at"), q.alias("q")).alias("order"))
    d = d.groupBy("id").agg(F.max_by(F.struct("site", "weight"), "order").alias("r"))
    return d.select("id", F.when(F.col("r.site").isNotNull(), F.array("r.site")).alias("contributors"), F.col("r.weight").alias("weight"))


def p6_found(spark, sf_dir: str) -> DataFrame:
    shared_checkpoints(spark)
    records = page_records(table(spark, sf_dir, "docs")).checkpoint()
    total = records.agg(F.greatest(F.lit(5), F.floor(F.count("*") / 50)).alias("most"))
    r = records.crossJoin(F.broadcast(total))  # one row
    return suitor_matching(r, F.col("most")).where(~F.col("kept")).select("id")


P6_SQL = r"""
WITH one AS (SELECT id, domain, url, CASE WHEN NOT isnan(quality_score) AND quality_score BETWEEN 0 AND 1 THEN quality_score END AS q,
                    row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, quality_score DESC NULLS LAST) AS rn FROM docs WHERE id IS NOT NULL),
s AS (SELECT id, q, coalesce(nullif(regexp_replace(lower(trim(domain)), '^www\.', ''), ''),
             regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '')) AS site FROM one WHERE rn = 1),
r AS (SELECT id, row_number() OVER (PARTITION BY site ORDER BY q DESC NULLS LAST, id) AS rk, (SELECT greatest(5, count(*) // 50) FROM s) AS most FROM s WHERE site <> '')
SELECT id FROM r WHERE rk > most
"""
