"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

A document of a source with target T and size S is due T/S copies. The whole copies are given to
all; the fraction is rounded jointly: documents meet in pairs, and size-weighted mass moves from one
to the other, at random but in a way that keeps both expectations, until one of them is integral;
the other goes on. A group of a reduction tree folds its documents from the largest down and hands up
the one that is left open, with up to ``SPARE`` documents of all sizes that it set aside. The last
group of a source settles those from the largest down, each by the words that are owed so far, so
that a source ends within about half of its smallest spare document of its target.

Leaves are hash groups of about ``LEAF`` documents; level by level ``FAN`` groups merge into one, per
source, until one group is left. A group has at most LEAF rows or so of a source, so a source with a
third of all documents is never gathered. Every random number is a hash of the two documents and
the seed: reruns agree.

Edge cases: null text has size 0; a document of size 0 is never drawn (its taken is 0); a null
source is a source of its own, last in order; sources of size 0 have target 0; an empty table gives
no rows; doc_ids that repeat are told apart by a 128-bit row key; rows equal in all of id, source and
text are documents of their own, told apart by their rank among each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, left_join, numbered, row_key, scratch, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
LEAF = 512
FAN = 24
SPARE = 16
EPS = 1e-9
BLANK = " \t\n\x0b\x0c\r"


def word_count(column: str = "text") -> Column:
    """Each word with the white space before it becomes one character; none is listed."""
    text = F.rtrim(text_of(column), F.lit(BLANK))
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target``: water-filling, a source that would pass cap x its size stops there.

    The level rises by Newton steps until no source is above its stop; only two sums reach the driver in each.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranks without a global window: sort by range, number inside partitions, add the partitions' offsets
    s = s.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    s = cut(s.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "sources")
    parts = s.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per written partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.join(parts.select("_part", "_before"), "_part").withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("weight"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    stop = F.col("source_size") * cap
    while level > before:
        above = stop <= F.lit(level) * F.col("weight")
        full, open_w = s.agg(F.sum(F.when(above, stop).otherwise(0.0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        before, level = level, ((share * total - (full or 0.0)) / open_w if open_w else level)
    return s.select("source", "source_size", F.least(stop, F.lit(level) * F.col("weight")).alias("target"))


def _unit(*cols: Column) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """One step of the fold: the pending document ``acc.cur`` meets ``x``; what is settled goes to ``acc.done``."""
    c = acc["cur"]
    up = F.least(c["size"] * (1 - c["p"]), x["size"] * x["p"])  # mass that can go to the pending one
    down = F.least(c["size"] * c["p"], x["size"] * (1 - x["p"]))
    gain = _unit(F.lit(seed), c["id"], x["id"]) * (up + down) < down
    move = F.when(gain, up).otherwise(-down)
    snap = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
    a = F.struct(c["size"].alias("size"), c["h"].alias("h"), c["id"].alias("id"), snap(c["p"] + move / c["size"]).alias("p"))
    b = F.struct(x["size"].alias("size"), x["h"].alias("h"), x["id"].alias("id"), snap(x["p"] - move / x["size"]).alias("p"))
    a_open = (a["p"] > 0) & (a["p"] < 1)
    return F.when(c.isNull(), F.struct(x.alias("cur"), acc["done"].alias("done"))).otherwise(
        F.struct(F.when(a_open, a).otherwise(b).alias("cur"), F.concat(acc["done"], F.array(F.when(a_open, b).otherwise(a))).alias("done"))
    )


def _settle(acc: Column, x: Column) -> Column:
    """One step at the root: the document is taken if that leaves less owed than leaving it."""
    owed = acc["owed"] + x["size"] * x["p"]
    take = owed * 2 >= x["size"]
    p = F.when((x["p"] <= 0) | (x["p"] >= 1), x["p"]).otherwise(F.when(take, 1.0).otherwise(0.0))
    kept = F.struct(x["id"].alias("id"), p.alias("p"))
    return F.struct((owed - x["size"] * p).alias("owed"), F.concat(acc["done"], F.array(kept)).alias("done"))


def pivotal(rows: DataFrame, seed: int = 7) -> DataFrame:
    """``rows``: id, grp, size > 0, p in (0, 1). Returns ``id, extra`` (0 or 1), jointly rounded within each grp."""
    kind = f"struct<size:double,h:bigint,id:{dict(rows.dtypes)['id']},p:double>"
    groups = max(1, math.ceil(rows.count() / LEAF))
    node = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups))
    level = rows.select("id", "grp", F.col("size").cast("double").alias("size"), F.col("p").cast("double").alias("p"), node.alias("node"))
    settled: list[DataFrame] = []
    largest_first = lambda df: df.groupBy("grp", "node").agg(F.sort_array(F.collect_list(F.struct("size", F.xxhash64("id", F.lit(seed)).alias("h"), "id", "p")), asc=False).alias("xs"))
    while True:
        g = largest_first(level)
        n = F.size("xs")
        every = F.greatest(F.lit(2), F.ceil(n / SPARE).cast("int"))
        aside = lambda i: (i % every == every - 1) | (i == n - 1)  # noqa: B023,E731
        start = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("done"))
        folded = F.aggregate(F.filter("xs", lambda x, i: ~aside(i)), start, lambda acc, x: _meet(acc, x, seed))
        g = cut(g.select("grp", "node", F.filter("xs", lambda x, i: aside(i)).alias("spare"), folded.alias("acc")), "pivotal")
        settled.append(g.select(F.explode("acc.done").alias("x")).select("x.id", F.col("x.p").alias("p")))
        # a pending document may be integral already; it still travels, and the next meeting leaves it unchanged
        left = g.select("grp", "node", F.explode(F.concat("spare", F.filter(F.array("acc.cur"), lambda x: x.isNotNull()))).alias("x")).select("grp", "node", "x.*")
        if groups == 1:
            break
        groups = math.ceil(groups / FAN)
        level = left.withColumn("node", F.floor(F.col("node") / FAN))
    none = F.struct(F.lit(0.0).alias("owed"), F.array().cast(f"array<struct<id:{dict(rows.dtypes)['id']},p:double>>").alias("done"))
    root = largest_first(left).select(F.explode(F.aggregate("xs", none, _settle)["done"]).alias("x"))
    out = root.select("x.id", F.col("x.p").alias("p"))
    for s in settled:
        out = out.union(s)
    return out.select("id", F.round("p").cast("long").alias("extra"))


def _key_of(docs: DataFrame) -> Column:
    return row_key(docs["text"], docs["doc_id"], docs["source"])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken`` and its ``_row`` key."""
    with scratch(docs.sparkSession):
        sized = docs.select("doc_id", "source", word_count().alias("size"), _key_of(docs).alias("_row"))
        sized = cut(sized.withColumn("_uid", F.monotonically_increasing_id()), "sized")
        t = cut(source_targets(sized, weights, share, cap), "targets")
        due = left_join(numbered(sized, "_row", "_uid", "_nth"), t, ["source"])
        each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        own = F.when(F.col("_nth") == 0, F.col("_row")).otherwise(F.unhex(F.md5(F.concat("_row", F.col("_nth").cast("string").cast("binary")))))
        due = due.withColumn("_each", F.least(each, F.lit(cap))).withColumn("_whole", F.floor(F.col("_each") + EPS)).withColumn("_p", F.greatest(F.col("_each") - F.col("_whole"), F.lit(0.0)))
        due = due.withColumn("_own", own)
        open_ = due.where((F.col("size") > 0) & (F.col("_p") > EPS))
        extra = pivotal(open_.select(F.col("_own").alias("id"), F.xxhash64("source").alias("grp"), "size", F.col("_p").alias("p")), seed)
        out = due.join(extra, due["_own"] == extra["id"], "left")
        copies = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
        out = out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_row")
        return cut(out, "mix", stay=True)


def mixed_rows(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; documents without words stay once."""
    row, copies, alike, nth, uid = fresh(docs.columns, "_row", "_copies", "_alike", "_nth", "_uid")
    plan = mix(docs, seed=seed).groupBy(F.col("_row").alias(row))
    plan = plan.agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias(copies), F.count("*").alias(alike)).where(F.col(copies) > 0)
    out = docs.join(plan, _key_of(docs) == plan[row])
    single = out.where(F.col(alike) == 1)
    if not plan.where(F.col(alike) > 1).isEmpty():  # equal rows share their copies, the first ones one more
        again = cut(out.where(F.col(alike) > 1).withColumn(uid, F.monotonically_increasing_id()), "equal", stay=True)
        own = F.floor(F.col(copies) / F.col(alike)) + (F.col(nth) < F.col(copies) % F.col(alike)).cast("int")
        again = numbered(again, row, uid, nth).withColumn(copies, own).where(F.col(copies) > 0)
        single = single.select(*docs.columns, copies).unionByName(again.select(*docs.columns, copies))
    return single.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
