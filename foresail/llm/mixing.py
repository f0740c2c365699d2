"""Mixing sources to target weights by entropy balancing.

Each source gets a share of the words by weight; targets stop at ``max_copies`` times a source's words and the excess is
shared again. Document rates are tilted exponentially, r = c / (1 + exp(-l z)) with c the most copies, z the document's size
over its source's mean, and l the source's dual variable: the entropy-closest rates in (0, c) that meet
the token constraints. Newton steps on the convex dual run over a histogram of (source, size), which is one
distributed aggregate a step; the driver holds only the dual vector, one number for each source. Rates become whole copies by
systematic rounding in order of size, and what is then missing or too many goes to part of one document of the source.

Null texts have size 0 and take nothing. Null sources form one source, the last. Repeated rows are documents of their own.
Ties are broken by a hash of the id, and sums are decimal, so reruns agree. Very long texts are counted whole. Columns of the input with the operator's own names (``OWN``)
give way to them. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

SHARE = 1.5
MAX_COPIES = 2
WEIGHTS = (5.0, 2.0, 1.0)
SALTS = 64
TOLERANCE = 1e-10
OWN = (
    "__size", "__source_size", "__target", "__copies", "__taken", "__k", "__h", "__salt", "__rank", "__from", "__rank_of", "__part", "__whole",
    "__extra"
)
STEPS = 80


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> dict[str | None, float]:
    """Targets by source: shares by weight, none above cap times its size, the excess shared again by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(cap * size[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _solve(hist: DataFrame, totals: list[dict], cap: float) -> dict[str, float]:
    """Dual variables by source: safeguarded Newton, all sources at once."""
    lam, lo, hi = {}, {}, {}
    want = {}
    for t in totals:
        k = t["k"]
        if t["size"] <= 0 or t["target"] <= 0:
            lam[k] = -math.inf
        elif t["target"] >= cap * t["size"] * (1 - 1e-12):
            lam[k] = math.inf
        else:
            lam[k], lo[k], hi[k], want[k] = 0.0, -math.inf, math.inf, t["target"]
    spark = hist.sparkSession
    open_ = set(want)
    for _ in range(STEPS):
        if not open_:
            break
        dual = spark.createDataFrame([(k, lam[k]) for k in sorted(open_)], "k string, l double")
        r = F.lit(float(cap)) / (1 + F.exp(-F.col("l") * F.col("z")))
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")  # noqa: E731  the same in whatever order tasks end
        words = F.col("n") * F.col("size")
        rows = hist.join(dual, "k").groupBy("k").agg(exact(words * r).alias("g"), exact(words * F.col("z") * r * (1 - r / cap)).alias("h")).collect()
        for row in rows:  # one row for each source
            k, gap = row.k, row.g - want[row.k]
            if abs(gap) <= TOLERANCE * want[k]:
                open_.discard(k)
                continue
            if gap > 0:
                hi[k] = min(hi[k], lam[k])
            else:
                lo[k] = max(lo[k], lam[k])
            new = lam[k] - gap / row.h if row.h > 0 else math.nan
            if not lo[k] < new < hi[k]:
                a, b = lo[k], hi[k]
                new = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else (2 * a + 1 if math.isfinite(a) else 2 * b - 1)
            new = max(-700.0, min(700.0, new))
            if new == lam[k]:
                open_.discard(k)
            lam[k] = new
    return lam


def mix(
    df: DataFrame, id_col: str, source_col: str, size: Column, part_copies: bool = True, weights=WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES
) -> DataFrame:
    """The input's rows and columns with __size, __source_size, __target, __copies (whole) and __taken (words, parts counted)."""
    spark = df.sparkSession
    sc = Scratch(spark, "mix")
    df = df.drop(*[c for c in df.columns if c in OWN])
    sized = df.withColumn("__size", size).withColumn("__k", _key(F.col(source_col)))
    hist = sc.save(sized.groupBy(F.col("__k").alias("k"), F.col("__size").alias("size")).agg(F.count("*").alias("n")), "hist0")
    sums = hist.groupBy("k").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n")).collect()  # one row for each source
    name = lambda k: None if k == "n" else k[1:]
    target = fill_targets([(name(r.k), r["size"]) for r in sums], weights, share, cap)
    totals = [{"k": r.k, "size": r["size"], "mean": r["size"] / r.n if r["size"] else 1.0, "target": float(target[name(r.k)])} for r in sums]
    by_source = spark.createDataFrame(
        [(t["k"], int(t["size"]), t["mean"], t["target"]) for t in totals], "k string, source_size bigint, mean double, target double"
    )
    hist = hist.join(by_source, "k").withColumn("z", F.col("size") / F.col("mean"))
    lam = _solve(hist, totals, cap)
    dual = spark.createDataFrame(list(lam.items()), "k string, l double")
    rate = F.when(F.col("l") == math.inf, F.lit(float(cap))).when(
        (F.col("l") == -math.inf) | (F.col("size") == 0), F.lit(0.0)
    ).otherwise(F.lit(float(cap)) / (1 + F.exp(-F.col("l") * F.col("z"))))
    # systematic rounding over the histogram, by source in order of size
    by_size = Window.partitionBy("k").orderBy("size")
    plan = hist.join(dual, "k").withColumn("rate", rate).withColumn(
        "whole", F.least(F.floor("rate"), F.lit(cap))
    ).withColumn("frac", F.col("rate") - F.col("whole"))
    plan = plan.withColumn("upto", F.sum(F.col("n") * F.col("frac")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    plan = plan.withColumn("before", F.coalesce(F.lag("upto").over(by_size), F.lit(0.0)))
    plan = plan.withColumn("extra", F.least(F.floor(F.col("upto") + 0.5) - F.floor(F.col("before") + 0.5), F.col("n")))
    plan = plan.withColumn("extra", F.when(F.col("whole") >= cap, F.lit(0)).otherwise(F.col("extra")).cast("long"))
    got = F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.col("extra"))).over(Window.partitionBy("k"))
    plan = sc.save(
        plan.select(
            "k", "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), "extra", F.col("n"),
            (F.round("target").cast("long") - got.cast("long")).alias("gap")
        ),
        "plan"
    )
    # the m documents of a (source, size) that get one more: ranks by salted groups, then the groups' offsets
    salted = sized.withColumn("__h", F.xxhash64(F.col(id_col))).withColumn("__salt", F.pmod("__h", F.lit(SALTS)))
    groups = sized.select(
        "__k", "__size", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).alias("__salt")
    ).groupBy("__k", "__size", "__salt").agg(F.count("*").alias("c"))
    offset = F.sum("c").over(Window.partitionBy("__k", "__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("__from", F.coalesce(offset, F.lit(0)))
    groups = groups.join(plan.withColumnRenamed("k", "__k").withColumnRenamed("size", "__size"), ["__k", "__size"]).drop("c")
    # a part of one document makes up for what rounding left: the largest one with room for it
    copies_of = lambda rank: F.col("whole") + (rank <= F.col("extra")).cast("long")
    first, last = copies_of(F.lit(1)), copies_of(F.col("n"))
    room_first, room_last = (F.lit(cap) - first) * F.col("size"), (F.lit(cap) - last) * F.col("size")
    spare_first, spare_last = first * F.col("size"), last * F.col("size")
    up = F.col("gap") > 0
    at_last = F.when(up, room_last >= room_first).otherwise(spare_last > spare_first)
    could = F.when(up, F.greatest(room_first, room_last)).otherwise(F.greatest(spare_first, spare_last))
    fix = plan.where("gap <> 0 AND n > 0").groupBy("k").agg(
        F.max(F.struct(could.alias("could"), F.col("size"), F.when(at_last, F.col("n")).otherwise(F.lit(1)).alias("rank"), F.col("gap"))).alias("f")
    )
    part = F.when(F.col("f.gap") > 0, F.least(F.col("f.gap"), F.col("f.could"))).otherwise(-F.least(-F.col("f.gap"), F.col("f.could")))
    fix = fix.select(F.col("k").alias("__k"), F.col("f.size").alias("__size"), F.col("f.rank").alias("__rank_of"), part.alias("__part"))
    groups = groups.join(fix, ["__k", "__size"], "left") if part_copies else groups.withColumn(
        "__rank_of", F.lit(None).cast("long")
    ).withColumn("__part", F.lit(0).cast("long"))
    groups = groups.select(
        "__k", "__size", "__salt", "__from", "__rank_of", "__part", *[F.col(c).alias(f"__{c}") for c in ("whole", "extra", "source_size", "target")]
    )
    rank = F.row_number().over(Window.partitionBy("__k", "__size", "__salt").orderBy("__h", F.col(id_col)))
    ranked = salted.withColumn("__rank", rank).join(groups, ["__k", "__size", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__from"))
    copies = F.col("__whole") + (F.col("__rank") <= F.col("__extra")).cast("long")
    taken = copies * F.col("__size") + F.when(F.col("__rank") == F.col("__rank_of"), F.col("__part")).otherwise(F.lit(0))
    return ranked.select(
        *[F.col(f"`{c}`") for c in df.columns], "__size", "__source_size", "__target", copies.alias("__copies"), taken.alias("__taken")
    )
