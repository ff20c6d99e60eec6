"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Targets: FACTOR times all tokens are shared by weight; a source's share stops at CAP times its tokens and the excess
goes to the others by weight.

Rates: within a source, document d gets the rate w = min(CAP, exp(lambda * x)), x = ln(1 + size) / ln(1 + mean size).
Among all weights of at most CAP whose tokens add up to the target these are the nearest to 1: they minimise the sum of
(size / x) * (w ln w - w + 1), the Kullback-Leibler divergence from 1 in which a document counts size / x. So lambda
solves the convex dual, whose gradient is sum(size * w) - target. Newton steps, kept inside a bracket, run on the counts
of (source, size); each step is one aggregation, in whole numbers so that reruns agree to the bit. A dual that is not
solved is an error.

Copies: rates are rounded by systematic sampling along each source's documents in order of size class, so the copies
of any stretch differ from its rates by less than one. What then is missing or too much in a source (at most about one
document) is evened out with its smallest documents. Prefix sums run in two levels, over buckets of some thousand
documents and over bucket totals, so no task holds a whole source. Documents are ordered and dealt to buckets by a hash
of id, text and number among equal rows, so that neither null nor repeated ids meet in one bucket, and the same rows
give the same result however they are dealt.

Defined results: null text or no words is size 0, taken 0; null source is a source, the last; repeated rows are mixed
each on its own, and it does not matter which of them gets which copies; rows with one id and other texts are told
apart; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, FACTOR, CAP = (5, 2, 1), 1.5, 2.0
#: Fixed point of rates, and of sums of tokens. Documents in a bucket of the prefix sums.
RATE_ONE, SUM_ONE, BUCKET = 1 << 20, 1 << 10, 4096
TOLERANCE, BRACKET = 1e-6, 512.0
#: Newton steps between two looks at the state, and such rounds at most. Bisection alone closes the bracket in 40 steps.
STEPS, MAX_ROUNDS = 2, 40
#: A table of sources is sent to all tasks up to this many rows (some MB); beyond, it is joined by shuffling.
FEW_SOURCES = 50_000


def row_name(docs: DataFrame) -> Column:
    """A hash of a row's id and text, which tells rows apart that share an id."""
    return F.xxhash64(F.struct(docs["doc_id"].cast("long"), docs["text"].cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, name, spot of all rows: name is a hash of id and text, spot one of name and the number among
    equal rows."""
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"), row_name(docs).alias("name"),
    )
    # equal rows are counted, and numbered from their count in parts, so that any number of them is spread over tasks
    alike = rows.groupBy("doc_id", "source", "size", "name").agg(F.count("*").alias("m"))
    parts = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {BUCKET}"))).alias("part")).repartition("name", "part")
    nth = F.explode(F.sequence(F.col("part") * BUCKET, F.least(F.col("m"), (F.col("part") + 1) * BUCKET) - 1))
    return parts.select("doc_id", "source", "size", "name", nth.alias("nth")).select("doc_id", "source", "size", "name", F.xxhash64("name", "nth").alias("spot"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """sid (1.. by code point, null last), source, n, source_size, target."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    all_rows = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("sid", F.row_number().over(all_rows))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    per = per.withColumn("most", F.col("source_size") * cap).withColumn("reach", F.col("most") / F.col("w"))
    up = Window.orderBy("reach", "sid")
    per = per.withColumn("total", F.sum("source_size").over(whole) * factor)
    per = per.withColumn("before", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("behind", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("behind"))
    per = per.withColumn("free", F.min(F.when(F.col("reach") > F.col("level"), F.struct("reach", "sid", "level"))).over(whole)["level"])
    target = F.when(F.col("free").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("free")))
    return per.select("sid", "source", "n", "source_size", target.alias("target"))


def _tilt(size: Column, mean: Column) -> Column:
    return F.when(mean > 0, F.log1p(size.cast("double")) / F.log1p(mean)).otherwise(F.lit(0.0))


def balance(sizes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """sid, lam, mean: the dual solution. sizes: sid, size, count (documents of that size); targets: sid, n, source_size,
    target."""
    share = F.col("target") / F.col("source_size")
    # nothing to solve: an empty source, or one that every document reaches at the cap
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-9)
    state = targets.select(
        "sid", "target", (F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"),
        # the rate of a document of mean size is exp(lambda), so this is near the solution
        F.when(F.col("source_size") == 0, 0.0).when(full, BRACKET).otherwise(F.log(share)).alias("lam"),
        F.lit(-BRACKET).alias("lo"), F.lit(BRACKET).alias("hi"), ((F.col("source_size") == 0) | full).alias("done"),
    )
    state = cut(state)
    for _ in range(MAX_ROUNDS):
        for _ in range(STEPS):
            state = _newton(sizes, state, cap)
        state = cut(state)
        if state.where(~F.col("done")).isEmpty():
            return state.select("sid", "lam", "mean")
    raise RuntimeError("the dual of the mix did not converge")


def _newton(sizes: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One step of all sources that are not done."""
    x = _tilt(F.col("size"), F.col("mean"))
    w = F.exp(F.least(F.col("lam") * x, F.lit(64.0)))
    tokens = F.col("count") * F.col("size")
    sums = (
        sizes.join(state.where(~F.col("done")).select("sid", "lam", "mean"), "sid")
        .groupBy("sid")
        .agg(
            F.sum(F.round(tokens * F.least(w, F.lit(cap)) * SUM_ONE).cast("long")).alias("g"),
            F.sum(F.when(w < cap, F.round(tokens * w * x * SUM_ONE)).otherwise(F.lit(0.0)).cast("long")).alias("h"), F.count("*").alias("cells"),
        )
    )
    gap = F.col("g") / SUM_ONE - F.col("target")
    state = state.join(sums, "sid", "left")
    # solved: up to the rounding of the sums, or the bracket has closed
    done = F.col("done") | F.coalesce(F.abs(gap) <= F.col("target") * TOLERANCE + F.col("cells") / SUM_ONE, F.lit(True)) | (F.col("hi") - F.col("lo") < 1e-9)
    state = state.withColumn("was", done).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo")))
    step = F.when(F.col("h") > 0, F.col("lam") - gap / (F.when(F.col("h") > 0, F.col("h")) / SUM_ONE))
    inside = (step > F.col("lo")) & (step < F.col("hi"))
    state = state.withColumn("next", F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
    return state.select("sid", "target", "mean", F.when(F.col("was"), F.col("lam")).otherwise(F.col("next")).alias("lam"), "lo", "hi", F.col("was").alias("done"))


def _prefix(df: DataFrame, value: str, name: str) -> DataFrame:
    """df (sid, bin, bucket, spot, doc_id, value) with the sum of value over all rows before in its source."""
    inner = Window.partitionBy("sid", "bin", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy("sid").orderBy("bin", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("sid", "bin", "bucket").agg(F.sum(value).alias("_t")).select("sid", "bin", "bucket", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off"))
    return df.join(totals, ["sid", "bin", "bucket"]).withColumn(name, F.sum(value).over(inner) - F.col(value) + F.col("_off")).drop("_off")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, rate, name; one row per row of docs. name: the hash
    row_name() of the row."""
    base = cut(sized(docs))
    targets = cut(source_targets(base, weights, factor, cap))
    keyed = base.join(targets.select("sid", F.col("source").alias("_s"), "source_size", "target"), base["source"].eqNullSafe(F.col("_s"))).drop("_s")
    hist = cut(keyed.groupBy("sid", "size").agg(F.count("*").alias("count")))
    lam = balance(hist, targets, cap)
    per_source = F.broadcast if targets.count() <= FEW_SOURCES else lambda df: df
    size_class = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int")).otherwise(F.lit(-1))
    spread = hist.groupBy("sid", size_class.alias("bin")).agg(F.ceil(F.sum("count") / BUCKET).cast("long").alias("buckets"))
    rate = F.least(F.lit(cap), F.exp(F.least(F.col("lam") * _tilt(F.col("size"), F.col("mean")), F.lit(64.0))))
    placed = (
        keyed.withColumn("bin", size_class)
        .join(per_source(lam), "sid").join(spread, ["sid", "bin"])
        .select("doc_id", "source", "sid", "size", "source_size", "target", "bin", "name", "spot", F.pmod(F.shiftright("spot", 8), F.col("buckets")).alias("bucket"), F.round(rate * RATE_ONE).cast("long").alias("rate"))
    )
    ahead = _prefix(placed, "rate", "ahead")
    whole = lambda x: F.floor((x + RATE_ONE // 2) / RATE_ONE)
    rounded = cut(ahead.withColumn("copies", (whole(F.col("ahead") + F.col("rate")) - whole(F.col("ahead"))).cast("long")).drop("ahead"))
    left = rounded.groupBy("sid").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    # the smallest documents that may take one copy more (or less) even out what is left
    fit = (F.col("left") > 0) & (F.col("copies") + 1 <= cap) | (F.col("left") < 0) & (F.col("copies") > 0)
    small = rounded.join(per_source(left), "sid").withColumn("room", F.when(fit & (F.col("size") <= F.abs("left")), F.col("size")).otherwise(F.lit(0).cast("long")))
    evened = _prefix(small, "room", "used").withColumn("copies", F.col("copies") + F.when((F.col("room") > 0) & (F.col("used") + F.col("room") <= F.abs("left")), F.signum(F.col("left").cast("double")).cast("long")).otherwise(F.lit(0).cast("long")))
    return evened.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", (F.col("rate") / RATE_ONE).alias("rate"), "name")
