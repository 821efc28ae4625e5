"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate r between 0 and ``MOST``. Of all rates whose token total meets the target of
the source, these are the closest to one in relative entropy (sum of r ln r - r + 1): the optimum is
r = min(MOST, exp(b * size / mean size)), with one multiplier b a source, so that a source that has to
shrink loses its long documents' tokens first, and one that has to grow repeats its long documents
first. b solves the convex dual of the token constraint, cap included. Newton iterations solve it for
all sources at once: each is one distributed aggregation, over the histogram of (source, size), of the
dual's gradient and Hessian. The step is Newton's on the logarithm of the token total; where it would
leave the interval that still holds the solution, the interval is halved instead. A source whose target
is ``MOST`` times its tokens has the rate ``MOST`` throughout.

Rates are then rounded into whole copies: the integer part, and one more copy for documents drawn by a
hash of the doc_id. The draws are levelled from large to small documents: in each source and power of
two of sizes, the share drawn is set so that the words taken so far meet what the rates ask for, and
what is left over passes to the next smaller class. This is a fold over at most 64 classes of ``DRAWS``
buckets of sums a source, and runs in one task a source.

Sources may be as many as rows: their ranks, targets and multipliers are tables, and only a few sums
over all sources reach the driver in a round. Sums are whole numbers or decimals, so reruns agree.

Nulls and edge cases: a null text has size 0; a null source is a source of its own, last; sources
without words have target 0 and take nothing; a null doc_id draws by its text's hash; repeated rows
are drawn alike; an empty table gives no rows; only the named columns are read. Documents of words
without a copy are part of the result, with rate and copies as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import drop_scratch, row_of, scratch, table, word_count
from tesserine.operators.ranges import running_sums

MOST = 3.0
DRAWS = 256
WEIGHTS = (1, 2, 3)
#: Rows of a table of sources up to which joins with it are told to broadcast it.
SMALL = 100_000


def _held(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint, if its counted rows are few; else Spark joins by shuffles."""
    return F.broadcast(df) if rows <= SMALL else df


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """key, docs, tokens and target of every source of ``sizes`` (key, docs, tokens): weights in
    rotation over the keys in order share all tokens; a source stops at ``most`` times its own, and
    the others share the excess by weight until none is above. Each round is one aggregation to three sums."""
    ranked = running_sums(sizes, [], ["key"], place=F.lit(1))
    by = F.array(*[F.lit(float(w)) for w in weights])
    ranked = scratch(ranked.select("key", "docs", "tokens", F.get(by, F.col("place") % len(weights)).alias("weight"), (F.col("tokens") * F.lit(most)).alias("top")), "weights")
    unit, known, total = -1.0, -1, None
    while True:  # sources above the common unit stop; the unit then rises
        stopped = F.col("weight") * F.lit(unit) > F.col("top")
        r = ranked.agg(
            F.sum("tokens").alias("all"), F.count_if(stopped).alias("n"), F.sum(F.when(stopped, F.col("top").cast("decimal(38,3)"))).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")
        ).first()
        total = float(r["all"] or 0)
        if r["n"] == known or not r["open"]:
            break
        known, unit = r["n"], max(0.0, total - float(r["held"] or 0)) / r["open"]
    return ranked.withColumn("target", F.least(F.col("top"), F.col("weight") * F.lit(unit))).drop("top", "weight")


def _rate(b: Column, full: Column, size: Column, mean: Column) -> Column:
    return F.when(full, F.lit(MOST)).otherwise(F.least(F.lit(MOST), F.exp(b * size / mean)))


def solve(histogram: DataFrame, goals: DataFrame, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """``goals`` (key, docs, tokens, target) with mean, b and full (rate ``MOST`` throughout).
    ``histogram``: key, size, n. A source without tokens or target has null b and rate 0."""
    goals = goals.withColumn("mean", F.col("tokens") / F.col("docs"))
    live = (F.col("tokens") > 0) & (F.col("target") > 0)
    full = live & (F.col("target") >= F.col("tokens") * F.lit(MOST * (1 - 1e-12)))
    start = F.when(live & ~full, F.lit(0.0))
    now = scratch(goals.withColumns({"full": full, "b": start, "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "open": live & ~full}), "dual")
    for _ in range(rounds):
        left = now.filter("open").count()
        if not left:
            break
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.lit(40.0), F.col("b") * x))
        of = F.col("n") * F.col("size") * F.least(F.lit(MOST), raw)
        slope = F.when(raw < MOST, F.col("n") * F.col("size") * raw * x).otherwise(0.0)
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        sums = histogram.join(_held(now.filter("open").select("key", "b", "mean"), left), "key").groupBy("key").agg(exact(of).alias("g"), exact(slope).alias("h"))
        g, h, b, goal = (F.col(c) for c in ("g", "h", "b", "target"))
        done = F.abs(g - goal) <= F.lit(tolerance) * goal
        low, high = F.when(g < goal, b).otherwise(F.col("low")), F.when(g > goal, b).otherwise(F.col("high"))
        newton = b + F.when((h > 0) & (g > 0), F.log(goal / g) * g / h)
        # without a bound on one side, steps there double
        half = F.coalesce((low + high) / 2, F.when(low.isNull(), F.least(F.lit(-1.0), 2 * high)).otherwise(F.greatest(F.lit(1.0), 2 * low)))
        inside = F.coalesce(newton > low, F.lit(True)) & F.coalesce(newton < high, F.lit(True)) & F.coalesce(F.abs(newton - b) < F.greatest(F.lit(8.0), 2 * F.abs(b)), F.lit(False))
        step = F.when(inside, newton).otherwise(half)
        moved = now.join(sums, "key", "left").select(
            "key", "docs", "tokens", "target", "mean", "full",
            F.when(F.col("open") & ~done, F.round(step, 12)).otherwise(b).alias("b"),
            F.when(F.col("open"), low).alias("low"), F.when(F.col("open"), high).alias("high"),
            (F.col("open") & ~done & ~F.coalesce(high - low <= 1e-11, F.lit(False))).alias("open"),
        )
        last, now = now, scratch(moved, "dual")
        drop_scratch(last)
    return now.select("key", "docs", "tokens", "target", "mean", "full", "b")


def cuts(cells: DataFrame) -> DataFrame:
    """key, level and cut: draw buckets below the cut get one more copy. ``cells``: key, level, bucket,
    words and need (what the fractions ask for, in thousandths of words)."""
    upto = Window.partitionBy("key", "level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    drawn = cells.withColumn("upto", F.sum(F.when(F.col("bucket") < DRAWS - 1, F.col("words")).otherwise(0)).over(upto))
    rows = F.array_sort(F.collect_list(F.when(F.col("bucket") < DRAWS - 1, F.struct("bucket", "upto", "words"))))
    levels = drawn.groupBy("key", "level").agg(rows.alias("rows"), F.sum("need").alias("need"))
    by_key = levels.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("level", "rows", "need")), asc=False).alias("levels"))

    def step(s, x):
        want = s["carry"] + x["need"] / 1000
        # the next bucket comes nearer as long as its middle is not beyond what is wanted
        taken = F.filter(x["rows"], lambda r: r["upto"] - r["words"] / 2 <= want)
        last = F.get(taken, F.size(taken) - 1)
        cut = F.struct(x["level"].alias("level"), F.coalesce(last["bucket"] + 1, F.lit(0)).alias("cut"))
        return F.struct((want - F.coalesce(last["upto"], F.lit(0))).alias("carry"), F.array_append(s["cuts"], cut).alias("cuts"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<level:int,cut:int>>").alias("cuts"))
    folded = by_key.select("key", F.explode(F.aggregate("levels", start, step, lambda s: s["cuts"])).alias("c"))
    return folded.select("key", "c.level", "c.cut")


def rated(sized: DataFrame, dual: DataFrame, sources: int) -> DataFrame:
    """``sized`` with its source's figures and rate, base (whole copies), part, level and bucket."""
    rows = sized.join(_held(dual, sources), "key")
    rate = F.coalesce(F.round(_rate(F.col("b"), F.col("full"), F.col("size"), F.col("mean")), 8), F.lit(0.0))
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", "mark"), F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # draws below the fraction fill the lower half of the buckets, the others the upper half, so
    # that a class can also make up for what larger documents left over
    p, half = draw / F.col("part"), DRAWS // 2
    spread = F.when(p < 1, F.floor(p * half)).otherwise(half + F.floor((1 - 1 / p) * (half - 1)))
    place = F.when(F.col("part") > 0, spread).otherwise(DRAWS - 1)
    return rows.withColumn("bucket", place.cast("int")).withColumn("level", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document; with
    ``keep``, also a struct ``row`` of these columns."""
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("0"), source), F.lit("1")).alias("key"),
        word_count(text).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("mark"), *row_of(docs, keep),
    )
    sized = scratch(sized, "sizes")
    histogram = scratch(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "histogram")
    sizes = histogram.groupBy("key").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("tokens"))
    dual = solve(histogram, targets(sizes, weights))
    drop_scratch(histogram)
    sources = dual.count()
    rows = rated(sized, dual, sources)
    need = F.sum(F.round(F.col("size") * F.col("part") * 1000).cast("long"))
    cells = rows.filter("size > 0").groupBy("key", "level", "bucket").agg(F.sum("size").alias("words"), need.alias("need"))
    drawn = scratch(cuts(cells), "cuts")
    copies = (F.col("base") + F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("long")).cast("long")
    return rows.join(_held(drawn, 64 * sources), ["key", "level"], "left").select(
        "doc_id", "source", "size", F.col("tokens").alias("source_size"), "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
        *["row"] * bool(keep),
    )


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")
