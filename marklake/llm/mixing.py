"""Mixing sources to target weights by entropy balancing.

Of all document rates r between 0 and 3 whose words add up to the target of each source, the ones nearest to taking
every document once (in relative entropy) are min(3, exp(lambda * words)), with one lambda for each source. They are the
solution of a convex dual, found by Newton steps kept inside a bracket: every step is a distributed sum of the tilted
words and of their derivative. Sums run over a table of (source, size, number of documents), not over documents.

Rates are rounded to copies by a hash of the document; what that misses of a source's target is made up with one
copy more or less of a few of its documents, the largest that fit first.

Fixed results: a null source comes last; a null text has size 0, takes nothing and keeps its single copy; repeated rows
are drawn alike; a source without words has target 0; an empty table gives an empty result. Columns of the result that
the input has too are replaced, all others carried along. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marklake.storage import stage

MOST = 3
TOLERANCE = 1e-7
STEPS = 60
CANDIDATES = 8
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``target`` to one row for each source (``source``, ``source_size``).

    Weights repeat along the order of the sources. Raising all targets together by weight until they hold everything,
    each stopping at MOST times its source, is what resharing the excess comes to: sources fill up in the order of
    size / weight. The windows here go over the sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    df = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    df = df.withColumn("_cap", MOST * F.col("source_size").cast("double"))
    fills = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    full = fills.rowsBetween(Window.unboundedPreceding, -1)
    open_ = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    df = df.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(full), F.lit(0.0)))
    df = df.withColumn("_level", F.col("_left") / F.sum("_weight").over(open_))
    # Setting aside a source that fills up raises the level, setting aside one that doesn't lowers it.
    level = F.max("_level").over(everything)
    target = F.when(F.col("_cap") == 0, F.lit(0.0)).otherwise(F.least(F.col("_cap"), level * F.col("_weight")))
    return df.withColumn("target", target).drop("_weight", "_cap", "_left", "_level")


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(tilt * size / mean, F.lit(math.log(MOST))))


def solve(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source``, ``mean`` and ``tilt``: rates are min(MOST, exp(tilt * size / mean)).

    ``sizes`` has (source, size, n), ``wanted`` (source, source_size, target).
    """
    # A source of all its words (MOST times each) and one of none bound the tilt from both sides.
    held = sizes.where("size > 0").groupBy("source").agg(F.sum("n").alias("docs")).withColumnRenamed("source", "s")
    state = wanted.join(held, wanted["source"].eqNullSafe(held["s"])).where("source_size > 0 AND target > 0")
    mean = F.col("source_size") / F.col("docs")
    state = state.select(
        "source", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), (-mean * F.log(F.greatest(F.col("source_size") / F.col("target"), F.lit(1.0)))).alias("low"),
        (mean * math.log(MOST)).alias("high"), F.lit(False).alias("done"),
    )
    state = stage(state, "tilts")
    for _ in range(STEPS):
        s = state.withColumnRenamed("source", "s")
        rows = sizes.where("size > 0").join(s, sizes["source"].eqNullSafe(s["s"]))
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy(F.col("s").alias("source"), "target", "mean", "tilt", "low", "high").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        miss = F.col("words") - F.col("target")
        low, high = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        close = F.abs(miss) <= TOLERANCE * F.col("target")
        middle = (low + high) / 2
        new = F.when(close, F.col("tilt")).when((newton > low) & (newton < high), newton).otherwise(middle)
        state = stage(sums.select("source", "target", "mean", new.alias("tilt"), low.alias("low"), high.alias("high"), close.alias("done")), "tilts")
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "mean", "tilt")


def _draw(seed: int, *of: str) -> Column:
    """A number from 0 to 1 that depends on the values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _corrections(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source``, ``doc_id``, ``size`` and ``change`` (+1 or -1) that bring each source nearer to its target.

    A few documents of each source and size class are candidates; they are taken from the largest down, as long as
    each fits what is still missing. One bounded list for each source.
    """
    # Words of rows with one id go together, as they would be changed together.
    each = drawn.where("doc_id IS NOT NULL AND size > 0").groupBy("source", "doc_id", "size", "copies").agg(F.count("*").alias("rows"))
    each = each.withColumns({"words": F.col("size") * F.col("rows"), "class": F.floor(2 * F.log2("size")).cast("int")})
    taken = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).withColumnRenamed("source", "t_source")
    gaps = wanted.join(taken, wanted["source"].eqNullSafe(taken["t_source"])).select(F.col("source").alias("g_source"), (F.col("target") - F.col("taken")).alias("gap"))
    up = F.when(F.col("gap") > 0, F.lit(1)).otherwise(F.lit(-1))
    able = each.join(gaps, each["source"].eqNullSafe(gaps["g_source"])).withColumn("change", up)
    able = able.where((F.col("copies") + F.col("change")).between(0, MOST) & (F.col("words") <= F.abs("gap")))
    order = Window.partitionBy("source", "class").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "size")
    able = able.withColumn("n", F.row_number().over(order)).where(F.col("n") <= CANDIDATES)
    some = able.groupBy("source", "gap", "change").agg(F.sort_array(F.collect_list(F.struct("words", "doc_id", "size")), asc=False).alias("c"))
    kind = some.schema["c"].dataType.simpleString()
    start = F.struct(F.abs("gap").alias("left"), F.expr(f"cast(array() as {kind})").alias("took"))

    def take(state: Column, x: Column) -> Column:
        fits = x["words"] <= state["left"]
        left = F.when(fits, state["left"] - x["words"]).otherwise(state["left"])
        return F.struct(left.alias("left"), F.when(fits, F.array_append(state["took"], x)).otherwise(state["took"]).alias("took"))

    chosen = some.select("source", "change", F.explode(F.aggregate("c", start, take)["took"]).alias("x"))
    return chosen.select(F.col("source").alias("c_source"), F.col("x.doc_id").alias("c_doc"), F.col("x.size").alias("c_size"), "change")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken`` and the ``carry``
    columns of every row of ``docs`` (``doc_id``, ``source``, ``text``)."""
    carried = [c for c in carry if c not in ("doc_id", "source")]
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = stage(targets(totals, weights), "targets")
    tilts = solve(sizes, wanted).withColumnRenamed("source", "t_source")
    known = wanted.join(tilts, wanted["source"].eqNullSafe(tilts["t_source"]), "left").drop("t_source").withColumnRenamed("source", "k_source")

    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(_rate(F.col("tilt"), F.col("size"), F.col("mean")), F.lit(0.0)))
    rows = sized.join(known, sized["source"].eqNullSafe(known["k_source"])).withColumn("rate", rate)
    whole = F.floor("rate")
    more = (_draw(seed, "doc_id", "size") < F.col("rate") - whole).cast("long")
    drawn = stage(rows.select("doc_id", "source", "size", "source_size", "target", "rate", F.least(whole + more, F.lit(MOST)).alias("copies")), "copies")

    change = _corrections(drawn, wanted)
    same = drawn["doc_id"].eqNullSafe(change["c_doc"]) & drawn["source"].eqNullSafe(change["c_source"]) & (drawn["size"] == change["c_size"])
    final = drawn.join(change, same, "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    final = final.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    if not carried:
        return final
    # One plan row for each kind of document is joined back to the rows with the wanted columns.
    plan = final.select(*[F.col(c).alias(f"p_{c}") for c in final.columns]).distinct()
    full = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), *[F.col(c).alias(f"_carried_{c}") for c in carried])
    match = full["doc_id"].eqNullSafe(plan["p_doc_id"]) & full["source"].eqNullSafe(plan["p_source"]) & (full["_size"] == plan["p_size"])
    both = full.join(plan, match)
    return both.select(*[F.col(f"p_{c}").alias(c) for c in final.columns], *[F.col(f"_carried_{c}").alias(c) for c in carried])
