"""Operator 9: mix sources to target token numbers by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import attach, in_order, small_side, stored, whole_rows

#: Rates are kept in millionths, so that all running sums are exact integers and reruns agree.
MICRO = 1_000_000
MAX_RATE = 2


def word_count(text: F.Column) -> F.Column:
    """Number of runs of [^\\x20\\x09-\\x0D]."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """Target words of every source: (source, sid, source_size, docs, smallest, target).

    ``sizes`` has source and size. Sources in code point order, null last, get
    the weights in turn and share ``share`` times all words by weight. No
    target is above twice its source's size; the excess goes to the others by
    weight until none is above. There may be millions of sources: their
    order and the level up to which they are filled come from running sums over range partitions.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    totals = in_order(totals, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-sources").withColumn("sid", F.col("place") + 1)
    totals = totals.drop("place").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = (MAX_RATE * F.col("source_size")).cast("double")
    # Sources are full in the order of cap / weight: with those before it full, a source
    # is full too if its cap is below its part of what is left.
    filled = in_order(totals.withColumn("fullness", cap / F.col("weight")), [F.col("fullness"), F.col("sid")],
                      {"words": cap, "weights": F.col("weight")}, "mix-fullness")
    all_ = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(share * (all_["size"] or 0)) - F.col("words")) / (F.lit(all_["weight"] or 0.0) - F.col("weights"))
    open_ = filled.withColumn("level", level).where("fullness >= level").agg(F.min_by("level", F.struct("fullness", "sid"))).first()[0]
    reach = F.col("weight") * F.lit(open_) if open_ is not None else cap
    return filled.withColumn("target", F.least(cap, reach)).select("source", "sid", "source_size", "docs", "smallest", "target")


def balance(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-7, max_steps: int = 200) -> DataFrame:
    """Entropy balancing: (sid, lam, unit) such that documents taken at the rate
    min(2, exp(lam * size / unit)) hold the target words of their source.

    Of all rates between 0 and 2 that meet the token constraints, these are
    closest to 1 in relative entropy; lam is the constraint's dual variable.
    ``unit`` is the source's mean size. Each step is one distributed pass over
    the distinct (source, size) pairs with their counts: it sums the words
    taken and their derivative for all sources, and makes a Newton step of
    the convex dual, halving the bracket where Newton's step would leave it.
    Steps end when every source is within ``tolerance`` of its target, or no
    number lies between the ends of its bracket; if that takes more than ``max_steps``, an error says so.
    """
    cells = stored(sizes.where(F.col("size") > 0).groupBy("sid", "size").agg(F.count("*").alias("n")), "mix-cells")
    rate = F.least(F.lit(float(MAX_RATE)), F.exp(F.col("lam") * F.col("size") / F.col("unit")))
    ratio = F.col("target") / F.col("source_size")
    reach = F.col("unit") / F.col("smallest")
    state = targets.where((F.col("target") > 0)).select(
        "sid", "target", (F.col("source_size") / F.col("docs")).alias("unit"), "source_size", "smallest").select(
        "sid", "target", "unit", "source_size",
        F.when(ratio < 1, F.log(ratio) * reach).otherwise(0.0).alias("low"),
        F.when(ratio > 1, F.log(F.lit(float(MAX_RATE))) * reach).otherwise(0.0).alias("high"),
        F.when(ratio >= MAX_RATE, F.log(F.lit(float(MAX_RATE))) * reach).otherwise(F.log(ratio)).alias("lam"),
        (ratio >= MAX_RATE).alias("done"))
    sources = targets.count()
    state = stored(state.withColumn("lam", F.least(F.greatest("lam", "low"), "high")), "mix-state", sources)
    for _ in range(max_steps):
        open_ = state.where(~F.col("done"))
        words = F.col("n") * F.col("size") * rate
        # Rounded to integers, so that the order of summing doesn't matter.
        sums = (cells.join(small_side(open_, sources), "sid").groupBy("sid").agg(
            F.sum(F.round(words * 1000).cast("decimal(38,0)")).alias("words"),
            F.sum(F.when(rate < MAX_RATE, F.round(words * F.col("size") / F.col("unit") * 1000)).otherwise(0)
                  .cast("decimal(38,0)")).alias("slope")))
        sums = sums.select("sid", (F.col("words").cast("double") / 1000).alias("words"), (F.col("slope").cast("double") / 1000).alias("slope"))
        over = F.col("words") > F.col("target")
        near = F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (low + high) / 2
        step = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        near = near | (middle <= low) | (middle >= high)
        moved = open_.join(sums, "sid").select(
            "sid", "target", "unit", "source_size", low.alias("low"), high.alias("high"),
            F.when(near, F.col("lam")).otherwise(step).alias("lam"), near.alias("done"))
        state = stored(moved.unionByName(state.where("done")), "mix-state", sources)
        if not state.where(~F.col("done")).limit(1).count():
            return state.select("sid", "lam", "unit")
    raise ArithmeticError(f"the rates of some sources did not settle in {max_steps} steps")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken so that the sources reach their target words.

    A document's size is its number of words (a null text has none). Targets
    are those of ``source_targets``; ``balance`` gives each document its rate.
    Rates become whole copies by systematic rounding: within a source, in the
    order of falling size (ties by a hash of the id, then the id and the text), the
    running sum of the rates is rounded, and a document gets as many copies as
    the rounded sum rises. The words taken from a source then differ from its
    target by at most its largest document, and no rate of at most 2 gives
    more than 2 copies. The running sums are taken per range partition and
    joined by the partitions' totals, so a source or a size that holds most
    rows is spread over many tasks.

    Returns one row per input row: the id, ``text_md5``, ``size``,
    ``source``, ``source_size``, ``target``, ``rate``, ``copies`` and
    ``taken`` (copies x size), and the columns ``keys`` of the input. Null sources are one source. Documents without
    words keep one copy and take nothing. Repeated rows are rounded one by one.
    An empty table gives no rows.
    """
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_md5"),
                               F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *keys), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share), "mix-targets")
    n = targets.count()
    keyed = sizes.join(small_side(targets.select("source", "sid", "source_size", "target"), n),
                       sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    tilts = balance(keyed, targets)
    rate = F.coalesce(F.least(F.lit(MAX_RATE * MICRO), F.round(F.exp(F.col("lam") * F.col("size") / F.col("unit")) * MICRO)).cast("long"),
                      F.lit(MICRO))
    rated = keyed.join(small_side(tilts, n), "sid", "left").select(
        "id", "text_md5", "source", "size", "sid", "source_size", "target",
        F.when(F.col("size") > 0, rate).otherwise(MICRO).cast("long").alias("rate"), F.xxhash64("id").alias("h"), *keys)
    order = [F.col("size").desc(), F.col("h"), F.col("id"), F.col("text_md5")]
    rated = stored(rated.repartitionByRange(F.col("sid"), *order).withColumn("part", F.spark_partition_id()), "mix-order")
    per_part = rated.groupBy("sid", "part").agg(F.sum("rate").alias("rates"))
    before = per_part.withColumn("before", F.sum("rates").over(Window.partitionBy("sid").orderBy("part")) - F.col("rates")).drop("rates")
    before = stored(before, "mix-before")
    run = Window.partitionBy("part", "sid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("rate").over(run) + MICRO // 2
    copies = F.expr(f"upto div {MICRO} - (upto - rate) div {MICRO}")
    return (rated.join(small_side(before, before.count()), ["sid", "part"]).withColumn("upto", upto).withColumn("copies", copies)
            .select(F.col("id").alias(id_col), "text_md5", "size", F.col("source").alias("source"), "source_size", "target",
                    (F.col("rate") / MICRO).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *keys))


def take(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, with their own columns: each as often as ``mix`` takes it, so 0, 1 or 2 times."""
    rows = whole_rows(docs, "mix-rows", id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`"), source=F.col(f"`{source_col}`"))
    mixed = mix(rows, weights, share, "id", "text", "source", keys=("f", "r")).where("copies > 0").select("f", "r", F.col("copies").cast("int").alias("_copies"))
    taken = attach(rows.select("_row", "f", "r"), mixed)
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")
