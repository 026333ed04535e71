"""Mixing sources to target weights by capped water-filling.

A source's target is its share of the budget by weight, stopped at `max_epochs` times its size; what
a stopped source leaves goes to the others by weight until none is above. That fixed point is
min(cap, level * weight), with the level found by prefix sums over the sources in the order in
which they stop, so sources are never collected.

A source's target is met by whole repetitions of all its documents and a seeded sample for the
fraction: documents in the order of a seeded hash of id and text, taken up to the place where the
running size is nearest to what is left. That place is found by sums in levels (4096 hash ranges of a
source, 4096 of the one range in which the sample ends, then that range's places), so that a source with
most of the rows is no single task, and is applied to documents as one comparison with their source's row of the
plan. Rows of the same id and text have the same place and are as good as each other; where the
sample ends among them, as many as it needs are counted off: whole tasks' rows, then those of one task.

Results in special cases: a null text has size 0, a null source is a source of its own, after the
others; sources without any word have target 0; repeated rows and rows without an id are documents each,
of which a sample takes as many as bring it nearest to its target; an empty table gives an empty mix;
columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import keep_written, scratch, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources, in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The budget as a share of all words.
BUDGET = 1.5
MAX_EPOCHS = 2
#: Leading hex digits of a place that make a range, level by level.
LEVELS = (3, 6)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds weight, cap and target (a double).

    Sources are few beside documents; the windows here are over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    # Sources stop in the order of cap / weight. Source i stops if the level at which it stops is
    # reached: caps of those before it, plus that level times the weights from it on, fit the budget.
    stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = stop.rowsBetween(Window.unboundedPreceding, -1)
    here = stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.lit(float(budget)) * F.sum("source_size").over(whole))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(here))
        .withColumn("stops", F.col("caps") + F.col("cap") / F.col("weight") * F.col("rest") <= F.col("total"))
        .withColumn("level", F.max(F.when(~F.col("stops"), (F.col("total") - F.col("caps")) / F.col("rest"))).over(whole))
    )
    return ranked.select("source", "source_size", "weight", "cap", F.when(F.col("stops") | F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def seeded_order(seed: int) -> Column:
    """A document's place in its source's order: hex of md5 over seed, id and text."""
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sized: source, size, place of each document.

    Per source, named s: source_size, target, whole (repetitions of all), cut (places up to it are taken
    once more; null: none), and at (of the documents at the cut itself only so many; null: all).
    """
    known = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    known = known.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    known = written(known.select(F.col("source").alias("s"), "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("part")), "targets")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # The one range of a source in which its sample ends; only that range is looked into further.
    edge = known.filter("part > 0").select("s", F.lit("").alias("r"), F.lit(0).cast("long").alias("before"), "part")
    inside = sized.select("source", "size", "place")
    for digits in LEVELS:
        inside = inside.select("source", "size", "place").join(edge, same("source", "s") & F.col("place").startswith(F.col("r")))
        sums = inside.groupBy("s", "part", "before", F.substring("place", 1, digits).alias("r")).agg(F.sum("size").alias("size"))
        upto = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", upto).filter((F.col("before") <= F.col("part")) & (F.col("before") + F.col("size") > F.col("part")))
        edge = written(sums.select("s", "r", "before", "part"), "edges")
    ends = inside.select("source", "size", "place").join(edge, same("source", "s") & F.col("place").startswith(F.col("r")))
    ends = ends.groupBy("s", "r", "before", "part", "place").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.sum("size").alias("sum"))
    inside = Window.partitionBy("s", "r").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("part") - F.col("before") - F.coalesce(F.sum("sum").over(inside), F.lit(0))
    # Of the documents at a place, all of one size, those whose middle lies within what is left.
    ends = ends.filter("size > 0").withColumn("take", F.least(F.greatest(F.floor(left / F.col("size") + 0.5), F.lit(0)), F.col("n")))
    cuts = ends.groupBy("s", "r").agg(F.max_by(F.struct("place", F.when(F.col("take") < F.col("n"), F.col("take").cast("long")).alias("at")), F.when(F.col("take") > 0, F.col("place"))).alias("last"))
    cuts = cuts.select(F.col("s").alias("c"), F.coalesce("last.place", "r").alias("cut"), F.col("last.at").alias("at"))
    return written(known.join(cuts, same("s", "c"), "left").select("s", "source_size", "target", "whole", "cut", "at"), "plan")


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), seeded_order(seed).alias("place"))


def _counted_off(rows: DataFrame, by: str, at: str, more: str) -> DataFrame:
    """rows with column `more`: 1 for as many rows of each value of `by` (which may be null) as `at` says, else 0."""
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "ties")
    task = F.shiftright("_row", 33)
    tasks = numbered.groupBy(F.col(by).alias("_by"), task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_by").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = numbered.join(F.broadcast(tasks) if tasks.limit(SMALL + 1).count() <= SMALL else tasks, F.col(by).eqNullSafe(F.col("_by")) & (task == F.col("_task")))
    nth = F.row_number().over(Window.partitionBy("_by", "_task").orderBy("_row"))
    return joined.withColumn(more, (F.col("_before") + nth <= F.col(at)).cast("long")).drop("_row", "_by", "_task", "_before")


#: Rows up to which a table is broadcast.
SMALL = 100_000


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (of its source), times (how often it is taken), taken (times * size)."""
    with scratch(docs.sparkSession):
        rows = written(sized(docs, seed), "sizes")
        out = _with_times(rows, plan(rows, weights, budget, max_epochs), F.col("place"), "")
        return keep_written(out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")), "mix")


def _with_times(rows: DataFrame, known: DataFrame, place: Column, mark: str) -> DataFrame:
    """rows with their source's row of the plan and `times`, all of these names beginning with `mark`."""
    c = lambda name: F.col(f"`{mark}{name}`")
    ties = not known.filter(F.col("at").isNotNull()).isEmpty()
    known = known.withColumnsRenamed({n: mark + n for n in known.columns})
    joined = rows.join(known, F.col("source").eqNullSafe(c("s")))
    tie = F.coalesce((place == c("cut")) & c("at").isNotNull(), F.lit(False))
    plain = joined.filter(~tie) if ties else joined
    plain = plain.withColumn(f"{mark}times", c("whole") + F.coalesce((place <= c("cut")).cast("long"), F.lit(0)))
    if not ties:
        return plain
    # A source's sample ends at one place, so its rows there are the same.
    counted = _counted_off(joined.filter(tie), f"{mark}s", f"{mark}at", f"{mark}more")
    return plain.unionByName(counted.withColumn(f"{mark}times", c("whole") + c("more")).drop(f"{mark}more"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    mark = "mix_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    with scratch(docs.sparkSession):
        known = plan(written(sized(docs, seed), "sizes"), weights, budget, max_epochs)
        out = _with_times(docs, known, seeded_order(seed), mark).filter(F.col(f"{mark}times") > 0)
        out = out.withColumn(f"{mark}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{mark}times"))))
        return keep_written(out.select(*[F.col(f"`{c}`") for c in docs.columns]), "mixed")
