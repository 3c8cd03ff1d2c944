"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a budget of words. A budget of q times the source's size takes every document
floor(q) times (complete epochs) and fills the rest with a weighted sample without replacement:
documents are put in ascending order of an exponential key, -ln(u) / weight with u a hash of the
document, and taken while their running sum of sizes stays nearest to the rest.

The running sum never puts a source into one task. A source's keys are cut into cells, twice the root
of the source's row count, or more, so that they have about CELL_ROWS documents at most; sizes are
summed by cell, the sums are accumulated over cells, and only the one cell that crosses the budget
is sorted. Keys are
laid out by the least weight, so that no cell has more than the ratio of the greatest weight to
LEAST_WEIGHT times CELL_ROWS documents, as expected; smaller weights than that change no result, but
crowd the last cells.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents
of size 0 are taken in complete epochs only for nothing (taken 0); rows alike in id, size and text
are interchangeable and share one decision; an empty table gives no rows; other columns don't
matter, whatever their names. Texts of any length count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import rule_ledger
from tessera.llm.common import let, materialise, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
CELL_ROWS = 4096
LEAST_WEIGHT = 0.25
#: The plan has a row a source and is broadcast; more sources than this are an error.
MOST_SOURCES = 50_000
SEED = 42


def quality_weight(text: Column, n_words: Column) -> Column:
    """Weight of a document in the sample, from LEAST_WEIGHT to 1: how far it stays from the limits of the
    quality rules (rule_ledger.RULES) on length, symbols, repeated lines and capitals."""
    text = F.coalesce(text, F.lit(""))
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)))
    m, lines = rule_ledger.counts(text), rule_ledger.line_counts(text)
    repeated = let(lines, lambda x: share(2 * x.getField("dup"), x.getField("n")))
    clean = (1 - share(4 * m["n_symbols"], n_words)) * (1 - repeated) * (1 - share(2 * m["n_upper"], m["word_chars"]))
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * clean * F.least(F.lit(1.0), n_words / 20)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Words to take from each source. sizes: (source, words); one entry a source.

    Weights are dealt in code point order of the names, null last. What a target has above `most`
    times its source's size is dealt again by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size = dict(order)
    left, open_, found = share * sum(size.values()), [name for name, _ in order], {}
    while open_:
        total = sum(weight[x] for x in open_)
        over = [x for x in open_ if left * weight[x] / total > most * size[x]]
        if not over:
            found |= {x: left * weight[x] / total for x in open_}
            break
        for x in over:
            found[x] = most * size[x]
        left -= sum(found[x] for x in over)
        open_ = [x for x in open_ if x not in over]
    return found


def _narrow(docs: DataFrame, id_col: str, text: str, source: str, weight: Column | None, seed: int) -> DataFrame:
    """docs, each row in a struct `doc`, with what its decision rests on."""
    row = docs.select(F.struct("*").alias("doc"))
    body = F.col("doc").getField(text)
    if weight is None:
        weight = quality_weight(body, F.col("size"))
    draw = F.xxhash64(F.lit(seed), F.col("doc").getField(id_col), F.coalesce(body, F.lit("")))
    row = row.select(
        "doc",
        F.col("doc").getField(id_col).alias("doc_id"),
        F.size(words(body)).cast("long").alias("size"),
        F.col("doc").getField(source).alias("source"),
        draw.alias("draw"),
    ).withColumn("weight", weight.cast("double"))
    # u in (0, 1); 1 - u ** (LEAST_WEIGHT / weight) orders as the exponential key does, stays in (0, 1)
    # and is uniform for the least weight, denser at the lower end by weight / LEAST_WEIGHT at most
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return row.withColumn("place", 1 - F.pow(u, LEAST_WEIGHT / F.col("weight")))


_ORDER = ("place", "doc_id", "size", "draw")


def _plan(narrow: DataFrame, weights, share: float, most: float) -> DataFrame:
    """One row a source: source_size, target, epochs and cut, the last document sampled (null: none)."""
    spark = narrow.sparkSession
    found = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: their plan isn't sent to every task")
    sums = [(r["source"], r["size"], r["n"]) for r in found]
    aims = targets([(name, size) for name, size, _ in sums], weights, share, most)
    plan = spark.createDataFrame(
        [(name, size, aims[name], *_epochs(aims[name], size), max(1, n // CELL_ROWS, 2 * math.isqrt(n))) for name, size, n in sums],
        "name string, source_size long, target double, epochs int, rest double, cells long",
    )
    same = F.col("source").eqNullSafe(F.col("name"))
    at = narrow.join(F.broadcast(plan), same).filter("rest > 0")
    at = at.withColumn("cell", F.least(F.floor(F.col("place") * F.col("cells")), F.col("cells") - 1))
    cells = at.groupBy("source", "cell", "rest").agg(F.sum("size").alias("in_cell"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("below", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    # the cell in which each source's running sum passes the rest
    crossing = cells.filter((F.col("below") < F.col("rest")) & (F.col("below") + F.col("in_cell") >= F.col("rest")))
    crossing = crossing.select(F.col("source").alias("crossed"), F.col("cell").alias("crossing"), "below")
    inside = at.join(F.broadcast(crossing), F.col("source").eqNullSafe(F.col("crossed")) & (F.col("cell") == F.col("crossing")))
    running = Window.partitionBy("source").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.col("below") + F.sum("size").over(running))
    # the document that crosses is taken if that comes nearer
    taken = inside.filter(F.col("sum") - F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max(F.struct(*_ORDER)).alias("last"))
    # if a cell's first document stays out, the cut is the cell's lower edge
    edge = crossing.join(last, F.col("crossed").eqNullSafe(F.col("source")), "left").select("crossed", "crossing", "last")
    return plan.join(edge, F.col("name").eqNullSafe(F.col("crossed")), "left").drop("crossed", "rest")


def _decided(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    at = narrow.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    cell = F.least(F.floor(F.col("place") * F.col("cells")), F.col("cells") - 1)
    within = F.coalesce(F.struct(*_ORDER) <= F.col("last"), F.lit(False))
    sampled = F.coalesce((cell < F.col("crossing")) | ((cell == F.col("crossing")) & within), F.lit(False))
    return at.withColumn("sampled", sampled).withColumn("copies", F.col("epochs") + F.col("sampled").cast("int"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, weight: Column | None = None
) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, weight, epochs (complete
    ones), sampled (in the fractional selection), taken (words, repeats counted)."""
    narrow = materialise(_narrow(docs, id_col, text, source, weight, seed).drop("doc"))
    decided = _decided(narrow, _plan(narrow, weights, share, most))
    return decided.select("doc_id", "size", "source", "source_size", "target", "weight", "epochs", "sampled", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, weight: Column | None = None
) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken, its columns unchanged.

    A row's part in the mix follows from its own columns and its source's plan, so texts stay where
    they are.
    """
    full = _narrow(docs, id_col, text, source, weight, seed)
    plan = _plan(materialise(full.drop("doc")), weights, share, most)
    decided = _decided(full, plan)
    return decided.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def _epochs(target: float, size: int) -> tuple[int, float]:
    epochs = int(target // size) if size else 0
    return epochs, max(0.0, target - epochs * size)
