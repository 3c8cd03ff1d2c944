"""Quality rules as a bitmask ledger.

Each rule is evaluated once for a document; its failure becomes one bit of `failed`, next to the
measurements it was decided on. A policy is a named, versioned mask over those bits: applying one,
comparing two or taking a rule out (an ablation) are bitwise operations on the ledger and never
look at a text again.

Everything here is DataFrame expressions: a document is judged inside its own row, without a
shuffle. Repeated 8-word windows are found by hashing windows (three rounds of pairing: 2, 4, 8
words) and comparing the words themselves where two hashes agree.

Defined results: a null text counts as an empty one (no words, fails `short`); texts of any length
are judged whole; rows that repeat are judged each for itself; other columns pass through,
whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, let, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    #: From measured columns to a boolean Column that is true where a document fails.
    fails: object


#: The order fixes the bits. Append only: stored ledgers keep their meaning.
RULES = (
    Rule("short", lambda m: m.n_words < 20),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
    Rule("symbols", lambda m: 4 * m.n_symbols > m.n_words),
    Rule("word_length", lambda m: (m.word_chars > 15 * m.n_words) | (m.word_chars < 2 * m.n_words)),
    Rule("dup_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule("shouting", lambda m: 2 * m.n_upper > m.word_chars),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versioned policies; a document is kept if none of the policy's bits is set.
POLICIES = {
    "base.v1": BIT["short"] | BIT["repeats"],
    "web.v1": BIT["short"] | BIT["repeats"] | BIT["symbols"] | BIT["dup_lines"],
    "web.v2": (1 << len(RULES)) - 1,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


class _Measured:
    def __init__(self, source: Column):
        self._source = source

    def __getattr__(self, name: str) -> Column:
        return self._source.getField(name)


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _pairs(hashes: Column, distance: int) -> Column:
    """Hash of the values at i and i + distance; the last `distance` entries have no meaning."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(distance + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _beside(items: Column, field: str) -> Column:
    """Those structs of a sorted array whose field equals a neighbour's."""
    return F.filter(
        items,
        lambda x, i: F.coalesce(F.get(items, i - 1).getField(field) == x.getField(field), F.lit(False))
        | F.coalesce(F.get(items, i + 1).getField(field) == x.getField(field), F.lit(False)),
    )


def _covered(tokens: Column, windows: Column) -> Column:
    """Words inside windows that occur twice or more, given the windows' hashes."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spelled = let(
        by_hash,
        lambda s: F.sort_array(
            F.transform(
                _beside(s, "h"),
                lambda x: F.struct(F.array_join(F.slice(tokens, x.getField("i") + 1, WINDOW), " ").alias("w"), x.getField("i").alias("i")),
            )
        ),
    )
    places = let(spelled, lambda s: F.sort_array(F.transform(_beside(s, "w"), lambda x: x.getField("i"))))
    return F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a.getField("n") + F.least(F.lit(WINDOW), x - a.getField("last"))).alias("n")),
        lambda a: a.getField("n").cast("long"),
    )


def line_counts(text: Column) -> Column:
    """struct(n, dup): lines with a word, and those equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def counts(text: Column) -> dict[str, Column]:
    """The measurements that need no word windows, of a text that isn't null."""
    return {
        "word_chars": F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
        "n_symbols": _removed(text, r"[#*$%&|<>]+"),
        "n_upper": _removed(text, r"\p{Lu}+"),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with two more columns: `measured` (a struct of MEASURES) and `failed` (rule bits).

    Where docs has columns of those names already, the new ones replace them.
    """
    row = docs.select(F.struct("*").alias("doc"))
    row = row.withColumn("text", F.coalesce(F.col("doc").getField(text), F.lit("")))
    row = row.withColumn("words", words(F.col("text")))
    row = row.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    row = row.withColumn("h2", _pairs(F.col("h1"), 1)).drop("h1")
    row = row.withColumn("h4", _pairs(F.col("h2"), 2)).drop("h2")
    row = row.withColumn("h8", _pairs(F.col("h4"), 4)).drop("h4")
    row = row.withColumn("h8", F.slice("h8", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    measured = counts(F.col("text")) | {
        "n_words": F.size("words").cast("long"),
        "n_lines": F.col("line_counts").getField("n"),
        "n_dup_lines": F.col("line_counts").getField("dup"),
        "n_repeat_words": F.when(
            F.size(F.array_distinct("h8")) < F.size("h8"), _covered(F.col("words"), F.col("h8"))
        ).otherwise(F.lit(0).cast("long")),
    }
    row = row.withColumn("line_counts", line_counts(F.col("text")))
    # as a generator's output, so that a filter on the verdict isn't pushed below the measuring and
    # doesn't measure again for every rule it names
    row = row.select("doc", F.explode(F.array(F.struct(*[measured[m].alias(m) for m in MEASURES]))).alias("measured"))
    bits = F.lit(0)
    for rule in RULES:
        bits = bits + F.when(rule.fails(_Measured(F.col("measured"))), F.lit(BIT[rule.name])).otherwise(F.lit(0))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("measured", "failed")]
    return row.select(*kept, "measured", bits.cast("long").alias("failed"))


def apply_policy(ledgered: DataFrame, policy: str) -> Column:
    """True where a ledger row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(ledgered: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that it alone rejects.

    One pass: documents are counted by failure mask (at most 2^rules groups), then each rule's
    figures are sums over masks.
    """
    mask = POLICIES[policy]
    masks = ledgered.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).alias("bit")) for r in RULES if BIT[r.name] & mask]))
    each = masks.select("mask", "n", rules.alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )
