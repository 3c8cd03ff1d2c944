"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes cuts a text wherever its value is of the form
3 * 2^k * j - 1; each chunk gives one character of the signature, so an edit changes the characters
near it and leaves the others. k follows the text's length: the block size 3 * 2^k is the least
with LENGTH blocks to the text or fewer, halved while it gives less than LENGTH / 4 chunks, and a
second signature of half the length is made at twice
the block size, so that texts of different lengths have block sizes in common. A fingerprint is
`block size:signature:second signature`; two of them are compared at their common block sizes by
an edit distance of insertions and deletions.

All trigger positions of a text come from one vector pass, whatever the block sizes tried; edit
distances are computed bit-parallel for many pairs at once.

Defined results: a null text counts as empty; an empty text has the fingerprint "3::"; texts of any
length are hashed whole (in a text that repeats itself, where one window cuts at every turn, only
every so many cuts end a chunk); equal texts have equal fingerprints; repeated rows follow one
another in the order of ids, each with a row of its own; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.textbytes import power_tables, mix

WINDOW = 7
LENGTH = 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
#: Signatures without a common run of this length (a quarter of the shorter, at most) are unlike.
RUN = 4
_PIECE = 1 << 19

_random = np.random.Generator(np.random.PCG64(23))
_ROLL = _random.integers(1, 1 << 32, (WINDOW, 256), dtype=np.uint32)
_ROLL[:, 0] = 0  # the zeros before a text add nothing
_CHUNK = _random.integers(1, 1 << 64, 256, dtype=np.uint64)


def _triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which some block size cuts, and the largest k of each."""
    roll = _ROLL[0][data]
    for j in range(1, WINDOW):
        roll[j:] ^= _ROLL[j][data[: len(data) - j]]
    roll ^= roll >> np.uint32(16)
    roll *= np.uint32(0x7FEB352D)
    roll ^= roll >> np.uint32(15)
    at = np.flatnonzero(roll % np.uint32(3) == 2)
    after = roll[at].astype(np.uint64) + np.uint64(1)
    lowest = after & (~after + np.uint64(1))
    return at, (np.frexp(lowest.astype(np.float64))[1] - 1).astype(np.int8)


def fingerprints(texts: list[bytes]) -> list[str]:
    """A fingerprint of each text."""
    pad = bytes(WINDOW)
    data = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    at, level = _triggers(data)
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CHUNK[data] * up[: len(data)], out=sums[1:])

    def signature(begin: int, end: int, cuts: np.ndarray, most: int) -> str:
        if len(cuts) >= 2 * most:
            # a text that repeats itself cuts too often or not at all: then by several cuts at once
            cuts = cuts[:: -(-len(cuts) // most)]
        ends = cuts[: most - 1] + 1
        ends = ends if len(ends) and ends[-1] == end else np.append(ends, end)
        starts = np.concatenate([[begin], ends[:-1]])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        return LETTERS[(hashes & np.uint64(63)).astype(np.intp)].tobytes().decode()

    out, begin = [], WINDOW
    for text in texts:
        end = begin + len(text)
        if not text:
            out.append("3::")
        else:
            a, b = np.searchsorted(at, (begin, end))
            places, levels = at[a:b], level[a:b]
            # how many cuts there are at each k and above
            cuts = np.bincount(levels, minlength=34)[::-1].cumsum()[::-1]
            k = max(0, (len(text) - 1) // (3 * LENGTH)).bit_length()
            while k and cuts[k] < LENGTH // 4:
                k -= 1
            one = signature(begin, end, places[levels >= k], LENGTH)
            two = signature(begin, end, places[levels > k], LENGTH // 2)
            out.append(f"{3 << k}:{one}:{two}")
        begin = end + WINDOW
    return out


def _likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """1 - edit distance / total length, for pairs of signatures; 0 without a common run."""
    left = np.zeros((len(pairs), LENGTH), dtype=np.uint8)
    right = np.full((len(pairs), LENGTH), 255, dtype=np.uint8)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = np.frombuffer(a.encode(), np.uint8)
        right[i, : len(b)] = np.frombuffer(b.encode(), np.uint8)
    n, m = (left != 0).sum(axis=1), (right != 255).sum(axis=1)
    one = np.uint64(1)
    rest = np.full(len(pairs), ~np.uint64(0))
    runs = [np.zeros(len(pairs), dtype=np.uint64) for _ in range(RUN)]
    longest = np.zeros(len(pairs), dtype=np.int64)
    for j in range(int(m.max(initial=0))):
        same = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        both = rest & same
        rest = (rest + both) | (rest - both)
        runs = [same, *((r << one) & same for r in runs[:-1])]
        for length, r in enumerate(runs, 1):
            longest[(r != 0) & (longest < length)] = length
    common = np.unpackbits((~rest).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64) if len(pairs) else n
    needed = np.clip(np.minimum(n, m) // 4, 1, RUN)
    return np.where(longest >= needed, 2 * common / np.maximum(n + m, 1), 0.0)


def compare(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness of pairs of fingerprints, from 0 to 1; 1 for equal ones."""
    out = np.zeros(len(pairs))
    work: list[tuple[int, str, str]] = []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = 1.0
            continue
        (size, one, two), (other, first, second) = a.split(":"), b.split(":")
        size, other = int(size), int(other)
        if size == other:
            work += [(i, one, first), (i, two, second)]
        elif size == 2 * other:
            work.append((i, one, second))
        elif other == 2 * size:
            work.append((i, two, first))
    work = [x for x in work if x[1] and x[2]]
    if work:
        np.maximum.at(out, [x[0] for x in work], _likeness([x[1:] for x in work]))
    return out


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str], prints: list[str], next_prints: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    changed_prints = fingerprints(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
            pa.array(prints, pa.string()), pa.array(changed_prints, pa.string()),
            pa.array(compare(list(zip(prints, changed_prints, strict=True)))), pa.array(compare(list(zip(prints, next_prints, strict=True)))),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, guard, doc_id, text) in order: each but the guards with the row after it."""
    held: list[tuple] = []  # (run, guard, doc_id, text, fingerprint); the first may be done already

    def done() -> pa.RecordBatch | None:
        fresh = [i for i, x in enumerate(held) if x[4] is None]
        for i, found in zip(fresh, fingerprints([held[i][3].encode() for i in fresh]), strict=True):
            held[i] = (*held[i][:4], found)
        pairs = [(a, b) for a, b in zip(held, held[1:]) if a[0] == b[0] and not a[1]]
        del held[:-1]
        if pairs:
            a, b = zip(*pairs, strict=True)
            return _rows([x[2] for x in a], [x[3] for x in a], [x[3] for x in b], [x[4] for x in a], [x[4] for x in b])
        return None

    size = 0
    for batch in batches:
        for run, guard, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append((run, guard, doc, text, None))
            size += len(text)
            if size > _PIECE:
                size = 0
                if (out := done()) is not None:
                    yield out
    if held and (out := done()) is not None:
        yield out


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = part.column(1).to_pylist()
            yield _rows(part.column(0).to_pylist(), texts, [""] * len(texts), fingerprints([t.encode() for t in texts]), ["3::"] * len(texts))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its end from the next document in ascending order of (id, text hash);
    after the last comes the first. A document without an id has no place in that order and an
    empty text after it.

    Texts are moved once: ids are cut into runs at quantiles, a run's first document is also sent
    to the run before it, and a run's rows meet their successors in one sorted pass. What the
    driver holds is a cut a run.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    placed = narrow.filter("doc_id is not null")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = 4 * partitions
    ids = placed.select(F.col("doc_id").cast("double").alias("at"))
    cuts = np.unique(ids.approxQuantile("at", [i / runs for i in range(1, runs)], 0.25 / runs))

    @F.pandas_udf("int")
    def run_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), "right").astype(np.int32))

    firsts = sorted((r["run"], r["first"]) for r in placed.groupBy(run_of(F.col("doc_id").cast("double")).alias("run")).agg(F.min("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    heads = np.array(sorted(before), dtype=np.int64)
    heads_before = np.array([before[int(x)] for x in heads], dtype=np.int32)

    @F.pandas_udf("int")
    def run_before(doc: pd.Series) -> pd.Series:
        values = doc.to_numpy()
        at = np.minimum(np.searchsorted(heads, values), len(heads) - 1)
        return pd.Series(np.where(heads[at] == values, heads_before[at], -1).astype(np.int32))

    at = placed.withColumn("run", run_of(F.col("doc_id").cast("double"))).withColumn("before", run_before("doc_id"))
    own, guard = F.struct(F.col("run"), F.lit(0).alias("guard")), F.struct(F.col("before").alias("run"), F.lit(1).alias("guard"))
    at = at.select("doc_id", "text", F.explode(F.when(F.col("before") >= 0, F.array(own, guard)).otherwise(F.array(own))).alias("to"))
    at = at.select("to.run", "to.guard", "doc_id", "text").repartition(partitions, "run")
    at = at.sortWithinPartitions("run", "guard", "doc_id", F.xxhash64("text"))
    linked = at.mapInArrow(_ring, _OUT)
    return linked.unionByName(narrow.filter("doc_id is null").mapInArrow(_alone, _OUT))
