"""Dropping lines whose template recurs across documents.

A line is parsed by a log-template tree of fixed depth: the root branches by token count, the next
LEADING levels by the leading tokens, tokens with a digit standing for a variable field everywhere.
In a leaf, lines that agree in SIMILAR of their positions form one template whose other positions
are variable, too. A template found in MIN_DOCS documents or more is dropped from all but the first
of them (by id), which keeps it.

How it is laid out: a line travels as hashes (its leaf, its masked self), so counting moves a few
dozen bytes a line. Only leaves with several different lines send tokens on, as 32-bit codes (two
different tokens look alike in one of 4 * 10^9 comparisons).
Templates form in a task as if it had the whole leaf. A leaf of more than BLOCK different lines is
cut without loss: a line joins a template only if it agrees in SIMILAR of its positions with every
line of it, and lines that do so have one of segments() in common; so lines that no chain of common
segments connects never share a template, and each connected part is a group of its own. Such a
part is one task's work. Texts move once, to meet the line numbers they lose.

Defined results: null texts stay null, empty ones empty; lines of fewer than MIN_TOKENS words are
never dropped; repeated rows of one id and text count as one document; a null id is last in the order; an empty
table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches
from tessera.llm.components import components
from tessera.llm.textbytes import mix, word_bounds, word_hashes

LEADING = 3
SIMILAR = 0.75
MIN_TOKENS = 3
MIN_DOCS = 3
#: Shorter lines are equal if the tree's path is.
SHORTEST = LEADING + 1
BLOCK = 1024
#: In how many parts the lines of a leaf meet what is known of the leaf.
SALTS = 64
#: Up to so many templates are compared one and all; beyond, those that a segment finds.
SCANNED = 64

_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_DIGIT = re.compile(rb"[0-9]").search


def parse(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, masked, tokens, token hashes, first token) of lines: the tree's path and the masked
    line as 64-bit hashes, how many tokens there are, and the tokens of all lines in a row."""
    masked = [_FIELD.sub(b"<*>", x) if _DIGIT(x) else x for x in lines]
    data, offsets = np.frombuffer(b"".join(masked), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in masked], dtype=np.int64)])
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    count = np.diff(first)
    leaf = mix(count.astype(np.uint64) + np.uint64(1))
    for j in range(LEADING):
        has = count > j
        leaf[has] = mix(leaf[has] + hashes[first[:-1][has] + j])
    # position-dependent sum, so that the order of tokens counts
    place = np.arange(len(hashes)) - np.repeat(first[:-1], count)
    spread = mix(hashes + mix(place.astype(np.uint64) + np.uint64(7)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    whole = mix(sums[first[1:]] - sums[first[:-1]] + count.astype(np.uint64))
    return leaf.view(np.int64), whole.view(np.int64), count, hashes, first


def _lines(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple]:
    """(keys, line numbers, parsed) of blocks of lines of MIN_TOKENS words or more."""

    def out() -> tuple:
        leaf, whole, count, hashes, first = parse(lines)
        return np.array(keys, dtype=np.int64), np.array(numbers, dtype=np.int32), leaf, whole, count, hashes, first

    lines, keys, numbers, size = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, line in enumerate(text.encode().split(b"\n")):
                lines.append(line)
                keys.append(key)
                numbers.append(i)
                size += len(line)
            if size > most:
                yield out()
                lines, keys, numbers, size = [], [], [], 0
    if lines:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, numbers, leaf, whole, count, _, _ in _lines(batches):
        keep = count >= MIN_TOKENS
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (keys, numbers, leaf, whole)], names=["key", "line", "leaf", "masked"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """leaf, masked and tokens (32-bit codes) of lines that may be generalised, once a block."""
    for _, _, leaf, whole, count, hashes, first in _lines(batches):
        codes = (hashes >> np.uint64(32)).astype(np.uint32)
        _, once = np.unique(whole, return_index=True)
        keep = [i for i in once.tolist() if count[i] >= SHORTEST]
        tokens = [codes[first[i] : first[i + 1]].tobytes() for i in keep]
        yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array(whole[keep]), pa.array(tokens, pa.binary())], names=["leaf", "masked", "tokens"])


def segments(width: int) -> list[tuple[int, int]]:
    """Begin and end of segments of the positions behind the leading ones: one more than the
    positions in which lines of a template may differ, so two lines of it have one in common."""
    n = width - math.ceil(SIMILAR * width) + 1
    rest = width - LEADING
    return [(LEADING + rest * i // n, LEADING + rest * (i + 1) // n) for i in range(n)]


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, masked, tokens) -> (masked, segment), segment being a hash of the leaf, the
    segment's place and its tokens."""
    for batch in batches:
        rows, keys = [], []
        for leaf, masked, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cuts = segments(len(tokens) // 4)
            keys += [hashlib.blake2b(b"%d %d " % (leaf, i) + tokens[4 * a : 4 * b], digest_size=8).digest() for i, (a, b) in enumerate(cuts)]
            rows += [masked] * len(cuts)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.frombuffer(b"".join(keys), dtype=np.int64))], names=["masked", "segment"])


def form_templates(tokens: np.ndarray) -> np.ndarray:
    """The number of the template that each line belongs to, lines taken in order.

    tokens: (lines, positions) of a leaf. A line joins the template with which it shares most
    positions, the first of those, if they are SIMILAR of all; positions that differ become
    variable.
    """
    n, width = tokens.shape
    member = np.zeros(n, dtype=np.int64)
    form, still = np.empty_like(tokens), np.ones(tokens.shape, dtype=bool)
    cuts = segments(width) if n > SCANNED else []
    filed: dict[tuple[int, bytes], list[int]] = {}
    found = 0
    for i in range(n):
        parts = [(j, tokens[i, a:b].tobytes()) for j, (a, b) in enumerate(cuts)]
        if found > SCANNED:
            few = np.array(sorted({t for x in parts for t in filed.get(x, ())}), dtype=np.int64)
        else:
            few = np.arange(found)
        if len(few):
            alike = ((form[few] == tokens[i]) & still[few]).sum(axis=1)
            at = int(alike.argmax())
            if alike[at] >= SIMILAR * width:
                best = int(few[at])
                member[i] = best
                still[best] &= form[best] == tokens[i]
                continue
        form[found] = tokens[i]
        for x in parts:
            filed.setdefault(x, []).append(found)
        member[i] = found
        found += 1
    return member


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, block, masked, tokens) in order of (leaf, block, length, masked) -> (masked,
    template) of those that share a template, which is named by its first line."""

    def out(run: list[tuple]) -> pa.RecordBatch:
        member = form_templates(np.stack([np.frombuffer(x[3], dtype=np.uint32) for x in run]))
        shared = np.bincount(member)[member] > 1
        _, first = np.unique(member, return_index=True)
        masked = np.array([x[2] for x in run], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(masked[shared]), pa.array(masked[first][member][shared])], names=["masked", "template"])

    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            # lines of a leaf have as many tokens; a clash of leaf hashes is kept apart
            if run and (row[:2] != run[0][:2] or len(row[3]) != len(run[0][3])):
                yield out(run)
                run = []
            run.append(row)
    if run:
        yield out(run)


def _marked(coded: DataFrame) -> DataFrame:
    """coded with large: whether its leaf has more than BLOCK different lines. Lines meet their leaf's
    mark by leaf and salt, so that the lines of one leaf are spread over SALTS tasks."""
    many = coded.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    many = many.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("large"))
    salted = coded.withColumn("salt", F.pmod("masked", F.lit(SALTS)).cast("int"))
    return salted.join(many, ["leaf", "salt"], "left").select(*coded.columns, F.coalesce("large", F.lit(False)).alias("large"))


def _grouped(coded: DataFrame) -> DataFrame:
    """coded with block: lines of a leaf in different blocks share no template. Of large leaves,
    lines that have no segment in common with another go."""
    marked = materialise(_marked(coded))
    large, small = (marked.filter(x).drop("large") for x in ("large", "not large"))
    small = small.withColumn("block", F.lit(0).cast("long"))
    keyed = materialise(large.mapInArrow(_segmented, "masked long, segment long"))
    if keyed.isEmpty():
        return small
    least = keyed.groupBy("segment").agg(F.min("masked").alias("v"))
    edges = keyed.join(least, "segment").select(F.col("masked").alias("u"), "v").filter("u <> v").distinct()
    part = components(edges).select(F.col("node").alias("masked"), F.col("root").alias("block"))
    return small.union(large.join(part, "masked").select(*small.columns))


def generalised(keyed: DataFrame, hashed: DataFrame) -> DataFrame:
    """(masked, template) of the lines that share a template with a different line."""
    # leaves with two different lines or more
    leaves = hashed.groupBy("leaf").agg(F.min("masked").alias("a"), F.max("masked").alias("b")).filter("a <> b").select("leaf")
    coded = keyed.mapInArrow(_coded, "leaf long, masked long, tokens binary").join(leaves, "leaf", "left_semi")
    coded = materialise(coded.groupBy("leaf", "masked").agg(F.first("tokens").alias("tokens")))
    at = _grouped(coded).select("leaf", "block", "masked", "tokens")
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = at.repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", F.length("tokens"), "masked")
    return materialise(at.mapInArrow(_grown, "masked long, template long").distinct())


def recurring(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, lines): numbers of the lines each document loses. keyed: key, text, doc_id."""
    texts = keyed.select("key", "text")
    hashed = materialise(texts.mapInArrow(_hashed, "key long, line int, leaf long, masked long"))
    same = generalised(texts, hashed)
    lines = hashed.select("key", "line", "masked").join(same, "masked", "left").select("key", "line", F.coalesce("template", "masked").alias("template"))
    lines = lines.distinct()
    order = keyed.select("key", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("key")).alias("place")).distinct()
    held = lines.select("template", "key").distinct()
    common = held.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("template")
    held = held.join(common, "template")
    first = held.join(order, "key").groupBy("template").agg(F.min("place").alias("place")).select("template", F.col("place.key").alias("keeper"))
    lost = lines.join(first, "template").filter("key <> keeper")
    return lost.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` less the lines dropped, and n_lines and n_dropped (replaced if there)."""
    small_batches(docs.sparkSession)
    row = docs.select(F.struct("*").alias("doc"))
    row = row.select("doc", F.xxhash64(F.col("doc").getField(id_col), F.col("doc").getField(text)).alias("key"))
    whole = F.coalesce(F.col("doc").getField(text), F.lit(""))
    keyed = row.select("key", whole.alias("text"), F.col("doc").getField(id_col).alias("doc_id"))
    lost = recurring(keyed, min_docs)
    joined = row.join(lost, "key", "left")
    kept = F.when(F.col("lines").isNull(), F.col("doc").getField(text)).otherwise(
        F.array_join(F.filter(F.split(F.col("doc").getField(text), "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    )
    same = [(kept if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    counts = [F.size(F.split(whole, "\n")).alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_dropped")]
    return joined.select(*same, *counts)
