"""Near-duplicate detection with HyperMinHash registers.

A document is the set of its word shingles' 64-bit hashes. Its sketch has REGISTERS buckets, chosen
by a hash's leading bits; a bucket keeps the least of the remaining bits, compressed to a count of
leading zeros and MANTISSA further bits. The work is done for each different set once:

1. sketch: equal sets become one node (a group of exact copies is one row from here on);
2. band: empty registers borrow from others in a fixed order, then ROWS registers at a time make a
   band; nodes with an equal band share a bucket. Two sets of Jaccard similarity 0.8 miss each
   other in all bands with probability (1 - 0.8^6)^42 = 3e-6;
3. pair: within a bucket every node is paired with the bucket's least node, so a bucket of m nodes
   makes m - 1 pairs, however many near copies it holds;
4. estimate: pairs whose collision-corrected Jaccard estimate lies five standard errors below the
   threshold are dropped; the others are confirmed on the full sets;
5. connect: links become components. A bucket whose nodes are then of one component is done. In the
   others a node that has too few shingles in common with any other of them drops out (a bound on
   the exact similarity, which rules out documents that only share passages), the node that shares
   most of its own is compared with the rest (ROUNDS times). What is still apart then
   is paired across components, whole: sets that share a shingle which at most RARE of them have, by
   that shingle, and others by bucket as far as their common shingles alone can reach the threshold;
   a pair is made only if enough registers agree for its estimate to pass.

Texts are read twice: all of them for the sketches, and those of nodes that share a bucket for their
full sets, which are kept by node from then on. Nothing about documents reaches the driver. A bucket
with many nodes is joined as sorted runs, which Spark splits where a partition is skewed (adaptive
skew joins); the other side has one row for it.

Defined results: documents without words, and null texts, have no shingles, are linked with
nothing and kept; repeated rows are equal documents; a document whose id is null takes part, and
its component's id is the least id that isn't null (null if there is none; then it is kept); an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, let, materialise, small_batches
from tessera.llm.components import components
from tessera.llm.textbytes import mix, parts, shingle_sets, word_bounds, word_hashes

BUCKET_BITS = 8
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 6
BANDS = REGISTERS // ROWS
ROUNDS = 1
RARE = 4
SIGMAS = 5.0
#: Two longs a row: at most 16 MB are broadcast.
BROADCAST_ROWS = 1_000_000

_ORDER = np.argsort(np.random.Generator(np.random.PCG64(11)).random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)
_PROBES = 12


def registers(hashes: np.ndarray) -> np.ndarray:
    """Sketch of a sorted array of distinct 64-bit hashes; 0 is an empty register."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    lead = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    # sorted, so the first of a bucket is its least
    rest = hashes[lead] << np.uint64(BUCKET_BITS)
    zeros = np.zeros(len(rest), dtype=np.uint16)
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < np.uint64(1 << (64 - step))
        zeros[low] += step
        rest[low] <<= np.uint64(step)
    mantissa = ((rest >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    out[bucket[lead]] = ((np.minimum(zeros, 62) + 1) << MANTISSA) | mantissa
    return out


def densified(sketches: np.ndarray) -> np.ndarray:
    """Sketches (one a row) whose empty registers hold the first full one in that register's own
    fixed order, so that similar sets borrow alike. Rows without any full register stay empty."""
    full = sketches != 0
    out, empty = sketches.copy(), ~full
    for j in range(_PROBES):
        source = _ORDER[:, j]
        fill = empty & full[:, source]
        out[fill] = sketches[:, source][fill]
        empty &= ~fill
    for row in np.flatnonzero(empty.any(axis=1) & full.any(axis=1)):
        have, need = np.flatnonzero(full[row]), np.flatnonzero(empty[row])
        out[row, need] = sketches[row, have[_RANK[np.ix_(need, have)].argmin(axis=1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(rows, BANDS) 64-bit keys of densified sketches."""
    cut = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for j in range(ROWS):
        keys = mix(keys) + cut[:, :, j]
    return mix(keys).view(np.int64)


_EDGES = 2.0 ** -np.arange(0, 56)[:, None] * (1 - np.arange(0, 17) / 32)[None, :]


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two unrelated sets of n and m hashes are expected to have alike.

    A register's least value falls into an octave (the leading zeros) and a mantissa cell of it;
    each octave is summed over 16 parts, in which the 2^MANTISSA / 16 cells are alike.
    """

    def falls(size: np.ndarray) -> np.ndarray:
        # probability that the least of size values, of which 1/REGISTERS come here, is in a part
        survive = np.power(1 - _EDGES[None] / REGISTERS, size[:, None, None])
        return survive[:, :, 1:] - survive[:, :, :-1]

    return REGISTERS * (falls(n) * falls(m)).sum(axis=(1, 2)) * 16 / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates, registers they rest on) for rows of sketches and their set sizes."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    alike = ((a == b) & (a != 0)).sum(axis=1)
    chance = accidental(n.astype(float), m.astype(float))
    # chance alike are only among the registers that don't agree for a reason
    jaccard = (alike - chance) / np.maximum(used - chance, 1)
    return np.clip(jaccard, 0, 1), used


def _sets(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    starts, ends, first = word_bounds(data, offsets)
    return shingle_sets(word_hashes(data, starts, ends, lower=True), first, size)


def _name(hashes: np.ndarray) -> int:
    """64-bit name of a set; 0 for the empty one."""
    if not len(hashes):
        return 0
    total = np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(mix(np.array([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fetch, n_shingles, node, registers: the one pass that reads all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in parts(batches, "text"):
            sets = _sets(part, data, offsets, size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "fetch", "n_shingles", "node", "registers"],
            )

    return docs.mapInArrow(run, "doc_id long, fetch long, n_shingles long, node long, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int16, copy=False).view(np.uint16).reshape(len(column), REGISTERS)


def _banded(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint16).reshape(len(batch), REGISTERS)
                keys = band_keys(densified(sketches))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, sketches.size + 1, REGISTERS), pa.int32()), pa.array(sketches.view(np.int16).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], held, lists], names=["node", "fetch", "n_shingles", "registers", "bands"])

    return nodes.mapInArrow(run, "node long, fetch long, n_shingles long, registers array<smallint>, bands array<long>")


class _Search:
    """One run: the nodes and what checks pairs of them."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.scratch = Scratch(docs.sparkSession)
        self.keep = self.scratch.keep
        self.rows = self.keep(_sketched(docs, size), wide=True)
        # equal sets have equal registers, so any of a group's serves
        nodes = self.rows.filter("n_shingles > 0").groupBy("node").agg(F.min("fetch").alias("fetch"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        self.nodes = self.keep(_banded(nodes), wide=True)
        self.links: list[DataFrame] = []
        self.known_roots: DataFrame | None = None
        self.sets: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        percent, least = self.percent, self.percent / 100

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                    jaccard, used = estimate(_matrix(batch.column(2)), _matrix(batch.column(3)), n, m)
                    error = np.sqrt(least * (1 - least) / np.maximum(used, 1))
                    # no pair of sizes further apart than the threshold can reach it
                    keep = (jaccard >= least - SIGMAS * error) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

        joined = self.both(pairs, self.nodes.select("node", "registers", "n_shingles"))
        return joined.select("u", "v", "u_registers", "v_registers", "u_n_shingles", "v_n_shingles").mapInArrow(run, "u long, v long")

    def both(self, pairs: DataFrame, table: DataFrame) -> DataFrame:
        """pairs, which are materialised, with the table's columns of u and of v.

        Up to BROADCAST_ROWS pairs go to where the rows of u are, so that a node of many pairs is no
        hot key, and only rows of v move; more pairs are joined as sorted runs.
        """
        names = [c for c in table.columns if c != "node"]
        side = lambda x: table.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in names])
        if pairs.count() > BROADCAST_ROWS:
            return pairs.join(side("u"), "u").join(side("v"), "v")
        other = side("v").join(F.broadcast(pairs.select("v")), "v", "left_semi")
        return side("u").join(F.broadcast(pairs), "u").join(other, "v")

    def among(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of table whose node is in wanted, which is materialised."""
        if wanted.count() <= BROADCAST_ROWS:  # else a shuffled join
            wanted = F.broadcast(wanted)
        return table.join(wanted.select("node"), "node", "left_semi")

    def read_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, hashes) for the nodes wanted, from their texts."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in parts(batches, "text"):
                sets = _sets(part, data, offsets, size)
                named = pa.array([_name(s) for s in sets], pa.int64())
                out = pa.RecordBatch.from_arrays([named, pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], names=["node", "hashes"])
                # rows that share an id need not share a text
                yield out.filter(pa.array(np.asarray(named) == part.column(1).to_numpy()))

        where = self.keep(self.nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("fetch", "node"))
        if where.count() <= BROADCAST_ROWS:  # else a shuffled join
            where = F.broadcast(where)
        texts = self.docs.select("fetch", "text").join(where, "fetch").select("text", "node")
        # repeated rows have the same id and the same set
        return texts.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
                    a, b = (a, b) if len(a) <= len(b) else (b, a)
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    both = int((b[at] == a).sum())
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return self.both(pairs, self.sets).select("u", "v", "u_hashes", "v_hashes").mapInArrow(run, "u long, v long")

    def check(self, pairs: DataFrame, estimated: bool = False) -> None:
        """Finds the links among pairs; estimated: if they were made by alike()."""
        pairs = self.keep(pairs)
        likely = pairs if estimated else self.keep(self.likely(pairs))
        if not likely.isEmpty():
            links = self.keep(self.confirmed(likely))
            if not links.isEmpty():
                self.links.append(links)
                self.known_roots = None
        self.scratch.drop(pairs, likely)

    def roots(self) -> DataFrame:
        """(node, root) by all links found so far."""
        if self.known_roots is None:
            self.known_roots = self.keep(components(reduce(DataFrame.union, self.links)))
        return self.known_roots

    def shared_sizes(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, n, most, common) and (shingle, node).

        most: how many of a set's shingles any other of the wanted sets has, which is as much as two
        of them can have in common. common: those that more than RARE of them have, which is as much
        as two can have in common that share no rarer one. The second table has the rare shingles
        of two sets or more.
        """
        sets = self.among(self.sets, wanted)
        size = 8

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column(1).to_pylist()
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) // size for x in raw])]), pa.int32())
                lists = pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(b"".join(raw), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "shingles"])

        each = sets.mapInArrow(run, "node long, shingles array<long>").select("node", F.explode("shingles").alias("shingle"))
        each = self.keep(each.distinct(), wide=True)
        counts = each.groupBy("shingle").agg(F.count("*").alias("df")).filter(f"df <= {RARE}")
        rare = self.keep(each.join(counts, "shingle"))
        few = rare.groupBy("node").agg(F.sum((F.col("df") == 1).cast("long")).alias("private"), F.count("*").alias("rare"))
        sizes = self.among(self.nodes.select("node", F.col("n_shingles").alias("n")), wanted)
        less = lambda c: F.col("n") - F.coalesce(c, F.lit(0))
        return sizes.join(few, "node", "left").select("node", "n", less("private").alias("most"), less("rare").alias("common")), rare.filter("df > 1").select("shingle", "node")

    def possible(self, n: str, most: str, m: str, other: str):
        """Whether two sets of these sizes and most common shingles can reach the threshold."""
        return (100 + self.percent) * F.least(most, other) >= self.percent * (F.col(n) + F.col(m))

    def alike(self, a: str, b: str):
        """Whether so many registers agree that the estimate may pass: what likely() tests, without the
        correction for accidental agreement, which only lowers an estimate."""
        each = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != 0), 1001).when((x != 0) | (y != 0), 1000).otherwise(0))
        least = self.percent / 100

        def enough(total):
            used = F.floor(total / 1000)
            return total % 1000 >= (F.lit(least) - SIGMAS * F.sqrt(F.lit(least * (1 - least)) / used)) * used

        return let(F.aggregate(each, F.lit(0), lambda s, x: s + x), enough)

    def mixed(self, members: DataFrame) -> DataFrame:
        """Members of buckets whose nodes aren't of one component yet, with their root."""
        if self.links:
            roots = self.roots()
            roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
            members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            members = members.withColumn("root", F.col("node"))
        several = members.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
        return self.keep(members.join(several, "bucket", "left_semi"))

    def resolve(self, members: DataFrame) -> None:
        """Find the links within buckets; members: (bucket, node)."""
        heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
        found = self.keep(members.join(heads, "bucket"), wide=True)
        self.sets = self.keep(self.read_sets(found.select("node")), wide=True)
        self.check(found.filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct())
        # two nodes are a head and one that was compared with it
        left = self.mixed(found.filter("n > 2").select("bucket", "node", "head"))
        self.scratch.drop(found)
        if left.isEmpty():
            return
        sizes, rare = self.shared_sizes(self.keep(left.select("node").distinct()))
        mixed, left = left, self.keep(left.join(sizes.filter(f"100 * most >= {self.percent} * n"), "node"))
        self.scratch.drop(mixed)
        for _ in range(ROUNDS):
            # the node that shares most is the likeliest to be near all others
            centre = left.groupBy("bucket").agg(F.max(F.struct((F.col("common") / F.col("n")).alias("share"), "node", "root", "n", "most")).alias("c"))
            centre = self.keep(centre.select("bucket", F.col("c.node").alias("u"), F.col("c.root").alias("other"), F.col("c.n").alias("m"), F.col("c.most").alias("theirs")))
            near = left.join(centre, "bucket").filter((F.col("root") != F.col("other")) & self.possible("n", "most", "m", "theirs"))
            self.check(near.select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct())
            # it has met every node of its bucket
            before, left = left, self.mixed(left.drop("root").join(centre.select("bucket", F.col("u").alias("node")), ["bucket", "node"], "left_anti"))
            self.scratch.drop(before, centre)
            if left.isEmpty():
                return
        # pairs that share a rare shingle: at most RARE partners for each
        nodes = self.keep(left.select("node", "root", "n", "most").distinct())
        sketches = self.among(self.nodes.select("node", "registers", "bands"), nodes)
        a = rare.join(nodes.join(sketches.drop("bands"), "node"), "node")
        b = a.select("shingle", F.col("node").alias("v"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("most").alias("theirs"), F.col("registers").alias("facing"))
        apart = (F.col("node") < F.col("v")) & (F.col("root") != F.col("other"))
        few = a.join(b.withColumnRenamed("shingle", "same"), (F.col("shingle") == F.col("same")) & apart & self.possible("n", "most", "m", "theirs") & self.alike("registers", "facing"))
        # the others have common shingles alone; each is made in one of the buckets that it shares
        left = left.join(sketches, "node")
        other = left.select(F.col("bucket").alias("met"), F.col("node").alias("v"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("common").alias("theirs"), F.col("head").alias("first"), F.col("bands").alias("keys"), F.col("registers").alias("facing"))
        apart = apart & (F.col("node") != F.col("head")) & (F.col("v") != F.col("first"))
        once = F.array_min(F.array_intersect("bands", "keys")) == F.col("bucket")
        many = left.join(other, (F.col("bucket") == F.col("met")) & apart & self.possible("n", "common", "m", "theirs") & once & self.alike("registers", "facing"))
        pairs = few.select(F.col("node").alias("u"), "v").union(many.select(F.col("node").alias("u"), "v"))
        self.check(pairs.coalesce(self.scratch.tasks).distinct(), estimated=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents whose sets of `size`-word shingles have a Jaccard similarity of percent / 100 or more
    are linked. A-Z count as a-z; all else in a word counts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("fetch"), F.coalesce(text, F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    search = _Search(texts, size, percent)
    try:
        return materialise(_resolved(search))
    finally:
        search.scratch.close()


def _resolved(search: _Search) -> DataFrame:
    search.resolve(search.nodes.select("node", F.explode("bands").alias("bucket")).select("bucket", "node"))
    keys = search.rows.select("doc_id", "n_shingles", "node")
    if search.links:
        roots = search.roots()
        group = F.coalesce("root", "node")
        keyed = keys.join(roots, "node", "left").withColumn("group", group).drop("root")
    else:
        keyed = keys.withColumn("group", F.col("node"))
    lead = keyed.filter("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("group", "lead")
    out = keyed.join(lead, "group", "left")
    component = F.coalesce("lead", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs less those whose component has a lesser id. Rows without an id stay."""
    doomed = materialise(near_duplicates(docs, id_col, text, size, percent).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct())
    if doomed.count() <= BROADCAST_ROWS:  # else a shuffled join
        doomed = F.broadcast(doomed)
    return docs.join(doomed, id_col, "left_anti")
