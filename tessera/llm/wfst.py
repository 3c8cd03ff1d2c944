"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled, once on the driver, into arrays that every task gets:

* the normaliser, a transducer of three states (begin, after a character, after a blank) that writes
  the word mark for a blank, a mark in front of the text and, if the model says so, one blank for
  several and none at the ends;
* the pieces, a trie from characters to piece numbers; a character that is no piece has an arc of
  its own, which writes the character's bytes (or the unknown piece, in a model without byte pieces);
* the grammar, which weighs the arcs: minus its score for a piece of a unigram model; for a BPE
  model 0 or infinite by the piece before it (lattice.Merges).

The three are composed with the input and the encoding is the composition's shortest path in the
tropical semiring (min, +). A text's lattice falls apart wherever no piece has the two characters
beside each other, and in a BPE model's long runs of marks at every longest run piece, so the paths
are found for each different stretch between such places, many at a time, and remembered within
bounds (lattice.Memo). Decoding writes the pieces' bytes.

Not compiled: models with a table of character replacements, with user-defined or unused pieces,
with a piece that has a mark after another character, or BPE models that score a piece above its
parts (training doesn't make them). They are refused with a ValueError.

Defined results: a null or empty text has no ids and decodes to an empty text; texts of any length
are encoded whole; rows that repeat are encoded each for itself; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.lattice import Costs, Lexicon, Memo, Merges, put_together, shortest, spread
from tessera.llm.textbytes import bytes_of, mix, parts, power_tables

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models, and what an unknown character
#: weighs more than the least likely piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Bits of the table of neighbours; two pairs on one bit only join two stretches.
_PAIR_BITS = 20
_STRETCHES = 200_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


def merged(symbols: list[str], score) -> tuple[list[str], tuple[str, str] | None]:
    """What BPE makes of symbols (the best scored merge, leftmost first, until none is left), and
    the last two that it merged."""
    last, none = None, -float("inf")
    while len(symbols) > 1:
        found = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        best = max(found)
        if best == none:
            break
        at = found.index(best)
        last = symbols[at], symbols[at + 1]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols, last


class Transducer:
    """The compiled model. content: the model file."""

    def __init__(self, content: bytes):
        pieces, kinds, scores = [], [], []
        model, self.prefix, self.squeeze, self.escape, table = UNIGRAM, True, True, True, b""
        for field, value in _fields(content):
            if field == 1:
                found = dict(_fields(value))
                pieces.append(found.get(1, b"").decode())
                scores.append(struct.unpack("<f", found[2])[0] if 2 in found else 0.0)
                kinds.append(found.get(3, NORMAL))
            elif field == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                found = dict(_fields(value))
                table = found.get(2, b"")
                self.prefix, self.squeeze, self.escape = bool(found.get(3, 1)), bool(found.get(4, 1)), bool(found.get(5, 1))
        if model not in (UNIGRAM, BPE) or table or not self.escape or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("compiled here: unigram and BPE models of normal, control, unknown and byte pieces without a table of character replacements")
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL and p}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a word mark after another character")
        self.size, self.unknown = len(pieces), kinds.index(UNKNOWN)
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        for i, p in enumerate(pieces):
            if kinds[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())
        # symbols: 0 for every character that no piece has
        letters = sorted(set("".join(normal)))
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.symbol = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 65535 else np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # pieces by number: those of the model, then each character that is none by itself
        alone = [0, *(number[c] for c in letters if c not in normal)]
        spelled = [() for _ in pieces] + [(x,) for x in alone]
        weights = np.full(len(spelled), np.float32(UNKNOWN_PENALTY) - np.float32(min((scores[i] for i in normal.values()), default=0.0)))
        for p, i in normal.items():
            weights[i] = -scores[i]
        if model == UNIGRAM:
            for p, i in normal.items():
                spelled[i] = tuple(number[c] for c in p)
            self.grammar: Costs | Merges = Costs(weights)
        else:
            single = {c: normal.get(c, self.size + alone.index(number[c]) if c not in normal else -1) for c in letters}
            self.grammar = self._merges(normal, scores, single, len(spelled))
            for p, i in normal.items():
                if len(p) == 1 or self.grammar.rank[i] >= 0:
                    spelled[i] = tuple(number[c] for c in p)
        self.lexicon = Lexicon(spelled, len(letters) + 1)
        pairs = np.array(sorted({(number[a], number[b]) for p in normal for a, b in zip(p, p[1:])}) or [(0, 0)], dtype=np.int64)
        bits = np.zeros(1 << _PAIR_BITS, dtype=bool)
        bits[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.beside = bits
        written = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(pieces, kinds, strict=True)
        ]
        self.written = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.written_ends = np.concatenate([[0], np.cumsum([len(x) for x in written])])
        self.memo: Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def _merges(self, normal: dict[str, int], scores: list[float], single: dict[str, int], n: int) -> Merges:
        """The BPE grammar. Pieces that merging doesn't make of their own characters get no rank."""
        score = {p: scores[i] for p, i in normal.items() if len(p) > 1}
        runs, settled, tied = np.zeros(n, dtype=np.int32), None, [p for p in score if set(p) == {MARK}]
        if tied and len({score[p] for p in tied}) == 1 and score[tied[0]] == min(score.values()):
            sizes = [1, *map(len, tied)]
            settled = np.zeros((max(sizes) + 1, max(sizes) + 1), dtype=bool)
            for a in sizes:
                for b in sizes:
                    settled[a, b] = merged([MARK] * (a + b), score.get)[0] == [MARK * a, MARK * b]
            if settled[-1, sizes].all():  # else there is no place to cut long runs
                for p in [MARK, *tied]:
                    runs[single[MARK] if p == MARK else normal[p]] = len(p)
        others = [score[p] for p in score if not runs[normal[p]]]
        if len(set(others)) < len(others) or runs.any() and min(others, default=0.0) <= score[tied[0]]:
            raise ValueError("pieces of equal score that are no run of marks have no defined order of merging")
        order = {x: i for i, x in enumerate(sorted(set(score.values()), reverse=True))}
        rank, left, right = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        of = lambda p: single[p] if len(p) == 1 else normal.get(p, -1)
        a, b, c = [], [], []
        for p in score:
            made, last = merged(list(p), score.get)
            if made == [p]:
                i = normal[p]
                rank[i], left[i], right[i] = order[score[p]], of(last[0]), of(last[1])
            for cut in range(1, len(p)):
                x, y = of(p[:cut]), of(p[cut:])
                if x >= 0 and y >= 0:
                    a.append(x), b.append(y), c.append(order[score[p]])
        late = np.flatnonzero(rank >= 0)
        if (np.maximum(rank[left[late]], rank[right[late]]) >= rank[late])[runs[late] == 0].any():
            raise ValueError("a piece that is merged before its parts can't be told from pairs")
        return Merges(rank, left, right, (np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.int64)), runs, settled, single.get(MARK, -1))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.astype(np.uint32) * np.uint32(0x85EBCA77))) >> np.uint32(32 - _PAIR_BITS)

    # --- encoding -------------------------------------------------------------------------

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points, where each text begins and the last ends) of what the normaliser writes."""
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = chars[offsets]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).copy()
        blank = points == 32
        points[blank] = ord(MARK)
        if self.squeeze and len(points):
            first = np.zeros(len(points), dtype=bool)
            first[bounds[:-1][np.diff(bounds) > 0]] = True
            before = np.concatenate([[False], blank[:-1]]) | first
            drop = blank & before  # leading ones and those after another
            # what is left of a run at a text's end goes, and so do marks of the text itself there
            kept = ~drop
            for end, begin in zip(bounds[1:].tolist(), bounds[:-1].tolist(), strict=True):
                end -= 1
                while end >= begin and (drop[end] or points[end] == ord(MARK)):
                    kept[end] = False
                    end -= 1
            sums = np.concatenate([[0], np.cumsum(kept)])
            points, bounds = points[kept], sums[bounds]
        if self.prefix:
            some = np.flatnonzero(np.diff(bounds) > 0)
            points = np.insert(points, bounds[some], ord(MARK))
            bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        return points, bounds

    def _stretches(self, points: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the lattice falls apart."""
        begin = np.ones(len(points), dtype=bool)
        begin[1:] = ~self.beside[self._pair(symbols[:-1], symbols[1:])]
        first = bounds[:-1][np.diff(bounds) > 0]
        begin[first] = True
        longest = self.grammar.longest if isinstance(self.grammar, Merges) else 0
        if longest:
            mark = points == ord(MARK)
            opens = mark.copy()
            opens[1:] &= ~mark[:-1]
            opens[first] = mark[first]
            place = np.arange(len(points))
            within = place[mark] - np.maximum.accumulate(np.where(opens, place, 0))[mark]
            # a longest run piece is followed by another mark here, and by no merge across
            begin[np.flatnonzero(mark)[within % longest == 0]] = True
        return np.flatnonzero(begin)

    def _paths(self, symbols: np.ndarray, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each stretch) of stretches that lie one after another."""
        pieces, ends, counts = shortest(self.lexicon, self.grammar, symbols, begins)
        ids, sizes = pieces.astype(np.int32), np.ones(len(pieces), dtype=np.int64)
        loose = np.flatnonzero(pieces >= self.size)
        if len(loose) and self.has_bytes:
            raw = [chr(x).encode() for x in points[ends[loose] - 1].tolist()]
            sizes[loose] = [len(x) for x in raw]
            out = np.repeat(ids, sizes)
            out[np.repeat(pieces >= self.size, sizes)] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            ids = out
        elif len(loose):
            ids[loose] = self.unknown
        sums = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(sums[edge])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has); texts lie one after another in data."""
        points, bounds = self.normalised(data, offsets)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        symbols = self.symbol[points]
        begins = self._stretches(points, symbols, bounds)
        ends = np.append(begins[1:], len(points))
        up, down = power_tables(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(77)) * up[: len(points)], out=sums[1:])
        hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        del sums
        self.memo = memo = self.memo or Memo()
        ids, sizes = [], []
        for at in range(0, len(begins), _STRETCHES):
            own = hashes[at : at + _STRETCHES]
            entry = memo.get(own)
            new = np.flatnonzero(entry < 0)
            if len(new):
                if not memo.room(len(new)):
                    memo.forget()
                    new = np.arange(len(own))
                _, once = np.unique(own[new], return_index=True)
                some = at + new[once]
                spot = spread(begins[some], ends[some] - begins[some])
                edges = np.concatenate([[0], np.cumsum(ends[some] - begins[some])])
                found, counts = self._paths(symbols[spot], points[spot], edges)
                memo.put(hashes[some], counts, found)
                entry = memo.get(own)
            ids.append(memo.gather(entry))
            sizes.append(memo.sizes(entry))
        ids, sums = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        total = np.diff(sums[np.searchsorted(begins, bounds)])
        if not self.has_bytes and len(ids) > 1:
            # unknown characters in a row are one
            text = np.repeat(np.arange(len(total)), total)
            again = np.concatenate([[False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (text[1:] == text[:-1])])
            total = total - np.bincount(text[again], minlength=len(total))
            ids = ids[~again]
        return ids, total

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]

    # --- decoding -------------------------------------------------------------------------

    def write(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's begin and the last ends)."""
        return put_together(self.written, self.written_ends[ids], self.written_ends[ids + 1])

    def decode(self, ids: np.ndarray) -> str:
        text = self.write(np.asarray(ids, dtype=np.int64))[0].tobytes().decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def agree(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether decoding each text's ids gives its bytes."""
        raw, at = self.write(ids)
        edges = at[np.concatenate([[0], np.cumsum(sizes)])]
        skip = np.zeros(len(sizes), dtype=np.int64)
        if self.prefix and len(raw):
            some = np.flatnonzero(np.diff(edges) > 0)
            skip[some] = raw[edges[:-1][some]] == 32
        same = edges[1:] - edges[:-1] - skip == np.diff(offsets)
        out = same.copy()
        some = np.flatnonzero(same & (np.diff(offsets) > 0))
        if len(some):
            length = np.diff(offsets)[some]
            differ = raw[spread(edges[:-1][some] + skip[some], length)] != data[spread(offsets[:-1][some], length)]
            out[some] = ~np.logical_or.reduceat(differ, np.cumsum(length) - length)
        return out


_COMPILED: dict[int, Transducer] = {}


def compiled(content: bytes) -> Transducer:
    """One compilation a process."""
    key = hash(content)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(content)
    return _COMPILED[key]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, round_trip (decoding the ids gives the text).

    model: path of a .model file that the driver reads and compiles; the workers get the arrays (a
    vocabulary, so their size doesn't follow the data). A text with the word mark itself (U+2581)
    decodes to spaces there, as in the library.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(compiled(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        is_byte = np.zeros(coder.size, dtype=bool)
        is_byte[coder.byte_ids[coder.byte_ids >= 0]] = True
        for part, data, offsets in parts(batches, "text", 1 << 20):
            ids, sizes = coder.encode_all(data, offsets)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            through = np.concatenate([[0], np.cumsum(is_byte[ids])])[edges]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
            same = coder.agree(ids, sizes, data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(np.diff(through)), pa.array(same)], names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text for rows of ids; null ids give a null text."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(compiled(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


__all__ = ["Transducer", "bytes_of", "compiled", "decode", "encode"]
