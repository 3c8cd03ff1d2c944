"""Token counts of a byte-level BPE tokenizer by compiled transducers.

Two deterministic transducers replace the tokenizer:

* the cutter reads classes of characters and marks where pre-tokens begin. A text is cut into
  chunks; each chunk is read from every state at once, which gives its map of states to states;
  the maps are composed by a parallel prefix scan, so every chunk then knows its first state and
  reports its marks in one more pass. Chunks don't follow words or documents, so a text of any
  length costs the same a character;
* the counter reads a pre-token's bytes. It is the token trie under the grammar of token pairs
  (lattice.Merges), whose one path of finite weight emits a token an arc. Paths are found for many
  different pre-tokens at a time and their counts remembered within bounds.

Each transition of the cutter is annotated with what it emits (the tokens of the pre-token that it
opens, one for a special token); the sums run through all chunks by a scan, and a text's count is
the difference between where it closes and where the text before it closes.

Special tokens inside a text are one token each, as the library has it by default.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows that repeat are counted each
for itself; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.lattice import Lexicon, Memo, Merges, put_together, shortest
from tessera.llm.textbytes import parts, word_hashes

CHUNK = 256
_EARLY = 16
_PRE_TOKENS = 200_000
#: Unicode's White_Space.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_LETTER, _SUFFIX, _R, _V, _E, _L, _NUMBER, _BLANK, _SPACE, _QUOTE, _OTHER, _RESET = range(12)
_START, _IN_LETTERS, _IN_NUMBER, _IN_OTHER, _ONE_BLANK, _ONE_SPACE, _RUN_BLANK, _RUN_SPACE, _QUOTED, _QUOTED_R, _QUOTED_V, _QUOTED_L = range(12)
_N = 12


def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[_SPACES] = _SPACE
    table[0x20], table[0x27] = _BLANK, _QUOTE
    for letters, kind in (("stmd", _SUFFIX), ("r", _R), ("v", _V), ("e", _E), ("l", _L)):
        for x in letters:
            table[ord(x)] = kind
    return table


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by 12 * state + class. Marks: 1, a pre-token begins here; 2, one character ago."""
    letters = {_LETTER, _SUFFIX, _R, _V, _E, _L}
    opens = {_NUMBER: _IN_NUMBER, _BLANK: _ONE_BLANK, _SPACE: _ONE_SPACE, _QUOTE: _QUOTED, _OTHER: _IN_OTHER} | dict.fromkeys(letters, _IN_LETTERS)
    joins = opens | {_QUOTE: _IN_OTHER}
    run = {_BLANK: _RUN_BLANK, _SPACE: _RUN_SPACE}
    to, marks = np.zeros(_N * _N, dtype=np.uint8), np.zeros(_N * _N, dtype=np.uint8)

    def step(state: int, kind: int) -> tuple[int, int]:
        if kind == _RESET:
            return _START, 2 if state in (_QUOTED_R, _QUOTED_V, _QUOTED_L) else 0
        if state in (_IN_LETTERS, _IN_NUMBER) and opens[kind] == state:
            return state, 0
        if state == _IN_OTHER and kind in (_OTHER, _QUOTE):
            return state, 0
        if state in (_ONE_BLANK, _ONE_SPACE, _RUN_BLANK, _RUN_SPACE) and kind in run:
            return run[kind], 0
        if state == _ONE_BLANK:
            return joins[kind], 0
        if state == _RUN_BLANK:
            return joins[kind], 2
        if state == _RUN_SPACE:
            return opens[kind], 3
        if state == _QUOTED:
            if kind == _SUFFIX:
                return _START, 0
            if kind in (_R, _V, _L):
                return {_R: _QUOTED_R, _V: _QUOTED_V, _L: _QUOTED_L}[kind], 0
            if kind in (_OTHER, _QUOTE):
                return _IN_OTHER, 0
        if state in (_QUOTED_R, _QUOTED_V, _QUOTED_L):
            if kind == (_L if state == _QUOTED_L else _E):
                return _START, 0
            return (_IN_LETTERS, 2) if kind in letters else (opens[kind], 3)
        return opens[kind], 1

    for state in range(_N):
        for kind in range(_N):
            to[_N * state + kind], marks[_N * state + kind] = step(state, kind)
    return to * _N, marks


_TO, _MARKS = _cutter()


def _chunk_maps(chunks: np.ndarray) -> np.ndarray:
    """States (times 12) that each chunk leads to from each state; chunks: (length, number)."""
    states = np.repeat((np.arange(_N, dtype=np.uint8) * _N)[:, None], chunks.shape[1], axis=1)
    for row in chunks[:_EARLY]:
        states = _TO[states + row]
    # mostly a few characters settle the state, whatever it was; then one lane will do
    settled = (states == states[0]).all(axis=0)
    for columns, lanes in ((np.flatnonzero(settled), 1), (np.flatnonzero(~settled), _N)):
        if len(columns):
            some = states[:lanes, columns]
            for row in chunks[_EARLY:, columns]:
                some = _TO[some + row]
            states[:, columns] = some
    return states


def _scan(maps: np.ndarray) -> np.ndarray:
    """Composition of each chunk's map with all those before it (parallel prefix, doubling)."""
    maps, step = maps.copy(), 1
    while step < maps.shape[1]:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp) // _N, axis=0)
        step *= 2
    return maps


def marks(kinds: np.ndarray) -> np.ndarray:
    """The cutter's marks for a sequence of character classes, read from the start state."""
    if not len(kinds):
        return np.zeros(0, np.uint8)
    padded = np.full(-(-len(kinds) // CHUNK) * CHUNK, _RESET, dtype=np.uint8)
    padded[: len(kinds)] = kinds
    chunks = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    ends = _scan(_chunk_maps(chunks))
    state = np.concatenate([[_START * _N], ends[_START, :-1]]).astype(np.uint8)
    out = np.empty_like(chunks)
    for i, row in enumerate(chunks):
        at = state + row
        out[i], state = _MARKS[at], _TO[at]
    return out.T.reshape(-1)[: len(kinds)]


def _byte_letters() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Counts tokens as the tokenizer of a .json file does. content: the file's text."""

    def __init__(self, content: str):
        spec = json.loads(content)
        cut = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser or prefix space is compiled here")
        letters = _byte_letters()
        spell = lambda x: bytes(letters[c] for c in x)
        merges = [tuple(map(spell, x.split(" ") if isinstance(x, str) else x)) for x in spec["model"]["merges"]]
        number = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        if len(number) != 256 + len(merges):
            raise ValueError("two merges that make the same token have no defined order here")
        n = len(number)
        rank, left, right = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        rank[256:] = np.arange(len(merges))
        left[256:], right[256:] = [number[a] for a, _ in merges], [number[b] for _, b in merges]
        self.grammar = Merges(rank, left, right, (left[256:], right[256:], rank[256:]))
        # tokens that merging makes of their own bytes
        made = np.ones(n, dtype=bool)
        made[256:] = self.grammar.allowed(left[256:], right[256:], rank[256:])
        for i in range(256, n):
            made[i] &= made[left[i]] and made[right[i]]
        self.lexicon = Lexicon([tuple(t) if made[i] else () for t, i in number.items()], 256)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.kinds = _class_table()
        self.memo: Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def _counted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of these pre-tokens: the arcs of the path that the counter takes through each."""
        self.memo = memo = self.memo or Memo()
        hashes = word_hashes(data, starts, ends)
        out = []
        for at in range(0, len(starts), _PRE_TOKENS):
            own = hashes[at : at + _PRE_TOKENS]
            entry = memo.get(own)
            new = np.flatnonzero(entry < 0)
            if len(new):
                if not memo.room(len(new)):
                    memo.forget()
                    new = np.arange(len(own))
                _, once = np.unique(own[new], return_index=True)
                some = at + new[once]
                _, _, counts = shortest(self.lexicon, self.grammar, *put_together(data, starts[some], ends[some]))
                memo.put(hashes[some], np.ones(len(some), np.int64), counts)
                entry = memo.get(own)
            out.append(memo.gather(entry))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of the texts that lie one after another in data."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(rows, dtype=np.int64)
        text = data.tobytes().decode()
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        bounds = np.searchsorted(lead, offsets)
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        emitted = np.zeros(len(kinds) + rows, dtype=np.int64)
        for special in self.specials:
            at = text.find(special)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(special) <= bounds[row + 1]:
                    kinds[at : at + len(special)] = _RESET
                    emitted[at + row] = 1
                    at = text.find(special, at + len(special))
                else:
                    at = text.find(special, at + 1)
        # a reset after each text
        kinds = np.insert(kinds, bounds[1:], _RESET)
        found = marks(kinds)
        begins = (found & 1) != 0
        begins[np.flatnonzero(found & 2) - 1] = True
        events = np.flatnonzero(begins | (kinds == _RESET))
        is_word = kinds[events] != _RESET
        starts, ends = events[:-1][is_word[:-1]], events[1:][is_word[:-1]]
        closes = bounds[1:] + np.arange(1, rows + 1)
        row = np.searchsorted(closes, starts, "right")
        emitted[starts] += self._counted(data, lead[starts - row], lead[ends - row])
        # what the transitions emit, summed up by a scan and read off where texts close
        return np.diff(np.concatenate([[0], np.cumsum(emitted)[closes - 1]]))


_COMPILED: dict[int, Tokenizer] = {}


def compiled(content: str) -> Tokenizer:
    """One compilation a process."""
    key = hash(content)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Tokenizer(content)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. tokenizer: path of a .json file that the driver reads;
    compiles; the workers get the arrays (a
    vocabulary, so their size doesn't follow the data)."""
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(compiled(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for part, data, offsets in parts(batches, "text", 1 << 20):
            counts = counter.count(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
