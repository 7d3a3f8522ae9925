"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

A text is a lattice of all ways to cut it into pieces. Forward filtering sums the weights of all
paths to a place; walking back from the end, each piece is drawn in proportion to them, so a whole
segmentation is drawn with its share of the total weight. Draws are a hash of the row's key and the
place, so a row always gets the same segmentation. Pieces never reach over the places where a run
of spaces or a line break starts, so the lattice splits there into units whose filters are computed
once a task; the draws of all units of a batch are made together on arrays.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import fresh, runs, shared, text_udf

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Weight of a piece: (its rank in the vocabulary + 2) to the power of minus this.
POWER = 0.5
#: Lattice edges a task keeps before it starts anew.
KEEP_EDGES = 1_500_000
DRAW_BITS = 24
#: Stands for a mark character that is part of a text.
_OWN_MARK = 0x1FFFFF
_G1, _G2, _G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Pieces:
    """The vocabulary as plain data: bounded by the model file, which the driver reads."""

    normal: dict[str, tuple[int, float]]
    byte_ids: list[int]
    byte_weight: float
    shown: list[bytes]
    cuts: bool

    @staticmethod
    def load(path: str = MODEL, power: float = POWER) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        normal = {model.id_to_piece(i): (i, -power * log(rank + 2)) for rank, i in enumerate(ranked)}
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in byte_ids):
            raise ValueError("the model needs pieces for all bytes, else unknown characters are lost")
        shown = [b""] * size
        for piece, (i, _) in normal.items():
            shown[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            shown[i] = bytes([b])
        cuts = not any("\n" in p or " " in p or MARK in p.lstrip(MARK) for p in normal)
        return Pieces(normal, byte_ids, -power * log(size + 2), shown, cuts)

    def units(self, text: str) -> list[str]:
        """The text, with one space in front as the model has it, cut where no piece reaches across."""
        if not text:
            return []
        return _UNITS.findall(" " + text) if self.cuts else [" " + text]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.shown.__getitem__, ids))[1:]


_UNITS = re.compile(r" *[^ \n]+| +|\n+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _G2
    x = (x ^ (x >> np.uint64(27))) * _G3
    return x ^ (x >> np.uint64(31))


class Lattices:
    """The filtered lattices of units: per place the shares of the pieces that end there.

    Places of all units are numbered through. The pieces that end at a place are neighbours in the
    edge arrays, the longest first, with running shares on a grid of ``2 ** -DRAW_BITS``; shares are
    computed from the unit alone, so they do not depend on what else a batch holds.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.longest = max(map(len, pieces.normal))
        self.several: dict[int, int] = {}
        self.spelled: list[list[int]] = []
        state: dict[str, int] = {"": 0}
        moves: dict[int, int] = {}
        for piece in pieces.normal:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in state:
                    state[piece[:k]] = len(state)
                    moves[state[piece[: k - 1]] << 21 | ord(piece[k - 1])] = state[piece[:k]]
        self.move_key = np.array(sorted(moves), dtype=np.int64)
        self.move_to = np.array([moves[k] for k in self.move_key.tolist()], dtype=np.int64)
        self.piece_at = np.full(len(state), -1, dtype=np.int32)
        self.weight_at = np.zeros(len(state))
        for piece, (i, weight) in pieces.normal.items():
            self.piece_at[state[piece]] = i
            self.weight_at[state[piece]] = weight
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.last = array("q")  # of each unit its last place
        self.first_edge = array("i")  # of each place
        self.upto, self.emits, self.comes, self.ends = array("d"), array("i"), array("i"), array("b")

    def _spell(self, point: int) -> tuple[int, int]:
        """A character without a piece of its own: its byte's piece, or a number above those of the pieces; and its bytes."""
        if point < 128:
            return self.pieces.byte_ids[point], 1
        if point not in self.several:
            self.several[point] = len(self.spelled)
            self.spelled.append([self.pieces.byte_ids[b] for b in chr(ord(MARK) if point == _OWN_MARK else point).encode()])
        k = self.several[point]
        return len(self.pieces.shown) + k, len(self.spelled[k])

    def _edges(self, points: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in the units: start, length, number and weight, the longest first."""
        at, state = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        found, alone = [], np.ones(len(points), dtype=bool)
        for size in range(1, self.longest + 1):
            key = state << 21 | points[at + size - 1]
            move = np.minimum(np.searchsorted(self.move_key, key), len(self.move_key) - 1)
            ok = self.move_key[move] == key
            at, state = at[ok], self.move_to[move[ok]]
            piece = self.piece_at[state]
            has = piece >= 0
            found.append((at[has], np.full(int(has.sum()), size), piece[has], self.weight_at[state[has]]))
            if size == 1:
                alone[at[has]] = False
            go = at + size < stop[at]
            at, state = at[go], state[go]
            if not len(at):
                break
        lone = np.flatnonzero(alone)
        kinds, which = np.unique(points[lone], return_inverse=True)
        spelled = np.array([self._spell(int(k)) for k in kinds], dtype=np.int64).reshape(-1, 2)
        found.insert(0, (lone, np.ones(len(lone), dtype=np.int64), spelled[which, 0].astype(np.int32), spelled[which, 1] * self.pieces.byte_weight))
        return tuple(np.concatenate(x) for x in zip(*reversed(found), strict=True))

    def add(self, units: list[str]) -> None:
        """Filter the lattices of new units forward and keep them."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points[points == ord(MARK)] = _OWN_MARK  # a mark in the text itself is no space
        points[points == 32] = ord(MARK)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        stop = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        start, size, emit, weight = self._edges(points, np.repeat(stop, sizes))
        source = start + unit[start]  # a unit has one place more than characters
        target = source + size
        order = np.argsort(target, kind="stable")
        source, target, emit, weight = source[order], target[order], emit[order], weight[order]
        begin = stop - sizes + np.arange(len(units))
        depth = target - begin[unit[start[order]]]
        total = np.zeros(len(points) + len(units))
        rounds = np.argsort(depth.astype(np.uint16) if len(depth) == 0 or depth.max() < 65536 else depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[rounds], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # all units a character further
            edge = rounds[a:b]
            value, to = total[source[edge]] + weight[edge], target[edge]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(value, heads)
            spread = np.diff(heads, append=len(to))
            total[to[heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, spread)), heads))
        share = np.exp(total[source] + weight - total[target])
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(heads, append=len(target))
        rank = np.arange(len(target)) - np.repeat(heads, counts)
        for k in range(1, int(counts.max(initial=0))):
            edge = np.flatnonzero(rank == k)
            share[edge] += share[edge - 1]
        share = np.minimum(np.rint(share * (1 << DRAW_BITS)) / (1 << DRAW_BITS), 1.0)
        share[heads + counts - 1] = 1.0
        places, edges = len(self.first_edge), len(self.upto)
        first = np.zeros(len(total), dtype=np.int32)
        first[target[heads]] = edges + heads
        for unit_text in units:
            self.number[unit_text] = len(self.number)
        for kept, new in ((self.last, places + begin + sizes), (self.first_edge, first), (self.upto, share), (self.emits, emit),
                          (self.comes, (places + source).astype(np.int32)), (self.ends, np.isin(source, begin).astype(np.int8))):
            kept.frombytes(np.ascontiguousarray(new).tobytes())

    def sample(self, data: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of every text, drawn with the seed of its row."""
        if len(self.upto) > KEEP_EDGES:
            self.clear()
        split = [self.pieces.units(t) for t in data]
        units = [u for row in split for u in row]
        if not units:
            return [np.zeros(0, dtype=np.int32) for _ in data]
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if new:
            self.add(new)
        sizes = np.array([len(r) for r in split], dtype=np.int64)
        last, first_edge = np.frombuffer(self.last, dtype=np.int64), np.frombuffer(self.first_edge, dtype=np.int32)
        upto, emits = np.frombuffer(self.upto), np.frombuffer(self.emits, dtype=np.int32)
        comes, ends = np.frombuffer(self.comes, dtype=np.int32), np.frombuffer(self.ends, dtype=np.int8)
        node = last[np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units))]
        first = np.cumsum(sizes) - sizes
        order = (np.arange(len(units)) - np.repeat(first, sizes)).astype(np.uint64)
        state = _mixed(np.repeat(seeds, sizes) + order * _G1)
        active, steps, drawn = np.arange(len(units)), 0, []
        count = np.zeros(len(units), dtype=np.int64)
        while len(active):
            draw = (_mixed(state + np.uint64((steps + 1) * int(_G1) & 2**64 - 1)) >> np.uint64(64 - DRAW_BITS)).astype(np.float64) / (1 << DRAW_BITS)
            edge = first_edge[node]
            past = np.flatnonzero(upto[edge] <= draw)
            while len(past):  # the longest pieces come first and mostly win
                edge[past] += 1
                past = past[upto[edge[past]] <= draw[past]]
            drawn.append((active, emits[edge]))
            steps += 1
            go = ends[edge] == 0
            count[active[~go]] = steps
            active, node, state = active[go], comes[edge[go]], state[go]
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int32)
        for step, (which, got) in enumerate(drawn):  # the last piece of a unit is drawn first
            out[place[which] + count[which] - 1 - step] = got
        bounds = np.append(place, len(out))[np.append(first, len(units))]
        vocabulary = len(self.pieces.shown)
        rows = [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if out.max(initial=0) < vocabulary:
            return rows
        return [r if r.max(initial=0) < vocabulary else self._spelled_out(r, vocabulary) for r in rows]

    def _spelled_out(self, ids: np.ndarray, vocabulary: int) -> np.ndarray:
        out: list[int] = []
        for i in ids.tolist():
            if i < vocabulary:
                out.append(i)
            else:
                out.extend(self.spelled[i - vocabulary])
        return np.array(out, dtype=np.int32)


def _listed(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, dtype=np.int32)])))


def _sampler(pieces: Pieces, seed: int):
    lattices = Lattices(pieces)

    def work(data: list[bytes], keys: pa.Array) -> list[np.ndarray]:
        numbers = np.array([0 if k is None else k for k in keys.to_pylist()], dtype=np.int64).view(np.uint64)
        return lattices.sample([t.decode() for t in data], _mixed(numbers * _G1 + np.uint64(seed & (2**64 - 1))))

    return work


def encode_column(text: Column, key: Column, pieces: Pieces, seed: int = 0) -> Column:
    """Piece ids drawn with the row's key (an integer; null counts as 0); null and empty texts have none.

    Rows of equal key and text get equal ids. Whole texts are encoded; white space is kept as it is.
    """
    sent = _broadcast(pieces)

    def make():
        work = _sampler(sent(), seed)
        return lambda column, keys: pa.concat_arrays([_listed([]), *(_listed(work(data, keys.slice(at, len(data)))) for at, data in runs(column))])

    return text_udf(make, "array<int>")(text, key.cast("bigint"))


def decode_column(ids: Column, pieces: Pieces) -> Column:
    """The text of piece ids; null for null, empty for none. Undoes :func:`encode_column` exactly."""
    sent = _broadcast(pieces)

    def make():
        known = sent()
        return lambda column: pa.array([None if r is None else known.decode(r).decode("utf-8", "replace") for r in column.to_pylist()], type=pa.string())

    return text_udf(make, "string")(ids)


def _broadcast(pieces: Pieces) -> Callable[[], Pieces]:
    return shared(SparkSession.getActiveSession(), pieces)


def encode_checked(docs: DataFrame, pieces: Pieces, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, out_col: str = "encoded") -> DataFrame:
    """``docs`` with a struct of the sampled ``ids`` and ``lossless``: whether decoding them gives the text back.

    ``out_col`` must be a new name; a column of ``docs`` is never replaced.
    Both are made in one visit of the row, so ids do not travel to a worker again for the check.
    """
    if fresh(out_col, docs.columns) != out_col:
        raise ValueError(f"there is a column {out_col} already, name another one as out_col")
    sent = _broadcast(pieces)

    def make():
        known = sent()
        work = _sampler(known, seed)

        def both(column, keys):
            ids, same = [_listed([])], []
            for at, data in runs(column):
                rows = work(data, keys.slice(at, len(data)))
                same += [known.decode(r.tolist()) == t for r, t in zip(rows, data, strict=True)]
                ids.append(_listed(rows))
            return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(same, pa.bool_())], ["ids", "lossless"])

        return both

    return docs.withColumn(out_col, text_udf(make, "struct<ids:array<int>,lossless:boolean>")(F.col(text_col), F.col(key_col).cast("bigint")))
