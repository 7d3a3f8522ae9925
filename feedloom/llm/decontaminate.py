"""Benchmark decontamination: test n-grams as a broadcast hash set, token windows of the training texts.

Words are runs of digits, letters and non-ASCII characters with A-Z lowered. A window is ``size``
consecutive words of an item; an item with fewer words is one window. A document word inside any
occurrence of a window is hit. Windows are found by a rolling hash and confirmed word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fresh, runs, text_udf

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SIZE = 10
#: The set is broadcast in blocks of items of at most this many bytes; a larger benchmark takes a pass for each block.
BLOCK_BYTES = 32 << 20
#: Bytes of texts taken into words at once.
PART_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "struct<n_words:long,spans:array<struct<start:int,end:int>>,n_hit:long,items:array<string>>"
KIND = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
])


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Windows:
    """The windows of some items: word numbers, and for each length the sorted window hashes."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = SIZE):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[int, dict[tuple, list[int]]] = {}
        for at, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners = found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), [])
                if not owners or owners[-1] != at:
                    owners.append(at)
        self.levels = []
        for n, grams in sorted(found.items()):
            rows = np.array(list(grams), dtype=np.uint64).reshape(-1, n)
            hashes = self.hashed(rows.T)
            order = np.argsort(hashes, kind="stable")
            owners = list(grams.values())
            self.levels.append((n, hashes[order], rows[order], [owners[i] for i in order]))

    @staticmethod
    def hashed(columns) -> np.ndarray:
        out = None
        for c in columns:
            out = c * _BASE if out is None else (out ^ (out >> np.uint64(29)) ^ c) * _BASE
        return out

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which positions of a word-number sequence are hit, and by which items."""
        hit = np.zeros(len(ids) + 1, dtype=np.int64)
        items: set[int] = set()
        for n, hashes, rows, owners in self.levels:
            if len(ids) < n:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # all words of the window are of the benchmark
            if not len(starts):
                continue
            got = self.hashed([ids[starts + k] for k in range(n)])
            first = np.searchsorted(hashes, got)
            for s, a, h in zip(starts.tolist(), first.tolist(), got, strict=True):
                while a < len(hashes) and hashes[a] == h:  # equal hashes are confirmed word by word
                    if np.array_equal(rows[a], ids[s : s + n]):
                        hit[s] += 1
                        hit[s + n] -= 1
                        items.update(owners[a])
                    a += 1
        return np.cumsum(hit[:-1]) > 0, items


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items, distinct, in blocks of bounded bytes (one longer item is a block of its own)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.encode(F.col(text_col), "utf-8").alias("t")).na.drop(subset=["t"])
    block, held = [], 0
    for r in rows.distinct().orderBy("i", "t").toLocalIterator():
        if block and held + len(r.t) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, bytes(r.t)))
        held += len(r.t)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         size: int = SIZE, block_bytes: int = BLOCK_BYTES, out_col: str = "found") -> DataFrame:
    """``docs`` with a struct ``out_col``: ``n_words``, hit word ``spans``, ``n_hit``, ``items`` (sorted as text).

    Null text has no words; a null benchmark text has no window, a null item id no name in
    ``items`` (its hits count). An empty benchmark hits nothing. Each row is scanned by itself, so
    repeated rows and other columns have no effect; columns of ``docs`` are untouched, and an
    ``out_col`` that is one of them is refused. The
    benchmark is broadcast in blocks of at most ``block_bytes``; each text is scanned against every
    block, so a benchmark of any size is handled and a task holds one block's windows at a time.
    """
    if fresh(out_col, docs.columns) != out_col:
        raise ValueError(f"there is a column {out_col} already, name another one as out_col")
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(b) for b in item_blocks(benchmark, item_id, item_text, block_bytes)]

    def make():
        single = Windows(shared[0].value, size) if len(shared) == 1 else None

        def rows(data):
            split = [words_of(t) for t in data]
            flags = [np.zeros(len(w), dtype=bool) for w in split]
            names: list[set] = [set() for _ in split]
            for block in shared:
                windows = single or Windows(block.value, size)
                number = windows.vocab.get
                for i, row in enumerate(split):
                    ids = np.fromiter(map(number, row, repeat(0)), dtype=np.uint64, count=len(row))
                    hit, items = windows.scan(ids)
                    flags[i] |= hit
                    names[i].update(windows.names[x] for x in items)
            return [
                {"n_words": len(row), "spans": _runs(hit), "n_hit": int(hit.sum()), "items": sorted(x for x in found if x is not None)}
                for row, hit, found in zip(split, flags, names, strict=True)
            ]

        def look(column):
            return pa.array([r for _, data in runs(column, PART_BYTES if single else 16 * PART_BYTES) for r in rows(data)], type=KIND)

        return look

    return docs.withColumn(out_col, text_udf(make, RESULT)(F.col(text_col)))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop: bool = True, **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``drop=False``) without the hit words.

    Removing spans rewrites a text as the parts between hit spans, taken as they stand, joined by
    one space. Columns stay as they are.
    """
    name = fresh("found", docs.columns)
    found = scan(docs, benchmark, text_col, out_col=name, **options)
    if drop:
        return found.filter(F.col(name)["n_hit"] == 0).drop(name)

    def make():
        def cut(column, spans):
            out = []
            for text, rows in zip(column.to_pylist(), spans.to_pylist(), strict=True):
                if not rows:
                    out.append(text)
                    continue
                data = text.encode()
                places = [m.span() for m in WORD.finditer(data.lower())]
                kept, at = [], 0
                for r in rows:
                    kept.append(data[at : places[r["start"]][0]])
                    at = places[r["end"] - 1][1]
                kept.append(data[at:])
                out.append(b" ".join(x.strip() for x in kept if x.strip()).decode())
            return pa.array(out, type=pa.string())

        return cut

    return found.withColumn(text_col, text_udf(make, "string")(F.col(text_col), F.col(name)["spans"])).drop(name)
