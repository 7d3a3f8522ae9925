"""Language-model scores: an interpolated n-gram model over whole texts, in Elias-Fano tries.

Words are split at white space with A-Z lowered; every text ends with one end token. The model is
counted over all words, pairs and triples of all teaching texts, without a cap or a least count:

    P1(w)    = (c(w) + 1) / (N + V + 1)
    P2(w|v)  = (c(vw) + PRIOR * P1(w)) / (c(v) + PRIOR)
    P3(w|uv) = (c(uvw) + PRIOR * P2(w|v)) / (c(uv) + PRIOR)

The first token of a text has the beginning as its only context. Probabilities of a context add up
to one, a word never seen included.

Nothing is broadcast and nothing but sizes, N and V passes the driver. Texts are dealt into chunks of
about ``CHUNK`` bytes. Each chunk names its distinct n-grams once, with how often its teaching texts
hold them; they meet by ranges of their hashes, where the counts of all chunks are added up, and the
sums go back to the chunks that asked and do not know them already. A task then holds one chunk and
the part of the model that its texts can ask for, as a trie of its own, so memory follows the chunk
and not the corpus. Words meet as 64-bit hashes, pairs and triples as hashes of 48 bits and those of
the range number, packed by range. Ranges grow in number with the input, so about one n-gram in 10^8
shares its hash with another; of 10^9 different words two share theirs with a probability of 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import crc_fold, runs, staged
from feedloom.llm.elias_fano import Level

#: Weight of the lower order, in tokens.
PRIOR = 4.0
#: Bytes of text in a chunk; a longer text is cut into pieces that know the two words before them.
CHUNK = 4 << 20
#: The end token as a word: no word holds white space.
END = "\n"

#: Packed n-grams that meet in one task at a time; bits of a hash below its range number.
RANGE_BYTES, LOW_BITS = 16 << 20, 48

_PLACED = "chunk bigint, row bigint, piece bigint, doc_id bigint, teach boolean, text string, size bigint, begins boolean, lead int, ends boolean"
_ASKED = "kind int, part bigint, chunk bigint, first bigint, last bigint, grams binary"
_SUMS = _ASKED + ", tokens bigint, kinds bigint"
_WORDS, _GRAMS = 0, 1
_SCORED = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, model double"


def pieces(text: bytes, most: int) -> Iterator[tuple[bytes, bool, int, bool]]:
    """A text as ``(piece, begins, lead, ends)``.

    A piece has about ``most`` bytes, or one longer word. ``lead`` words at its front repeat the end
    of the piece before, two if there are as many; ``begins`` says that nothing stands before them.
    """
    if len(text) <= most:
        yield text, True, 0, True
        return
    at, before = 0, []
    while True:
        stop = at + most
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        part, last = text[at:stop], stop >= len(text)
        yield b" ".join([*before, part]), len(before) < 2, len(before), last
        if last:
            return
        before = [*before, *part.split()][-2:]
        at = stop


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its context and that of its last word."""
    return _mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)


def _split(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The tokens of a chunk's texts by local number, where texts start, which tokens count here, which
    of these teach, the distinct words and how often they teach."""
    text = table.column("text").cast(pa.large_string()).combine_chunks()
    teach, begins, lead, ends = (table.column(c).to_numpy() for c in ("teach", "begins", "lead", "ends"))
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    n = np.bincount(owner.filter(real).to_numpy(), minlength=len(text))
    words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())])
    end, begin = len(words) - 1, len(words)
    sizes = n + begins + ends
    stop = np.cumsum(sizes)
    start, total = stop - sizes, int(sizes.sum())
    ids, inner, new = np.empty(total, dtype=np.int64), np.ones(total, dtype=bool), np.ones(total, dtype=bool)
    front, back = start[begins], (stop - 1)[ends]
    ids[front], ids[back] = begin, end
    inner[front] = inner[back] = new[front] = False
    ids[inner] = coded.indices.to_numpy()
    for k in np.flatnonzero(lead):  # only pieces of long texts have any
        new[start[k] + begins[k] : start[k] + begins[k] + lead[k]] = False
    taught = np.repeat(teach, sizes) & new
    return ids, start, new, taught, words, np.bincount(ids[taught], minlength=len(words) + 1)[: len(words)]


@dataclass(frozen=True)
class Grams:
    """The n-grams of a chunk by local number: words as in ``words`` (the end is the last), then the beginning.

    ``new`` marks tokens that count here: all but beginnings and repeated words. ``pair`` and
    ``triple`` are the distinct ``context * size + word``, a triple's context being its pair's place.
    ``*_c`` are the counts in teaching texts, ``ids`` and ``start`` the texts one behind the other.
    """

    words: pa.Array
    hashes: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    new: np.ndarray
    word_c: np.ndarray
    pair: np.ndarray
    pair_c: np.ndarray
    triple: np.ndarray
    triple_c: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + 1

    @staticmethod
    def of(table: pa.Table) -> Grams:
        ids, start, new, taught, words, word_c = _split(table)
        text_of = np.repeat(np.arange(len(table)), np.diff(np.append(start, len(ids))))

        def distinct(codes, at):
            found, place = np.unique(codes, return_inverse=True)
            return found, np.bincount(place, weights=taught[at], minlength=len(found)).astype(np.int64), place

        m = len(words) + 1
        first = np.flatnonzero(text_of[:-1] == text_of[1:])
        pair, pair_c, place = distinct(ids[first] * m + ids[first + 1], first + 1)
        third = np.flatnonzero(first[1:] == first[:-1] + 1)
        at = first[third] + 2
        third, at = third[new[at]], at[new[at]]
        triple, triple_c, _ = distinct(place[third] * m + ids[at], at)
        hashes = pd.util.hash_array(np.array([*words.to_pylist(), "\n\n"], dtype=object), categorize=False)
        return Grams(words, hashes, ids, start, new, word_c, pair, pair_c, triple, triple_c)

    def own(self) -> np.ndarray:
        """The counts of words, pairs and triples one behind the other."""
        return np.concatenate([self.word_c, self.pair_c, self.triple_c])

    def ranged(self, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``kind, part, keys, places``: hashes in rising order below their range number, and where they stand in :meth:`own`."""
        two = _joined(self.hashes[self.pair // self.size], self.hashes[self.pair % self.size])
        three = _joined(two[self.triple // self.size] ^ np.uint64(1), self.hashes[self.triple % self.size])
        for kind, keys, width, base in ((_WORDS, self.hashes[:-1], 64, 0), (_GRAMS, np.concatenate([two, three]), LOW_BITS, len(self.word_c))):
            low = min(width, 64 - bits)
            keys = keys >> np.uint64(64 - bits - low)
            places = np.argsort(keys)
            keys = keys[places]
            parts = keys >> np.uint64(low) if bits else np.zeros(len(keys), dtype=np.uint64)
            keys &= np.uint64((1 << low) - 1)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield kind, int(parts[a]), keys[a:b], places[a:b] + base

    def logs(self, word_c: np.ndarray, pair_c: np.ndarray, triple_c: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of P1 by word, P2 by pair and P3 by triple, from the counts over all chunks."""
        m = self.size
        one = (word_c + 1.0) / (tokens + kinds + 1.0)
        context = np.append(word_c, word_c[-1])  # as many beginnings as ends
        one_all = np.append(one, 1.0)
        two = (pair_c + PRIOR * one_all[self.pair % m]) / (context[self.pair // m] + PRIOR)
        parent, word = self.triple // m, self.triple % m
        lower = two[np.searchsorted(self.pair, self.pair[parent] % m * m + word)] if len(parent) else np.zeros(0)
        three = (triple_c + PRIOR * lower) / (pair_c[parent] + PRIOR)
        return np.log10(one), np.log10(two), np.log10(three)


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Rising numbers with a value each: the gaps and the values byte by byte, compressed."""
    gaps = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    planes = np.stack([gaps, values.astype("<u8")]).view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 16 * n), dtype=np.uint8).reshape(2, 8, n)
    gaps, values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8").reshape(2, n)
    return np.cumsum(gaps, dtype=np.uint64), values.astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a chunk that stand one behind the other, as one table."""
    held, own = [], None
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and chunk[a] != own:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            own = chunk[a]
    if held:
        yield pa.Table.from_batches(held)


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """Texts cut into pieces and dealt into chunks: odd chunks are scored, even ones only teach."""

    def deal(batches):
        base, row, piece = TaskContext.get().partitionId() << 24, 0, 0
        run, held = [0, 0], [0, 0]
        for batch in batches:
            ids, teach, ask = (batch.column(c).to_pylist() for c in ("doc_id", "teach", "ask"))
            for at, data in runs(batch.column("text")):
                out = []
                for k, text in enumerate(data, at):
                    row += 1
                    for part, begins, lead, ends in pieces(text, most):
                        if held[ask[k]] and held[ask[k]] + len(part) > most:
                            run[ask[k]] += 1
                            held[ask[k]] = 0
                        held[ask[k]] += len(part) + 1
                        piece += 1
                        out.append(((base + run[ask[k]] << 1) + ask[k], (base << 16) + row, (base << 16) + piece, ids[k], teach[k], part, len(part), begins, lead, ends))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                arrays[5] = arrays[5].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "row", "piece", "doc_id", "teach", "text", "size", "begins", "lead", "ends"])

    return rows.mapInArrow(deal, _PLACED)


def _asked(placed: DataFrame, bits: int) -> DataFrame:
    """The distinct words, pairs and triples of each chunk with their counts, packed by range of their hashes.

    A file may be read in parts, so a chunk may come in several; ``first`` and ``last`` are its pieces.
    """
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("part", "chunk", "first", "last")], ("grams", pa.binary())])

    def name(batches):
        for table in _chunks(batches):
            grams = Grams.of(table)
            own = grams.own()
            chunk, first, last = table.column("chunk")[0].as_py(), table.column("piece")[0].as_py(), table.column("piece")[-1].as_py()
            out = []
            for kind, part, keys, places in grams.ranged(bits):
                out.append((kind, part, chunk, first, last, packed(keys, own[places])))
                if len(out) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return placed.mapInArrow(name, _ASKED)


def _range_sums(table: pa.Table) -> pa.Table:
    """Of a range the sums over all chunks: to each chunk that asks, by place among those that it named,
    where they differ from its own count. A row without chunk holds the range's known words and their tokens."""
    rows = [unpacked(g.as_py()) for g in table.column("grams")]
    sizes = np.array([len(k) for k, _ in rows])
    keys, c = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) > 0]))
    sums = np.add.reduceat(c[order], head)
    total = np.empty_like(c)
    total[order] = np.repeat(sums, np.diff(np.append(head, len(c))))
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    out = [(kind, part, None, None, None, None, int(sums.sum()), int((sums > 0).sum()))] if kind == _WORDS else []
    stop = np.cumsum(sizes)
    for (chunk, first, last), a, b in zip(zip(*(table.column(c).to_pylist() for c in ("chunk", "first", "last")), strict=True), stop - sizes, stop, strict=True):
        other = np.flatnonzero(total[a:b] != c[a:b])
        if chunk & 1 and len(other):
            out.append((kind, part, chunk, first, last, packed(other, total[a:b][other]), None, None))
    types = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64()]
    columns = zip(*out, strict=True) if out else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "part", "chunk", "first", "last", "grams", "tokens", "kinds"])


def _with_sums(texts: pa.Table, grams: Grams, sums: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts over all chunks: the chunk's own ones where no other was sent."""
    own = grams.own()
    piece = texts.column("piece").to_numpy()
    sent: dict = {}
    for first, last, kind, part, data in zip(*(sums.column(c).to_pylist() for c in ("first", "last", "kind", "part", "grams")), strict=True):
        sent.setdefault((first, last), {})[kind, part] = data
    for (first, last), found in sent.items():
        if first == piece[0] and last == piece[-1]:
            for kind, part, _, places in grams.ranged(bits):
                if (kind, part) in found:
                    at, total = unpacked(found[kind, part])
                    own[places[at.astype(np.int64)]] = total
        else:  # the chunk was read in parts: the places are those of this part
            a, b = np.searchsorted(piece, [first, last + 1])
            some = Grams.of(texts.slice(a, b - a))
            by_key = {(kind, part): (keys, places) for kind, part, keys, places in grams.ranged(bits)}
            for kind, part, keys, _ in some.ranged(bits):
                if (kind, part) in found:
                    at, total = unpacked(found[kind, part])
                    every, places = by_key[kind, part]
                    own[places[np.searchsorted(every, keys[at.astype(np.int64)])]] = total
    w, p = len(grams.word_c), len(grams.pair)
    return own[:w], own[w : w + p], own[w + p :]


@dataclass(frozen=True)
class Trie:
    """A chunk's part of the model, its levels memory-mapped."""

    two: Level
    three: Level

    @staticmethod
    def build(grams: Grams, two: np.ndarray, three: np.ndarray) -> Trie:
        m = grams.size
        return Trie(Level.build(grams.pair // m, grams.pair % m + 1, m, two).mapped(),
                    Level.build(grams.triple // m, grams.triple % m + 1, len(grams.pair), three).mapped())

    def walk(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """log10 probability of every token after the one or two before it in its text; 0 at a text's first place."""
        logp, place = np.zeros(len(ids)), np.full(len(ids), -1, dtype=np.int64)
        later = np.ones(len(ids), dtype=bool)
        later[start[start < len(ids)]] = False
        at = np.flatnonzero(later)
        place[at] = self.two.find(ids[at - 1], ids[at] + 1, self.two.ranges())
        logp[at] = self.two.logp(place[at])
        deep = at[later[at - 1]]
        if self.three.keys.size and len(deep):
            found = self.three.find(place[deep - 1], ids[deep] + 1, self.three.ranges())
            logp[deep[found >= 0]] = self.three.logp(found[found >= 0])
        return logp


def score_chunk(texts: pa.Table, sums: pa.Table, tokens: int, kinds: int, bits: int) -> pa.Table:
    """One row per piece of text: its tokens, those known, and its log10 probabilities."""
    texts = texts.sort_by("piece")
    grams = Grams.of(texts)
    counts = _with_sums(texts, grams, sums, bits)
    one, two, three = grams.logs(*counts, tokens, kinds)
    logp = Trie.build(grams, two, three).walk(grams.ids, grams.start)
    taken = np.minimum(grams.ids, len(one) - 1)
    edges = np.append(grams.start, len(grams.ids))

    def summed(values):
        total = np.concatenate([[0], np.cumsum(np.where(grams.new, values, 0))])
        return total[edges[1:]] - total[edges[:-1]]

    def summed_apart(values):
        values = np.where(grams.new, values, 0.0)
        return np.array([values[a:b].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)])

    return pa.table({
        "row": texts.column("row"), "doc_id": texts.column("doc_id"),
        "n_tokens": summed(np.ones(len(grams.ids), dtype=np.int64)), "n_known": summed((counts[0][taken] > 0).astype(np.int64)),
        "base": summed_apart(one[taken]), "model": summed_apart(logp)})


@dataclass(frozen=True)
class Training:
    """The texts that teach: ``doc_id, text, teach``, and the rows they were taken from."""

    docs: DataFrame
    rows: DataFrame


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> Training:
    """Name the teaching texts: those whose ``crc32(id) mod folds`` is not ``held_out``; a null id teaches nothing.

    The counting itself is done by :func:`score`, for teaching and scored texts at once.
    """
    teach = F.coalesce(crc_fold(id_col, folds) != held_out, F.lit(False))
    return Training(docs, docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), teach.alias("teach")))


def score(docs: DataFrame, training: Training, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` sums log10 P1, ``score`` the model's log10 probability, both over the whole text
    and its end. Null and empty texts are their end token. Repeated rows are scored each; null ids
    are scored. Texts that both teach and are scored are read once. No n-gram is hot: a chunk names
    it once however often it holds it.
    """
    if docs is training.docs:
        rows = training.rows.withColumn("ask", F.lit(True))
    else:
        own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(False).alias("teach"), F.lit(True).alias("ask"))
        rows = own.unionByName(training.rows.filter("teach").withColumn("ask", F.lit(False)))
    placed = staged(_placed(rows, chunk), "lm-texts")
    odd = F.col("chunk") % 2 == 1
    size = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = (2 * size // RANGE_BYTES).bit_length()  # packed n-grams are about twice the text

    def add(table: pa.Table) -> pa.Table:
        return _range_sums(table)

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        return score_chunk(texts, found, tokens, kinds, bits)

    sums = staged(_asked(placed, bits).groupBy("kind", "part").applyInArrow(add, _SUMS), "lm-sums")
    seen = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds")]).first()
    tokens, kinds = int(seen[0]), int(seen[1])
    sums = sums.filter("chunk IS NOT NULL").drop("tokens", "kinds")
    parts = placed.filter(odd).drop("size").groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(work, _SCORED)
    return parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "model")]).select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("model").alias("score"))


def per_token(score_col: Column, tokens: Column) -> Column:
    """log10 probability per token."""
    return score_col / tokens
