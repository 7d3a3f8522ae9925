"""Phrase collocations by marginalising the longest windows.

Every word occurrence opens one window of ``longest`` words inside its piece, padded where the piece
ends. The windows stand side by side as shifted columns (the lead of one word, of two, ...), so
nothing is sorted to build them, and only these windows are counted. The count of a shorter phrase
is the sum over the windows that it begins: one ``ROLLUP`` over the counted windows gives all shorter
phrases, single words and the number of words of each language, without an explosion for each length.

Most long windows are rare, and a window with a rare pair of words in it is rare itself. So pairs are
counted first, as 64-bit hashes (two pairs of one hash only seem more frequent), and the frequent ones
mark a filter of ``FILTER_BITS`` bits. A window is padded from the second word of its first pair that
the filter does not know: no sum of a phrase that occurs often enough changes, and far fewer windows
are different. A full filter pads less, which costs shuffle and changes nothing.

Counts are exact over all texts. Candidates, their parts and the longer phrases around them meet in
joins whose keys are dealt over ``SALTS`` places, so a word that a third of all candidates share is
not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import runs, staged

#: Pieces end at these characters; words are separated by spaces and tabs.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
#: Bits of the filter of frequent pairs; the driver and every task hold that much.
FILTER_BITS = 1 << 27
#: Places that the rows of one phrase or word are dealt over in a join.
SALTS = 16
#: Windows counted at once in a task, and distinct words; a longer text goes beyond both.
WINDOWS, WORDS = 1 << 21, 1 << 19
_WHOLE = "decimal(20,0)"
_BREAK = b"\xff"  # no byte of a text
_LOW = bytes(_BREAK[0] if c in PIECE_END else c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Known(dict):
    """The numbers of a language's words; a new word gets the next one."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({_BREAK: 0})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


class Numbered:
    """Words of texts as numbers from 1, each language's own; 0 stands between pieces."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, _Known] = {}
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.parts: list[np.ndarray] = []
        self.held = 0

    def full(self) -> bool:
        return self.held > WINDOWS or len(self.words) > WORDS

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = _Known(lang, self.words, self.langs)
        tokens = text.translate(_LOW).replace(_BREAK, b" \xff ").split()
        tokens.append(_BREAK)
        self.parts.append(np.fromiter(map(self.known[lang].__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.held += len(tokens)

    def tokens(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int64), *self.parts], dtype=np.int64)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all neighbouring numbers, by language, and whether both are words."""
        own = np.array([xxhash.xxh64_intdigest(w, xxhash.xxh32_intdigest(x)) for w, x in zip(self.words, self.langs, strict=True)], dtype=np.uint64)
        h = own[ids]
        return _mixed(_mixed(h[:-1]) * _M2 + h[1:]), (ids[:-1] > 0) & (ids[1:] > 0)


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[Numbered]:
    """The words of all rows, some texts at a time."""
    now = Numbered()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, data in runs(batch.column(1)):
            for lang, text in zip(langs[at:], data, strict=False):
                now.add(lang, text)
                if now.full():
                    yield now
                    now.clear()
    yield now


def frequent_pairs(docs: DataFrame, text_col: str, lang_col: str, least: int) -> np.ndarray:
    """The filter, 64 bits a number: a bit for each pair that occurs ``least`` times, and a few more."""

    def count(batches):
        for now in _filled(batches):
            h, good = now.pairs(now.tokens())
            h, n = np.unique(h[good].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "c"])

    pairs = _source(docs, text_col, lang_col).mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    spots = pairs.select(F.pmod("h", F.lit(FILTER_BITS)).alias("s"))
    cells = spots.groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[cells.column("w").to_numpy()] = cells.column("b").to_numpy()
    return out.view(np.uint64)


def _counted(columns: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns of numbers of some bits, and how often each occurs."""
    key, held = columns[0], bits
    for c in columns[1:]:
        if held + bits > 63:  # number what is there, to make room
            key = np.unique(key, return_inverse=True)[1]
            held = len(key).bit_length()
        key, held = key << bits | c, held + bits
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def window_counts(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int) -> DataFrame:
    """``lang, w0 .., c``: how often each padded window occurs, where rare pairs may end a window early."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, text_col, lang_col, least))
    names = [f"w{k}" for k in range(longest)]

    def count(batches):
        known = shared.value
        for now in _filled(batches):
            ids = now.tokens()
            h, good = now.pairs(ids)
            spot = h % np.uint64(FILTER_BITS)
            good &= (known[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)) > 0
            # the lead of k words: whole where all pairs up to it are frequent; a text's last token is 0
            columns, whole = [ids], np.ones(len(ids), dtype=bool)
            for k in range(1, longest):
                whole = whole & np.append(good[k - 1 :], np.zeros(min(k, len(ids)), dtype=bool))
                columns.append(np.where(whole, np.append(ids[k:], np.zeros(min(k, len(ids)), dtype=np.int64)), 0))
            starts = ids > 0
            columns, n = _counted([c[starts] for c in columns], len(now.words).bit_length())
            words, langs = pa.array(now.words, pa.binary()).cast(pa.string()), pa.array(now.langs, pa.string())
            out = [langs.take(pa.array(columns[0])), *[words.take(pa.array(c, mask=c == 0)) for c in columns], pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, ["lang", *names, "c"])

    ddl = ", ".join(["lang string", *[f"{x} string" for x in names], "c bigint"])
    return _source(docs, text_col, lang_col).mapInArrow(count, ddl).groupBy("lang", *names).agg(F.sum("c").alias("c"))


def phrase_counts(counted: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, c`` of all phrases that occur ``least`` times, and ``lang, n``.

    The longest ones are the counted windows themselves, all others their rolled-up prefixes. A
    padded window is no phrase of its padded length.
    """
    names = [f"w{k}" for k in range(longest)]
    prefixes = names[:-1]
    # grouping_id is 0 for all columns, then 1, 3, 7 .. as the prefix gets shorter; the total of all languages is not needed
    rolled = counted.rollup("lang", *prefixes).agg(F.sum("c").alias("c"), F.grouping_id().alias("g"))
    held = staged(rolled.filter((F.col("c") >= least) | (F.col("g") == 2 ** len(prefixes) - 1)), "prefixes")
    out = [counted.filter(F.col(names[-1]).isNotNull() & (F.col("c") >= least))
           .select("lang", F.concat_ws(" ", *names).alias("phrase"), F.lit(longest).alias("words"), "c")]
    for k in range(1, longest):
        level = held.filter((F.col("g") == 2 ** (len(prefixes) - k) - 1) & F.col(names[k - 1]).isNotNull() & (F.col("c") >= least))
        out.append(level.select("lang", F.concat_ws(" ", *names[:k]).alias("phrase"), F.lit(k).alias("words"), "c"))
    totals = held.filter(F.col("g") == 2 ** len(prefixes) - 1).select("lang", F.col("c").alias("n"))
    return reduce(DataFrame.unionByName, out), totals


def _meet(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose left rows of one key are dealt over ``SALTS`` places; ``other`` has one row a key."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    spread = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "salt"], how).drop("salt")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of all phrases of several words, by their lowest-scoring cut.

    The score of a cut is ``floor(1000000 * a * a / (l * r))`` in whole numbers of up to 38 digits
    (counts up to 5 * 10**15 fit); ties go to the cut after fewer words. Any part of a phrase occurs
    at least as often as the phrase, so ``counts`` holds it.
    """
    whole = counts.filter("words > 1").withColumnRenamed("c", "a")
    words = F.split("phrase", " ")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
        "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    known = counts.select("lang", "phrase", "c")
    met = _meet(cuts, known.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    met = _meet(met, known.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(1000000 as {_WHOLE}) * cast(a as {_WHOLE}) * cast(a as {_WHOLE})) div (cast(l as {_WHOLE}) * cast(r as {_WHOLE}))")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("b"))
    return best.select("lang", "phrase", "b.words", "b.a", "b.l", "b.r", "b.score")


def covered(counts: DataFrame, percent: int) -> DataFrame:
    """``lang, phrase`` of phrases that lie inside a longer one which occurs ``percent`` per cent as often.

    Every phrase hands its count to the shorter ones inside it; the largest such count decides, so
    one pass with a partial maximum is enough.
    """
    words = F.split("phrase", " ")
    longest = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda at: F.array_join(F.slice(words, at, m), " ")))
    inside = counts.filter("words > 2").select("lang", F.explode(F.flatten(longest)).alias("phrase"), "c")
    most = inside.groupBy("lang", "phrase").agg(F.max("c").alias("m"))
    whole = counts.filter("words > 1").select("lang", "phrase", F.col("c").alias("a"))
    limit = F.expr(f"100 * cast(m as {_WHOLE}) >= {int(percent)} * cast(a as {_WHOLE})")
    return whole.join(most, ["lang", "phrase"]).filter(limit).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10,
                 percent: int = 50, top: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases by falling score.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times, overlaps included,
    within pieces of the text. A candidate goes if its words lie inside a longer candidate that
    occurs at least ``percent`` per cent as often, whether or not that one goes too. The first
    ``top`` of each language are returned (all, if None); ties in score go to the larger count, then
    to the phrase in byte order.

    Null and empty texts have no words; a null language is ``und``, together with rows that say
    ``und``. Repeated rows count each time. A text of any length is split in its own row; other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    if longest < 2:
        raise ValueError("a phrase has at least two words")
    counted = staged(window_counts(docs, text_col, lang_col, longest, least), "windows")
    counts, totals = phrase_counts(counted, longest, least)
    counts = staged(counts, "phrases")
    rows = scored(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
