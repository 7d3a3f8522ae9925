"""Language identification by interpolated Kneser-Ney character models.

Texts become sequences of character classes: one for everything that is no letter (runs count
once), one for each of a to z, and the other letters hashed over the rest. Each language has a
trigram model in sorted arrays of n-gram codes, so it holds at most ``CLASSES ** 3`` entries
whatever the corpus. A text gets the language of the lowest cross-entropy per character; it is
marked as rejected where that lies above what nearly all training texts of the language have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import crc_fold, runs, text_udf

CLASSES, DISCOUNT = 64, 0.75
#: Cross-entropies are gathered in bins of this width, up to the last bin, for the rejection limits.
BIN_BITS, LAST_BIN, KEEP_SHARE = 0.02, 1000, 0.999
UNDEFINED = "und"
RESULT = "struct<lang:string,score:double,bits:double,rejected:boolean>"
_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("rejected", pa.bool_())])


def letter_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            out[point] = 27 + (point * 2654435761 >> 8) % (CLASSES - 27)
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k + 1
    for point in range(0x80, 0x250):  # a capital counts as its small letter
        low = chr(point).lower()
        if len(low) == 1:
            out[point] = out[ord(low)]
    return out


def encode(data: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts in a row and where each text starts (its end is the next start).

    Every text is taken as if between two gaps; a text without letters has no code.
    """
    parts, starts, at = [], [0], 0
    for text in data:
        seq = classes[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)]
        seq = np.concatenate([[0, 0], seq, [0]]).astype(np.int32)
        keep = (seq[1:] > 0) | (seq[:-1] > 0)
        seq = np.concatenate([np.zeros(2, dtype=np.int32), seq[1:][keep]]) if keep.any() else seq[:0]
        if len(seq) > 2:
            parts.append((seq[:-2] * CLASSES + seq[1:-1]) * CLASSES + seq[2:])
            at += len(parts[-1])
        starts.append(at)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), np.array(starts)


@dataclass(frozen=True)
class CharModel:
    """Sorted codes of each order with log2 probabilities, and of each context with its left-over mass."""

    codes: tuple[np.ndarray, np.ndarray]
    probs: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    spare: tuple[np.ndarray, np.ndarray]
    single: np.ndarray

    @staticmethod
    def build(code: np.ndarray, count: np.ndarray) -> CharModel:
        """From trigram counts; lower orders count the different characters in front."""
        order = np.argsort(code)
        code, count = code[order], count[order].astype(float)
        pair, pair_n = np.unique(code % CLASSES**2, return_counts=True)
        _, single_n = np.unique(pair % CLASSES, return_counts=True)
        single = np.full(CLASSES, 1.0 / CLASSES)
        total = single_n.sum()
        left = DISCOUNT * len(single_n) / total
        single *= left
        single[np.unique(pair % CLASSES)] += np.maximum(single_n - DISCOUNT, 0) / total
        p2, c2, s2 = CharModel._level(pair, pair_n.astype(float), single[pair % CLASSES])
        at = np.searchsorted(pair, code % CLASSES**2)
        p3, c3, s3 = CharModel._level(code, count, p2[at])
        return CharModel((pair, code), (p2, p3), (c2, c3), (s2, s3), single)

    @staticmethod
    def _level(code: np.ndarray, count: np.ndarray, lower: np.ndarray) -> tuple:
        context, inverse, kinds = np.unique(code // CLASSES, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=count)
        cut = np.minimum(count, DISCOUNT)
        spare = np.bincount(inverse, weights=cut) / total
        return (count - cut) / total[inverse] + spare[inverse] * lower, context, spare

    def _query(self, level: int, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes[level], code), len(self.codes[level]) - 1)
        found = self.codes[level][at] == code
        context = code // CLASSES
        place = np.minimum(np.searchsorted(self.contexts[level], context), len(self.contexts[level]) - 1)
        spare = np.where(self.contexts[level][place] == context, self.spare[level][place], 1.0)
        return np.where(found, self.probs[level][at], spare * lower)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each trigram's last character after its first two."""
        pair = code % CLASSES**2
        return -np.log2(self._query(1, code, self._query(0, pair, self.single[pair % CLASSES])))


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    models: list[CharModel]
    limits: np.ndarray
    sharpness: float = 40.0

    def table(self) -> np.ndarray:
        """Bits of every trigram in every language, looked up once a task."""
        every = np.arange(CLASSES**3)
        return np.column_stack([m.bits(every) for m in self.models]).astype(np.float32)

    def entropies(self, column: pa.Array, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Bits per character, a row for each text and a column for each language; nan without letters."""
        out = np.full((len(column), len(self.names)), np.nan)
        for at, data in runs(column):
            codes, starts = encode(data, classes)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            if len(full):
                sums = np.column_stack([np.add.reduceat(table[codes, k].astype(np.float64), starts[:-1][full]) for k in range(len(self.names))])
                out[at + full] = sums / n[full][:, None]
        return out

    def predict_column(self, text: Column) -> Column:
        """``lang``, ``score`` (share of the best language), ``bits`` and ``rejected`` of a text.

        A null, empty or letterless text, or any text where nothing was learned, is ``und`` with score
        0 and is rejected; of equal languages the first by name wins.
        """

        def make():
            if not self.names:
                return lambda column: pa.array([{"lang": UNDEFINED, "score": 0.0, "bits": None, "rejected": True}] * len(column), type=_KIND)
            classes, table = letter_classes(), self.table()

            def work(column):
                found = self.entropies(column, classes, table)
                blank = np.isnan(found[:, 0])
                safe = np.where(blank[:, None], 0.0, found)
                best = safe.argmin(axis=1)
                low = safe[np.arange(len(best)), best]
                score = 1.0 / np.exp2(-self.sharpness * (safe - low[:, None])).sum(axis=1)
                rows = zip(blank.tolist(), best.tolist(), score.tolist(), low.tolist(), (low > self.limits[best]).tolist(), strict=True)
                return pa.array([
                    {"lang": UNDEFINED, "score": 0.0, "bits": None, "rejected": True} if no
                    else {"lang": self.names[b], "score": s, "bits": x, "rejected": r} for no, b, s, x, r in rows
                ], type=_KIND)

            return work

        return text_udf(make, RESULT)(text)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> LanguageModel:
    """Learn from all texts with a language whose ``crc32(id) mod folds`` is not ``held_out``.

    Trigrams are counted in the tasks and added up by Spark; what comes back is bounded by the
    classes. A second pass over the same texts gathers the rejection limits. Null texts, languages
    and ids teach nothing.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).filter(
        (crc_fold(id_col, folds) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def count(batches):
        classes = letter_classes()
        for batch in batches:
            for name in sorted(set(batch.column(0).to_pylist())):
                total = np.zeros(CLASSES**3, dtype=np.int64)
                for _, data in runs(batch.column(1).filter(pc.equal(batch.column(0), name))):
                    total += np.bincount(encode(data, classes)[0], minlength=CLASSES**3)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "code", "n"])

    counts = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counts.toPandas().sort_values(["lang", "code"])
    names = sorted(got["lang"].unique().tolist())
    models = [CharModel.build(g["code"].to_numpy(), g["n"].to_numpy()) for _, g in got.groupby("lang", sort=True)]
    plain = LanguageModel(names, models, np.full(len(names), np.inf))
    if not names:
        return plain

    def spread(batches):
        classes, table = letter_classes(), plain.table()
        for batch in batches:
            own = np.array([names.index(x) if x in names else 0 for x in batch.column(0).to_pylist()])
            bits = plain.entropies(batch.column(1), classes, table)[np.arange(len(own)), own]
            fine = ~np.isnan(bits)
            cell = own[fine] * (LAST_BIN + 1) + np.minimum(bits[fine] / BIN_BITS, LAST_BIN).astype(int)
            total = np.bincount(cell)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = known.mapInArrow(spread, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    limits = np.full(len(names), np.inf)
    for k in range(len(names)):
        own = cells[cells["cell"] // (LAST_BIN + 1) == k].sort_values("cell")
        share = own["n"].cumsum() / max(own["n"].sum(), 1)
        if len(own):
            limits[k] = (own["cell"].to_numpy()[int(np.argmax(share.to_numpy() >= KEEP_SHARE))] % (LAST_BIN + 1) + 1) * BIN_BITS
    return LanguageModel(names, models, limits)
