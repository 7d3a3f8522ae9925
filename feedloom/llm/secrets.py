"""Secrets in texts: all rules in one combined automaton, one pass over the bytes.

The automaton of all rules tells where a match shows itself. Its start is found by the reversed rule
read backwards from there, its value by the rule's head read from the start (the longest), its end
by the value's characters; these run on hits only. Matches are leftmost and do not overlap within a
kind; one whose value is too short is dropped and the scan goes on behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.automaton import compile_trees, parse, reverse
from feedloom.llm.common import runs, text_udf, texts


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` and then one or more characters of the class ``value``, ``least`` of them to count.

    ``any_case`` is for the head's letters. A rule without a head is a run of the class.
    """

    kind: str
    head: str
    value: str
    least: int
    any_case: bool = False


#: The base kinds in the contract's order, then further published token forms.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
EXTRA = (
    Rule("forge", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("chat", r"xox[abprs]\-", r"[A-Za-z0-9\-]", 10),
    Rule("web", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.", r"[A-Za-z0-9_\-]", 10),
    Rule("key", r"\-\-\-\-\-BEGIN( [A-Z]+)* PRIVATE KEY", r"\-", 5),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


class Scanner:
    """The rules as automata over bytes, built once a task."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + EXTRA):
        self.kinds = [r.kind for r in rules]
        self.least = [r.least for r in rules]
        heads = [parse(r.head, r.any_case) for r in rules]
        values = [parse(r.value) for r in rules]
        shows = [("seq", [h, ("rep", v, 1 if r.head else r.least, 1 if r.head else r.least)]) for r, h, v in zip(rules, heads, values, strict=True)]
        self.start = compile_trees(shows).rows()[0]
        self.back = [compile_trees([reverse(("seq", [h, ("rep", v, 1, None)]))], floating=False).rows()[0] for h, v in zip(heads, values, strict=True)]
        self.heads = [compile_trees([h], floating=False).rows()[0] for h in heads]
        self.values = [v[1][0][1] for v in values]

    @staticmethod
    def _reach(row: list, data: bytes, places: range) -> int | None:
        """How many of ``places`` the longest match takes, read from the first on."""
        found = 0 if row[256] else None
        for n, i in enumerate(places, 1):
            row = row[data[i]]
            if row[256]:
                found = n
            elif all(x is row for x in row[:256]):  # nothing can match any more
                break
        return found

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, kind number, end)`` in bytes, in order of start and then kind."""
        row, out, resume = self.start, [], [0] * len(self.kinds)
        for i, byte in enumerate(data):
            row = row[byte]
            if row[256] is None:
                continue
            for k in row[256]:
                if i < resume[k]:
                    continue
                back = self._reach(self.back[k], data, range(i, resume[k] - 1, -1))
                if back is None:  # it would begin inside the match before
                    continue
                begin, end = i + 1 - back, i + 1
                while end < len(data) and data[end] in self.values[k]:
                    end += 1
                resume[k] = end
                head = self._reach(self.heads[k], data, range(begin, end)) or 0
                if end - begin - head >= self.least[k]:
                    out.append((begin, k, end))
        return sorted(out)

    def spans(self, data: bytes) -> list[dict]:
        """The matches with starts and ends in code points."""
        found = self.find(data)
        if not found:
            return []
        marks, at, points = {}, 0, 0
        for place in sorted({x for s, _, e in found for x in (s, e)}):
            points += len(data[at:place].decode("utf-8", "replace"))
            marks[place], at = points, place
        return [{"kind": self.kinds[k], "start": marks[s], "end": marks[e]} for s, k, e in found]


def secret_spans(text: Column, rules: tuple[Rule, ...] = BASE + EXTRA) -> Column:
    """All spans in the text by start, then by the rules' order; null and empty texts have none.

    Start and end count code points, the end is exclusive. Each row is read by itself, whole.
    """

    def make():
        scanner = Scanner(rules)
        return lambda column: pa.array([scanner.spans(t) for _, data in runs(column) for t in data], type=SPANS_KIND)

    return text_udf(make, SPANS)(text)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; null stays null."""

    def make():
        scanner = Scanner(rules)

        def cut(column):
            out = []
            for text, data in zip(column.to_pylist(), texts(column), strict=True):
                parts, at = [], 0
                for start, _, end in scanner.find(data):
                    if start >= at:
                        parts += [data[at:start], mark.encode()]
                    at = max(at, end)
                out.append(text if not parts else b"".join([*parts, data[at:]]).decode())
            return pa.array(out, type=pa.string())

        return cut

    return docs.withColumn(text_col, text_udf(make, "string")(F.col(text_col)))
