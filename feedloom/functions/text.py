"""String column functions: cleaning, tokenising, normalising. JVM-side wherever Spark has
the primitive; only Unicode decomposition runs as an Arrow-batched function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.arrays import let

# Character classes.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\x{FFFD}]"
WHITESPACE = r"[ \t\n\r\p{Zs}]"
CJK_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(a|an|the)\b"
UNDEFINED = "〓"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def half_bytes(s) -> Column:
    """The first half of a string's UTF-8 bytes (a cut inside a character stays a cut)."""
    raw = F.encode(_c(s), "UTF-8")
    return F.substring(raw, F.lit(1), F.floor(F.octet_length(raw) / 2).cast("int")).cast("string")


def source_id(s) -> Column:
    """Id text to BIGINT; empty text is -1."""
    return F.coalesce(F.nullif(_c(s), F.lit("")).try_cast("bigint"), F.lit(-1).cast("bigint"))


def strip(s) -> Column:
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def split_words(s) -> Column:
    """Words between runs of whitespace; none for blank text."""
    return F.filter(F.split(_c(s), r"\s+"), lambda w: w != "")


def clean_text(s) -> Column:
    """Without control characters, every whitespace character a plain space."""
    return F.regexp_replace(F.regexp_replace(_c(s), CONTROL, ""), WHITESPACE, " ")


def space_cjk(s) -> Column:
    return F.regexp_replace(_c(s), f"({CJK})", " $1 ")


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Canonical decomposition without the nonspacing marks."""

    def plain(s):
        if s is None or s.isascii():
            return s
        parts = unicodedata.normalize("NFD", s)
        return "".join(c for c in parts if unicodedata.category(c) != "Mn")

    return text.map(plain)


def split_punct(s) -> Column:
    """Array of words in which every punctuation character is a token of its own."""
    return split_words(F.regexp_replace(_c(s), f"({PUNCTUATION})", " $1 "))


def basic_tokenize(s, lower: bool = True) -> Column:
    """Clean, space out ideographs, lower-case without accents, split off punctuation."""
    out = space_cjk(clean_text(s))
    if lower:
        out = strip_accents(F.lower(out))
    return split_punct(out)


ALNUM_RUN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def split_alnum_runs(s) -> Column:
    """Runs of letters/digits and runs of the rest; a lone inner space is implied, not kept."""
    runs = F.regexp_extract_all(_c(s), F.lit(ALNUM_RUN), F.lit(0))
    return let(
        runs, lambda rs: F.filter(rs, lambda r, i: (r != " ") | (i == 0) | (i == F.size(rs) - 1))
    )


def join_alnum_runs(tokens) -> Column:
    """Inverse of ``split_alnum_runs``."""
    alnum = lambda t: t.rlike(r"^[\p{L}\p{N}]")

    def spaced(ts):
        between = lambda t, i: (i > 0) & alnum(t) & alnum(F.get(ts, i - 1))
        return F.transform(ts, lambda t, i: F.when(between(t, i), F.concat(F.lit(" "), t)).otherwise(t))

    return F.array_join(let(_c(tokens), spaced), "")


def escape_token(token, alphabet: str) -> Column:
    r"""``\`` and ``_`` escaped, characters outside the alphabet as ``\code;``, ``_`` appended."""
    s = F.replace(F.replace(_c(token), F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\u"))
    known = lambda c: F.contains(F.lit(alphabet.replace("\n", "")), c)
    code = lambda c: F.concat(F.lit("\\"), F.ascii(c).cast("string"), F.lit(";"))
    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    return F.concat(
        F.array_join(F.transform(chars, lambda c: F.when(known(c), c).otherwise(code(c))), ""),
        F.lit("_"),
    )


def _from_code(digits: Column) -> Column:
    n = digits.try_cast("int")
    valid = n.isNotNull() & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    safe = F.when(valid, n).otherwise(ord(UNDEFINED))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def unescape_token(token) -> Column:
    """Inverse of ``escape_token`` (the closing ``_`` already removed)."""
    parts = F.regexp_extract_all(
        _c(token), F.lit(r"(?s)\\u|\\\\|\\[0-9]+;|."), F.lit(0)
    )

    def plain(p):
        return (
            F.when(p == "\\u", "_")
            .when(p == "\\\\", "\\")
            .when(F.length(p) > 1, _from_code(F.regexp_extract(p, "([0-9]+)", 1)))
            .otherwise(p)
        )

    return F.array_join(F.transform(parts, plain), "")


def bleu_tokenize(s) -> Column:
    """Punctuation split off except between digits; symbols always split off."""
    out = F.regexp_replace(_c(s), r"([^\p{Nd}])([\p{P}])", "$1 $2 ")
    out = F.regexp_replace(out, r"([\p{P}])([^\p{Nd}])", " $1 $2")
    out = F.regexp_replace(out, r"([\p{S}])", " $1 ")
    return split_words(out)


@F.pandas_udf(T.StringType())
def _without_combining(text: pd.Series) -> pd.Series:
    def plain(s):
        if s is None or s.isascii():
            return s
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return text.map(plain)


def preprocess_text(
    s, collapse: bool = True, lower: bool = False, keep_accents: bool = False, quotes: bool = False
) -> Column:
    """Collapsed spaces, compatibility decomposition without combining marks, lower case.

    ``quotes`` first turns doubled back-ticks and doubled single quotes into one double quote.
    """
    out = strip(s)
    if collapse:
        out = F.regexp_replace(out, r"\s+", " ")
    else:
        out = _c(s)
    if quotes:
        out = F.regexp_replace(out, "``|''", '"')
    if not keep_accents:
        out = _without_combining(out)
    return F.lower(out) if lower else out


def normalize_answer(s, spaced: bool = False) -> Column:
    """Lower case without punctuation, articles and surplus spaces.

    ``spaced`` puts a space in place of punctuation (and four quote marks) instead of
    deleting it.
    """
    out = F.lower(_c(s))
    if spaced:
        out = F.regexp_replace(out, f"{ASCII_PUNCTUATION}|[‘’´`]", " ")
    else:
        out = F.regexp_replace(out, ASCII_PUNCTUATION, "")
    return F.array_join(split_words(F.regexp_replace(out, ARTICLES, " ")), " ")


# Punctuation kept by each spelling of an answer.
ALIAS_KEEPS = ("", ",.", "-", ",.-", r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")


def _alias(s: Column, keep: str) -> Column:
    s = F.lower(F.replace(s, F.lit("_"), F.lit(" ")))
    dropped = "".join(c for c in ALIAS_KEEPS[-1] + "‘’´" if c not in keep)
    if dropped:
        s = F.translate(s, dropped, " " * len(dropped))
    return F.array_join(split_words(s), " ")


def answer_aliases(values, normalised=None) -> Column:
    """Distinct spellings of every given answer, with given normalised ones added."""
    spelled = F.transform(_c(values), lambda v: F.array(*[_alias(v, k) for k in ALIAS_KEEPS]))
    out = F.flatten(spelled)
    if normalised is not None:
        out = F.concat(out, _c(normalised))
    return F.array_distinct(out)


def normalize_url(url) -> Column:
    """Without query, percent-decoded, without ``http:``/``https:``; the fragment stays."""
    bare = F.regexp_replace(_c(url), r"^([^?#]*)\?[^#]*", "$1")
    kept_plus = F.replace(bare, F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(F.try_url_decode(kept_plus), bare)
    parts = F.filter(
        F.split(decoded, "//"),
        lambda p, i: ~F.when(i == 0, F.lower(p)).otherwise(p).isin("http:", "https:"),
    )
    return F.array_join(parts, "//")


def pair_lengths(len_a: Column, len_b: Column, limit) -> tuple[Column, Column]:
    """Lengths after dropping items one by one from the longer side (ties: the second)."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    a = F.least(len_a, F.greatest(limit - len_b, F.ceil(limit / 2).cast("int")))
    b = F.least(len_b, F.greatest(limit - len_a, F.floor(limit / 2).cast("int")))
    over = len_a + len_b > limit
    return F.when(over, a).otherwise(len_a), F.when(over, b).otherwise(len_b)


def truncate_pair(a, b, limit: int) -> tuple[Column, Column]:
    """Two token arrays cut to a total length, always from the end of the longer one."""
    a, b = _c(a), _c(b)
    n_a, n_b = pair_lengths(F.size(a), F.size(b), limit)
    return F.slice(a, F.lit(1), n_a), F.slice(b, F.lit(1), n_b)


def truncate_pair_ends(a, b, limit: int, front_share) -> tuple[Column, Column]:
    """Same lengths, but a share in [0, 1] of the dropped items comes off the front."""
    a, b = _c(a), _c(b)
    out = []
    for x, n in zip((a, b), pair_lengths(F.size(a), F.size(b), limit)):
        front = F.floor((F.size(x) - n) * front_share).cast("int")
        out.append(F.slice(x, front + 1, n))
    return out[0], out[1]


def pair_features(a, b, limit: int, cls="[CLS]", sep="[SEP]", pad="[PAD]") -> Column:
    """Struct of ``tokens``, ``type_ids`` and ``mask`` of one or two token arrays, padded.

    ``b`` may be None (or null) for a single sequence.
    """
    a = _c(a)
    if b is None:
        first, second = F.slice(a, 1, limit - 2), None
    else:
        first, second = truncate_pair(a, b, limit - 3)
    tokens = F.concat(F.array(F.lit(cls)), first, F.array(F.lit(sep)))
    head = F.size(tokens)
    if second is not None:
        tokens = F.concat(tokens, second, F.array(F.lit(sep)))
    used = F.size(tokens)
    fill = F.lit(limit) - used
    return F.struct(
        F.concat(tokens, F.array_repeat(F.lit(pad), fill)).alias("tokens"),
        F.concat(
            F.array_repeat(F.lit(0), head),
            F.array_repeat(F.lit(1), used - head),
            F.array_repeat(F.lit(0), fill),
        ).alias("type_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), fill)).alias("mask"),
    )


def sliding(tokens, n: int) -> Column:
    """All windows of n consecutive items; none when the array is shorter."""

    def windows(ts):
        starts = F.sequence(F.lit(1), F.greatest(F.size(ts) - n + 1, F.lit(1)))
        cut = F.transform(starts, lambda i: F.slice(ts, i, F.lit(n)))
        return F.filter(cut, lambda w: F.size(w) == n)

    return let(_c(tokens), windows)
