import math
import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import corpus as C
from feedloom.operators import vocabulary as V
from feedloom.session import staged


def words_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def plain_discount(counts, least):
    """Longest first: take a kept token's count off each of its prefixes."""
    left = dict(counts)
    for token in sorted(counts, key=len, reverse=True):
        if left[token] >= least:
            for end in range(1, len(token)):
                left[token[:end]] -= left[token]
    return left


@pytest.mark.parametrize("tree_rows", [5, 40, 100000])
def test_prefix_discount(spark, tree_rows):
    rng = random.Random(tree_rows)
    counts = {}
    for _ in range(300):
        word, n = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))), rng.randrange(1, 6)
        for end in range(1, len(word) + 1):
            counts[word[:end]] = counts.get(word[:end], 0) + n
    least = 6
    often = {w: n for w, n in counts.items() if n >= least}
    df = spark.createDataFrame(list(often.items()), "token string, n bigint")
    got = {r["token"]: r["left"] for r in V.discount_prefixes(df, least, tree_rows).collect()}
    assert got == plain_discount(often, least)


def test_vocabulary_and_round_trip(spark):
    texts = [(0, "the_lower low lowest"), (1, "new newer newest, low!"), (2, ""), (3, "  two  spaces\\ü ")]
    docs = spark.createDataFrame(texts, "id int, text string")
    words, chars = V.escaped_counts(docs, "text")
    vocab = V.subword_vocab(words, chars, 2)
    rows = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(rows.values()) == list(range(len(rows)))
    assert rows["<pad>"] == 0 and rows["<EOS>"] == 1 and set(chars) <= set(rows)
    coded = V.subword_encode(docs, ["id"], "text", vocab, chars)
    assert all(r["ids"][-1] == V.EOS_ID for r in coded.collect())
    back = {r["id"]: r["text"] for r in V.subword_decode(coded, ["id"], "ids", vocab).collect()}
    assert back == dict(texts)


def test_wordpiece_values(spark):
    vocab = spark.createDataFrame([(t,) for t in ("un", "##aff", "##able", "runn", "##ing")], "token string")
    words = spark.createDataFrame([("unaffable",), ("running",), ("unwanted",), ("u" * 401,)], "word string")
    got = {r["word"]: r["pieces"] for r in V.wordpiece(words, vocab).collect()}
    assert got["unaffable"] == ["un", "##aff", "##able"] and got["running"] == ["runn", "##ing"]
    assert got["unwanted"] == ["[UNK]"] and got["u" * 401] == ["[UNK]"]


@pytest.mark.usefixtures("many_ranges")
def test_longest_prefixes(spark):
    """Entries that begin before a range and end inside it, repeated texts, texts without an entry."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab中") for _ in range(rng.randrange(9))) for _ in range(400)] + [None, "", "c", "ab\U0001f600"]
    entries = sorted({t[: rng.randrange(1, 9)] for t in rng.sample(texts[:400], 60) if t})
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["n"] for r in V.longest_prefixes(rows, spark.createDataFrame([(e,) for e in entries], "text string"), ["id"]).collect()}
    assert got == {i: max((len(e) for e in entries if t and t.startswith(e)), default=0) for i, t in enumerate(texts)}


@pytest.mark.usefixtures("many_ranges")
@pytest.mark.parametrize("prefix", ["", "##"])
def test_ways_of_segmenting(spark, prefix):
    """Shipped whole, shipped for the rest of a word, and joined: the same pieces; no way writes a word's substrings."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abc#") for _ in range(rng.randrange(1, 10))) for _ in range(200)] + ["", "a" * 30, "##ab", "x"]
    tokens = ["", "##", "a", "b", "##a", "##b", "##c", "##ab", "##bca"] + ["".join(rng.choice("abc#") for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    words = [*dict.fromkeys(words), "x", None]
    df, vocab = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in tokens], "token string")
    later = sum(len(t) + V.ENTRY_BYTES for t in tokens if t and t.startswith(prefix) and len(t) > len(prefix))
    known = set(tokens) - {""}

    def cut(word):
        at, pieces = 0, []
        while word is not None and at < len(word):
            found = [p for n in range(len(word) - at, 0, -1) if (p := (prefix if at else "") + word[at : at + n]) in known]
            if not found:
                return None
            pieces.append(found[0])
            at += len(found[0]) - (len(prefix) if at else 0)
        return None if word is None else pieces

    want = sorted(((w, cut(w)) for w in words), key=repr)
    assert any(p is None for w, p in want if w) and sum(len(p or ()) > 2 for _, p in want) > 20
    for shipped in (1 << 20, later, 0):
        cuts = V.segment_words(df, vocab, prefix, shipped=shipped)
        assert sorted(((r["word"], r["pieces"]) for r in cuts.collect()), key=repr) == want


def test_joined_words_ask_once_a_block(spark, monkeypatch):
    """A text that many words of a block hold is looked up once; blocks of any size give the shipped way's pieces."""
    asked, whole = [], V.longest_prefixes

    def counted(rows, entries, key=()):
        asked.append(rows.count())
        return whole(rows, entries, key)

    monkeypatch.setattr(V, "longest_prefixes", counted)
    words = [f"{i:010b}" for i in range(500)] + ["", "0", "10" * 40, "1x", "x1", "01é0", None, "10", "10"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    vocab = spark.createDataFrame([(t,) for t in ("0", "1", "10", "##0", "##1", "##01", "##110", "##é", "0000000")], "token string")
    plain = lambda way: sorted(((r["word"], r["pieces"]) for r in way.collect()), key=repr)
    want = plain(V.segment_words(df, vocab, "##"))
    assert plain(V.segment_words(df, vocab, "##", shipped=0)) == want and len(want) == len(words)
    assert asked[0] == len(words) and asked[1] < 100  # 4,500 starts, 14 texts of them
    monkeypatch.setattr(V, "BLOCK_STARTS", 7)
    assert plain(V.segment_words(df, vocab, "##", shipped=0)) == want and asked[3] > 500


def test_grams(spark):
    tokens = ["[CLS]", "That", "lit", "##tle", "blue", "tru", "##ck", "[SEP]"]
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    got = [tuple(r) for r in df.select(C.gram_spans("t")).first()[0]]
    assert got == [(1, 2), (2, 4), (4, 5), (5, 7)]


def test_ngram_masks(spark):
    tokens = ["[CLS]"] + [p for i in range(60) for p in (["w"] if i % 3 else ["w", "##x"])] + ["[SEP]"]
    df = spark.createDataFrame([(i, tokens) for i in range(40)], "k int, t array<string>").withColumn("g", C.gram_spans("t"))
    spans = df.select("g").first()[0]
    whole = {tuple(range(b, e)) for b, e in spans}
    for row in df.select(C.ngram_positions("g", F.lit(12), 3, F.col("k"), 5).alias("p")).collect():
        assert row["p"] == sorted(set(row["p"])) and 0 < len(row["p"]) <= 12
        left = set(row["p"])
        for w in whole:
            if left & set(w):
                assert set(w) <= left
    assert df.select(C.ngram_positions("g", F.lit(12), 3, F.col("k"), 5).alias("p")).distinct().count() > 30


def test_ngram_masks_like_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        words = [["w"] + ["##x"] * rng.randrange(3) for _ in range(rng.randrange(12))]
        rows.append((k, ["[CLS]"] + [p for w in words for p in w] + ["[SEP]"] + [p for w in words[:4] for p in w] + ["[SEP]"]))
    df = spark.createDataFrame(rows, "k int, t array<string>").withColumn("g", C.gram_spans("t"))
    got = {r["k"]: r for r in df.select("k", "g", C.ngram_positions("g", F.lit(7), 3, F.col("k"), 5).alias("p")).collect()}
    low, m = 2147483647, {1: 0, 2: 0, 3: 0}
    for k, _ in rows:
        spans = [(g["begin"], g["end"]) for g in got[k]["g"]]
        order = []
        for n in (1, 2, 3):
            for run in zip(*[spans[i:] for i in range(n)]):
                if all(x[1] == y[0] for x, y in zip(run, run[1:])):
                    linear = (k * 48271 + (run[0][0] * 4 + n) * 69621 + 5 * 16807 + 12345) % low
                    u = ((linear * linear) % low * 48271 + linear + 11) % low / low
                    order.append((-math.log(1 - u) * n, run[0][0], run[-1][1], n))
        want = set()
        for _, begin, end, n in sorted(order):
            run = set(range(begin, end))
            if not run & want and len(want | run) <= 7:
                want |= run
                m[n] += 1
        assert got[k]["p"] == sorted(want)
    assert m[1] > m[2] > m[3] > 0


def test_sentence_pairs(spark):
    rng = random.Random(1)
    docs = {d: [[f"d{d}s{s}w{w}" for w in range(rng.randrange(1, 15))] for s in range(rng.randrange(1, 12))] for d in range(30)}
    df = spark.createDataFrame(list(docs.items()), "id int, s array<array<string>>")
    rows = C.sentence_pairs(df, "id", "s", 32, 3, copies=2).collect()
    doc_of = lambda w: int(w[1:].split("s")[0])
    assert {r["id"] for r in rows} == set(docs)
    for r in rows:
        sep = r["tokens"].index("[SEP]")
        a, b = r["tokens"][1:sep], r["tokens"][sep + 1 : -1]
        assert a and b and len(r["tokens"]) <= 32 and len(r["type_ids"]) == len(r["tokens"])
        assert r["type_ids"] == [0] * (sep + 1) + [1] * (len(b) + 1)
        assert {doc_of(w) for w in a} == {r["id"]}
        assert (doc_of(b[0]) == r["id"]) != r["is_random"]
    assert 0.2 < sum(r["is_random"] for r in rows) / len(rows) < 0.95


@pytest.mark.usefixtures("many_ranges")
def test_segments(spark):
    rng = random.Random(4)
    docs = [(d, [[f"t{rng.randrange(99)}" for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 9))]) for d in range(60)]
    df = spark.createDataFrame(docs, "id int, s array<array<string>>")
    stream, steps = C.segment_stream(df, "id", "s", 2, 7)
    stream = stream.cache()
    rows = {}
    for r in stream.collect():
        rows.setdefault(r["row"], {})[r["col"]] = (r["token"], r["parity"])
    assert set(rows) == {0, 1} and all(sorted(r) == list(range(steps)) for r in rows.values())
    assert steps == sum(len(w) for _, s in docs for w in s) // 2
    seq, reuse = 32, 8
    total = seq - reuse - 3
    out = C.segments_ab(stream, steps, seq, reuse, 9).collect()
    changes = {r: [c for c in range(1, steps) if rows[r][c][1] != rows[r][c - 1][1]] for r in rows}
    for i in out:
        a0, a1 = i["a_begin"], i["a_begin"] + i["a_length"]
        b0, b1 = i["b_begin"], i["b_begin"] + i["b_length"]
        assert i["data_index"] % reuse == 0 and a0 == i["data_index"] + reuse
        assert i["a_length"] + i["b_length"] <= total and a0 + total < steps and b1 < steps
        cuts = [c for c in changes[i["row"]] if a0 < c < a0 + total]
        if i["label"] == 1:
            assert cuts and b0 in cuts and a1 <= b0
        else:
            assert b0 == 0 or b0 in changes[i["row"]]
    starts = {(i["row"], i["data_index"]) for i in out}
    assert len(starts) == len(out) and 0 < sum(i["label"] for i in out) < len(out)
    tokens = C.segment_tokens(C.segments_ab(stream, steps, seq, reuse, 9), stream, reuse).collect()
    assert len(tokens) == len(out)
    for r in tokens:
        line = rows[r["row"]]
        assert r["tokens"][: reuse] == [line[r["data_index"] + k][0] for k in range(reuse)]
        assert r["tokens"][-1] == "<cls>" and r["tokens"].count("<sep>") == 2


def test_segments_grow_without_the_driver(spark, monkeypatch):
    """Sentences and instances are shuffled, however small their files; small blocks give the tokens of large ones, also at shared places."""
    rows = [(r, c, f"t{r}{c * 7 % 11}", c // 5 % 2) for r in range(2) for c in range(400)] + [(0, c, f"u{c}", c // 5 % 2) for c in range(90, 130)]
    stream = spark.createDataFrame(rows, "row bigint, col bigint, token string, parity int")
    out = C.segments_ab(stream, 400, 32, 8, 9)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    out = out.cache()
    whole = sorted(C.segment_tokens(out, stream, 8).collect())
    held = {}
    for r, c, token, _ in rows:
        held.setdefault((r, c), []).append(token)
    place = lambda r, a, n: [t for c in range(a, a + n) for t in sorted(held[r, c])]
    for a, got in zip(sorted(out.collect()), whole, strict=True):
        parts = (a["data_index"], 8), (a["a_begin"], a["a_length"]), (a["b_begin"], a["b_length"])
        reused, first, second = (place(a["row"], *p) for p in parts)
        assert got["tokens"] == reused + first + ["<sep>"] + second + ["<sep>", "<cls>"] and got["first_part"] == len(reused + first) + 1
    monkeypatch.setattr(C, "BLOCK", 8)
    monkeypatch.setattr(C, "HALO", 4)
    assert sorted(C.segment_tokens(out, stream, 8).collect()) == whole
    monkeypatch.setattr(C, "SENT_STARTS", 0)
    docs = spark.createDataFrame([(i, [["a", "b"], [f"c{i}"]]) for i in range(9)], "id int, s array<array<string>>")
    got = C.segment_pieces(docs, "id", "s", 2, 7)[0]
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_tagging_packs_whole_words(spark):
    sizes = [1, 3, 2, 0, 9, 4, 1, 1, 5, 2]
    pieces = [[f"w{i}p{j}" for j in range(n)] for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(1, pieces, list(range(10)))], "k int, p array<array<string>>, l array<int>")
    out = C.tagging_features(df, ["k"], "p", "l", 8).orderBy("sub_id").collect()
    want, room = [[]], 6
    for i, p in enumerate(pieces):
        p = p if 0 < len(p) <= room else ["[UNK]"]
        if len(want[-1]) + len(p) > room:
            want.append([])
        want[-1] += [(x, i if j == 0 else -1) for j, x in enumerate(p)]
    assert len(out) == len(want)
    for row, sub in zip(out, want):
        assert row["tokens"] == (["[CLS]"] + [x for x, _ in sub] + ["[SEP]"] + ["[PAD]"] * 8)[:8]
        assert row["label_ids"] == ([-1] + [l for _, l in sub] + [-1] * 9)[:8]


def plain_evidence(paragraphs, taken, max_tokens, max_global, stride):
    """Sentence sizes of every row, by growing each row sentence by sentence."""
    p, rows = 0, []
    while p < len(paragraphs):
        after = [(q, n) for q in range(p, len(paragraphs)) for n in paragraphs[q]]
        row = 0
        while row < len(after) and taken + sum(n for _, n in after[: row + 1]) + 1 < max_tokens and 1 + taken + row < max_global:
            row += 1
        rows.append([n for _, n in after[:row]])
        if row == len(after) or stride <= 0:
            break
        stop = after[row][0]
        p = max([p + 1] + [q for q in range(p + 1, stop + 2) if sum(map(sum, paragraphs[p:q])) <= stride])
    return rows


@pytest.mark.parametrize("max_tokens, max_global, stride", [(24, 50, 12), (40, 9, 20), (16, 6, 0), (30, 30, 100)])
def test_evidence_rows_like_brute_force(spark, max_tokens, max_global, stride):
    rng = random.Random(max_tokens)
    docs = {0: [], 1: [[]], 2: [[], [3], []], 3: [[99], [1]], 4: [[5, 6], [7], [3, 3, 3], [12], [4]]}
    for k in range(5, 60):
        docs[k] = [[rng.randrange(1, 12) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame([(k, [[["a"] * n for n in p] for p in d], k % 4) for k, d in docs.items()], "k int, p array<array<array<string>>>, q int")
    got = {k: [] for k in docs}
    for r in C.evidence_features(df, ["k"], "p", "q", max_tokens, max_global, stride).orderBy("k", "stride_index").collect():
        assert r["stride_index"] == len(got[r["k"]])
        got[r["k"]].append([len(s) for s in r["sentences"]])
    assert got == {k: plain_evidence(d, k % 4, max_tokens, max_global, stride) for k, d in docs.items()}


def test_chunks_cover_every_sentence(spark):
    rng = random.Random(8)
    docs = [(k, [rng.randrange(1, 15) for _ in range(rng.randrange(1, 30))]) for k in range(200)] + [(200, [])]
    df = spark.createDataFrame(docs, "k bigint, s array<int>")
    plan = C.chunk_plan(F.col("s"), F.col("k"), 29, 0.1, 3)
    rows = {r["k"]: r["c"] for r in df.select("k", plan.alias("c")).collect()}
    assert rows[200] == []
    apart, short = [], 0
    for k, sizes in docs[:-1]:
        at, targets = 0, {c["wanted"] + sum(sizes[c["a_from"] : c["a_to"]]) for c in rows[k]}
        assert len(targets) == 1
        target = targets.pop()
        short += target < 29
        for c in rows[k]:
            assert c["a_from"] == at < c["a_to"] <= c["b_to"] <= len(sizes)
            count = c["b_to"] - at
            assert c["b_to"] == len(sizes) or sum(sizes[at : c["b_to"]]) >= target
            assert count == 1 or sum(sizes[at : c["b_to"] - 1]) < target
            assert c["is_random"] if count == 1 else c["a_to"] < c["b_to"]
            apart += [c["is_random"]] * (count > 1)
            at = c["a_to"] if c["is_random"] else c["b_to"]
        assert at == len(sizes)
    assert 0.4 < sum(apart) / len(apart) < 0.6 and 5 < short < 40


def test_answer_spans(spark):
    text = "Die Straße in New-York is new york indeed"
    offsets, at = [], 0
    for w in text.split(" "):
        offsets.append(at)
        at += len(w.encode()) + 1
    df = spark.createDataFrame([(1, text, offsets, ["new york", "york"])], "k int, c string, o array<int>, a array<string>")
    got = sorted((r["begin"], r["end"], r["text"]) for r in C.answer_spans(df, ["k"], "c", "o", "a").collect())
    assert got == [(3, 3, "New-York"), (3, 3, "York"), (5, 6, "new york"), (6, 6, "york")]


def test_both_ways_to_segment_agree(spark):
    """The shipped and the joined vocabulary give the same pieces, also for odd words."""
    tokens = ["a", "ab", "abc", "##b", "##bc", "##c", "##", "é", "##é", "𝄞x", "##𝄞", "xx", "##xxxx", "##x", ""]
    vocab = spark.createDataFrame([(t,) for t in tokens], "token string")
    letters = ["a", "b", "c", "x", "é", "𝄞"]
    made = {"".join(letters[(k // 6**i) % 6] for i in range(n)) for n in range(1, 5) for k in range(0, 6**n, 1 + n)}
    words = spark.createDataFrame([(w,) for w in sorted(made | {"", "x" * 500, "abc" * 60})], "word string")
    for prefix in ("##", ""):
        got = [{r["word"]: r["pieces"] for r in V.segment_words(words, vocab, prefix, shipped).collect()} for shipped in (V.SHIPPED_BYTES, 0)]
        assert got[0] == got[1] and any(got[0].values()) and None in got[0].values()
    assert V.segment_words(words.limit(0), vocab).count() == 0
    assert {r["pieces"] is None for r in V.segment_words(words.filter("word <> ''"), vocab.limit(0)).collect()} == {True}


def test_a_word_that_begins_like_a_continuation(spark):
    vocab = spark.createDataFrame([(t,) for t in ("##ab", "##", "#", "a", "##b")], "token string")
    words = spark.createDataFrame([(w,) for w in ("##ab", "##abb", "##b", "ab", "##a", "#b", "##")], "word string")
    got = [{r["word"]: r["pieces"] for r in V.segment_words(words, vocab, "##", shipped).collect()} for shipped in (V.SHIPPED_BYTES, 0)]
    assert got[0] == got[1] and got[0]["##abb"] == ["##ab", "##b"] and got[0]["##a"] is None


@pytest.mark.usefixtures("many_ranges")
def test_segments_from_pieces_equal_those_from_tokens(spark):
    """The stream by sentences gives the token stream's segments; lookups sort no range again and again."""
    rng = random.Random(8)
    docs = [(d, [[f"t{rng.randrange(99)}" for _ in range(rng.choice([1, 5, 90, 700]))] for _ in range(rng.randrange(1, 9))]) for d in range(40)]
    df = spark.createDataFrame(docs, "id int, s array<array<string>>")
    pieces, steps = C.segment_pieces(df, "id", "s", 3, 7)
    pieces = pieces.cache()
    stream = C.segment_stream(df, "id", "s", 3, 7)[0].cache()
    held = [(r["row"], r["col"] + i, t, r["parity"]) for r in pieces.collect() for i, t in enumerate(r["tokens"])]
    assert sorted(held) == sorted(tuple(r) for r in stream.collect()) and len(held) == 3 * steps
    cut = [C.segments_ab(s, steps, 128, 64, 9).cache() for s in (pieces, stream)]
    assert sorted(cut[0].collect()) == sorted(cut[1].collect()) != []
    tokens = [sorted(C.segment_tokens(cut[0], s, 64).collect()) for s in (pieces, stream)]
    assert tokens[0] == tokens[1] != []
    line = {(row, col): token for row, col, token, _ in held}
    for a, got in zip(sorted(cut[0].collect()), tokens[0]):
        spans = ((a["data_index"], 64), (a["a_begin"], a["a_length"]), (a["b_begin"], a["b_length"]))
        reused, first, second = ([line[a["row"], at + i] for i in range(n)] for at, n in spans)
        assert got["tokens"] == [*reused, *first, "<sep>", *second, "<sep>", "<cls>"]


def test_attention_rows_of_any_length(spark):
    """Compared as one array a row, not by a lambda for every pair of positions."""
    rng = random.Random(5)
    rows = [(k, (o := rng.sample(range(n), n)), [rng.random() < 0.6 for _ in o]) for k, n in enumerate([3, 3, 0, 7, 64, 64, 1])]
    df = spark.createDataFrame([*rows, (9, None, [True])], "k int, o array<int>, p array<boolean>").coalesce(1)
    out = df.select("k", C.attention_mask(F.col("o"), F.col("p")).alias("m"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString()
    got = {r["k"]: r["m"] for r in out.collect()}
    assert got.pop(9) is None
    for k, o, p in rows:
        assert got[k] == [[int((x if a else -1) > (y if b else -2)) for y, b in zip(o, p)] for x, a in zip(o, p)]


def test_runs_taken_equal_a_plain_walk(spark):
    """Draws are made for a batch of rows at once, also where words do not touch and where there is no key."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        at, spans = 1, []
        for _ in range(rng.randrange(0, 30)):
            size = rng.randrange(1, 5)
            spans.append((at, at + size))
            at += size + (rng.random() < 0.1)
        rows.append((k if k % 9 else None, k, rng.randrange(0, 12), spans))
    rows.append((5, 99, 3, None))
    df = spark.createDataFrame(rows, "key long, id int, n int, s array<struct<begin: int, end: int>>").repartition(3)
    out = df.select("id", C.ngram_spans("s", F.col("n"), 3, F.col("key"), 71).alias("g"))
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString()
    got = {r["id"]: r["g"] and [tuple(g) for g in r["g"]] for r in out.collect()}
    m = 2147483647

    def draw(key, b):
        linear = (key % m * 48271 + b * 69621 + 71 * 16807 + 12345) % m
        return ((linear * linear) % m * 48271 + linear + 11) % m / m

    import math

    for key, k, count, spans in rows:
        if spans is None:
            assert got[k] is None
            continue
        runs = [spans[i : i + n] for n in (1, 2, 3) for i in range(len(spans) - n + 1)]
        runs = [r for r in runs if all(x[1] == y[0] for x, y in zip(r, r[1:]))]
        order = sorted((0 if key is None else -math.log(1 - draw(key, r[0][0] * 4 + len(r))) * len(r), r[0][0], r[-1][1]) for r in runs)
        taken = []
        for _, b, e in order:
            if sum(y - x for x, y in taken) + e - b <= count and not any(x < e and y > b for x, y in taken):
                taken.append((b, e))
        assert (got[k] or []) == sorted(taken)


def test_offsets_of_a_long_text(spark):
    """One pass: concatenating what was there for every word took minutes on a text of this length."""
    from feedloom.functions.arrays import offsets_before

    df = spark.createDataFrame([([1] * 200_000,), ([2, 5],), ([],), (None,)], "s array<int>").coalesce(1)
    got = [r[0] for r in df.select(offsets_before("s")).collect()]
    assert got[0] == list(range(200_000)) and got[1:] == [[0, 2], [], None]


def test_tagging_features_and_tallies_stay_with_their_rows(spark):
    """Rows of their own keys are not shuffled with their words; rows under one key are joined as before."""
    from feedloom.operators.timelines import item_tallies

    rng = random.Random(9)
    rows = [(k, [[f"p{rng.randrange(5)}"] * rng.randrange(0, 4) for _ in range(n)], list(range(n))) for k, n in enumerate([0, 1, 30, 40, 7])]
    df = spark.createDataFrame(rows, "k int, p array<array<string>>, l array<int>")
    both = [C.tagging_features(x, ["k"], "p", "l", 8) for x in (df, df.unionByName(df.filter("k = 4")))]
    assert "ollect_list" not in both[0]._jdf.queryExecution().toString()
    got = [sorted(tuple(r) for r in x.collect()) for x in both]
    want = []
    for k, words, labels in rows:
        subs = []
        for p, l in zip(words, labels):
            p = p or ["[UNK]"]
            if not subs or sum(len(x) for x, _ in subs[-1]) + len(p) > 6:
                subs.append([])
            subs[-1].append((p, [l] + [-1] * (len(p) - 1)))
        for i, s in enumerate(subs):
            tokens, ids = ["[CLS]", *[x for p, _ in s for x in p], "[SEP]"], [-1, *[x for _, l in s for x in l], -1]
            want.append((k, i, tokens + ["[PAD]"] * (8 - len(tokens)), ids + [-1] * (8 - len(ids))))
    assert got[0] == sorted(want)
    assert [r for r in got[1] if r[0] < 4] == [r for r in got[0] if r[0] < 4] and {r[:2] for r in got[1]} == {r[:2] for r in got[0]}
    doubled = [r for r in got[1] if r[0] == 4][0][2]
    once = [r for r in got[0] if r[0] == 4][0][2]
    assert doubled == ["[CLS]", *[x for p in rows[4][1] for x in (p or ["[UNK]"]) * 2], "[SEP]", *["[PAD]"] * 8][:8] and doubled != once

    items = spark.createDataFrame([(1, ["a", "b", "a", "a"]), (2, ["c"]), (3, []), (4, None), (None, ["x", "y"])], "k int, i array<string>")
    tallies = lambda x: sorted((tuple(r) for r in x.collect()), key=str)
    alone = item_tallies(items, ["k"], "i")
    assert "_item" not in alone._jdf.queryExecution().toString()
    assert tallies(alone) == [(1, 4, 2, 3), (2, 1, 1, 1), (None, 2, 2, 1)]
    assert tallies(item_tallies(items.unionByName(items.filter("k = 1 or k is null")), ["k"], "i")) == [(1, 8, 2, 6), (2, 1, 1, 1), (None, 4, 2, 2)]


def test_target_vocabulary_counts_the_first_round_once(spark, monkeypatch):
    """Every minimum count starts from the same counts, and rare sub-tokens are not kept."""
    rng = random.Random(3)
    words = [("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) + "_", rng.randrange(1, 300)) for _ in range(60)]
    df = spark.createDataFrame(list(dict(words).items()), "word string, n long").cache()
    calls, counted = [], V._counted
    monkeypatch.setattr(V, "_counted", lambda w, v, least: calls.append((least, counted(w, v, least))) or calls[-1][1])
    vocab, least = V.subword_vocab_target(df, "abcde_", 40, 3, iterations=1)
    got = {r["token"]: r["id"] for r in vocab.collect()}
    rounds = len(calls)
    assert rounds <= 3 and all(r["n"] >= bound or len(r["token"]) == 1 for bound, c in calls for r in c.collect())
    plain = {r["token"]: r["id"] for r in V.subword_vocab(df, "abcde_", least, 1).collect()}
    assert got == plain and len(calls) == rounds + 1


def test_sentence_pairs_are_cut_beside_their_document(spark, monkeypatch):
    """One table is written, and none is joined to a document's text but the parts drawn elsewhere."""
    docs = [(d, [[f"d{d}s{s}w{w}" for w in range(3 + (d + s) % 5)] for s in range(6)]) for d in range(30)]
    df = spark.createDataFrame(docs, "id int, s array<array<string>>")
    labels = []
    monkeypatch.setattr(C, "staged", lambda x, label="stage": labels.append(label) or staged(x, label))
    out = C.sentence_pairs(df, "id", "s", 32, 3, copies=2)
    assert labels == ["docs"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {(r["id"], r["copy"]) for r in out.collect()} == {(d, c) for d in range(30) for c in range(2)}


def test_a_vocabulary_is_built_without_the_driver(spark, monkeypatch):
    """Tables that grow with the corpus are shuffled at every size; a large vocabulary also when ids are read."""
    plans, solved = [], V.staged
    monkeypatch.setattr(V, "staged", lambda df, label="stage": plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or solved(df, label))
    rows = [(f"{a}{b}{c}", 1 + (len(a) + ord(c)) % 5) for a in ("ab", "abc", "b") for b in "abcde" for c in "abc"]
    words = spark.createDataFrame(rows, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    vocab = V.subword_vocab(staged(words), "abcde", 2, iterations=2, tree_rows=8)
    kinds = {label for label, plan in plans if "BroadcastHashJoin" not in plan}
    assert {"counts", "tree"} <= kinds and all("BroadcastHashJoin" not in plan for label, plan in plans if label in ("counts", "tree"))
    whole = V.subword_vocab(staged(words), "abcde", 2, iterations=2)
    assert sorted(vocab.collect()) == sorted(whole.collect())
    coded = staged(V.subword_encode(spark.createDataFrame([(1, "abc ab bad"), (2, "")], "id int, text string"), ["id"], "text", vocab, "abcde_"))
    texts = []
    for most in (0, 1 << 18):
        monkeypatch.setattr(V, "SENT_ENTRIES", most)
        out = V.subword_decode(coded, ["id"], "ids", vocab)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        texts.append(sorted(out.collect()))
    assert texts[0] == texts[1]
