"""Edge cases and brute-force comparisons of operators 11 to 13."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import prefix_trie, topk, variants

# --- 13 top-k ------------------------------------------------------------------------------------------------------


def plain_top_k(rows, queries, k=5, scale=256):
    """One list for each query row, by exact integers; the query's own row is the one at its place."""
    good = lambda r: r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])
    whole = [(r[0], [int(np.floor(scale * float(x))) for x in r[1]]) for r in rows if good(r)]
    out = []
    for at, (q, v) in enumerate(whole):
        if q in queries:
            found = [(-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(whole) if n != at and len(w) == len(v)]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def searched(df, k=5):
    return sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 10 = 0"), df, k).collect())


VECTORS = "vec_id long, embedding array<double>"


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.1, 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(1000, 1400)]  # one common vector: ties go to smaller ids
    rows += [(10, [9.0, 9.0, 9.0, 9.0])] * 8 + [(20, [1.0, 2.0, 3.0])] * 2 + [(30, [1.0, 2.0, -3.0])]  # copies, and another length
    rows += [(None, [1.0] * 4), (40, None), (50, [None, 1.0, 1.0, 1.0]), (60, [float("nan")] * 4), (70, [float("inf")] * 4), (80, [])]
    want = plain_top_k(rows, set(range(0, 2000, 10)))
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("dim", "shard", "block", "rank", "score", "id", "vector")}).repartition(3)
    assert searched(df) == want
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 4 * 8 * 20)
    monkeypatch.setattr(topk, "FAN", 3)
    assert searched(df) == want  # many blocks and shards, merged in three rounds
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 10 and embedding[0] = 9").limit(1)
    assert topk.top_k(one, df, 50, skip_own=False).where(f"score = {4 * (9 * 256) ** 2}").count() == 8


@pytest.mark.parametrize("far", [0.0, 2.0**45])
def test_top_k_of_large_components_is_exact(spark, far):
    """Scores past 2^53; with `far` a product bound past 2^63, although no score is."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 0, 1]) / 256, *(rng.randrange(-4, 4) * 2.0**20 + rng.random() for _ in range(2))]) for i in range(80)] + [(81, [far, 1.0, 2.0])]
    assert searched(spark.createDataFrame(rows, VECTORS)) == plain_top_k(rows, set(range(0, 80, 10)))


def test_top_k_refuses_scores_beyond_a_long(spark):
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], VECTORS), spark.createDataFrame([(0, [1e30]), (1, [1e30])], VECTORS)).collect()


# --- 11 prefix trie ------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """A trie walked turn by turn."""
    convs = defaultdict(list)
    md5 = lambda s: hashlib.md5(s.encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, md5(role or ""), md5(text or ""), role or "", text or ""))
    convs = {c: [t[4:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, convs.get(c - int(np.fmod(c, 100)), [])
        rebuilt[c] = base[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(rebuilt[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows():
    rng, rows = random.Random(5), []
    for c in [*range(0, 330), *range(-150, -90), 70_000, 70_001, 140_000]:
        if c == 100:
            continue  # a base that isn't there
        for turn in range(rng.choice([1, 1, 2, 3, 5, 7])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "é😀", None, "a long text"])))
    rows += [(400, t, "user", "same") for t in range(45)] + [(401, t, "user", "same") for t in range(37)]
    rows += [(500, None, "user", "b"), (500, None, "user", "a"), (500, 1, None, "c"), (500, 1, None, "c"), (None, 0, "user", "no conversation")]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def trie_of(df):
    return sorted((tuple(r) for r in prefix_trie.shared_prefixes(df).collect()), key=str)


@pytest.mark.parametrize(("span", "ranges"), [(4096, 1 << 18), (4, 40)])
def test_prefix_trie_equals_a_plain_one(spark, monkeypatch, span, ranges):
    """With short spans and ranges long conversations and common turns are cut many times."""
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    monkeypatch.setattr(prefix_trie, "RANGE_ROWS", ranges)
    df = spark.createDataFrame(trie_rows(), TURNS).withColumns({c: F.lit("mine") for c in ("conv", "depth", "key", "head", "name", "part", "n")})
    assert trie_of(df) == plain_trie(trie_rows())


def test_prefix_trie_without_turns(spark):
    """Empty tables, and conversations that lose all their turns to a base that isn't there."""
    assert trie_of(spark.createDataFrame([], TURNS)) == []
    rows = [(c, 0, "user", "x") for c in range(101, 140)]
    lone = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6]
    assert trie_of(spark.createDataFrame(lone, TURNS)) == plain_trie(lone)
    assert trie_of(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


# --- 12 spelling variants ------------------------------------------------------------------------------------------


def plain_vocabulary(rows, min_chars=6, min_n=5):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += len(w) >= min_chars
    return {w: n for w, n in total.items() if n >= min_n}


def at_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocab):
    near = {w: [v for v in vocab if at_one(w, v)] for w in vocab}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * vocab[w] else None
    root = {}
    for w in vocab:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return sorted(((w, form[w], root[w], vocab[w], len(near[w]), vocab.get(form[w])) for w in vocab), key=str)


def grouped(df):
    return sorted((tuple(r) for r in variants.group_variants(df).collect()), key=str)


def test_vocabulary_equals_a_plain_one(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abÀÿ÷C") for _ in range(rng.randrange(4, 9)))
    few = [word() for _ in range(60)]
    rows = [(i, " ".join(rng.choice(few) + rng.choice(["", ",", " 日", "\n"]) for _ in range(80))) for i in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (70, None), (71, ""), (72, "words, " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("mine"), "n": F.lit(1)})
    want = plain_vocabulary(rows)
    assert {r["word"]: r["n"] for r in variants.vocabulary(df).collect()} == want
    monkeypatch.setattr(variants, "COUNTED", 7)
    monkeypatch.setattr(variants, "PIECE", 50)
    assert {r["word"]: r["n"] for r in variants.vocabulary(df).collect()} == want
    assert variants.vocabulary(df.limit(0)).count() == 0


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocab = {"".join(rng.choice("aabé") for _ in range(rng.randrange(6, 9))): rng.choice([5, 5, 7, 30, 160, 900, 5000]) for _ in range(400)}
    vocab |= {"prefix" + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 5))): rng.choice([5, 25, 125, 625]) for _ in range(150)}
    long = "a" * 253
    vocab |= {long + end: n for n, end in enumerate(["", "b", "bc", "bd", "bcd", "bce", "bcdb", "cbcd", "bcdbc", "bcdbccc"], 5)}
    vocab |= {"b" + long + "a": 40, "b" + long + "ab": 400, "x" * 3000: 5, "x" * 1500 + "y" + "x" * 1500: 6, "x" * 1500 + "y" + "x" * 1499: 50}
    want = plain_variants(vocab)
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert grouped(df) == want
    monkeypatch.setattr(variants, "CHUNK", 16)
    assert grouped(df) == want  # many ranges, words of most pairs in different ones
    assert grouped(df.limit(0)) == [] and grouped(df.limit(1))[0][4] == 0


def test_a_range_that_is_too_large_is_cut_again(spark, monkeypatch):
    vocab = {f"word{a}{b}{c}": 5 + ord(a) for a in "abcde" for b in "abcde" for c in "abcde"}
    monkeypatch.setattr(variants, "CHUNK", 10)
    monkeypatch.setattr(variants.math, "ceil", lambda x: 1)
    assert grouped(spark.createDataFrame(list(vocab.items()), "word string, n long")) == plain_variants(vocab)
