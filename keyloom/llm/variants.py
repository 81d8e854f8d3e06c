"""Spelling variants: a trie self-join with active nodes over a vocabulary that is dealt by prefixes.

The vocabulary, in code-point order, is cut into chunks: ranges of prefixes. A task builds the trie of one
chunk and propagates its active nodes: two nodes become active for each other where one letter is replaced
(two children of a node) or inserted (a node and its child). From there on the distance is spent, so a
pair only goes on to children with equal letters, down to pairs of terminals. Each pair of words is reached
once, at the node where they part. Nodes are numbers and one step moves all pairs of the chunk at once.

Words of two chunks part above the cut between them, at a depth that the first and the last word of the
neighbour chunks bound for each word. For those few depths the same propagation is one grouping: nodes that
go on with equal letters meet under (node, letters behind the edit), where at most one word for each letter
can be. A chunk is never split by how often a prefix occurs, so a prefix that a third of all words share
is only many chunks.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import CRC_TABLE_SQL, LOWER, UPPER, crc32_sql, discard, materialise, read_table

#: Words of a chunk; more in a range are cut again.
CHUNK = 1 << 14
#: Different words that a task counts before it passes the counts on.
COUNTED = 300_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 24
#: Words of this length or longer don't enter a trie but meet at every depth, under digests.
LONG = 256
_MARK = "\x01"
_PRIME, _BASE = 2**127 - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835

#: Letters A-Z a-z U+00C0 to U+00FF as Latin-1, A-Z lower-cased; everything else is a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def _pieces(data: bytes):
    """Cuts of a long text at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        yield data[at:] if end < 0 else data[at:end]
        at = len(data) if end < 0 else end


def _count(min_chars: int, modulus: int):
    def table(total):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: dict[bytes, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if (text := text.as_py()) is None:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for piece in _pieces(text.encode("latin-1", "replace").translate(_LETTERS)):
                    for w, n in Counter(piece.split()).items():
                        if len(w) < min_chars:
                            continue
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % modulus == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < min_chars:
                                continue
                        total[w] = total.get(w, 0) + n
                if len(total) >= COUNTED:
                    yield table(total)
                    total = {}
        yield table(total)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_n: int = 5, modulus: int = 199) -> DataFrame:
    """word, n: the words of all texts with at least min_chars code points and min_n occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where the unsigned crc32 of
    `<id>:<word>` is divisible by modulus, the occurrence loses its letter number crc32 % length. A null text has
    no words; a null id is written as nothing. Repeated rows count again, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = rows.mapInArrow(_count(min_chars, modulus), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def terminal_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted, different words at distance one: the trie self-join of one chunk."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < 2:
        return none, none
    size = np.array([len(w) for w in words])
    depth = int(size.max())
    grid = np.frombuffer(b"".join(w.ljust(depth, b"\0") for w in words), dtype=np.uint8).reshape(len(words), depth)
    # Word i makes a node for each of its prefixes that it doesn't share with the word before it.
    shared = np.concatenate([[0], np.argmax(np.hstack([grid[1:] != grid[:-1], np.ones((len(words) - 1, 1), bool)]), axis=1)])
    made = size - shared
    start = np.cumsum(made) - made + 1
    column = np.arange(depth)
    node = np.where((column >= shared[:, None]) & (column < size[:, None]), start[:, None] + column - shared[:, None], 0)
    parents, letters = np.zeros(int(made.sum()) + 1, dtype=np.int64), np.zeros(int(made.sum()) + 1, dtype=np.int64)
    new = node > 0
    path = np.hstack([np.zeros((len(words), 1), dtype=np.int64), np.maximum.accumulate(node, axis=0)])
    parents[node[new]], letters[node[new]] = path[:, :-1][new], grid[new]
    terminal = np.full(len(parents), -1, dtype=np.int64)
    terminal[path[np.arange(len(words)), size]] = np.arange(len(words))
    # Children in order of (parent, letter), and where those of each node start.
    keys = parents[1:] * 256 + letters[1:]
    order = np.argsort(keys, kind="stable")
    keys, kids = keys[order], order + 1
    first = np.searchsorted(keys, np.arange(len(parents)) * 256)
    count = np.searchsorted(keys, np.arange(1, len(parents) + 1) * 256) - first

    def below(a, b, but=None):
        """Children of a and of b with equal letters; `but`: a letter that doesn't count, for each pair."""
        swap = count[a] > count[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        each = np.repeat(np.arange(len(a)), count[a])
        at = np.arange(len(each)) - np.repeat(np.cumsum(count[a]) - count[a], count[a]) + first[a][each]
        child = kids[at]
        if but is not None:
            keep = letters[child] != but[each]
            each, child = each[keep], child[keep]
        want = b[each] * 256 + letters[child]
        spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[spot] == want
        return child[hit], kids[spot[hit]]

    left, right = [], []

    def emit(a, b):
        both = (terminal[a] >= 0) & (terminal[b] >= 0)
        left.append(terminal[a[both]])
        right.append(terminal[b[both]])

    # Inserted: a node and its child, which part at the next letter. Replaced: two children of a node.
    child = kids
    emit(parents[child], child)
    active = [below(parents[child], child, letters[child])]
    step = 1
    while True:
        same = np.flatnonzero(parents[kids[step:]] == parents[kids[:-step]]) if step < len(kids) else none
        if not len(same):
            break
        active.append((kids[same], kids[same + step]))
        step += 1
    a, b = np.concatenate([x for x, _ in active]), np.concatenate([y for _, y in active])
    while len(a):
        emit(a, b)
        a, b = below(a, b)
    return np.concatenate(left), np.concatenate(right)


def _fold(i, j, n, size):
    """For each word: how many near words, and the most frequent of them (the smallest of equals), or -1."""
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    best = np.full(size, -1, dtype=np.int64)
    top = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    best[a[top]] = b[top]
    return np.bincount(a, minlength=size), best


def _chunks(batches):
    """One range of the vocabulary, in order: the near words within each chunk."""
    part, sub, words, counts = TaskContext.get().partitionId(), 0, [], []

    def done():
        coded = [w.encode("latin-1") for w in words]
        n = np.array(counts, dtype=np.int64)
        near, best = _fold(*terminal_pairs(coded), n, len(words))
        some = best >= 0
        top = pa.array([words[b] if s else None for b, s in zip(best, some)], pa.string())
        home = pa.array(np.full(len(words), (part << 20) + sub), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n), home, pa.array(near, pa.int64()), pa.array(n[best], pa.int64(), mask=~some), top], ["word", "n", "home", "near", "best_n", "best"])

    for b in batches:
        words += b.column("word").to_pylist()
        counts += b.column("n").to_pylist()
        while len(words) >= 2 * CHUNK:
            later = words[CHUNK:], counts[CHUNK:]
            words, counts = words[:CHUNK], counts[:CHUNK]
            yield done()
            sub += 1
            words, counts = later
    if words:
        yield done()


def _common(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _digested(word: str):
    """(place, digest of the letters before it, digest of those from it on) for each place of a long word."""
    after, h = [0], 0
    power = 1
    for c in reversed(word):
        h = (h + ord(c) * power) % _PRIME
        power = power * _BASE % _PRIME
        after.append(h)
    after.reverse()
    h = 0
    for i in range(len(word) + 1):
        yield i, h, after[i], after[min(i + 1, len(word))]
        if i < len(word):
            h = (h * _BASE + ord(word[i])) % _PRIME


def _cuts(word: str, deepest: int):
    """(node, rest, letter): the word without its letter behind the node, and as it is (no letter), down to a depth."""
    for i in range(min(deepest, len(word)) + 1):
        if i < len(word):
            yield word[:i], word[i + 1 :], word[i]
        yield word[:i], word[i:], ""


def _long_cuts(word: str):
    for i, before, whole, rest in _digested(word):
        node = f"{_MARK}{i}:{before:x}"
        if i < len(word):
            yield node, f"{word[i + 1 : i + 2]}{len(word) - i - 1}:{rest:x}", word[i]
        yield node, f"{word[i : i + 1]}{len(word) - i}:{whole:x}", ""


def _edges(batches):
    """The nodes above the cuts, where a word can meet words of other chunks."""
    names = ["node", "rest", "letter", "n", "home", "word"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    rows: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    for b in batches:
        for word, n, home, before, after in zip(*(b.column(c).to_pylist() for c in ("word", "n", "home", "before", "after"))):
            if len(word) < LONG:
                rows += [(*cut, n, home, None) for cut in _cuts(word, max(_common(word, before), _common(word, after)))]
            if len(word) >= LONG - 1:
                for cut in _long_cuts(word):
                    rows.append((*cut, n, home, word))
                    if len(rows) >= 50_000:
                        yield flush()
                        rows = []
            if len(rows) >= 50_000:
                yield flush()
                rows = []
    if rows:
        yield flush()


def _across(placed: DataFrame, long_words: DataFrame) -> DataFrame:
    """Near words of different chunks, and of long words: word, n, near, best_n, best of each meeting."""
    spark = placed.sparkSession
    ends = placed.groupBy("home").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    ends = sorted(ends.collect(), key=lambda r: r["home"])  # a row a chunk
    bounds = [(r["home"], ends[i - 1]["high"] if i else None, ends[i + 1]["low"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    bounds = spark.createDataFrame(bounds, "home long, before string, after string")
    none = F.lit(None).cast("string")
    rows = placed.select("word", "n", "home").join(F.broadcast(bounds), "home").select("word", "n", "home", "before", "after")
    rows = rows.unionByName(long_words.select("word", "n", F.lit(None).cast("long").alias("home"), none.alias("before"), none.alias("after")))
    cuts = rows.mapInArrow(_edges, "node string, rest string, letter string, n long, home long, word string")
    met = cuts.groupBy("node", "rest").agg(F.collect_list(F.struct("letter", "n", "home", "word")).alias("all")).where(F.size("all") > 1)
    # A word and the same word with a letter more part here unless that letter is the next one anyway.
    ahead = F.substring("rest", 1, 1)
    met = met.select("node", "rest", "all", ahead.alias("ahead"), F.explode("all").alias("me"))
    name = lambda v: F.coalesce(v["word"], F.concat(F.col("node"), v["letter"], F.col("rest")))
    apart = lambda v: (v["letter"] != F.col("me.letter")) & ~v["home"].eqNullSafe(F.col("me.home"))
    outside = lambda v: v["home"].isNull() & F.col("me.home").isNull() & (v["letter"] != F.col("me.letter"))
    parts = lambda v: ((v["letter"] != "") & (F.col("me.letter") != "")) | (F.concat(v["letter"], F.col("me.letter")) != F.col("ahead"))
    # Words just below LONG also meet under digests, but there only long ones count.
    counts = lambda v: ~F.startswith(F.col("node"), F.lit(_MARK)) | v["home"].isNull() | F.col("me.home").isNull()
    near = F.filter("all", lambda v: (apart(v) | outside(v)) & parts(v) & counts(v))
    best = F.array_min(F.transform(near, lambda v: F.struct(F.bitwise_not(v["n"]).alias("down"), name(v).alias("word"))))
    out = met.select(name(F.col("me")).alias("word"), F.col("me.n").alias("n"), F.size(near).cast("long").alias("near"), best.alias("best")).where("near > 0")
    return out.select("word", "n", "near", F.bitwise_not("best.down").alias("best_n"), F.col("best.word").alias("best"))


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n, n_near (words at distance exactly one), best and best_n (the most frequent of them; equal counts: the smallest).

    vocab: word, n, each word once, of letters below U+0100. A word without near words has n_near 0 and nulls. An
    empty table gives an empty table.
    """
    vocab = materialise(vocab, "vocabulary")
    short = vocab.where(F.char_length("word") < LONG)
    ranges = max(1, math.ceil(short.count() / CHUNK))
    dealt = short.repartitionByRange(ranges, "word").sortWithinPartitions("word")
    placed = materialise(dealt.mapInArrow(_chunks, "word string, n long, home long, near long, best_n long, best string"), "chunks")
    long_words = vocab.where(F.char_length("word") >= LONG)
    seen = placed.drop("home").unionByName(_across(placed, long_words)).unionByName(long_words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")))
    top = F.min(F.when(F.col("best").isNotNull(), F.struct(F.bitwise_not("best_n").alias("down"), F.col("best").alias("word"))))
    out = seen.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), top.alias("top"))
    done = materialise(out.select("word", "n", "n_near", F.col("top.word").alias("best"), F.bitwise_not("top.down").alias("best_n")), "near_words")
    discard(vocab, placed)
    return done


def group_variants(vocab: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with the near word that it is a variant of, and where those lead.

    form is the near word of largest n (equal counts: the smallest), if it occurs at least `times` as often, else
    null; root follows forms to the last. n grows by `times` with each step, so chains are short: their
    length is bounded by the largest n, and pointers jump twice as far in each round.
    """
    near = near_words(vocab)
    is_form = F.col("best_n") >= times * F.col("n")
    near = near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    jumps = materialise(near.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    largest = near.agg(F.max("n")).first()[0] or 1
    reach = 1
    while times**reach <= largest:
        step = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = materialise(jumps.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "forms")
        discard(jumps)
        jumps, reach = longer, 2 * reach
    return near.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(read_table(spark, sf_dir, "documents")))


SQL = f"""
with recursive {CRC_TABLE_SQL}, runs as (
  select doc_id, translate(w, '{UPPER}', '{LOWER}') as w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')) as w from documents) group by 1, 2
), hashed as (
  select w, n, case when length(w) >= 6 then {crc32_sql("coalesce(doc_id::varchar, '') || ':' || w")} end as h from runs, crc
), words as (
  select case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, sum(n)::bigint as n
  from hashed group by 1 having length(word) >= 6 and sum(n) >= 5
), places as (
  select word, n, unnest(range(length(word))) as i from words
), cuts as (
  select word, n, i, left(word, i) || substr(word, i + 2) as k from places
), near as (
  select a.word, b.word as other, b.n from cuts a join cuts b using (i, k) where a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on a.k = b.word
  union select b.word, a.word, a.n from cuts a join words b on a.k = b.word
), best as (
  select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by word
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 5 * w.n then b.other end as form, case when b.other_n >= 5 * w.n then b.other_n end as form_n
  from words w left join best b using (word)
), walk as (
  select word, word as at, form as next from forms
  union all select w.word, w.next, f.form from walk w join forms f on f.word = w.next
)
select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n from forms f join walk w on w.word = f.word and w.next is null
"""
