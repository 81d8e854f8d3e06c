"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, each a 64-bit hash; hashes order the shingles. Two
sets whose Jaccard index reaches t share at least `l` of the first `n - ceil(t n) + l` shingles of each,
for any l: a longer prefix must match more often. Each document chooses its l by the estimated cost of
the candidates it gets, from the number of documents that hold each prefix shingle:

* shingles that more than `most` documents hold in their prefix aren't worth looking up. If l is larger
  than the number of such shingles in the prefix, any partner also shares a rarer one, so the document
  is only indexed under those;
* beyond that, l is what makes postings read plus candidates expected (postings over l) cheapest;
* documents of which nearly all shingles are frequent (a large group of near copies) find no such l.
  They ask for as many matches f as they may, and are indexed in lists of their own under all shingles of
  that prefix but the f - 1 most widely held: any partner shares f of them, and the rarest shared one is
  left to both. Passages that many documents share are what is left out. Others come into these lists
  with all shingles of their longest prefix.

Only shingles that two documents share are indexed, and lists that hold the same documents count once.
Within a list, sizes, l common prefix shingles and a bound on the overlap from parity bitmaps (each
differing shingle flips one bit) leave few pairs. Prefix shingles are compared by 16 bits each, with
repeats, which can only make more of them common. Only links are wanted up to connectivity: a list
proposes a spanning forest of its pairs, which are verified on whole sets. Where a proposed pair fails,
the list proposes again around it, and in the last round every pair that still joins two components.
So each pair that reaches t is verified or lies in one component; no group is expanded into all pairs.

Lists of those frequent documents are worked on block by block first. Documents of two blocks are compared
only under shingles whose documents lie in two components by then, and as few as possible go to other
blocks: a group of near copies, however large, is dealt out once.

Exact copies (equal sets, by a 128-bit digest) are represented by their smallest id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import discard, materialise, read_table

#: Documents from which a prefix shingle counts as frequent, and documents of a block of its list.
HOT, BLOCK = 64, 2048
#: Bits of a parity bitmap, and bytes of text that are hashed together.
BITS, BATCH = 512, 1 << 19
#: Cost of verifying a candidate in postings read.
VERIFY = 8.0
#: Slots of the bitmap of ids whose texts are read again (a power of 2; an eighth of it in bytes is broadcast).
MARKS = 1 << 24
#: Parts into which rows of one frequent shingle are dealt for a join with what is known of the shingle.
SALTS = 16
#: Bytes of texts, postings or whole sets that a worker gets at a time; it and its executor hold a few of these.
BATCH_BYTES = 1 << 22

_U = np.uint64
_P, _A = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct shingle hashes of texts: A-Z lower-cased, words parted by \\x20 and \\x09-\\x0D."""

    def __init__(self, k: int):
        self.k = k
        self.inverse = _U(pow(int(_P), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * BATCH)
            for name, base in (("powers", _P), ("inverses", self.inverse)):
                x = np.full(n, base, dtype=_U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        out, group, size = [], [], 0
        for t in texts:
            group.append((t or "").encode())
            size += len(group[-1])
            if size > BATCH:
                out += self._sets(group)
                group, size = [], 0
        return out + self._sets(group)

    def _sets(self, group: list[bytes]) -> list[np.ndarray]:
        if not group:
            return []
        b = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
        self._grow(len(b) + 1)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        low = b + ((b >= 65) & (b <= 90)) * np.uint8(32)
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum((low.astype(_U) + _U(1)) * self.powers[: len(b)], dtype=_U)])
        word = _mix((total[ends] - total[starts]) * self.inverses[starts] + (ends - starts).astype(_U) * _A)
        bounds = np.cumsum([len(x) + 1 for x in group])
        at = np.concatenate([[0], np.searchsorted(starts, bounds)])
        k, n = self.k, len(word)
        whole = np.zeros(max(0, n - k + 1), dtype=_U)
        for i in range(k):
            whole = whole * _A + word[i : i + len(whole)]
        whole = _mix(whole)
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo >= k:
                out.append(np.unique(whole[lo : hi - k + 1]))
            elif hi > lo:
                x = np.full(1, hi - lo, dtype=_U)
                for w in word[lo:hi]:
                    x = _mix(x * _P + w)
                out.append(x)
            else:
                out.append(np.zeros(0, dtype=_U))
        return out


def least_overlap(n, num: int, den: int):
    """Shingles that a set of n shares with any partner at least."""
    return -(-num * n // den)


def base_prefix(n: int, num: int, den: int) -> int:
    return n - least_overlap(n, num, den) + 1


def most_matches(n: int, num: int, den: int) -> int:
    """Matches that a document of n shingles may ask for at most."""
    return max(1, min(4 + n // 20, least_overlap(n, num, den)))


def bitmap(shingles: np.ndarray) -> bytes:
    odd = np.bincount((shingles & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def choose(pos: np.ndarray, df: np.ndarray, n: int, num: int, den: int, most: int = HOT) -> tuple[int, bool]:
    """Matches a document asks for, and whether it has to be indexed under frequent shingles.

    pos, df: places in the prefix order, ascending, of the shingles that others hold too, and by how many documents.
    """
    matches = np.arange(1, most_matches(n, num, den) + 1)
    inside = np.searchsorted(pos, base_prefix(n, num, den) + matches - 1)
    hot = np.concatenate([[0], np.cumsum(df > most)])[inside]
    postings = np.concatenate([[0], np.cumsum(np.where(df > most, 0, df - 1))])[inside]
    ok = matches > hot
    if not ok.any():
        return int(matches[-1]), True
    cost = np.where(ok, postings + VERIFY * postings / np.maximum(1, matches - hot), np.inf)
    return int(matches[np.argmin(cost)]), False


def _sketch(k: int, num: int, den: int):
    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                cut = b.slice(i, 1000)
                rows = []
                for s in shingler.sets(cut.column(1).to_pylist()):
                    n = len(s)
                    sig = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    length = min(n, base_prefix(n, num, den) + most_matches(n, num, den) - 1) if n else 0
                    rows.append((int(sig[0]), int(sig[1]), n, s[:length].view(np.int64), bitmap(s)))
                cols = list(zip(*rows))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in cols[3]])]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[3]), pa.int64()))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), prefix, pa.array(cols[4], pa.binary())], ["id", "s1", "s2", "n", "prefix", "bits"])

    return run


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), pa.int64()))


def _decide(num: int, den: int, most: int):
    def run(batches):
        for b in batches:
            out = []
            flat = [np.asarray(b.column(i).flatten(), dtype=np.int64) for i in (2, 3, 4)]
            ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(b.column(2)), dtype=np.int64))]).tolist()
            for node, n, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:]):
                pos, df, token = (x[lo:hi] for x in flat)
                order = np.argsort(pos)
                pos, df, token = pos[order], df[order], token[order]
                matches, frequent = choose(pos, df, n, num, den, most)
                end = int(np.searchsorted(pos, base_prefix(n, num, den) + matches - 1))
                if end:
                    fewest = most_matches(least_overlap(n, num, den), num, den)  # that any partner shares of the longest prefix
                    often = token[np.lexsort((token, df))][: max(1, len(token) - fewest + 1)] if frequent else token
                    rare = token[:0] if frequent else token[:end][df[:end] <= most]
                    out.append((node, n, matches, frequent, rare, often, np.sort(token[:end].astype(np.uint16)).tobytes()))
            if out:
                node, n, matches, frequent, rare, often, tokens = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(matches, pa.int32()), pa.array(frequent), _lists(rare), _lists(often), pa.array(tokens, pa.binary())], ["node", "n", "matches", "frequent", "rare", "often", "tokens"])

    return run


def _pairs_of(rows: list[dict], num: int, den: int, whole: bool):
    """Pairs of one list that may reach the threshold: a spanning forest over what is linked already, or with whole all that join two components.

    Row by row, all columns at once: of each other component that a row may be linked with, the nearest
    document by bitmap is proposed, and the two count as one from then on.
    """
    g = len(rows)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    node = np.array([r["node"] for r in rows], dtype=np.int64)
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), dtype=np.uint64).reshape(g, -1)
    side, frequent = np.array([r["side"] for r in rows]), np.array([r["frequent"] for r in rows])
    label = np.unique(np.array([r["comp"] for r in rows], dtype=np.int64), return_inverse=True)[1]
    left, need, hot_list, across = label.max() + 1, [r["matches"] for r in rows], rows[0]["hot_list"], rows[0]["across"]
    tokens: list = [None] * g

    def match(i: int, j: int) -> bool:
        for x in (i, j):
            if tokens[x] is None:
                t = np.frombuffer(rows[x]["tokens"], dtype=np.uint16).astype(np.int64)
                tokens[x] = (t << 16) + np.arange(len(t)) - np.searchsorted(t, t)
        return len(np.intersect1d(tokens[i], tokens[j], assume_unique=True)) >= min(need[i], need[j], len(tokens[i]), len(tokens[j]))

    for i in range(g - 1):
        if left == 1:
            return
        m = n[i + 1 :]
        ok = (num * np.maximum(n[i], m) <= den * np.minimum(n[i], m)) & (label[i + 1 :] != label[i])
        if hot_list:
            ok &= frequent[i] | frequent[i + 1 :]
        if across:
            ok &= side[i + 1 :] != side[i]
        at = np.flatnonzero(ok) + i + 1
        if not len(at):
            continue
        far = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = far <= n[i] + n[at] - 2 * (-(-num * (n[i] + n[at]) // (den + num)))
        if rows[i]["failed"]:
            near &= ~np.isin(node[at], np.array(rows[i]["failed"], dtype=np.int64))
        at = at[near][np.argsort(far[near], kind="stable")]
        if whole:
            hits = [j for j in at.tolist() if match(i, j)]
        else:
            hits, labels = [], label[at]
            for u in np.unique(labels).tolist():
                j = next((j for j in at[labels == u].tolist() if match(i, j)), None)
                if j is not None:
                    hits.append(j)
                    label[label == u] = label[i]
                    left -= 1
        for j in hits:
            yield rows[i]["bucket"], min(rows[i]["node"], rows[j]["node"]), max(rows[i]["node"], rows[j]["node"])


def _propose(num: int, den: int, whole: bool):
    def run(batches):
        rows, out = [], []

        def emit():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "a", "b"])

        for b in batches:
            for r in b.to_pylist():
                if rows and rows[0]["bucket"] != r["bucket"]:
                    out.extend(_pairs_of(rows, num, den, whole))
                    rows = []
                    if len(out) > 10_000:
                        yield emit()
                rows.append(r)
        if rows:
            out.extend(_pairs_of(rows, num, den, whole))
        if out:
            yield emit()

    return run


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(ids.view(_U)) & _U(bits - 1)).astype(np.int64)


def _marks(batches):
    """Words of a bitmap of all slots, in which those of the ids of a task are set."""
    for b in batches:
        slots = np.unique(_slot(np.asarray(b.column(0)), MARKS))
        words, start = np.unique(slots >> 6, return_index=True)
        if len(words):
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bitwise_or.reduceat(_U(1) << (slots & 63).astype(_U), start).view(np.int64))], ["word", "bits"])


def _bitmap_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of MARKS slots with those of ids set; it is that large at most, however many ids there are."""
    found = ids.mapInArrow(_marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, dtype=_U)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(_U)
    return out


def _sets(k: int, marked):
    """Whole sets of the rows whose id's slot is set; that passes some others too."""

    def run(batches):
        shingler, marks = Shingler(k), marked.value
        for b in batches:
            slot = _slot(np.asarray(b.column(0)), MARKS)
            asked = b.filter(pa.array((marks[slot >> 6] >> (slot & 63).astype(_U)) & _U(1) == 1))
            for i in range(0, asked.num_rows, 500):
                cut = asked.slice(i, 500)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([s.tobytes() for s in shingler.sets(cut.column(1).to_pylist())], pa.binary())], ["node", "s"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                s, t = (np.frombuffer(v.as_buffer(), dtype=_U) for v in (x, y))
                inter = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(den * inter >= num * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _written(df: DataFrame, label: str) -> DataFrame:
    return materialise(df, label, BATCH_BYTES)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A written table (u, v): for each node of an edge but the smallest of its component, that smallest one.

    By alternating star steps: each moves every edge to the smallest neighbour and is an aggregation and a
    join, in which a node with very many edges is pre-aggregated or split; each step is written down.
    """
    cur, last = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"), None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        done, cur = cur, _written(small, "stars")
        discard(done)
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            return cur
        last = state


def _labelled(df: DataFrame, stars: DataFrame | None) -> DataFrame:
    """df with comp, the component of its column node as far as links are known."""
    if stars is None:
        return df.withColumn("comp", F.col("node"))
    return df.join(stars.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, most: int = HOT, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row with a non-null id.

    Rows are linked if den * |A & B| >= num * |A | B| for their sets of k-word shingles; component_id is the
    smallest id reachable by links. Shingles that more than `most` documents hold in their prefixes count as
    frequent, and lists of frequent ones are dealt in blocks of `block` documents; neither changes a result. Fewer than k words are one shingle; null texts and texts without words
    have none and are linked with nothing. Rows that repeat an id are reduced to one: the row with the
    largest set. Other columns are ignored. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    sk = _written(base.mapInArrow(_sketch(k, num, den), "id long, s1 long, s2 long, n int, prefix array<long>, bits binary"), "sketches")
    if sk.groupBy("id").count().where("count > 1").limit(1).count():
        once = _written(sk.groupBy("id").agg(F.max_by(F.struct("s1", "s2", "n", "prefix", "bits"), F.struct("n", "s1", "s2")).alias("r")).select("id", "r.*"), "sketches")
        discard(sk)
        sk = once
    # Copies of one text, which may be a third of all rows, meet their representative in SALTS tasks.
    copies = sk.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("node"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sk.select("id", "s1", "s2", "n", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    classes = _written(salted.join(copies, ["s1", "s2", "n", "salt"], "left").select("id", "n", F.coalesce("node", "id").alias("node")), "classes")
    copied = classes.where("id <> node").select("id")
    nodes = sk.where("n > 0").select("id", "n", "prefix").join(copied, "id", "left_anti")
    postings = nodes.select(F.col("id").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    # Counting n, not rows, asks for the same columns of nodes as the join does, so that their shuffle is used twice.
    held = postings.groupBy("token").agg(F.count("n").alias("df")).where("df > 1")
    grouped = postings.join(held, "token").groupBy("node", "n").agg(F.collect_list(F.struct("pos", "df", "token")).alias("shared"))
    chosen = grouped.select("node", "n", "shared.pos", "shared.df", "shared.token").mapInArrow(_decide(num, den, most), "node long, n int, matches int, frequent boolean, rare array<long>, often array<long>, tokens binary")
    chosen = _written(chosen, "prefixes")

    stars = _linked(sk, chosen, base, k, num, den, block)
    discard(sk, chosen)
    out = _labelled(classes, stars).withColumnRenamed("comp", "component_id")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _by_token(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the facts of their token, the rows of one token dealt to SALTS tasks."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"]).drop("salt")


def _linked(sk: DataFrame, chosen: DataFrame, base: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame | None:
    """Components (u, v) of all verified links; None if there are none."""
    # In order of size, documents without a neighbour of compatible size have no partner in a list.
    lists = chosen.select(F.struct("n", "node").alias("x"), F.explode("rare").alias("token")).groupBy("token").agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    fits = lambda a, b: F.coalesce(den * a["n"] >= num * b["n"], F.lit(False))  # noqa: E731  a is the smaller one
    paired = F.filter("xs", lambda x, i: fits(F.get("xs", i - 1), x) | fits(x, F.get("xs", i + 1)))
    lists = lists.select("token", F.transform(paired, lambda x: x["node"]).alias("nodes")).where(F.size("nodes") > 1)
    rare = lists.groupBy("nodes").agg(F.min("token").alias("bucket")).select("bucket", F.lit(0).alias("side"), F.lit(False).alias("across"), F.lit(False).alias("hot_list"), F.explode("nodes").alias("node"))

    # Only partners of frequent documents count here; others of another size can't be.
    # A band is a hair wider than the ratio of sizes that can link, so such sizes lie in one band or two next to each other.
    band = F.floor(F.log("n") / (math.log(den / num) + 1e-9)).cast("long")
    held = chosen.select("node", "frequent", band.alias("band"), F.explode("often").alias("token"))
    bands = held.where("frequent").groupBy("token").agg(F.collect_set("band").alias("bands"))
    near = F.arrays_overlap("bands", F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    often = _written(_by_token(held, bands).where(F.col("frequent") | near).select("node", "frequent", "token"), "often")
    sizes = often.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    dealt = _written(_by_token(often, sizes).withColumn("part", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "blocks")
    discard(often)
    bucket = lambda part: F.xxhash64(F.lit(1), "token", part).alias("bucket")
    row = lambda df, part, side, across: df.select(bucket(part), F.lit(side).alias("side"), F.lit(across).alias("across"), F.lit(True).alias("hot_list"), "node")

    facts = chosen.select("node", "n", "matches", "frequent", "tokens").join(sk.select(F.col("id").alias("node"), "bits"), "node")
    members = _written(rare.unionByName(row(dealt, "part", 0, False)), "lists")
    stars, failed = _rounds(members, facts, base, None, None, k, num, den)
    discard(members)

    # What is left: pairs in two blocks and two components, one of them frequent. Of each such pair one goes to
    # the other's block: the frequent ones outside the largest component, and against the rest of that component
    # either its frequent ones or the others outside, whichever are fewer.
    many = _labelled(dealt.where("blocks > 1"), stars)
    counted = many.groupBy("token", "comp").agg(F.count("*").alias("c"), F.count_if("frequent").alias("f"))
    largest = counted.groupBy("token").agg(F.max(F.struct("c", "f", "comp")).alias("most"), F.sum(F.col("c") - F.col("f")).alias("r"), F.count("*").alias("k")).where("k > 1")
    largest = largest.select("token", F.col("most.comp").alias("largest"), (F.col("most.f") <= F.col("r") - F.col("most.c") + F.col("most.f")).alias("inner"))
    several = _written(_by_token(many, largest), "several")
    if not several.isEmpty():
        sent = F.when(F.col("comp") == F.col("largest"), F.col("frequent") & F.col("inner")).otherwise(F.col("frequent") | ~F.col("inner"))
        others = several.where(sent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> part")
        members = _written(row(several, "part", 0, True).unionByName(row(others, "other", 1, True)), "across")
        stars, failed = _rounds(members, facts, base, stars, failed, k, num, den)
        discard(members)
    discard(dealt, several, failed)
    return stars


def _rounds(members: DataFrame, facts: DataFrame, base: DataFrame, stars: DataFrame | None, failed: DataFrame | None, k: int, num: int, den: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Components and pairs known not to link, once no pair in a bucket of members can join two components any more."""
    proposed, again = members, None
    for turn in range(3):
        info = _labelled(facts, stars)
        if failed is not None:
            both_ways = failed.union(failed.select("b", "a"))
            info = info.join(both_ways.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("failed")), "node", "left")
        else:
            info = info.withColumn("failed", F.lit(None).cast("array<long>"))
        rows = proposed.join(info, "node").repartition("bucket").sortWithinPartitions("bucket", "node")
        pairs = _written(rows.mapInArrow(_propose(num, den, turn == 2), "bucket long, a long, b long"), "pairs")
        discard(again)
        whole = pairs.select("a", "b").distinct()
        # Whole sets only of what is proposed, from the texts, which don't move.
        marked = base.sparkSession.sparkContext.broadcast(_bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        sets = _written(base.mapInArrow(_sets(k, marked), "node long, s binary").groupBy("node").agg(F.max_by("s", F.octet_length("s")).alias("s")), "sets")
        both = whole.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        checked = _written(both.mapInArrow(_verify(num, den), "a long, b long, ok boolean"), "checked")
        discard(sets)
        good, bad = checked.where("ok").select("a", "b"), checked.where("not ok").select("a", "b")
        if not good.isEmpty():
            before = stars
            stars = components(good if stars is None else good.unionAll(stars.select(F.col("u").alias("a"), F.col("v").alias("b"))))
            discard(before)
        if more := not bad.isEmpty():
            before, failed = failed, _written(bad if failed is None else failed.unionAll(bad), "failed")
            discard(before)
            if turn < 2:
                again = _written(pairs.join(bad, ["a", "b"]).select("bucket").distinct(), "again")
                proposed = members.join(again, "bucket")
        discard(pairs, checked)
        if not more:
            break
    return stars, failed


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)


SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, case when len(w) >= 3 then array_to_string(w[i:i+2], ' ') else array_to_string(w, ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
f as (select g, count(*) as df from s group by g having count(*) > 1),
c as (
  select a.doc_id as x, b.doc_id as y, count(*) as inter from s a join f using (g) join s b using (g) where a.doc_id < b.doc_id group by all
), l as (
  select x, y from c join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * inter >= 90 * (nx.n + ny.n - inter)
), e as (select x, y from l union all select y, x from l),
r as (select doc_id as a, doc_id as b from n union select r.a, e.y from r join e on e.x = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id
from d left join n using (doc_id) left join (select a as doc_id, min(b) as component_id from r group by a) m using (doc_id)
"""
