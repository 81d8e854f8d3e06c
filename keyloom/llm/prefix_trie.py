"""Conversation prefix trie by prefix doubling, without walking a trie.

Each turn is a pair of digests. Blocks of 2^k turns at multiples of 2^k get dense names: two neighbours of
half the length are joined, and the pair of their names is named. A prefix of d turns is then the list of
the names of its blocks, one for each bit of d, and rows with equal depth and list are one node.

Naming never groups equal rows in one task. Rows are dealt by ranges of (key, conversation) and each range is
numbered in one pass; a row a range then tells how many names went before, and whether a range goes on
with the last key of the one before. So a first turn that a third of all conversations share only makes a few
ranges equal, and the first row of a key is its smallest conversation, which names the node: a node is
(smallest member, depth). Sums over subtrees go along conversations: a node's weight lies on the path of its
smallest member, is summed from the end of that path, and the members of a node add up.

Long conversations are cut into spans of SPAN turns wherever a window needs order, so that no window
holds more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import CRC_TABLE_SQL, crc32_sql, discard, materialise, read_table

#: Turns that one window holds.
SPAN = 4096
#: Rows of a range that is numbered in one pass, about.
RANGE_ROWS = 1 << 18
#: Ids of one piece of a list that is digested: those that agree beyond their last 16 bits.
PIECE_BITS = 16


def _ranges(rows: int, spark) -> int:
    return max(1, math.ceil(rows / RANGE_ROWS), min(math.ceil(rows / 8192), spark.sparkContext.defaultParallelism))


def _runs(batches):
    """Number the runs of equal `key` within a range, and say which conversation began each."""
    last, run, head = None, -1, None
    for b in batches:
        if not b.num_rows:
            continue
        keys, conv = b.column("key"), b.column("conv").to_numpy()
        coded = keys.dictionary_encode().indices.to_numpy()
        new = np.empty(b.num_rows, dtype=bool)
        new[1:] = coded[1:] != coded[:-1]
        new[0] = keys[0].as_py() != last
        runs = run + np.cumsum(new)
        heads = np.concatenate([[head if head is not None else 0], conv[new]])[np.cumsum(new)]
        last, run, head = keys[-1].as_py(), int(runs[-1]), int(heads[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.int64()), pa.array(heads, pa.int64())], [*b.schema.names, "run", "head"])


def _named(df: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """df (key binary, conv, ...) with `name`, dense over all keys from 0, and `head`, the key's smallest conv.

    The second table is what the first reads; the caller discards it.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(_ranges(rows, spark), "key", "conv").sortWithinPartitions("key", "conv")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = materialise(dealt.mapInArrow(_runs, f"{schema}, run long, head long").withColumn("part", F.spark_partition_id()), "named")
    ends = placed.groupBy("part").agg(F.max("run").alias("last"), F.min_by("key", "run").alias("low"), F.max_by("key", "run").alias("high"), F.max_by("head", "run").alias("head"))
    offsets, names, high, head = [], 0, None, None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # a row a range
        goes_on = high is not None and r["low"] == high
        offsets.append((r["part"], names - goes_on, head if goes_on else None))
        names += r["last"] + 1 - goes_on
        head = head if goes_on and r["last"] == 0 else r["head"]
        high = r["high"]
    shifts = spark.createDataFrame(offsets, "part int, _shift long, _head long")
    first = F.when(F.col("run") == 0, F.coalesce("_head", "head")).otherwise(F.col("head"))
    out = placed.join(F.broadcast(shifts), "part").withColumns({"name": F.col("run") + F.col("_shift"), "head": first})
    return out.drop("key", "part", "run", "_shift", "_head"), placed


def _position(batches):
    """Number the rows of each conversation within a range."""
    last, at = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column("conv").to_numpy()
        edges = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), b.num_rows]
        pos = np.empty(b.num_rows, dtype=np.int64)
        for lo, hi in zip(edges, edges[1:]):
            at = at if conv[lo] == last else 0
            pos[lo:hi] = np.arange(at, at + hi - lo)
            last, at = conv[lo], at + hi - lo
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], [*b.schema.names, "at"])


def _digest(role: Column, text: Column) -> Column:
    md5 = lambda c: F.md5(c.cast("binary"))
    return F.unhex(F.concat(md5(role), md5(text)))


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """conv, pos (from 0), key, chars of every turn, in order of turn; and the tables it reads."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    base = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), _digest(role, text).alias("key"), F.char_length(text).cast("long").alias("chars"))
    base = materialise(base, "turns")
    spark, rows = turns.sparkSession, base.count()
    order = ("conv", F.asc_nulls_first("turn"), "key")
    dealt = base.repartitionByRange(_ranges(rows, spark), *order).sortWithinPartitions(*order).select("conv", "key", "chars")
    placed = materialise(dealt.mapInArrow(_position, "conv long, key binary, chars long, at long").withColumn("part", F.spark_partition_id()), "ordered")
    discard(base)
    # Only a conversation that began in an earlier range is shifted: at most one a range, or the one in all of it.
    pieces = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = pieces.withColumn("_before", before).where("_before > 0").select("conv", "part", "_before")
    out = placed.join(F.broadcast(shifts), ["conv", "part"], "left")
    return out.select("conv", (F.col("at") + F.coalesce("_before", F.lit(0))).alias("pos"), "key", "chars"), [placed]


def share_heads(ordered: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuild conversations, so that those of a group share beginnings: (turns, conversations).

    Conversation c takes the first h turns of c - c % group (all if it has fewer, none if it isn't there) and
    goes on with its own turns after its first h; h is the unsigned crc32 of c's decimal digits, modulo most.
    """
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % group
    sizes = ordered.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"h": head, "base": base})
    bases = sizes.select(F.col("conv").alias("base"), F.col("own").alias("_size"))
    sizes = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("_size", F.lit(0))))
    convs = sizes.select("conv", "base", "h", "own", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))
    heads = ordered.where((F.col("pos") < most - 1) & (F.col("conv") == base)).select(F.col("conv").alias("base"), "pos", "key", "chars")
    begun = convs.join(heads, "base").where("pos < h").select("conv", "pos", "key", "chars", "length")
    spans = convs.where("own > h").select("conv", "taken", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("own") - 1) / SPAN))).alias("span"))
    own = ordered.where(F.col("pos") >= head).withColumn("span", F.floor(F.col("pos") / SPAN)).join(spans, ["conv", "span"])
    own = own.select("conv", (F.col("pos") - head + F.col("taken")).alias("pos"), "key", "chars", "length")
    return begun.unionByName(own), convs.select("conv", "length")


def _pack(*names: str) -> Column:
    """Names as fixed-width hex digits."""
    return F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names])


def _prefixes(turns: DataFrame, longest: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """conv, depth, chars (of the last text), length, key: one row for each prefix of one turn or more."""
    tables, parts, level = [], [turns.select("conv", (F.col("pos") + 1).alias("depth"), "chars", "length", F.lit(None).cast("struct<up: int, name: string>").alias("piece"))], 0
    blocks = turns.select("key", "conv", F.col("pos").alias("j"), "length")
    while True:
        named, table = _named(blocks, max(1, rows >> level))
        tables.append(table)
        size = 1 << level
        first = (F.col("j") + 1) * size
        reach = F.explode(F.sequence(first, F.least(first + (size - 1), F.col("length"))))
        piece = F.struct(F.lit(-level).alias("up"), F.lpad(F.hex("name"), 16, "0").alias("name"))
        parts.append(named.where("j % 2 = 0").select("conv", reach.alias("depth"), F.lit(None).cast("long").alias("chars"), "length", piece.alias("piece")))
        level += 1
        if 1 << level > longest:
            break
        pair = named.where(F.col("j") % 2 == 0).select("conv", F.floor(F.col("j") / 2).alias("j"), "length", F.col("name").alias("left"))
        other = named.where(F.col("j") % 2 == 1).select("conv", F.floor(F.col("j") / 2).alias("j"), F.col("name").alias("right"))
        blocks = pair.join(other, ["conv", "j"]).select(F.unhex(_pack("left", "right")).alias("key"), "conv", "j", "length")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.groupBy("conv", "depth").agg(F.max("chars").alias("chars"), F.max("length").alias("length"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = F.concat(F.lpad(F.hex("depth"), 16, "0"), F.array_join(F.col("pieces.name"), ""))
    return out.select(F.unhex(whole).alias("key"), "conv", "depth", "chars", "length"), tables


def _along(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each member row with its parent's head and, from its own depth to its end, the sums of what its nodes weigh."""
    span = F.floor(F.col("depth") / SPAN)
    rows = members.join(nodes.select(F.col("head").alias("conv"), "depth", "weight", "leaf"), ["conv", "depth"], "left")
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0)), "span": span})
    totals = rows.groupBy("conv", "span").agg(F.sum("weight").alias("w"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("conv").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "span", F.coalesce(F.sum("w").over(later), F.lit(0)).alias("w"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"))
    # The last row of a span is seen by the next one, for its parent.
    ghosts = rows.where((F.col("depth") + 1) % SPAN == 0).select("conv", (F.col("span") + 1).alias("span"), "depth", "head", F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("ghost"))
    both = rows.select("conv", "span", "depth", "head", F.col("weight").cast("long").alias("weight"), F.col("leaf").cast("long").alias("leaf"), F.lit(False).alias("ghost")).unionByName(ghosts)
    here = Window.partitionBy("conv", "span").orderBy("depth")
    rest = Window.partitionBy("conv", "span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({"parent": F.lag("head").over(here), "below": F.sum("weight").over(rest), "leaves": F.sum("leaf").over(rest)}).where("not ghost")
    return out.join(totals, ["conv", "span"]).select("conv", "depth", "head", "parent", (F.col("below") + F.col("w")).alias("below"), (F.col("leaves") + F.col("l")).alias("leaves"))


def _hash_pieces(batches):
    """Stream the pieces of each node through SHA-256; only the running digest is held."""
    node, digest, rows = None, None, []
    done = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["head", "depth", "ends_sha256"])
    for b in batches:
        for head, depth, ids in zip(b.column("head").to_pylist(), b.column("depth").to_pylist(), b.column("ids")):
            if (head, depth) != node:
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                    if len(rows) == 4096:
                        yield done()
                        rows = []
                node, digest = (head, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
    if node is not None:
        rows.append((*node, digest.hexdigest()))
        yield done()


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, pos (0 to length - 1, without gaps), key (a digest of role and text), chars, length (the conversation's).
    convs: conv, length, each conversation once, those without turns included. The root has depth 0 and all
    conversations. An empty table of conversations has no node.
    """
    empty_sha = hashlib.sha256(b"").hexdigest()
    turns = materialise(turns, "rebuilt")
    size = turns.agg(F.count("*").alias("n"), F.max("length").alias("longest")).first()
    roots = convs.crossJoin(F.broadcast(convs.agg(F.min("conv").alias("head")))).select("conv", F.lit(0).cast("long").alias("depth"), "head", F.lit(0).cast("long").alias("chars"), "length")
    tables = [turns]
    if size["n"]:
        prefixes, blocks = _prefixes(turns, size["longest"], size["n"])
        prefixes = materialise(prefixes, "prefixes")
        discard(*blocks)
        named, table = _named(prefixes, size["n"])
        tables += [prefixes, table]
        members = named.select("conv", "depth", "head", "chars", "length").unionByName(roots)
    else:
        members = roots
    nodes = members.groupBy("head", "depth").agg(F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("length").alias("longest"))
    nodes = nodes.select("head", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"), F.when(F.col("longest") == F.col("depth"), F.lit(1)).otherwise(F.lit(0)).alias("leaf"))
    nodes = materialise(nodes, "nodes")
    along = materialise(_along(members, nodes), "along")
    none = F.lit(0).cast("long")
    sums = along.select("head", "depth", "below", "leaves", none.alias("child"), F.when(F.col("conv") == F.col("head"), F.col("parent")).alias("parent"))
    kids = along.where("conv = head and depth > 0").select(F.col("parent").alias("head"), (F.col("depth") - 1).alias("depth"), none.alias("below"), none.alias("leaves"), F.lit(1).cast("long").alias("child"), F.lit(None).cast("long").alias("parent"))
    sums = sums.unionByName(kids).groupBy("head", "depth").agg(F.sum("below").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("child").alias("n_children"), F.max("parent").alias("parent_conv_id"))
    ends = members.where("depth = length").groupBy("head", "depth", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    ends = ends.select("head", "depth", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition("head", "depth").sortWithinPartitions("head", "depth", "piece").mapInArrow(_hash_pieces, "head long, depth long, ends_sha256 string")
    out = nodes.join(sums, ["head", "depth"]).join(ends, ["head", "depth"], "left")
    done = materialise(
        out.select(F.col("head").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty_sha)).alias("ends_sha256")), "trie"
    )
    discard(*tables, nodes, along)
    return done


def shared_prefixes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes (prefix_nodes) of the conversations rebuilt by share_heads.

    Turns go in order of turn_col, null first; ties by the MD5 of the role, then by that of the text, and repeated rows
    are turns of their own. Null roles and texts are empty. Rows with a null conversation take no part.
    Turns are equal if the MD5 digests of role and of text are. Other columns are ignored. An empty table
    gives an empty table.
    """
    ordered, read = _ordered(conversations, conv_col, turn_col, role_col, text_col)
    turns, convs = share_heads(ordered)
    convs = materialise(convs, "conversations")
    out = prefix_nodes(turns, convs)
    discard(convs, *read)
    return out


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return shared_prefixes(read_table(spark, sf_dir, "conversations"))


SQL = f"""
with {CRC_TABLE_SQL}, t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(role, '')), md5(coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null
), convs as (
  select c, n, c - c % 100 as b, {crc32_sql("c::varchar")} % 6 as h from (select c, count(*) as n from t group by c), crc
), sized as (
  select v.*, least(v.h, coalesce(w.n, 0)) as taken from convs v left join convs w on w.c = v.b
), r as (
  select v.c, t.pos, t.role, t.text from sized v join t on t.c = v.b and t.pos < v.h
  union all select v.c, t.pos - v.h + v.taken, t.role, t.text from sized v join t on t.c = v.c and t.pos >= v.h
), p as (
  select c, pos + 1 as d, string_agg(md5(role) || md5(text), '') over (partition by c order by pos) as k, length(text) as chars from r
  union all select c, 0, '', 0 from sized
), ends as (
  select c, max(d) as last from p group by c
), nodes as (
  select d, k, min(c) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where last = d), '')) as ends_sha256
  from p join ends using (c) group by d, k
), kids as (
  select left(k, 64 * (d - 1)) as k, count(*) as n from nodes where d > 0 group by 1
), up as (
  select left(u.k, 64 * i) as k, sum((u.n_convs - 1) * u.chars) as saved, count(*) filter (where kids.n is null) as leaves
  from (select *, unnest(range(d + 1)) as i from nodes) u left join kids using (k) group by 1
)
select v.conv_id, v.d as depth, w.conv_id as parent_conv_id, v.n_convs, coalesce(kids.n, 0) as n_children,
  up.leaves as n_leaves, up.saved::bigint as saved_tokens, v.ends_sha256
from nodes v left join nodes w on v.d > 0 and w.d = v.d - 1 and w.k = left(v.k, 64 * (v.d - 1)) left join kids on kids.k = v.k join up on up.k = v.k
"""
