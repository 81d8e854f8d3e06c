"""Line deduplication: explode lines, hash their keys, count documents for each hash, drop, reassemble.

The eligible lines of each document are exploded with their position; a line's key is hashed to 128
bits. Pairs of hash and document are made distinct, dealt by both, and then counted by hash (combined
before that shuffle, so a line that a third of all documents hold costs one row a task), which also
finds the largest id. The lines of hashes over the threshold are joined back, those of one hash in
several tasks by a salt, become a sorted list of positions for each document, and the text is put
together from the slices between those positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower, pinned, strip_spaces

#: Tasks to which the lines of one hash are dealt when they meet its count.
SALTS = 8


def line_key(line: Column) -> Column:
    return ascii_lower(strip_spaces(line))


def _hashed(df: DataFrame) -> DataFrame:
    key = F.col("_k")
    return df.withColumns({"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(7919), key)}).drop("_k")


def _eligible(text: Column, min_chars: int) -> Column:
    keys = F.transform(F.split(text, "\n", -1), line_key)
    return F.filter(keys, lambda k: F.char_length(k) >= min_chars)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents with repeated lines cut from text_col; adds n_lines and n_dropped, replacing columns of that name.

    A line goes if its key (white space stripped at both ends, A-Z lower-cased) has min_chars code
    points or more and min_docs documents or more hold it, except in the document with the largest id.
    Rows that repeat an id are one document in that count; each is cut for itself. Null text counts as one
    empty line and comes back as "". A row with a null id keeps all its lines and counts as no document.
    Other columns pass through. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped").withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    once = base.select("_id", F.explode(F.array_distinct(_eligible(F.col("_text"), min_chars))).alias("_k"))
    common = _hashed(once).groupBy("_h1", "_h2").agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_keep")).where(F.col("_n") >= min_docs).select("_h1", "_h2", "_keep")
    placed = base.select("_id", F.xxhash64("_text").alias("_row"), F.posexplode(F.transform(F.split(F.col("_text"), "\n", -1), line_key)).alias("_pos", "_k")).where(F.char_length("_k") >= min_chars)
    common = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = _hashed(placed).withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(common, ["_h1", "_h2", "_salt"]).where(F.col("_id") != F.col("_keep"))
    cuts = hits.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_cut"))
    # The row travels as one struct, so that no name in it clashes with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("_in"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"))
    joined = rows.join(cuts, ["_id", "_row"], "left")
    joined = pinned(joined, _lines=F.split(F.col("_in")[text_col], "\n", -1))
    edges = F.concat(F.array(F.lit(-1)), F.coalesce(F.col("_cut"), F.array().cast("array<int>")), F.array(F.size("_lines")))
    joined = pinned(joined, _at=edges)
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("_at") - 1),
            lambda j: F.slice(F.col("_lines"), F.element_at("_at", j) + 2, F.element_at("_at", j + 1) - F.element_at("_at", j) - 1),
        )
    )
    text = F.when(F.col("_cut").isNull(), F.col("_in")[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("_in")[c].alias(c) for c in docs.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import read_table

    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d,
       lateral (select unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line) u
), common as (
  select k, max(doc_id) as keep from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3
)
select l.doc_id, count(*) as n_lines,
       count(*) filter (where c.k is not null and l.doc_id <> c.keep) as n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where c.k is null or l.doc_id = c.keep), '')) as kept_sha256
from lines l left join common c using (k)
group by l.doc_id
"""
