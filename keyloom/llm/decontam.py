"""Benchmark decontamination: item-sized windows found by shared shingles, exact check, SimHash distance.

DataFrame expressions only. Words are lower-cased and lose punctuation marks; similarity is the weighted
Jaccard index of five-word shingles (a shingle weighs as often as it occurs).

1. Windows. A window can only reach the similarity if it shares at least `t/(1+t)` of its own and the
   item's shingles together, so windows are only taken where a document holds that many. A window has as
   many shingles as the item, or all of a shorter document's. For such a document and item, each shared
   shingle fixes an alignment (position in the document less position in the item). All window starts
   from one alignment to the next, up to one item length apart, are taken; between them the number of
   shared shingles has its maximum. A shorter document is one window.
2. Exact weighted-shingle similarity of window and item decides.
3. Fingerprints of 128 bits, each bit the sign of the sum over the window's words, give the distance that
   is reported for what was found. They don't decide: an edit that leaves a similarity of 0.8 can
   change a tenth of the words, and no radius is sure to hold the bits that this moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialise, pinned, with_window_hashes, words_of

BLOCKS, BLOCK_BITS = 8, 16
#: Benchmarks up to so many words in all are broadcast; larger ones are joined by shuffles.
MAX_BROADCAST_WORDS = 400_000
#: Slots into which documents are hashed; those with a window are broadcast, at most so many numbers.
SLOTS = 1 << 20
MARKS = ".,;:!?\"'()[]{}«»“”„¿¡…"


def normal_words(text: Column) -> Column:
    return words_of(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, ""))


def with_fingerprint(df: DataFrame, words: str, name: str) -> DataFrame:
    """Add the SimHash of a column of words as 8 ints of 16 bits."""
    df = pinned(df, _h=F.array(*[F.transform(words, lambda w, s=seed: F.xxhash64(F.lit(s), w)) for seed in (0, 1)]))
    powers = F.array(*[F.lit(1 << j) for j in range(BLOCK_BITS)])

    def block(k: int) -> Column:
        seed, low = divmod(k * BLOCK_BITS, 64)
        votes = lambda j: F.aggregate(F.get("_h", F.lit(seed)), F.lit(0), lambda a, x: a + 2 * F.getbit(x, j + low).cast("int") - 1)
        return F.aggregate(F.sequence(F.lit(0), F.lit(BLOCK_BITS - 1)), F.lit(0), lambda a, j: a + F.when(votes(j) > 0, F.get(powers, j)).otherwise(0))

    return pinned(df, **{name: F.array(*[block(k) for k in range(BLOCKS)])}).drop("_h")


def _weighted(a: Column, b: Column) -> Column:
    """Weighted Jaccard index of two arrays taken as multisets."""
    common = F.array_intersect(a, b)
    count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    least = F.aggregate(F.transform(common, lambda g: F.least(count(a, g), count(b, g))), F.lit(0), lambda x, y: x + y)
    inter = F.when(plain, F.size(common)).otherwise(least)
    return inter / (F.size(a) + F.size(b) - inter)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, item_col, start_word, similarity, distance): the best window of each document for each item it contains.

    Items with fewer than `shingle` words, or null text, have no shingle and match nothing; so do such
    documents. Ties go to the first window. Rows with equal id and text count once, rows that share an id but not the
    text are searched apart and the best window stays. Null ids are kept as null. Empty tables give
    an empty table. Further columns of either table, whatever their names, are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), normal_words(F.col(item_text_col)).alias("iw")).distinct()
    items = with_window_hashes(pinned(items, len=F.size("iw")).where(F.col("len") >= shingle), "iw", shingle, "ig")
    items = materialise(items, "items")
    small = (items.agg(F.sum("len")).first()[0] or 0) <= MAX_BROADCAST_WORDS
    hint = F.broadcast if small else (lambda df: df)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("row", F.xxhash64("t"))
    # The size is taken before shingles are exploded, so that no row of one carries the words.
    words = pinned(base.select("id", "row", "t"), w=normal_words(F.col("t"))).select("id", "row", F.size("w").alias("size"), "w")
    grams = with_window_hashes(words, "w", shingle, "gs").select("id", "row", "size", F.posexplode("gs").alias("pos", "g"))
    index = items.select("item", "len", F.posexplode("ig").alias("at", "g"))
    total = F.col("len") + F.least("len", "size") - 2 * (shingle - 1)
    need = F.ceil(total * F.lit(similarity / (1 + similarity)) - 1e-9)
    shared = grams.join(hint(index), "g").groupBy("id", "row", "size", "item", "len").agg(F.count_distinct("pos").alias("n"), F.sort_array(F.collect_set(F.col("pos") - F.col("at"))).alias("ds")).where(F.col("n") >= need)
    d = F.col("ds")
    steps = F.flatten(F.transform(d, lambda x, i: F.sequence(x, F.greatest(x, F.least(F.coalesce(F.get(d, i + 1) - 1, x), x + F.col("len"))))))
    starts = pinned(shared.select("id", "row", "item", "len", "ds"), starts=steps).groupBy("id", "row").agg(F.collect_set(F.struct("item", "len", "starts")).alias("spans"))
    starts = materialise(starts.withColumnsRenamed({"id": "id2", "row": "row2"}), "spans")

    # Only documents in a slot with a window are split into words again and moved.
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLOTS)).alias("slot")
    marked = F.broadcast(starts.select(slot("id2", "row2")).distinct())
    near = pinned(base.withColumn("slot", slot("id", "row")).join(marked, "slot", "left_semi").select("id", "row", "t"), w=normal_words(F.col("t"))).drop("t")
    joined = near.join(starts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2"))).select("id", "row", "w", "spans").dropDuplicates(["id", "row"])
    span = joined.select("id", "row", "w", F.explode("spans").alias("s"))
    last = F.greatest(F.lit(0), F.size("w") - F.col("s.len"))
    clipped = F.array_distinct(F.transform(F.col("s.starts"), lambda x: F.greatest(F.lit(0), F.least(x, last))))
    windows = span.select("id", "w", "s.item", "s.len", F.explode(clipped).alias("start"))
    windows = pinned(windows, win=F.slice("w", F.col("start") + 1, F.col("len"))).drop("w")
    windows = with_window_hashes(windows, "win", shingle, "wg")

    prints = with_fingerprint(items, "iw", "ifp").drop("iw")
    both = windows.join(hint(prints), ["item", "len"])
    found = pinned(both, sim=_weighted(F.col("wg"), F.col("ig"))).where(F.col("sim") >= similarity).drop("wg", "ig")
    distance = F.aggregate(F.zip_with("fp", "ifp", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    found = with_fingerprint(found, "win", "fp").withColumn("distance", distance)
    best = found.groupBy("id", "item").agg(F.min(F.struct((-F.col("sim")).alias("s"), "start", "distance")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.start").cast("long").alias("start_word"), (-F.col("b.s")).alias("similarity"), F.col("b.distance").cast("long").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that contain a benchmark item; all columns pass through, rows with a null id stay."""
    found = contamination(docs, benchmark, id_col, text_col, **options).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti").select(*docs.columns)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import read_table

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
