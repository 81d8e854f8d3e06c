"""Language identification by known words, backing off to character n-grams for unseen ones.

Word counts by language cover every training document. The most frequent words of each language form the
lexicon; a known word scores its log frequency in each language. An unseen word is padded and scored by
the mean over its known character n-grams of the longest length of which at least one is known, then by
shorter ones. A document's score is the sum over its words.

Words and their counts are made batch by batch on whole Arrow columns; n-grams are 64-bit hashes of code
points, looked up in sorted arrays. Nothing runs word by word in Python but the splitting of overlong ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import discard, held_out, materialise, most_frequent, read_table, slices

#: Entries that the model keeps at most of each language: words, and n-grams of each length.
MAX_WORDS = 30_000
MAX_GRAMS = 10_000
LENGTHS = (5, 4, 3, 2, 1)
#: Bytes of text that are split at once, and words whose n-grams are counted at once.
SLICE, WORDS = 1 << 22, 100_000
#: Values of words by languages that a task holds at a time.
ENTRIES = 1 << 20
#: Longer runs of letters count as words of this length each.
LONG_WORD = 64

#: What parts words, and what makes a word one: marks alone are none.
BREAK, LETTER = r"[^\p{L}\p{M}]+", r"\p{L}"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of texts, the places of all words among them, and where each text's begin.

    Each text has at least one word, which may be empty or hold no letter; those don't count.
    """
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), BREAK)
    starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts), dtype=np.int64))])[:-1]
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), starts


def _pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of at most LONG_WORD code points that words with a letter are made of, and the place of the word each is from."""
    place = np.flatnonzero(np.asarray(pc.match_substring_regex(words, LETTER)))
    words = words.take(pa.array(place))
    long = np.asarray(pc.greater(pc.utf8_length(words), LONG_WORD))
    if not long.any():
        return words, place
    cut = [(w[i : i + LONG_WORD], p) for w, p in zip(words.filter(pa.array(long)).to_pylist(), place[long].tolist()) for i in range(0, len(w), LONG_WORD)]
    return pa.concat_arrays([words.filter(pa.array(~long)), pa.array([w for w, _ in cut], words.type)]), np.concatenate([place[~long], [p for _, p in cut]])


def _count_words(batches):
    for b in batches:
        langs = b.column(1)
        for lang in pc.unique(langs).to_pylist():
            for texts in slices(b.column(0).filter(pc.equal(langs, lang)), SLICE):
                words, places, _ = _split(texts)
                pieces, place = _pieces(words)
                n = np.bincount(places, minlength=len(words))[place]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces), pa.string()), pieces, pa.array(n, pa.int64())], ["lang", "w", "n"])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """For each code point of the padded words: the word's place, the code points left in it, and by length the hash of the n-gram from there."""
    points = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(_U)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(points))
    hashes, h = {}, np.zeros(len(points), dtype=_U)
    for k in range(1, max(LENGTHS) + 1):
        ahead = np.zeros(len(points), dtype=_U)
        ahead[: max(0, len(points) - k + 1)] = points[k - 1 :]
        h = hashes[k] = _mix(h * _U(0x9E3779B97F4A7C15) + ahead + _U(k))
    return owner, left, hashes


def _count_grams(batches):
    def counted(parts):
        t = pa.Table.from_batches(parts)
        langs, weights = t.column("lang").combine_chunks().dictionary_encode(), np.asarray(t.column("n"))
        owner, left, hashes = _grams(t.column("w").to_pylist())
        lang = np.asarray(langs.indices)[owner]
        for k in LENGTHS:
            for i, name in enumerate(langs.dictionary.to_pylist()):
                here = (left >= k) & (lang == i)
                h, inverse = np.unique(hashes[k][here], return_inverse=True)
                n = np.bincount(inverse, weights=weights[owner[here]], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array([k] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "len", "h", "n"])

    parts, size = [], 0
    for b in batches:
        parts.append(b)
        size += b.num_rows
        if size >= WORDS:
            yield from counted(parts)
            parts, size = [], 0
    if size:
        yield from counted(parts)


class SparseLogs:
    """Log frequencies by language of known keys: only those a language has are held, all others have its default."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, n: np.ndarray, totals: np.ndarray, keys_known: int):
        """Entries in order of key (its place), for each the language's place and its count."""
        self.default = np.log(0.5 / (totals + 0.5 * max(1, keys_known)))
        self.lang, self.more = langs.astype(np.int32), np.log((n + 0.5) / 0.5)
        self.start = np.searchsorted(keys, np.arange(keys_known + 1))

    def rows(self, place: np.ndarray, owner: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Add weight times the values of the keys at `place` to the rows `owner` of out, in parts of bounded size."""
        languages = out.shape[1]
        step = max(1, ENTRIES // languages)
        for at in range(0, len(place), step):
            p, o, w = place[at : at + step], owner[at : at + step], weight[at : at + step]
            out += np.bincount(o, weights=w, minlength=len(out))[:, None] * self.default
            size = self.start[p + 1] - self.start[p]
            entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[p], size)
            cell = np.repeat(o, size) * languages + self.lang[entry]
            out += np.bincount(cell, weights=np.repeat(w, size) * self.more[entry], minlength=out.size).reshape(out.shape)


@dataclass
class LanguageModel:
    """Log frequencies by language: of known words, and of known n-grams by their ascending hashes."""

    languages: list[str]
    words: list[str] = field(default_factory=list)
    word_values: SparseLogs | None = None
    grams: dict[int, tuple[np.ndarray, SparseLogs]] = field(default_factory=dict)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that aren't in the lexicon, a row each."""
        owner, left, hashes = _grams(words)
        scores, todo = np.zeros((len(words), len(self.languages))), np.ones(len(words), dtype=bool)
        for k in LENGTHS:
            known, values = self.grams[k]
            at = np.flatnonzero((left >= k) & todo[owner])
            if not len(known) or not len(at):
                continue
            h = hashes[k][at]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[place] == h
            own, place = owner[at[hit]], place[hit]
            found = np.bincount(own, minlength=len(words))
            values.rows(place, own, 1 / found[own], scores)
            todo &= found == 0
        return scores

    def scores(self, texts: pa.Array, lexicon: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each text's words by language, and whether it has a word; lexicon is `words` as an array.

        Distinct words are scored in parts, so that no matrix of all of them by all languages is held.
        """
        words, places, starts = _split(texts)
        pieces, place = _pieces(words)
        known = np.asarray(pc.fill_null(pc.index_in(pieces, value_set=lexicon), -1))
        sums = np.zeros((len(texts), len(self.languages)))
        text = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(places))))
        order = np.argsort(places, kind="stable")  # occurrences by word, and by piece below
        first, behind = np.searchsorted(places[order], place), np.searchsorted(places[order], place, side="right")
        step = max(1, ENTRIES // max(1, len(self.languages)))
        for at in range(0, len(pieces), step):
            here = known[at : at + step]
            values, old = np.zeros((len(here), len(self.languages))), np.flatnonzero(here >= 0)
            self.word_values.rows(here[old], old, np.ones(len(old)), values)
            if len(new := np.flatnonzero(here < 0)):
                values[new] = self.unseen(pieces.slice(at, step).take(pa.array(new)).to_pylist())
            size = behind[at : at + step] - first[at : at + step]
            seen = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at : at + step], size)]
            row = np.repeat(np.arange(len(here)), size)
            for x in range(len(self.languages)):
                sums[:, x] += np.bincount(text[seen], weights=values[row, x], minlength=len(texts))
        has = np.zeros(len(words), dtype=bool)
        has[place] = True
        return sums, np.logical_or.reduceat(has[places], starts)


def _most_frequent(counts: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    """Rows of counts, of all languages, with keys that are among the most frequent of a group in `by`."""
    same = [x for x in by if x != "lang"] + [key]
    kept = most_frequent(counts, by, limit).select(*same).distinct()
    return counts.join(F.broadcast(kept), same)  # at most limit rows a group


def _values(keys: pa.Array, langs: pa.Array, n: pa.Array, languages: list[str], totals: np.ndarray) -> tuple[pa.Array, SparseLogs]:
    coded = keys.dictionary_encode()
    order = np.argsort(np.asarray(coded.indices), kind="stable")
    lang = np.asarray(pc.index_in(langs, value_set=pa.array(languages, pa.string())))
    return coded.dictionary, SparseLogs(np.asarray(coded.indices)[order], lang[order], np.asarray(n)[order], totals, len(coded.dictionary))


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Learn from every row of docs with text and language; counts cover all of them.

    The lexicon keeps at most max_words words and max_grams n-grams of each length of each language, those
    with the highest counts; a run of equal counts that doesn't fit is broken by hash. Everything else
    counts as unseen and backs off. An empty table, or one without texts and languages, gives a model without languages.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    words = materialise(rows.mapInArrow(_count_words, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")
    grams = materialise(words.mapInArrow(_count_grams, "lang string, len int, h long, n long").groupBy("len", "h", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {(r["len"], r["lang"]): float(r["n"]) for r in words.select(F.lit(0).alias("len"), "lang", "n").unionByName(grams.select("len", "lang", "n")).groupBy("len", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})
    model = LanguageModel(languages)
    if languages:
        total = {k: np.array([totals.get((k, x), 0.0) for x in languages]) for k in (0, *LENGTHS)}
        found = _most_frequent(words, ["lang"], "w", max_words).select("w", "lang", "n").toArrow().combine_chunks()
        known, model.word_values = _values(*(_column(found, c) for c in ("w", "lang", "n")), languages, total[0])
        model.words = known.to_pylist()
        found = _most_frequent(grams, ["len", "lang"], "h", max_grams).select("len", "h", "lang", "n").toArrow()
        for k in LENGTHS:
            part = found.filter(pc.equal(found.column("len"), k))
            h = np.asarray(_column(part, "h")).view(_U)
            order = pa.array(np.argsort(h, kind="stable"))  # so that keys are numbered in order of their hash
            known, values = _values(*(_column(part, c).take(order) for c in ("h", "lang", "n")), languages, total[k])
            model.grams[k] = (np.asarray(known).view(_U), values)
    discard(words, grams)
    return model


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out and score_out (columns of those names are replaced).

    The language is `und` with score 0 if the text is null or has no letter, or if nothing was learnt.
    The score is the posterior share of the language. Ties go to the smaller name. Whole texts count;
    repeated rows get equal results, other columns pass through, an empty table stays empty.
    """
    kept = docs.drop(lang_out, score_out)
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(batches):
        m = shared.value
        lexicon = pa.array(m.words, pa.string())
        names = np.array([*m.languages, "und"], dtype=object)
        for b in batches:
            best, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for texts in slices(b.column(at), SLICE):
                if not m.languages:
                    best.append(np.zeros(len(texts), dtype=np.int64))
                    score.append(np.zeros(len(texts)))
                    continue
                sums, has = m.scores(texts, lexicon)
                top = np.argmax(sums, axis=1)
                share = 1 / np.exp(np.clip(sums - sums[np.arange(len(top)), top][:, None], -700, 0)).sum(axis=1)
                best.append(np.where(has, top, len(m.languages)))
                score.append(np.where(has, share, 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score), pa.float64())], [*b.schema.names, lang_out, score_out])

    return kept.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    out = predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
