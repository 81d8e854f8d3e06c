"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Frequent words of the corpus (counted over all documents) are encoded once on the driver and compiled into
a minimal acyclic automaton: states with the same right language are shared, and each transition carries
the number of words that sort before it, so that the sum along a path is the word's row in a table of id
sequences. The automaton is one flat file that every task memory-maps; a batch's distinct words walk it
together, one byte a step. Words it doesn't hold are merged exactly by rank. The lexicon only saves time:
ids are those of the merges.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import most_frequent, read_table, shared_dir, slices, write_file

#: Words of the lexicon.
LEXICON = 50_000
#: Longer words never enter it: they are rare, cost a state a byte, and tasks merge them faster than the driver.
LONGEST = 256
#: Bytes of text whose words are counted at a time, and words that a task remembers.
COUNTED, CACHE = 1 << 22, 150_000
#: Rank of a pair that doesn't merge.
NONE = 1 << 40
#: Put before the string of a special token to tell it from words of texts.
SPECIAL = "\0special:"
#: Words that are looked up at a time, and bytes of text or tokens that make up a result batch.
STEP, BATCH = 100_000, 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself, or 256 and on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes of each id ("" where there is none); merges: pairs of ids to (rank, id)."""

    tokens: list[bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    pattern: str


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """From a byte-level BPE file of the tokenizers library; by default the public byte_bpe_50k.json."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, ids = byte_alphabet(), spec["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max([*ids.values(), *specials.values()]))
    for t, i in ids.items():
        if t not in specials:
            tokens[i] = bytes(alphabet[c] for c in t)
    for t, i in specials.items():
        tokens[i] = t.encode()
    merges = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return Vocabulary(tokens, merges, specials, public_tokenizers.PATTERN)


def merge(word: bytes, first: list[int], merges: dict) -> list[int]:
    """Ids of a word: the pair of lowest rank merges first, from the left."""
    ids = [first[b] for b in word]
    while len(ids) > 1:
        ranks = [merges.get(p, (1 << 30, 0))[0] for p in zip(ids, ids[1:])]
        low = min(ranks)
        if low == 1 << 30:
            break
        out, i = [], 0
        while i < len(ids):
            if i < len(ranks) and ranks[i] == low:
                out.append(merges[ids[i], ids[i + 1]][1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


class Merger:
    """Exact merges of many words at once: in each round every word merges its pair of lowest rank."""

    def __init__(self, first: list[int], merges: dict):
        """Merges lie in an open hash table with at least four slots for each, keys being pairs of ids."""
        self.first, self.bits = np.array(first, dtype=np.int64), max(4, (4 * len(merges)).bit_length())
        pairs = np.array([(a << 32 | b, rank, new) for (a, b), (rank, new) in merges.items()], dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.new = (np.full(1 << self.bits, x, dtype=np.int64) for x in (-1, NONE, 0))
        left, slot = np.arange(len(pairs)), self._slot(pairs[:, 0])
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)
            put = left[free[one]]
            self.keys[at], self.ranks[at], self.new[at] = pairs[put].T
            go = np.ones(len(left), dtype=bool)
            go[free[one]] = False
            left, slot = left[go], (slot[go] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each pair, or an empty one."""
        slot = self._slot(key)
        there = self.keys[slot]
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[rest]]
            rest = rest[(there != key[rest]) & (there >= 0)]
        return slot

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids, word = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)], np.repeat(np.arange(len(words)), lengths)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        slot, rank = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), NONE, dtype=np.int64)
        new = np.flatnonzero(word[:-1] == word[1:])  # places whose pair with the next id has to be looked up
        while len(ids):
            slot[new] = self._find(ids[new] << 32 | ids[new + 1])
            rank[new] = self.ranks[slot[new]]
            low = np.full(len(words), NONE, dtype=np.int64)
            np.minimum.at(low, word, rank)
            least = low[word]
            keep = least < NONE
            parts.append((word[~keep], ids[~keep]))  # words without a pair are done
            where = np.flatnonzero(keep & (rank == least))
            if len(where) > 1:  # in a run of overlapping hits every second one merges, from the left
                new_run = np.concatenate([[True], np.diff(where) > 1])
                start = where[np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))]
                where = where[(where - start) % 2 == 0]
            ids[where] = self.new[slot[where]]
            keep[where + 1] = False
            changed = np.zeros(len(ids), dtype=bool)
            changed[where] = changed[np.maximum(0, where - 1)] = True
            ids, word, slot, rank = ids[keep], word[keep], slot[keep], rank[keep]
            new = np.flatnonzero(changed[keep])
            ends = np.ones(len(word), dtype=bool)
            ends[:-1] = word[:-1] != word[1:]
            rank[ends] = NONE
            new = new[~ends[new]]
        parts.append((word, ids))
        word, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs starts[i] .. starts[i] + lengths[i], one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


# --- lexicon -----------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]], file) -> dict:
    """Write the minimal acyclic transducer of words to an open file; returns its sizes.

    Built from sorted words: when the next word leaves a branch, its states are complete and are replaced by equal ones
    known already (same finality and transitions).
    """
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple]] = []  # finality and (label, target) pairs of finished states

    def finish(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (known := register.get(key)) is None:
            known = register[key] = len(done)
            done.append(key)
        return known

    order = sorted(words)
    stack: list[list] = [[False, []]]  # the open branch: finality, finished (label, target) pairs
    last = b""
    for w in order:
        shared = len(os.path.commonprefix([last, w]))
        while len(stack) - 1 > shared:
            child = finish(stack.pop())
            stack[-1][1].append((last[len(stack) - 1], child))
        stack.extend([False, []] for _ in w[shared:])
        stack[-1][0] = True
        last = w
    while len(stack) > 1:
        child = finish(stack.pop())
        stack[-1][1].append((last[len(stack) - 1], child))
    root = finish(stack[0])

    below = np.zeros(len(done), dtype=np.int64)  # words accepted from each state; targets come before sources
    keys, targets, outs = [], [], []
    for s, (final, edges) in enumerate(done):
        n = int(final)
        for label, t in edges:
            keys.append(s * 256 + label)
            targets.append(t)
            outs.append(n)
            n += int(below[t])
        below[s] = n
    ids = [words[w] for w in order]
    arrays = [
        np.array(keys, dtype=np.int64),
        np.array(targets, dtype=np.int64),
        np.array(outs, dtype=np.int64),
        np.array([f for f, _ in done], dtype=np.int64),
        np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        np.array([i for x in ids for i in x], dtype=np.int64),
    ]
    file.write(np.array([root, *map(len, arrays)], dtype=np.int64).tobytes())
    for a in arrays:
        file.write(a.tobytes())
    return {"states": len(done), "transitions": len(keys), "words": len(order)}


class Lexicon:
    def __init__(self, path: str):
        flat = np.memmap(path, dtype=np.int64, mode="r")
        self.root = int(flat[0])
        at, parts = 7, []
        for n in flat[1:7]:
            parts.append(flat[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.outs, self.final, self.offsets, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Row of each word, -1 where there is none. All words take a step together."""
        rows = np.full(len(words), -1, dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(self.keys):
            return rows
        text, starts = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths) - lengths
        live, state, total, step = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), dtype=np.int64), 0
        while len(live):
            ended = lengths[live] == step
            hit = ended & (self.final[state] == 1)
            rows[live[hit]] = total[hit]
            go = ~ended
            live, state, total = live[go], state[go], total[go]
            if not len(live):
                break
            key = state * 256 + text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, total = self.targets[at], total[ok] + self.outs[at]
            step += 1
        return rows


# --- encoding ----------------------------------------------------------------------------------------


class _Numbers(dict):
    """Words by number, given when a word is first looked up; fresh are those that have no ids yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Ids of whole texts. Give specials=False to treat the strings of special tokens as ordinary text."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, specials: bool = True):
        self.merges, self.lexicon = vocabulary.merges, lexicon
        first = {t: i for i, t in reversed(list(enumerate(vocabulary.tokens))) if len(t) == 1}
        self.first = [first[bytes([b])] for b in range(256)]
        self.merger = Merger(self.first, self.merges)
        self.pattern = regex.compile(vocabulary.pattern)
        self.specials = vocabulary.specials if specials else {}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.starts, self.lengths = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 14, dtype=np.int64), 0
        if self.specials:
            numbers = np.array([self.known[SPECIAL + s] for s in self.specials])
            self.known.fresh.clear()
            self._add(numbers, np.array(list(self.specials.values()), dtype=np.int64), np.ones(len(self.specials), dtype=np.int64))

    def _add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.known) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of the words that got a number since the last time."""
        raw = [w.encode() for w in self.known.fresh]
        numbers = np.arange(len(self.known) - len(raw), len(self.known))
        self.known.fresh.clear()
        if self.lexicon:
            rows = self.lexicon.find(raw)
            held = rows >= 0
            starts = self.lexicon.offsets[rows[held]]
            lengths = self.lexicon.offsets[rows[held] + 1] - starts
            self._add(numbers[held], self.lexicon.ids[spread(starts, lengths)], lengths)
            numbers, raw = numbers[~held], [raw[i] for i in np.flatnonzero(~held).tolist()]
        if raw:
            self._add(numbers, *self.merger.merge(raw))

    def _rows(self, words: list[str]) -> np.ndarray:
        """Numbers of words, whose ids are known afterwards."""
        rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        if self.known.fresh:
            self._learn()
        return rows

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each word has."""
        if len(self.known) > CACHE:
            self._clear()
        rows = self._rows(words)
        return self.flat[spread(self.starts[rows], self.lengths[rows])], self.lengths[rows]

    def _words(self, text: str):
        """The words of a text; strings of special tokens are words of their own."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from self.pattern.findall(text[at : m.start()])
            yield SPECIAL + m.group()
            at = m.end()
        rest = text[at:] if at else text
        yield from (m.group() for m in self.pattern.finditer(rest)) if len(rest) > BATCH else self.pattern.findall(rest)

    def encode(self, text: str) -> np.ndarray:
        found = self._words(text)
        out = [self._ids(step)[0] for step in iter(lambda: list(islice(found, STEP)), [])]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; short texts share a step."""
        out: list[np.ndarray] = []
        words: list[str] = []
        ends: list[int] = []

        def flush():
            if ends:
                ids, lengths = self._ids(words)
                at = np.concatenate([[0], np.cumsum(lengths)])[ends]
                out.extend(np.split(ids, at)[:-1])
                words.clear()
                ends.clear()

        for text in texts:
            if len(text) > BATCH:
                flush()
                out.append(self.encode(text))
                continue
            words += self._words(text) if self.cut and self.cut.search(text) else self.pattern.findall(text)
            ends.append(len(words))
            if len(words) > STEP:
                flush()
        flush()
        return out


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        lengths = np.array([len(t) for t in vocabulary.tokens], dtype=np.int64)
        self.lengths, self.starts, self.flat = lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(vocabulary.tokens), dtype=np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        out = []
        for i in range(0, len(ids), BATCH):
            part = ids[i : i + BATCH]
            part = part[(part >= 0) & (part < len(self.lengths))]
            out.append(self.flat[spread(self.starts[part], self.lengths[part])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")


def _count_words(batches):
    for b in batches:
        for texts in slices(b.column(0), COUNTED):
            counts = pc.value_counts(pc.utf8_split_whitespace(texts.drop_null()).flatten())
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["w", "n"])
    pa.default_memory_pool().release_unused()  # the worker goes on to encode


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", size: int = LEXICON) -> str:
    """Compile the most frequent words of all texts, size at most and of LONGEST bytes at most (others merge in tasks); returns the name under which tasks find the file.

    The file is written to the shared folder under its digest, from where each executor fetches its copy.
    """
    spark = docs.sparkSession
    counts = docs.select(text_col).mapInArrow(_count_words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    frequent = most_frequent(counts.withColumn("_all", F.lit(0)), ["_all"], size).select("w").toArrow().column("w").to_pylist()
    pattern, encoder, words = regex.compile(vocabulary.pattern), Encoder(vocabulary), {}
    for word in frequent:
        for w in pattern.findall(" " + word) if len(word) <= LONGEST else ():
            words.setdefault(w.encode(), None)
    first, merges = encoder.first, encoder.merges
    words = {w: merge(w, first, merges) for w in words}
    data = io.BytesIO()
    compile_lexicon(words, data)
    name = f"lexicon-{hashlib.sha256(data.getvalue()).hexdigest()[:32]}.bin"
    path = f"{shared_dir(spark)}/keyloom/{name}"
    write_file(spark, path, data.getvalue())
    spark.sparkContext.addFile(path)
    return name


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, convert) -> DataFrame:
    """df with column name made from column source by convert(values) -> arrays, batch by batch."""
    kept = df.drop(name) if name != source else df
    at = kept.columns.index(source)
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != name], T.StructField(name, kind)])

    def run(batches):
        make = convert()
        for b in batches:
            rest = [i for i, n in enumerate(b.schema.names) if n != name]
            at_row = 0
            for part in make(b.column(at)):
                cut = b.slice(at_row, len(part))
                at_row += len(part)
                yield pa.RecordBatch.from_arrays([*[cut.column(i) for i in rest], part], [*[b.schema.names[i] for i in rest], name])

    return kept.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, lexicon: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with out_col, the ids of each whole text (null: of the empty text), as array<int>.

    Strings of special tokens become their ids, as in the tokenizers library. A column named out_col is
    replaced, all others pass through; repeated rows get equal ids; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file's size

    def convert():
        encoder = Encoder(shared.value, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)

        def make(column):
            texts, size = [], 0
            for text in column:
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > BATCH:
                    yield _lists(encoder.encode_many(texts))
                    texts, size = [], 0
            if texts:
                yield _lists(encoder.encode_many(texts))

        return make

    return _with_column(docs, text_col, out_col, T.ArrayType(T.IntegerType()), convert)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))


def decode_ids(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col, the text of ids_col: null for null, "" for no ids; unknown ids give nothing."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def convert():
        decoder = Decoder(shared.value)

        def make(column):
            texts, size = [], 0
            for ids in column:
                texts.append(None if not ids.is_valid else decoder.decode(np.asarray(ids.values, dtype=np.int64)))
                size += len(texts[-1] or "")
                if size > BATCH:
                    yield pa.array(texts, pa.string())
                    texts, size = [], 0
            if texts:
                yield pa.array(texts, pa.string())

        return make

    return _with_column(df, ids_col, out_col, T.StringType(), convert)


def digest(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    texts = docs.select(id_col, "text")
    coded = encode_texts(texts, vocabulary, build_lexicon(texts, vocabulary)).drop("text")
    out = decode_ids(coded, vocabulary)
    return out.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"), load_vocabulary())
