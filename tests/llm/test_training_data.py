"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import bpe, chat, decontam, html_text, langid, linededup, ngram_join, quality, queries, rules, warc
from keyloom.session import work_path

DATA = "/root/testdata/sf0.001"
LONG = "word other " * 30_000
TEXTS = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, LONG), (6, "one two"), (6, "one two"), (None, "no id here, but a text of more than twenty characters"), (7, "Ünïcode ЖЖ 日本 😀")]


def docs(spark, rows=TEXTS):
    """Documents with columns whose names clash with those that operators add or use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in ("n_lines", "score", "ids", "kept", "n", "t", "w", "id", "row", "node", "_lines")})


def empty(spark):
    return docs(spark).limit(0)


@pytest.fixture(scope="module")
def con():
    import pathlib

    c = duckdb.connect()
    for p in pathlib.Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    df, want = queries.queries()[name](spark, DATA), con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    text = lambda rows: sorted([str(x) for x in r] for r in rows)
    assert text(df.select(*names).collect()) == text(want.fetchall())


# --- 1 chat --------------------------------------------------------------------------------------------------------


def test_escape_is_reversible_and_leaves_no_control_string():
    rng, parts = random.Random(0), [*chat.CONTROL, "<", "\\", "|", "s>", "[", "INST]", "a", "<s", "[/"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(7)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_chat_edge_cases(spark):
    rows = [(1, 2, "assistant", "b<|end|>"), (1, 1, "user", "a"), (1, 2, "assistant", "b<|end|>"), (2, None, None, None), (None, 1, "assistant", "x"), (None, 0, "user", ""), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    template = chat.Template(bpe.load_vocabulary())
    out = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
    decoder = bpe.Decoder(template.vocabulary)
    back = lambda k: chat.read_back(np.array(out[k]["ids"]), np.array(out[k]["loss_mask"]), template, decoder)
    assert back(1) == ([("user", "a"), ("assistant", "b<|end|>"), ("assistant", "b<|end|>")], ["b<|end|>"] * 2)
    assert back(2) == ([("", "")], []) and back(None) == ([("user", ""), ("assistant", "x")], ["x"])
    assert back(3)[1] == [LONG] and out[3]["formatted"] == f"{chat.BEGIN}{chat.TURN}assistant{chat.TEXT}{LONG}{chat.END}"
    assert chat.format_conversations(df.limit(0), template).count() == 0


# --- 2 BPE ---------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok, vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.load_vocabulary()
    rng = random.Random(5)
    texts = ["", "a<|endoftext|>b<|endoftext|>", "aaaa aaaaaaa  \n\n x", "tabs\t\t x\r\n ", "日本語 テスト 123４５ café's I'll'", "\xa0　 x", "😀😀 👨‍👩‍👧", LONG] + ["".join(rng.choice("ab é'\n1!😀") for _ in range(60)) for _ in range(200)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bpe.Encoder(vocabulary).encode_many(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = bpe.build_lexicon(df, vocabulary, size=50)
    out = bpe.decode_ids(bpe.encode_texts(df, vocabulary, lexicon), vocabulary).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == dict(enumerate(want))
    assert {r["doc_id"]: r["decoded"] for r in out} == {i: tok.decode(w, skip_special_tokens=False) for i, w in enumerate(want)}


def test_bpe_edge_cases(spark):
    vocabulary = bpe.load_vocabulary()
    out = bpe.encode_texts(docs(spark), vocabulary)
    assert out.count() == len(TEXTS) and set(out.columns) == set(docs(spark).columns)
    assert [r["ids"] for r in out.where("doc_id in (1, 2)").collect()] == [[], []]
    assert bpe.encode_texts(empty(spark), vocabulary).count() == 0 and bpe.build_lexicon(empty(spark), vocabulary)
    none = spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>")
    assert [tuple(r) for r in bpe.decode_ids(none, vocabulary).select("i", "decoded").orderBy("i").collect()] == [(1, None), (2, "")]


def test_lexicon_is_minimal(tmp_path):
    words = {w.encode(): [i] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops"])}
    with open(tmp_path / "x", "wb") as f:
        sizes = bpe.compile_lexicon(words, f)
    lex = bpe.Lexicon(str(tmp_path / "x"))
    assert sizes["states"] < 10 and lex.find([b"tap", b"to", b"stops", b"", b"z"]).tolist() == [2, -1, 1, -1, -1]
    with open(tmp_path / "y", "wb") as f:
        bpe.compile_lexicon({}, f)
    assert bpe.Lexicon(str(tmp_path / "y")).find([b"a"]).tolist() == [-1]


# --- 3 n-gram join -------------------------------------------------------------------------------------------------


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        if len(s) >= len(sets.get(i, ())):
            sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, groups, size, words):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(words)]
        for _ in range(rng.randrange(1, size + 1)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                at, op = rng.randrange(len(w)), rng.random()
                w[at : at + 1] = [] if op < 0.2 else [f"e{rng.randrange(10**6)}"] if op < 0.7 else [w[at], "more"]
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("k,num,den,most,block", [(3, 90, 100, 64, 2048), (5, 80, 100, 64, 2048), (3, 90, 100, 5, 4), (5, 80, 100, 2, 3)])
def test_near_duplicates_equal_brute_force(spark, k, num, den, most, block):
    """With few documents counting as frequent, large groups go through the blocks."""
    rng = random.Random(k + most)
    rows = near_copies(rng, 14, 14, 50) + [(900, None), (901, ""), (902, "A b"), (903, "a  B"), (904, "a"), (905, LONG)]
    out = ngram_join.near_duplicates(docs(spark, [*rows, (None, "x y z")]), k=k, num=num, den=den, most=most, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_groups(rows, k, num, den)


def test_large_groups_over_many_blocks_equal_brute_force(spark):
    """Two groups of near copies and other documents hold one passage; all lists have several blocks."""
    rng = random.Random(9)
    word = lambda: f"q{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(25)], []
    for size, length in ((60, 60), (40, 66), (40, 40)):
        base = [word() for _ in range(length)] + passage
        for _ in range(size):
            w = list(base) if size != length else [word() for _ in range(length)] + passage
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    want = brute_groups(rows, 3, 90, 100)
    out = ngram_join.near_duplicates(docs(spark, rows), k=3, num=90, den=100, most=3, block=7).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert max(Counter(c for _, c in want.values()).values()) >= 30


def test_near_duplicates_pass_texts_and_sets_in_small_batches(spark, monkeypatch):
    def watched(make):
        def made(*args):
            work = make(*args)

            def run(batches):
                def small():
                    for b in batches:
                        assert b.nbytes < 1 << 23
                        yield b

                yield from work(small())

            return run

        return made

    for name in ("_sketch", "_decide", "_sets", "_verify"):
        monkeypatch.setattr(ngram_join, name, watched(getattr(ngram_join, name)))
    text = F.concat_ws(" ", F.expr("transform(sequence(0, 7999), x -> concat('w', x))"), F.concat(F.lit("own"), "id"))
    out = ngram_join.near_duplicates(spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert {(r["n_shingles"], r["component_id"]) for r in out.collect()} == {(7997, 0)}


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    one = ngram_join.near_duplicates(docs(spark)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in one) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 4), (7, 7)]


def test_choice_of_matches():
    rare = np.full(40, 2)
    assert ngram_join.choose(np.arange(40), rare, 400, 90, 100)[1] is False
    hot = np.full(400, 10**6)
    assert ngram_join.choose(np.arange(400), hot, 400, 90, 100)[1] is True


# --- 4 language ----------------------------------------------------------------------------------------------------


def test_language_edge_cases(spark):
    rows = [("the house and the tree", "en"), ("das haus und der baum", "de"), (None, "en"), ("le chat", None)]
    model = langid.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    out = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(spark.createDataFrame([("the haus tree",), ("HOUSES",), ("baumen",), ("12 !",), (None,), ("",)], "text string"), model).collect()}
    assert out["12 !"] == out[None] == out[""] == ("und", 0.0)
    assert out["HOUSES"][0] == "en" and out["baumen"][0] == "de" and all(0 <= s <= 1 for _, s in out.values())
    assert langid.predict_languages(docs(spark), model).count() == len(TEXTS) and langid.predict_languages(empty(spark), model).count() == 0
    nothing = langid.fit_languages(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict_languages(docs(spark), nothing).collect()} == {"und"}


def gram_hash(gram):
    """The hash of an n-gram as the module has it: of its code points behind the pad that _grams puts first."""
    return int(langid._grams([gram])[2][len(gram)][1])


def test_a_run_of_equal_counts_is_broken_not_left_out(spark):
    from keyloom.llm.common import most_frequent

    flat = spark.range(40_000).select(F.lit("x").alias("lang"), F.col("id").cast("string").alias("w"), F.lit(7).cast("long").alias("n"))
    kept = {n: most_frequent(flat, ["lang"], n).count() for n in (30_000, 39_999, 40_000, 50_000, 3)}
    assert 29_900 <= kept[30_000] <= 30_000 and 39_900 <= kept[39_999] <= 39_999 and kept[40_000] == kept[50_000] == 40_000 and kept[3] <= 3
    mixed = flat.withColumn("n", F.when(F.col("w").cast("int") < 100, 900).otherwise(F.col("n")))
    got = most_frequent(mixed, ["lang"], 1000).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in got}[900] == 100 and 850 < sum(r["count"] for r in got if r["n"] == 7) <= 900
    assert most_frequent(flat.limit(0), ["lang"], 5).count() == 0


def test_lexicon_leaves_long_words_to_tasks(spark):
    import time

    df = spark.createDataFrame([(1, "one " + "ab" * 100_000 + " two")], "doc_id long, text string")
    began, vocabulary = time.perf_counter(), bpe.load_vocabulary()
    coded = bpe.encode_texts(df, vocabulary, bpe.build_lexicon(df, vocabulary)).first()["ids"]
    assert time.perf_counter() - began < 60
    assert coded == bpe.encode_texts(df, vocabulary).first()["ids"]


def plain_language_scores(train, texts, max_words, max_grams):
    """The method word by word: counts, cuts, log frequencies, back-off."""
    words_of = lambda t: [w[i : i + langid.LONG_WORD] for w in regex.findall(r"[\p{L}\p{M}]+", t.lower()) if regex.search(r"\p{L}", w) for i in range(0, len(w), langid.LONG_WORD)]
    part_of = lambda x, k: xxhash.xxh64(np.uint64(gram_hash(x)).tobytes() if k else x.encode(), seed=42).intdigest() % 4096
    grams_of = lambda w, k: [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)]
    counts = {k: defaultdict(Counter) for k in range(6)}
    for text, lang in train:
        if text is not None and lang is not None:
            for w in words_of(text):
                counts[0][lang][w] += 1
                for k in langid.LENGTHS:
                    counts[k][lang].update(grams_of(w, k))
    languages, known = sorted(counts[0]), {}
    for k, by in counts.items():
        limit, keep = max_grams if k else max_words, set()
        for c in by.values():
            down = {x: n if n < 1000 else n // 10 ** (len(str(n)) - 3) * 10 ** (len(str(n)) - 3) for x, n in c.items()}
            keep |= {x for x, n in down.items() if sum(m >= n for m in down.values()) <= limit}
            lower = [n for n in down.values() if sum(m >= n for m in down.values()) > limit]
            if lower:  # the run at the cut: the parts of lowest hash that fit
                run, room = [x for x, n in down.items() if n == max(lower)], limit - sum(m > max(lower) for m in down.values())
                part = {x: part_of(x, k) for x in run}
                keep |= {x for x in run if sum(p <= part[x] for p in part.values()) <= room}
        known[k] = {x: np.log([(by[l][x] + 0.5) / (by[l].total() + 0.5 * max(1, len(keep))) for l in languages]) for x in keep}

    def score(w):
        if w in known[0]:
            return known[0][w]
        for k in langid.LENGTHS:
            if found := [known[k][g] for g in grams_of(w, k) if g in known[k]]:
                return np.mean(found, axis=0)
        return np.zeros(len(languages))

    out = []
    for t in texts:
        found = words_of(t or "")
        total = np.sum([score(w) for w in found], axis=0) if found else np.zeros(len(languages))
        out.append((languages[int(np.argmax(total))], float(1 / np.exp(total - total.max()).sum())) if found else ("und", 0.0))
    return out


@pytest.mark.parametrize("words,grams", [(30_000, 10_000), (60, 25)])
def test_languages_equal_a_plain_version(spark, words, grams):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang").collect()]
    train, texts = [*rows[:100], ("Zürich " + "x" * 200, "de"), (None, "de"), ("none", None)], [t for t, _ in rows] + ["", None, "12 ½ ² Ⅷ", "é́ \u0301", "y" * 300, "हिन्दी"]
    model = langid.fit_languages(spark.createDataFrame(train, "text string, lang string"), max_words=words, max_grams=grams)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [(r["lang_pred"], r["score"]) for r in langid.predict_languages(df, model).orderBy("i").collect()]
    want = plain_language_scores(train, texts, words, grams)
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def test_many_languages_in_bounded_memory(spark, monkeypatch):
    """Two hundred languages, in parts of a few words: the model grows with what languages have, not with their square."""
    import pickle

    train = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}x" for w in "abcdefghijklmnop"), f"l{i:03d}") for i in range(200)]
    model = langid.fit_languages(spark.createDataFrame(train, "text string, lang string"))
    assert len(model.languages) == 200 and len(model.words) == 3200
    assert len(pickle.dumps(model)) < 3_000_000  # dense it would be 3,200 words by 200 languages by 8 bytes, and more for n-grams
    texts = [t for t, _ in train] + ["", None, "unseen words only"]
    want = plain_language_scores(train, texts, 30_000, 10_000)
    for entries in (1 << 20, 600):
        monkeypatch.setattr(langid, "ENTRIES", entries)
        sums, has = model.scores(pa.array(texts), pa.array(model.words))
        assert [model.languages[i] if h else "und" for i, h in zip(sums.argmax(axis=1), has)] == [x for x, _ in want]


def test_language_accuracy_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = langid.op4_language_id(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# --- 5 lines -------------------------------------------------------------------------------------------------------


def test_line_edge_cases(spark):
    line = "This line is long enough to count"
    rows = [(1, f"{line}\nshort\n{line}"), (2, f"  {line.upper()}\t\nx"), (3, f"{line}\n{line}"), (4, None), (5, ""), (None, line), (2, f"  {line.upper()}\t\nx"), (9, "\n".join([line] * 3000 + ["end"]))]
    out = linededup.dedup_lines(docs(spark, rows))
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)
    whole = "\n".join([line] * 3000 + ["end"])
    assert got == sorted([(1, "short", 3, 2), (2, "x", 2, 1), (2, "x", 2, 1), (3, "", 2, 2), (4, "", 1, 0), (5, "", 1, 0), (None, line, 1, 0), (9, whole, 3001, 0)], key=str)
    again = [(1, line), (2, line), (2, line + "\nother"), (None, line), (None, line)]
    assert {r["n_dropped"] for r in linededup.dedup_lines(docs(spark, again)).collect()} == {0}
    assert linededup.dedup_lines(empty(spark)).count() == 0 and "_lines" in out.columns


# --- 6 WARC --------------------------------------------------------------------------------------------------------


def test_warc_round_trip_over_small_splits(spark):
    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(200_000))
    rows = [(i, f"http://x/{i} y", ["same", None, "", noise, "ü" * i][i % 5]) for i in range(60)] + [(70, None, "magic \x1f\u008b\x08 inside"), (70, None, "magic \x1f\u008b\x08 inside"), (None, "u", "no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0))
    path = work_path(spark, "warc")
    warc.write_warc(df.repartition(3), path)
    read = warc.read_warc(spark, path, split=777)
    assert read.rdd.getNumPartitions() == sum(-(-r["length"] // 777) for r in spark.read.format("binaryFile").load(path).select("length").collect())
    out = {r["page_id"]: r for r in read.collect()}
    assert sorted(out) == [*range(60), 70]
    first = {}
    for i, _, html in rows[:61]:
        raw, r = (html or "").encode(), out[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), warc.digest(raw))
        owner = first.setdefault(raw, i)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if owner == i else ("revisit", owner))
        assert bytes(r["payload"]) == (raw if owner == i else b"")
    none = work_path(spark, "warc")
    warc.write_warc(df.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_splits_own_each_record_once():
    records = [warc.gzip_member(warc.record_bytes(i, "u", (b"\x1f\x8b\x08" * i) + b"x" * i, None)) for i in range(40)]
    data = b"".join(records)
    for size in (1, 13, 500, len(data)):
        ids = [r[0] for s in range(0, len(data), size) for r in warc.records_in(io.BytesIO(data), s, min(len(data), s + size))]
        assert ids == list(range(40))


def test_large_member_ends_in_padding():
    import gzip

    big = warc.gzip_member(warc.record_bytes(1, "u", b"a" * (1 << 24), None))
    assert big[-1] != 0 and gzip.decompress(big + b"\0").startswith(b"WARC/1.1")


# --- 7 quality -----------------------------------------------------------------------------------------------------


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (4, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs(spark), labels)
    out = quality.score_quality(docs(spark), model)
    assert out.count() == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out.collect()) and sorted(out.columns) == sorted(docs(spark).columns)
    nothing = quality.fit_quality(empty(spark), labels.limit(0))
    assert {round(r["score"], 9) for r in quality.score_quality(docs(spark), nothing).collect()} == {0.7}
    assert quality.score_quality(empty(spark), model).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op7_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def all_pairs_weights(good, bad):
    """Weights and cut of the quality model from a list of all pairs."""
    both = np.vstack([good, bad])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    g, b = (good - mean) / scale, (bad - mean) / scale
    d, w = (g[:, None, :] - b[None, :, :]).reshape(-1, both.shape[1]), np.zeros(both.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 1e-3 * len(d) * np.eye(len(w)), d.T @ p - 1e-3 * len(d) * w)
    s = np.sort(np.concatenate([g @ w, b @ w]))
    return w, (s[len(b) - 1] + s[len(b)]) / 2


def test_quality_learns_from_all_labelled_documents_and_pairs(spark):
    rng = random.Random(5)
    words = lambda n, loud: " ".join(rng.choice(["some", "plain", "words,", "here.", "LOUD" if rng.random() < loud else "calm", "$$$" if rng.random() < loud else "text"]) for _ in range(n))
    rows = [(i, words(rng.randrange(9, 40), 0.7 if i % 3 == 0 else 0.3)) for i in range(600)]
    rows += [(600 + i, words(rng.randrange(9, 40), 0.5)) for i in range(40)]  # labelled against their looks
    label = {i: int(i % 3 != 0) if i < 600 else i % 2 for i, _ in rows}
    model = quality.fit_quality(docs(spark, rows), spark.createDataFrame(list(label.items()), "doc_id long, quality int"))
    seen = [(label[i], quality.features(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    w, cut = all_pairs_weights(*(np.array([x for y, x in seen if y == c]) for c in (1, 0)))
    assert np.abs(np.array(model.weights) - w).max() < 1e-3 and abs(model.cut - cut) < 1e-2


# --- 8 HTML --------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=x>Home</a></header><nav><ul><li><a>One</a></ul></nav>
<div class="cookie-notice">We use cookies, fine?</div><div id=content><h2>Title &amp; more</h2><p>First paragraph,
 with text. And more&nbsp;of it, indeed.<p>Second one <b>bold</b> text; it goes on, and on.<ul><li>item one<li>item two, with words</ul><script>var x = "<p>no</p>";</script>
<div class='comments'><p>I liked it, a lot. Really, much. Indeed!</p></div></div><aside>Related: more, of this, here.</aside><form><input value=1><label>Mail</label></form><footer>2020, all rights.</footer>"""


def test_html_extraction(spark):
    want = "Title & more\nFirst paragraph, with text. And more of it, indeed.\nSecond one bold text; it goes on, and on.\nitem one\nitem two, with words"
    assert html_text.main_text(PAGE) == want
    for odd in (None, "", "<", "<p>", "<!-- <p>x", "<script>x", "</p></b>", "<p", "&nbsp;", "<a href='"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string").withColumn("text", F.lit("mine"))
    assert [r["text"] for r in html_text.extract_text(df).orderBy("page_id").collect()] == [want, "", ""]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_articles_of_the_pages_are_whole(con):
    """With article elements, and without any, when paths alone tell."""
    import html

    found = 0
    for _, page in con.execute("select page_id, html from pages").fetchall():
        if page and (a := re.search(r"<article>(.*?)</article>", page, re.S)):
            parts = re.split(r"</?(?:p|h1)>", a[1])
            want = "\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split())))
            layout = re.sub(r"</?article>", "", page).replace("<body>", "<body><form method=post>").replace("</body>", "</form></body>")
            forms = [page, page.replace("article>", "div>"), re.sub(r"</?article>", "", page), layout]
            assert [html_text.main_text(x) == want for x in forms] == [True] * 4
            found += 1
    assert found > 20


LINES = ["A lead of some words, no more.", "The body goes on, with commas, and with more words than the lead had. It even has two sentences.", "A last one, to close."]


@pytest.mark.parametrize(
    "page",
    [
        "<article><p>%s</p><p>%s</p></article><article><p>%s</p></article>",
        "<div><p>%s</p></div><section><p>%s</p></section><div class=end><p>%s</p></div>",
        "<main><div class=related-work><p>%s</div><div class=side-by-side><p>%s</div><div id=share class='tag skip'><p>%s</div></main>",
        "<form><article><p class=search-results-analysis>%s<p class=comments-on-theory>%s<p>%s</article><input></form>",
        "<div class=header>A site, with a name.</div><article><p>%s<p>%s<p>%s</article>",
        "<div class=site-header><p>A site, with a name, and more.</div><p>%s<p>%s<p>%s",
        "<article><p>%s<p>%s<p>%s<section class=user-comments><p>I, too, think so. Yes, really.</section></article>",
        "<article><p>%s<p>%s<p>%s</article><div class=discussion><article><p>I, too, think so. Yes.</article><article><p>No, never, I say.</article></div>",
        "<article><p>%s<div class=ad-slot>Buy, now, this.</div><p>%s<div class=advert-300x250>Buy!</div><p>%s</article><div class=gdpr-overlay>We, use, it.</div>",
        "<main><article><p>%s<p>%s<p>%s</article><div class=more><article><a href=x>Another story, of the day.</a></article></div></main>",
        "<article><div class=article-header><h1>%s</h1></div><p>%s<p>%s</article>",
        "<p>A site text that is much longer than the article is, with commas, and more, and more, and more words, and sentences. And another one, too. And more of it.</p><article><p>%s<p>%s<p>%s</article>",
        "<div class='layout has-sidebar'><p>%s<p>%s<p>%s</div>",
        "<p>%s<p>%s<p>%s<div class=siteFooter>All rights, reserved.</div><div class='x cookie-notice'>We, use, cookies.</div><div id=comment-list-2><p>Nice, text, this.</div>",
    ],
)
def test_named_kinds_go_and_nothing_else(page):
    assert html_text.main_text(page % tuple(LINES)) == "\n".join(LINES)


#: Nothing names the parts of these: only paths can tell.
UNNAMED = [
    "<article><p>%s<div class=x>Also: <a href=1>another story of this site</a> <a href=2>and one more of them</a></div><p>%s<p>%s</article>",
    "<div class=top><div>Hello <a href=1>to you</a></div><div>Today <a href=2>is a day</a></div></div><div class=mid><p>%s<p>%s<p>%s</div><div class=low><i>Made by <a href=3>somebody else</a></i></div>",
    "<table><tr><td class=l>Go <a href=1>to the first page</a><td class=r><p>%s<p>%s<p>%s</table>",
]


@pytest.mark.parametrize("page", UNNAMED)
def test_paths_decide_where_nothing_is_named(page, monkeypatch):
    want = "\n".join(LINES)
    assert html_text.main_text(page % tuple(LINES)) == want
    monkeypatch.setattr(html_text, "content_paths", lambda nodes: {p for p, _, _ in nodes})
    assert html_text.main_text(page % tuple(LINES)) != want


def test_hostile_pages_take_time_in_proportion():
    import time
    import tracemalloc

    for make in (lambda n: '<div class="c">' * n + "x", lambda n: "<a " * n, lambda n: "<b>x" * n, lambda n: "<a '" * n, lambda n: "<ul>" + "<b>" * n + "<li>x" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<p><i>" * n):
        tracemalloc.start()
        began = time.perf_counter()
        html_text.main_text(make(15_000))
        assert time.perf_counter() - began < 5 and tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


# --- 9 rules -------------------------------------------------------------------------------------------------------


def test_rules_edge_cases(spark):
    out = rules.quality_rules(docs(spark))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(TEXTS) and got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and not got[1]["kept"]
    assert got[5]["n_words"] == 60_000 and got[5]["n_repeat_words"] == 60_000 and got[5]["base_failed"]
    assert rules.quality_rules(empty(spark)).count() == 0
    clean = "A sentence of plain words stands here, and another one follows it. " * 1 + "Then the text goes on with quite different matters, as texts do."
    mixed = [(1, clean), (2, clean + "\nHome | News | Sport | Weather\nAll rights reserved."), (3, "BUY!! NOW!! BEST!! DEAL!! " * 6 + "x y"), (4, "\n".join(f"a{i} | b{i} | c{i} | d{i} |" for i in range(9)))]
    mixed += [(10 + i, f"{x}\n{clean}") for i, x in enumerate(["Menü", "MENÜ", "Lire la suite...", "Página siguiente", "Alle Rechte vorbehalten.", "© x. Tous droits réservés"])] + [(20 + i, f"{x}\n{clean}") for i, x in enumerate(["Menüfolge", "Iniciose", "Homes are built."])]
    kept = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in rules.quality_rules(docs(spark, mixed)).collect()}
    assert all(kept[10 + i] == (True, clean) for i in range(6)) and all(kept[20 + i] == (True, mixed[10 + i][1]) for i in range(3))
    assert kept[1] == (True, clean) and kept[2] == (True, clean) and not kept[3][0] and not kept[4][0]


# --- 10 decontamination --------------------------------------------------------------------------------------------


def brute_contamination(texts, items, t=0.8):
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower().translate({ord(c): None for c in decontam.MARKS}))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, text in texts:
        w = words(text)
        g = grams(w)
        for i, item in items:
            n, ig = len(words(item)), Counter(grams(words(item)))
            for s in range(max(0, len(w) - n) + 1) if ig else ():
                c = Counter(g[s : s + n - 4])
                inter = sum((c & ig).values())
                sim = inter / (sum(c.values()) + sum(ig.values()) - inter)
                if sim >= t:
                    out[d, i] = max(sim, out.get((d, i), 0))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 70)))) for i in range(25)] + [(90, None), (91, "too short"), (92, "a b a b a b a b a b a b")]
    texts = []
    for d in range(60):
        w = rng.choice(items[:25])[1].split()
        for _ in range(rng.randrange(0, 4)):
            at, op = rng.randrange(len(w)), rng.random()
            w[at : at + 1] = [] if op < 0.3 else [word()] if op < 0.7 else [w[at].upper() + ",", word()]
        texts.append((d, " ".join([word() for _ in range(rng.randrange(20))] + w + [word() for _ in range(rng.randrange(20))])))
    texts += [(80, "x a b a b a b a b a b a b y"), (81, None), (82, ""), (83, LONG), (84, texts[0][1] + " " + LONG + " " + items[3][1])]
    want = brute_contamination(texts, items)
    out = decontam.contamination(docs(spark, [*texts, texts[0]]), spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(0)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out.collect()}
    assert len(want) >= 15 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_windows_with_a_replaced_end_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"r{rng.randrange(4000)}" for _ in range(50))) for i in range(150)]
    texts = [(i, " ".join([*item.split()[:45], *(f"x{rng.randrange(4000)}" for _ in range(5))])) for i, item in items]
    want = {(i, i): 41 / 51 for i, _ in items}
    assert brute_contamination(texts[:3], items[:3]) == {k: v for k, v in want.items() if k[0] < 3}
    out = decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in out.collect()} == want


def test_documents_shorter_than_an_item_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"s{rng.randrange(4000)}" for _ in range(rng.randrange(20, 70)))) for i in range(8)]
    cut = [(i, item.split(), k) for i, item in items for k in range(1, len(item.split()) // 4)]
    texts = [(100 * i + k, " ".join(w[:-k])) for i, w, k in cut] + [(5000 + 100 * i + k, " ".join(w[k:])) for i, w, k in cut]
    want = brute_contamination(texts, items)
    out = decontam.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out.collect()}
    assert 50 <= len(want) < len(texts) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_decontaminate_keeps_clean_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = [*TEXTS, (50, "zero one two three four five six seven")]
    out = decontam.decontaminate(docs(spark, rows), items)
    assert out.count() == len(TEXTS) and out.columns == docs(spark).columns
    assert decontam.decontaminate(docs(spark), items.limit(0)).count() == len(TEXTS)
    assert decontam.decontaminate(empty(spark), items).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline as p

    out = {r["doc_id"]: r for r in p.run(spark, DATA).collect()}
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit_quality(whole, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = [r for r in whole.collect() if model.scores(np.array([quality.features(r["text"])]))[0] >= model.threshold]
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for r in kept:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r["doc_id"])
    cut = lambda r: "\n".join(x for x in r["text"].split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r["doc_id"])
    texts = [(r["doc_id"], cut(r)) for r in kept]
    groups = brute_groups(texts, 5, 80, 100)
    texts = [(i, t) for i, t in texts if groups[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contamination(texts, items)}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts if i not in bad}
    assert {i: r["decoded_sha256"] for i, r in out.items()} == want
