"""Quality rules, line first: judge each line, remove those that fail, reject documents that lose too much.

Everything here is DataFrame expressions. A line with words is judged by three rules:

* punctuation: at least half of its words carry a symbol of `#*$%&|<>` or end in a run of two
  exclamation or question marks, or it is a long run of words with no sentence mark at all;
* navigation: cells parted by `|`, or a short line that starts with a navigation or consent phrase;
* boilerplate: licence, copyright and template phrases.

Removed lines and the words in them are counted; a document is kept if its base checks pass and the
lines left hold at least `min_kept` of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, pinned, with_window_hashes, words_of

SYMBOLS = "#*$%&|<>"
#: Share of a line's words that carry symbols or shout from which the punctuation rule removes it.
NOISY_SHARE = 0.5
#: Words without any sentence mark from which a line counts as unpunctuated.
UNPUNCTUATED_WORDS = 60
#: Share of a document's words that must be left after cleaning.
MIN_KEPT = 0.6

NOISY_WORD = r"[#*$%&|<>]|[!?]{2,}[\"')\]]*$"
#: Phrases in English, German, French and Spanish; letters beyond ASCII are spelt in both cases, since engines fold those differently.
NAVIGATION = (
    r"^(?i:home|menu|skip to|log ?in|sign ?(?:in|up)|share (?:this|on)|read more|click here|back to top|previous|next page|subscribe|we use cookies|accept (?:all )?cookies|follow us|related (?:posts|articles))\b"
    r"|^(?i:startseite|men[üÜ]|zum inhalt|anmelden|registrieren|weiterlesen|mehr lesen|nach oben|n[äÄ]chste seite|vorherige seite|newsletter abonnieren|wir verwenden cookies|alle cookies akzeptieren|[äÄ]hnliche (?:beitr[äÄ]ge|artikel)"
    r"|accueil|se connecter|connexion|s'inscrire|lire la suite|haut de page|page suivante|page pr[éÉ]c[éÉ]dente|s'abonner|nous utilisons des cookies|accepter les cookies|articles similaires"
    r"|inicio|men[úÚ]|iniciar sesi[óÓ]n|registrarse|leer m[áÁ]s|volver arriba|p[áÁ]gina siguiente|p[áÁ]gina anterior|suscr[íÍ]bete|utilizamos cookies|aceptar cookies|art[íÍ]culos relacionados)(?:[^\p{L}\p{N}]|$)"
)
BOILERPLATE = (
    r"(?i:all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|licensed under the|lorem ipsum|terms of (?:use|service)|privacy policy|javascript (?:is|must be)"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerkl[äÄ]rung|tous droits r[éÉ]serv[éÉ]s|conditions d'utilisation|politique de confidentialit[éÉ]"
    r"|todos los derechos reservados|t[éÉ]rminos (?:de uso|y condiciones)|pol[íÍ]tica de privacidad)"
)
SENTENCE_MARK = r"[.!?;:…。！？]"


def _line_facts(line: Column) -> Column:
    w = words_of(line)
    noisy = F.size(F.filter(w, lambda x: x.rlike(NOISY_WORD)))  # only lines that can have such a word are looked at word by word
    return F.struct(line.alias("line"), F.size(w).alias("n"), F.when(line.rlike(r"[#*$%&|<>]|[!?]{2}"), noisy).otherwise(0).alias("noisy"))


def _judged(f: Column) -> Column:
    return F.struct(f["line"].alias("line"), f["n"].alias("n"), _line_fails(f).alias("fails"))


def _line_fails(f: Column) -> Column:
    line, n, noisy = f["line"], f["n"], f["noisy"]
    punctuation = (noisy >= n * F.lit(NOISY_SHARE)) | ((n >= UNPUNCTUATED_WORDS) & ~line.rlike(SENTENCE_MARK))
    navigation = ((n <= 12) & F.btrim(line, F.lit(SPACES)).rlike(NAVIGATION)) | (F.char_length(line) - F.char_length(F.translate(line, "|", "")) >= 3)
    boilerplate = (n <= 40) & line.rlike(BOILERPLATE)
    return (n > 0) & (punctuation | navigation | boilerplate)


def _repeat_words(window: int) -> Column:
    """Words covered by windows found twice or more, from `_hashes`: one hash for each window start."""
    h = F.col("_hashes")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(pairs)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, window: int = 8, max_repeat_percent: int = 30, min_kept: float = MIN_KEPT) -> DataFrame:
    """Adds the counts, base_failed, clean_text (failing lines removed), n_lines_removed, words_kept and kept.

    Columns of those names are replaced, all others pass through. Null text counts as empty: no words,
    base_failed, not kept, clean_text "". Repeated rows get equal results. Windows are compared by a
    64-bit hash of their words. An empty table gives an empty table.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "words_kept", "clean_text", "kept"]
    docs = docs.drop(*new)
    # The row travels as one struct, so that no name in it clashes with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("_in"))
    df = pinned(rows, _t=F.coalesce(F.col("_in")[text_col], F.lit("")), _words=words_of(F.col("_in")[text_col]))
    df = with_window_hashes(pinned(df, _n=F.size("_words").cast("long")), "_words", window, "_hashes").drop("_words")
    df = pinned(df, _facts=F.transform(F.split("_t", "\n", -1), _line_facts))
    df = pinned(df, _sorted=_repeat_words(window), _lines=F.transform("_facts", _judged)).drop("_hashes", "_facts")
    df = pinned(df, _with=F.filter("_lines", lambda f: f["n"] > 0), _failed=F.filter("_lines", lambda f: f["fails"]), _left=F.filter("_lines", lambda f: ~f["fails"])).drop("_lines")
    s = F.col("_sorted")
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    twice = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    df = pinned(df, _p=F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("_sorted")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    total = lambda c: F.aggregate(F.transform(c, lambda f: f["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
    df = pinned(
        df,
        n_words=F.col("_n"),
        word_chars=F.char_length(F.translate("_t", SPACES, "")).cast("long"),
        n_symbols=(F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("_with") - F.size(F.array_distinct(F.transform("_with", lambda f: f["line"])))).cast("long"),
        n_repeat_words=covered,
        n_lines_removed=F.size("_failed").cast("long"),
        words_kept=F.col("_n") - total(F.col("_failed")),
        clean_text=F.array_join(F.transform("_left", lambda f: f["line"]), "\n"),
    ).drop("_p", "_with", "_failed", "_left", "_n", "_t")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("words_kept") >= F.col("n_words") * F.lit(min_kept)))
    return df.select(*[F.col("_in")[c].alias(c) for c in docs.columns], *new)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import read_table

    out = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "words_kept", "kept")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    space, ws = r"[\x20\x09-\x0D]+", "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    words = lambda t: f"list_filter(regexp_split_to_array({t}, '{space}'), lambda x: x <> '')"
    count = lambda chars: " + ".join(f"(length(t) - length(replace(t, {q(c)}, '')))" for c in chars)
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, {words("coalesce(text, '')")} as w from documents),
base as (
  select doc_id, t, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {count(SYMBOLS)} as n_symbols from d
), win as (
  select doc_id, i, array_to_string(w[i:i+7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
), dup as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c >= 2
), rep as (
  select doc_id, count(distinct i + o) as n_repeat_words from dup, (select unnest(range(0, 8)) as o) group by doc_id
), lines as (
  select doc_id, l, {words("l")} as lw, trim(l, {ws}) as st from (select doc_id, unnest(string_split(t, chr(10))) as l from d)
), facts as (
  select doc_id, l, len(lw) as n,
    (len(list_filter(lw, lambda x: regexp_matches(x, {q(NOISY_WORD)}))) >= len(lw) * {NOISY_SHARE}
     or (len(lw) >= {UNPUNCTUATED_WORDS} and not regexp_matches(l, {q(SENTENCE_MARK)}))
     or (len(lw) <= 12 and regexp_matches(st, {q(NAVIGATION)}))
     or length(l) - length(replace(l, '|', '')) >= 3
     or (len(lw) <= 40 and regexp_matches(l, {q(BOILERPLATE)}))) as failed
  from lines where len(lw) > 0
), byline as (
  select doc_id, count(*) - count(distinct l) as n_dup_lines, count(*) filter (where failed) as n_lines_removed,
         coalesce(sum(n) filter (where failed), 0)::bigint as lost from facts group by doc_id
)
select *, not base_failed and words_kept >= n_words * {MIN_KEPT} as kept from (
  select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * n_words as base_failed,
    coalesce(n_lines_removed, 0) as n_lines_removed, n_words - coalesce(lost, 0) as words_kept
  from base left join byline using (doc_id) left join rep using (doc_id))
"""


SQL = _sql()
