"""Chat formatting at token level: encode segments on their own, splice reserved ids, mask by prefix sums.

Each turn's role and text are escaped and encoded as ordinary text, so nothing in them can become a
reserved id. Then the turns of a conversation are put in order and spliced:

    BEGIN  (TURN role TEXT text END)*

with ids past the vocabulary for the markers. The loss mask is +1 where an assistant text starts and -1
behind its end, summed up. Escaping puts one backslash behind the first character of each control string
(and one more where backslashes stand there already), which unescaping takes away again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bpe import Decoder, Encoder, Vocabulary, load_vocabulary
from keyloom.llm.common import read_table

BEGIN, TURN, TEXT, END = "<|begin|>", "<|turn|>", "<|text|>", "<|end|>"
MARKERS = (BEGIN, TURN, TEXT, END)
#: Control strings that are escaped in roles and texts: the markers above and those of common templates.
CONTROL = (*MARKERS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")

_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m.group()[:-1], text)


@dataclass(frozen=True)
class Template:
    vocabulary: Vocabulary
    learnt_role: str = "assistant"

    @property
    def reserved(self) -> dict[str, int]:
        return {m: len(self.vocabulary.tokens) + i for i, m in enumerate(MARKERS)}


def _encode_turns(vocabulary):
    def run(batches):
        encoder = Encoder(vocabulary.value, specials=False)
        for b in batches:
            conv, turn, role, text = (b.column(i) for i in range(4))
            for at in range(0, b.num_rows, 512):
                cut = [c.slice(at, 512) for c in (conv, turn, role, text)]
                roles, texts = ([escape(x or "") for x in c.to_pylist()] for c in cut[2:])
                ids = encoder.encode_many(roles + texts)
                raw = [x.astype("<i4").tobytes() for x in ids]
                n = len(roles)
                yield pa.RecordBatch.from_arrays([cut[0], cut[1], cut[2], pa.array(raw[:n], pa.binary()), pa.array(raw[n:], pa.binary())], ["conv", "turn", "role", "role_ids", "text_ids"])

    return run


def _assemble(template):
    def run(batches):
        t = template.value
        r, decoder, none = t.reserved, Decoder(t.vocabulary), object()
        key, turns = none, []

        def row():
            parts, at, learn, spans = [[r[BEGIN]]], 1, [], 0
            for role, role_ids, text_ids in turns:
                for part in ([r[TURN]], role_ids, [r[TEXT]], text_ids, [r[END]]):
                    if part is text_ids and role == t.learnt_role:
                        learn += [(at, 1), (at + len(part), -1)]
                        spans += 1
                    parts.append(part)
                    at += len(part)
            ids = np.concatenate([np.asarray(p, dtype=np.int32) for p in parts])
            steps = np.zeros(at + 1, dtype=np.int32)
            for i, d in learn:
                steps[i] += d
            mask = np.cumsum(steps)[:-1].astype(np.int8)
            return key, ids, mask, render(ids, t, decoder)

        def flush(rows):
            ends = np.concatenate([[0], np.cumsum([len(x[1]) for x in rows])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k] for x in rows]), kind)) for k, kind in ((1, pa.int32()), (2, pa.int8()))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), *lists, pa.array([x[3] for x in rows], pa.string())], ["conv", "ids", "loss_mask", "formatted"])

        rows, size = [], 0
        for b in batches:
            for conv, role, role_ids, text_ids in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if conv != key or key is none:
                    if key is not none:
                        rows.append(row())
                        size += len(rows[-1][1])
                        if size > 1 << 19:
                            yield flush(rows)
                            rows, size = [], 0
                    key, turns = conv, []
                turns.append((role, np.frombuffer(role_ids, dtype="<i4"), np.frombuffer(text_ids, dtype="<i4")))
        if key is not none:
            rows.append(row())
        if rows:
            yield flush(rows)

    return run


def render(ids: np.ndarray, template: Template, decoder: Decoder) -> str:
    """The formatted text: markers as their strings, everything between decoded."""
    names = {i: m for m, i in template.reserved.items()}
    at = np.flatnonzero(ids >= len(template.vocabulary.tokens))
    out, last = [], 0
    for i in at.tolist():
        out.append(decoder.decode(ids[last:i].astype(np.int64)))
        out.append(names[int(ids[i])])
        last = i + 1
    out.append(decoder.decode(ids[last:].astype(np.int64)))
    return "".join(out)


def read_back(ids: np.ndarray, mask: np.ndarray, template: Template, decoder: Decoder) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns as (role, text), and the texts under the mask, from the ids and mask of a conversation."""
    r, turns, learnt = template.reserved, [], []
    starts, middles, ends = (np.flatnonzero(ids == r[m]).tolist() for m in (TURN, TEXT, END))
    for s, m, e in zip(starts, middles, ends):
        text = unescape(decoder.decode(ids[m + 1 : e].astype(np.int64)))
        turns.append((unescape(decoder.decode(ids[s + 1 : m].astype(np.int64))), text))
        under = ids[m + 1 : e][mask[m + 1 : e] == 1]
        if len(under):
            learnt.append(unescape(decoder.decode(under.astype(np.int64))))
    return turns, learnt


def format_conversations(turns: DataFrame, template: Template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_col, ids, loss_mask (1 for tokens of assistant texts), formatted.

    Turns go in order of turn_col, nulls first, ties by role and then by the bytes of the text's ids; repeated rows are turns of
    their own. Null roles and texts count as empty. Rows with a null conversation make up one
    conversation with a null id. Other columns are ignored. An empty table gives an empty table. Turns
    are encoded where they lie; only ids are shuffled, and a task holds one conversation at a time.
    """
    sc = turns.sparkSession.sparkContext
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(_encode_turns(sc.broadcast(template.vocabulary)), "conv long, turn long, role string, role_ids binary, text_ids binary")
    dealt = coded.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text_ids")
    out = dealt.mapInArrow(_assemble(sc.broadcast(template)), "conv long, ids array<int>, loss_mask array<tinyint>, formatted string")
    return out.withColumnRenamed("conv", conv_col)


def _digests(template):
    def run(batches):
        t = template.value
        decoder = Decoder(t.vocabulary)
        for b in batches:
            rows = []
            for ids, mask, chars in zip(b.column("ids"), b.column("loss_mask"), b.column("formatted")):
                turns, learnt = read_back(np.asarray(ids.values), np.asarray(mask.values), t, decoder)
                whole, under = hashlib.sha256(), "".join(learnt)
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                rows.append((len(turns), whole.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(chars.as_py())))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    template = Template(load_vocabulary())
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_conversations(turns, template)
    shared = spark.sparkContext.broadcast(template)
    return out.mapInArrow(_digests(shared), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql() -> str:
    # An escaped text is longer by one character for each control string in it.
    alternatives = "|".join("".join(f"\\{x}" if x in "[]|\\<>/" else x for x in c[:1]) + r"\\*" + "".join(f"\\{x}" if x in "[]|\\" else x for x in c[1:]) for c in CONTROL).replace("\\<", "<").replace("'", "''")
    marks = sum(map(len, (TURN, TEXT, END)))
    return rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, {marks} + length(role) + length(text) + len(regexp_extract_all(role, '{alternatives}')) + len(regexp_extract_all(text, '{alternatives}')) as chars from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  ({len(BEGIN)} + sum(chars))::bigint as formatted_chars
from e group by conv_id
"""


SQL = _sql()
