"""Chat formatting: whole conversations rendered once, encoded once, with a loss mask on what the assistant says.

The template's marks are added tokens, so the encoder never joins a mark and a text in one token. The spans of the assistant's texts
are sorted; a binary search in the sorted token offsets finds the tokens each span covers.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import quoted
from candela.llm.language import small_batches
from candela.llm.packing import public_tokenizer
from candela.llm.registry import query, table

TURN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
ESCAPED = re.compile(r"\\|<(?=/?(?:turn|text)>)")
UNESCAPED = re.compile(r"\\([\\l])")
TURNS = re.compile(f"{TURN}(.*?){TEXT}(.*?){CLOSE}", re.DOTALL)
SCHEMA = "formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    r"""Text in which no template mark can occur: a backslash is doubled, and the ``<`` of a mark becomes ``\l``."""
    return ESCAPED.sub(lambda m: r"\\" if m[0] == "\\" else r"\l", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "<", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation's text from (role, text) in order, and the span of each assistant's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURNS.findall(formatted)]


def loss_mask(starts: list[int], ends: list[int], spans: list[tuple[int, int]]) -> list[bool]:
    """Which tokens lie in a span. Offsets and spans are sorted, so each span's tokens are the ones between two binary searches.
    A character of several bytes may be several tokens with the same offsets."""
    mask = [False] * len(starts)
    for low, high in spans:
        first, last = bisect_left(starts, low), bisect_left(starts, high)
        while first < last and ends[first] <= low:
            first += 1
        mask[first:last] = [True] * (last - first)
    return mask


def masked_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> str:
    """The text under the mask, as it was before escaping: each stretch of masked tokens once, in order."""
    out, k = [], 0
    while k < len(mask):
        if not mask[k]:
            k += 1
            continue
        low = high = starts[k]
        while k < len(mask) and mask[k]:
            high = max(high, ends[k])
            k += 1
        out.append(unescape(formatted[low:high]))
    return "".join(out)


_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer with the template's marks as added tokens; one a Python worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = False
        made.add_special_tokens([AddedToken(t, normalized=False) for t in (TURN, TEXT, CLOSE)])
        _ENCODERS[path] = made
    return _ENCODERS[path]


def _formatted(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
            rows = []
            for (text, spans), code in zip(
                made, coder.encode_batch([t for t, _ in made], add_special_tokens=False), strict=True
            ):
                starts, ends = [list(x) for x in zip(*code.offsets, strict=True)] if code.ids else ([], [])
                rows.append((text, code.ids, starts, ends, loss_mask(starts, ends, spans)))
            out = pd.DataFrame(rows, columns=["formatted", "input_ids", "starts", "ends", "loss_mask"])
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), out], axis=1)

    return run


def format_conversations(
    turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each conversation: ``conv_id``, the ``formatted`` text, its ``input_ids``, each token's ``starts`` and ``ends`` in
    the text, and ``loss_mask``, true on the assistant's texts only.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a defined place and all stay. A null
    text or role counts as empty; rows with a null conversation make one conversation. An empty table gives an empty result. Other
    columns are not used. A conversation is one training example and thus one row here, however long it is.
    """
    small_batches(turns.sparkSession, 256)
    rows = turns.select(
        F.col(quoted(conv)).alias("conv_id"),
        F.struct(
            F.col(quoted(turn)).cast("long").alias("turn"),
            F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"),
            F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = whole.schema["conv_id"].dataType
    named = whole.withColumn("conv_id", F.col("conv_id").cast("string"))  # a null among numbers would make them floats
    made = named.mapInPandas(_formatted(tokenizer), f"conv_id string, {SCHEMA}")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            turns = parse(r.formatted)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = masked_text(r.formatted, list(r.starts), list(r.ends), list(r.loss_mask))
            digests = [sha256(x.encode("utf-8", "replace")).hexdigest() for x in (said, loss)]
            rows.append((r.conv_id, len(turns), digests[0], len(loss), digests[1], len(r.formatted), len(r.input_ids)))
        yield pd.DataFrame(
            rows,
            columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"],
        )


# Turns that hold the template's own marks and other chat formats' marks.
HARD = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@query(
    "op8_chat_formatting",
    r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(text) + 19
  + length(regexp_replace(text, '[^\\]', '', 'g')) + length(regexp_replace(role, '[^\\]', '', 'g'))
  + len(regexp_extract_all(text, '</?(turn|text)>')) + len(regexp_extract_all(role, '</?(turn|text)>')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
)
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD, "conv_id long, turn long, role string, text string")
    made = format_conversations(turns.unionByName(hard), public_tokenizer("byte_bpe_50k.json"))
    return made.mapInPandas(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long",
    ).drop("n_tokens")
