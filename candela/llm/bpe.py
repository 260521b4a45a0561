"""Byte-level BPE: encode and decode whole texts, cut first where no token can cross.

Two bytes that stand side by side inside no token of the vocabulary part every encoding, so a text may be cut between them. Fragments
between such cuts are short and come again and again; each is encoded once a worker, alone, and a text's ids are those of its fragments,
joined. Of these cuts, only those are used that leave the tokenizer's own pre-splitting as it is (``Fragments``).
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import ROW, packed, quoted, unpacked
from candela.llm.packing import public_tokenizer
from candela.llm.registry import query, table

KNOWN = 400_000  # fragments a worker remembers
LONGEST = 48  # bytes of a fragment that is remembered
CUT = b"\xff"  # a byte that no UTF-8 text holds
OLD = "\u024f"  # last character of the blocks whose letters, digits and white space are the same in all versions of Unicode
# The byte-level pre-splitter's pattern, fixed by the format: contractions, words, numbers, marks, white space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "ids array<int>, decoded string"
RESULTS = ["ids", "decoded"]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on in turn."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(made: dict, pieces: dict[int, bytes]) -> bool:
    """Whether ids rank the merges: bytes come first, then one token a merge, in the merges' order, of two tokens before it.

    Then merging by ids is the same as merging by pairs: when a token's turn comes, what lies between its ends was merged as in that
    token alone, so it is its own pair.
    """
    model = made["model"]
    if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    ids, whole = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made_ids = [(ids[a], ids[b], ids[a + b]) for a, b in whole]
    turns = [t for _, _, t in made_ids]
    single = sorted(i for i, piece in pieces.items() if len(piece) == 1)
    longer = {i for i, piece in pieces.items() if len(piece) > 1}
    added = {t["id"] for t in made["added_tokens"]}
    return (
        len(single) == 256 and turns == sorted(set(turns)) and longer - added == set(turns) - added
        and single[-1] < turns[0] and all(max(a, b) < t for a, b, t in made_ids)
    )


class Fragments:
    """A byte-level tokenizer file with its table of certain cuts, and what its fragments became.

    The pre-splitter parts letters, digits, marks and white space, takes one space before a word with it, and knows contractions. A cut
    behind a visible ASCII byte moves none of its splits, but for an apostrophe behind a mark, which must stay with it: alone, it might
    open a contraction. Cuts behind white space could change which space goes with the next word, so they aren't used.

    A short new fragment is merged by ``quick`` if the file's ids rank its merges (``ranked``) and its characters are of blocks that no
    version of Unicode changes; all others go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or made["normalizer"]:
            raise ValueError("needs a byte-level tokenizer without normaliser or prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_letters()
        self.pieces = {i: bytes(letters[c] for c in t) for t, i in made["model"]["vocab"].items()}
        self.quick = None
        if ranked(made, self.pieces):
            listed = {t["id"] for t in made["added_tokens"]}
            ranks = {piece: i for i, piece in self.pieces.items() if i not in listed}
            self.quick = tiktoken.Encoding("fragments", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), dtype=bool)
        for piece in self.pieces.values():
            pairs = np.frombuffer(piece, dtype=np.uint8)
            inside[pairs[:-1], pairs[1:]] = True
        visible = np.array([0x21 <= b <= 0x7E for b in range(256)])
        plain = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
        self.certain = ~inside & visible[:, None]
        self.certain[~plain, ord("'")] = False
        self.certain = self.certain.ravel()
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        lengths = np.zeros(max(self.pieces) + 2, dtype=np.int64)  # the last one stands for ids beyond the vocabulary
        for i, piece in self.pieces.items():
            lengths[i] = len(piece)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.pieces[i] for i in sorted(self.pieces)), dtype=np.uint8)
        names = sorted(self.added, key=len, reverse=True)
        self.parted = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.known: dict[bytes, bytes] = {t.encode(): np.array([i], "<i4").tobytes() for t, i in self.added.items()}
        self.fixed = len(self.known)

    def cut(self, text: str) -> list[bytes]:
        """The fragments of a text; strings of added tokens stand alone."""
        parts = self.parted.split(text) if self.parted and any(t in text for t in self.added) else [text]
        out = []
        for k, part in enumerate(parts):
            raw = part.encode()
            if k % 2 or len(raw) < 2:
                out += [raw] * (len(raw) > 0)
                continue
            data = np.frombuffer(raw, dtype=np.uint8)
            at = np.flatnonzero(self.certain[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]) + 1
            out += np.insert(data, at, CUT[0]).tobytes().split(CUT)
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        parts = self.cut(text)
        known = self.known
        found = list(map(known.get, parts))
        if None in found:
            new = [f for f in dict.fromkeys(parts) if f not in known]  # a difference with the dict's keys would walk all of them
            self.learn(new)
            found = list(map(known.__getitem__, parts))
            full = len(known) > KNOWN + self.fixed
            for fragment in new:
                if full or len(fragment) > LONGEST:
                    del known[fragment]
        return np.frombuffer(b"".join(found), dtype="<i4")

    def learn(self, new: list[bytes]) -> None:
        """Encode fragments and remember them."""
        slow = []
        for fragment in new:
            if self.quick and len(fragment) <= LONGEST and max(body := fragment.decode()) <= OLD:
                self.known[fragment] = array("i", self.quick.encode_ordinary(body)).tobytes()
            else:
                slow.append(fragment)
        for k in range(0, len(slow), 4096):
            some = slow[k : k + 4096]
            made = self.tokenizer.encode_batch_fast([f.decode() for f in some], add_special_tokens=False)
            self.known.update((f, array("i", e.ids).tobytes()) for f, e in zip(some, made, strict=True))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that make no character become U+FFFD, ids beyond the vocabulary nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        none = len(self.lengths) - 1
        ids = np.where((ids < 0) | (ids > none), none, ids)
        n = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(n) - n)  # from a byte's place in the text to its place in the table
        return self.bytes[np.repeat(shift, n) + np.arange(n.sum())].tobytes().decode("utf-8", "replace")


_FRAGMENTS: dict[str, Fragments] = {}


def fragments(path: str) -> Fragments:
    """One coder a Python worker, kept between its tasks."""
    if path not in _FRAGMENTS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _FRAGMENTS[path] = Fragments(path)
    return _FRAGMENTS[path]


def ids_array(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, "<i4")])))


def coded(docs: DataFrame, tokenizer: str, text: str = "text", results: list[str] = RESULTS) -> DataFrame:
    """Every row with the ``ids`` of its whole text and, from these ids alone, the text ``decoded`` again.

    Null and empty texts have no ids and decode to an empty text; strings of added tokens become their ids, as the tokenizer has it;
    repeated rows give the same each; an empty table gives an empty result. A text is worked on alone, with some 100 bytes a byte of
    it; a stretch without a certain cut, such as one word of a million letters, is one fragment and isn't remembered. ``results`` renames
    the two; input columns named like a result are replaced by it, all others are kept.
    """

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = fragments(tokenizer)
        for bodies in batches:
            found = [coder.encode(body.as_py()) for body in bodies]
            yield pa.StructArray.from_arrays([ids_array(found), pa.array(map(coder.decode, found), pa.string())], names=RESULTS)

    rows = packed(docs, run(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("found"))
    return unpacked(rows.select(ROW, *[F.col(f"found.{c}").alias(n) for c, n in zip(RESULTS, results, strict=True)]), docs.columns, results)


def decoded(ids: Column, tokenizer: str) -> Column:
    """The text of an array of ids; null for null, nothing for null ids."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = fragments(tokenizer)
        for rows in batches:
            yield pa.array([None if r is None else coder.decode([i for i in r if i is not None]) for r in rows.to_pylist()], pa.string())

    return run(ids)


@query("op13_bpe_coding")
def op13_bpe_coding(spark: SparkSession, folder: str) -> DataFrame:
    made = coded(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizer("byte_bpe_50k.json"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.btrim(F.to_json("ids"), F.lit("[]")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
