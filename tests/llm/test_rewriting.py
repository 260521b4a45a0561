"""Fill in the middle, periodic runs and byte-level coding against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import bpe, fim, runs
from candela.llm.packing import public_tokenizer
from candela.llm.queries import QUERIES

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABETS = ["ab \n", "a\t é中 \r", "x1'.,sl re  \n", "\U0001f600́e '- d", "<|endoftext|> a"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(seed, n=300, most=60):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "a"] + ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(0, most))) for _ in range(n)]


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols, 4)
        for s in range(16):
            assert matrix.rank(s, np.arange(n + 1)).tolist() == [0, *np.cumsum(symbols == s).tolist()]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_unit_ends(unit):
    given = texts(2)
    ends = fim.Boundaries(given, unit)
    for k, t in enumerate(given):
        units = TOKEN.findall(t) if unit == "word" else re.findall(r"[^\n]*\n|[^\n]+", t)
        assert ends.n[k] == len(units)
        sizes = [0, *np.cumsum([len(u) for u in units]).tolist()]
        assert ends.places(np.full(len(sizes), k), np.arange(len(sizes))).tolist() == sizes


def plain_fim(key, text):
    h = [int(sha(f"42:{key}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = TOKEN.findall(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_the_middle(frame, odd_documents):
    given = [*texts(3), "has <P> in it", "ends in <", "<S", "a <S< b >", "<|P>"]
    df = frame([(k, t) for k, t in enumerate(given)], "doc_id long, text string")
    for r in fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_fim(r.doc_id, given[r.doc_id])
        assert r.back == given[r.doc_id]
    odd = odd_documents.withColumn("form", F.lit("clash"))
    found = fim.transform(odd)
    assert found.count() == odd.count() and found.columns.count("form") == 1 and "block" in found.columns
    for r in found.collect():
        assert r.output and r.n == plain_fim("" if r.doc_id is None else r.doc_id, r.text or "")[0] or not r.text
    assert fim.transform(odd.limit(0)).count() == 0


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if end > start and length >= max(6, 4 * q):
                piece = words[start : start + length]
                if all(any(piece[k] != piece[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(4)
    for k in range(1500):
        words = [str(rng.randint(0, rng.choice([0, 1, 2, 9]))) for _ in range(rng.randint(0, 30))]
        while k % 2 and len(words) < 120:
            piece = [str(rng.randint(0, 3)) for _ in range(rng.randint(1, 9))]
            words += piece * rng.randint(1, 7) + piece[: rng.randint(0, len(piece))]
        assert runs.examined(" ".join(words))[1] == plain_runs(words), words


def test_runs_of_long_texts():
    assert runs.examined("a " * 200_000)[1] == [(0, 200_000, 1)]
    phrase = " ".join(f"w{k}" for k in range(1000))
    n, found, kept = runs.examined(f"start {phrase} " + f"{phrase} " * 9 + "end")
    assert (n, found) == (10_002, [(1, 10_000, 1000)]) and kept.decode() == f"start {phrase} end"


def plain_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    milli = 1000 * top[1] // top[2] if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return len(found), *top, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_op12_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices("a b c d e".split(), k=rng.randint(0, 80))) + rng.choice(["", "\n", " x y" * 5])) for k in range(400)]
    rows += [(400, None), (401, ""), (402, " \t "), (403, "a " * 50), (403, "a " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) and {tuple(r) for r in got.collect()} == {(k, *plain_op12(k, t)) for k, t in rows}
    assert got.count() == len(rows)


def test_runs_of_odd_tables(odd_documents):
    odd = odd_documents.withColumn("runs", F.lit("clash"))
    found = runs.with_runs(odd)
    assert found.count() == odd.count() and found.columns.count("runs") == 1
    assert {r.collapsed for r in found.filter("text IS NULL OR trim(text) = ''").collect()} <= {""}
    assert runs.with_runs(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def coder():
    return bpe.Fragments(public_tokenizer("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))


def test_coding_against_the_library(coder, library):
    rng = random.Random(6)
    given = texts(7, 3000) + ["x" * 5000, "中" * 3000, ".'s ,'re !'ll a's 's ''s \"'t", "a\x1cb \x85 c", "<|endoftext|><|endoftext|>x"]
    given += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(32, 64)])) for _ in range(40)) for _ in range(5000)]
    for t in given:
        want = library.encode(t, add_special_tokens=False).ids
        ids = coder.encode(t)
        assert ids.tolist() == want, t
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False), t
    for _ in range(300):
        some = [rng.randint(0, 50256) for _ in range(6)]
        assert coder.decode(some) == library.decode(some, skip_special_tokens=False)


def test_no_token_crosses_a_cut(coder):
    certain = coder.certain.reshape(256, 256)
    assert not any(certain[a, b] for piece in coder.pieces.values() if piece != b"<|endoftext|>" for a, b in zip(piece, piece[1:]))
    assert len(coder.cut("The words of a line, cut apart.")) > 6


def test_quick_merges_need_ranked_ids(coder, library):
    import json

    with open(public_tokenizer("byte_bpe_50k.json"), encoding="utf-8") as file:
        made = json.load(file)
    assert bpe.ranked(made, coder.pieces) and coder.quick is not None
    merges = made["model"]["merges"]
    made["model"]["merges"] = [merges[1], merges[0], *merges[2:]]
    assert not bpe.ranked(made, coder.pieces)
    made["model"]["merges"] = merges[:-1]
    assert not bpe.ranked(made, coder.pieces)
    for k in range(0x250):
        for t in (f"{chr(k)}a", f" {chr(k)}1", f"a {chr(k)}", f"'{chr(k)}'s", f"1{chr(k)}{chr(k)}  "):
            assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_remembered_fragments_are_bounded(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    small = bpe.Fragments(public_tokenizer("byte_bpe_50k.json"))
    for t in texts(8):
        assert small.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    before = len(small.known)
    small.encode("entirely new words every time")
    assert len(small.known) == before and b"<|endoftext|>" in small.known


def test_op13_query(spark, tmp_path, library):
    rows = list(enumerate([*texts(9), "tail <|endoftext|> x", None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in QUERIES["op13_bpe_coding"](spark, str(tmp_path)).collect()} == want


def test_coding_of_odd_tables(odd_documents):
    odd = odd_documents.withColumn("ids", F.lit("clash"))
    path = public_tokenizer("byte_bpe_50k.json")
    found = bpe.coded(odd, path).withColumn("again", bpe.decoded(F.col("ids"), path))
    assert found.count() == odd.count() and found.columns.count("ids") == 1
    assert found.filter("again <> decoded OR decoded <> coalesce(text, '')").count() == 0
    assert bpe.coded(odd.limit(0), path).count() == 0
