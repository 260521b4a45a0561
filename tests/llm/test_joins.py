"""Fingerprints and near-duplicate groups against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candela.llm import hashing, jaccard_join, simhash
from candela.llm.queries import QUERIES


def words_of(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    for space in "\t\n\x0b\x0c\r":
        low = low.replace(space, " ")
    return [w for w in low.split(" ") if w]


def shingles_of(text, k=5):
    words = words_of(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_hashes_tell_words_and_shingles_apart():
    texts = ["a b c", "A\x0bb  c\n", "", "x", "a b", "ab", "a b c d e f", "é É", "a b c d e"]
    words, at = hashing.word_hashes(texts)
    spelled = [w for t in texts for w in words_of(t)]
    assert len(words) == len(spelled) and len(set(zip(spelled, words.tolist()))) == len(set(spelled)) == len(set(words.tolist()))
    shingles, first = hashing.shingle_hashes(words, at, 5)
    want = [s for t in texts for s in ([tuple(words_of(t)[i : i + 5]) for i in range(max(1, len(words_of(t)) - 4))] if words_of(t) else [])]
    assert len(shingles) == len(want) and len(set(want)) == len(set(shingles.tolist()))
    assert np.diff(first).tolist() == [1, 1, 0, 1, 1, 1, 2, 1, 1]


def test_fingerprint_votes():
    def plain(text):
        words, _ = hashing.word_hashes([text])
        terms, _ = hashing.shingle_hashes(words, np.array([0, len(words)]), simhash.TERM_WORDS)
        votes = [0] * 128
        for term, weight in Counter(terms.tolist()).items():
            term = np.array([term], dtype=np.uint64)
            both = np.append(term, hashing.mixed(term ^ simhash.SECOND)).view(np.uint8)
            for k, bit in enumerate(np.unpackbits(both)):
                votes[k] += weight if bit else -weight
        return np.packbits(np.array(votes) > 0).tobytes().hex()

    texts = ["", "one", "one two", "one two one two one three", "a b c d e f g " * 9, "ü \U0001f600 x y"]
    assert simhash.fingerprints(texts) == [plain(t) for t in texts]
    assert simhash.fingerprints([None, ""]) == ["0" * 32] * 2 and simhash.fingerprints([]) == []


def test_near_pairs_against_brute_force(frame):
    chance = random.Random(5)
    prints = []
    for _ in range(12):
        base = chance.getrandbits(128)
        for _ in range(8):
            prints.append(base ^ sum(1 << chance.randrange(128) for _ in range(chance.choice((0, 1, 2, 4, 7)))))
    rows = [(k, f"{p:032x}") for k, p in enumerate(prints)] + [(900, None), (901, None)]
    docs = frame(rows, "doc_id long, fingerprint string")
    known = sorted({p for _, p in rows if p})
    for radius in (0, 3, 6):
        want = {
            (a, b, d)
            for i, a in enumerate(known)
            for b in known[i + 1 :]
            if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius
        }
        assert {tuple(r) for r in simhash.near_pairs(docs, radius).collect()} == want
        asked = {p for k, p in rows if p and k % 50 == 0}
        got = simhash.near_pairs(docs, radius, F.col("doc_id") % 50 == 0)
        assert {tuple(r) for r in got.collect()} == {x for x in want if x[0] in asked or x[1] in asked}
    assert simhash.near_pairs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        simhash.near_pairs(docs, 40)


def test_fingerprint_column(odd_documents):
    got = simhash.with_fingerprint(odd_documents)
    assert got.count() == odd_documents.count() and got.columns.count("fingerprint") == 1
    for r in got.collect():
        assert r.fingerprint == simhash.fingerprints([r.text])[0]


def test_edited_texts(spark, small):
    got = {r.doc_id: r for r in QUERIES["op4_document_fingerprints"](spark, small).collect()}
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        text, after, r = text or "", docs[(k + 1) % len(docs)].text or "", got[doc_id]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == simhash.fingerprints([text, edited])
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.2 > np.mean([r.near_next for r in got.values()])


def test_next_rows_over_stretches(frame, monkeypatch):
    monkeypatch.setattr(simhash, "NEIGHBOURS", 3)
    ids = sorted({random.Random(1).randrange(10**6) for _ in range(20)} | {-5, 10**12})
    docs = frame([(k, f"t{k}") for k in ids], "k long, text string")
    got = simhash.with_next(docs, "k", ["text"], lambda d: d.withColumn("size", F.length("text")), ["size"])
    want = {(a, f"t{a}", f"t{b}", len(f"t{b}")) for a, b in zip(ids, ids[1:] + ids[:1])}
    assert {(r.k, r.text, r.next_text, r.next_size) for r in got.collect()} == want
    one = simhash.with_next(docs.filter("k = -5"), "k", ["text"], lambda d: d, [])
    assert [(r.k, r.next_text) for r in one.collect()] == [(-5, "t-5")]
    assert simhash.with_next(docs.filter("false"), "k", ["text"], lambda d: d, []).count() == 0


def brute_groups(rows):
    sets = [shingles_of(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                above[root(i)] = root(j)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[root(k)] = min(key, least.get(root(k), key))
    return Counter((key, len(sets[k]), least.get(root(k))) for k, (key, _) in enumerate(rows))


def made_texts(chance, groups=8, copies=14):
    rows, key = [], 0
    for g in range(groups):
        base = [f"w{chance.randrange(400)}" for _ in range(chance.choice((3, 5, 9, 40, 120)))]
        shared = [f"p{k}" for k in range(30)]
        for _ in range(copies):
            text = list(base)
            for _ in range(chance.choice((0, 0, 1, 1, 2, 3, 5))):
                text[chance.randrange(len(text))] = f"e{chance.randrange(1000)}"
            rows.append((key, " ".join(text + (shared if g % 2 else []))))
            key += 1
    return rows


@pytest.mark.parametrize("blocks", [500, 6])
def test_groups_against_brute_force(frame, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", blocks)
    rows = made_texts(random.Random(blocks))
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (None, "all alone here"), (3, rows[3][1]), (3, "other text"), (503, "A"), (504, "a")]
    got = jaccard_join.near_groups(frame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows)


@pytest.mark.parametrize("longest", [2, 3])
def test_common_shingles_against_brute_force(frame, monkeypatch, longest):
    monkeypatch.setattr(jaccard_join, "LONGEST_RUN", longest)
    rows = made_texts(random.Random(21), 6, 20)
    rows += [(1000 + k, t) for k, t in rows[::3]]
    got = jaccard_join.near_groups(frame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_long_runs_keep_one_order(size):
    # Shingle 1: nodes 0 to 6, twice each; 2: two nodes; 3: one node in many copies; 4: seven nodes.
    rows = [(1, k // 2) for k in range(14)] + [(2, 5), (2, 9)] + [(3, 4)] * 9 + [(4, k) for k in range(7)]
    table = pa.table({"shingle": [s for s, _ in rows], "node": [n for _, n in rows], "n": pa.array([10] * len(rows), pa.int32())})
    for longest in (3, 7, 100):
        found = pa.Table.from_batches(jaccard_join._shared(iter(table.to_batches(size)), longest)).to_pylist()
        held = {1: min(7, longest), 2: 2, 4: min(7, longest)}
        want = [(s, n, held[s]) for s, n in sorted(set(rows)) if s in held]
        assert [(r["shingle"], r["node"], r["held"]) for r in found] == want
    # Six shared shingles of six are a prefix of two; three of ten come after seven of the node's own, which fill it.
    one = pa.table({"shingle": list(range(9)), "node": [7] * 6 + [8] * 3, "n": pa.array([6] * 6 + [10] * 3, pa.int32())})
    found = pa.Table.from_batches(jaccard_join._prefixes(iter(one.to_batches(size))))
    assert found.to_pylist() == [{"shingle": 0, "node": 7}, {"shingle": 1, "node": 7}]


@pytest.mark.parametrize("small,sent", [(150, False), (10**6, True)])
def test_copied_rows_decide_the_broadcast(frame, monkeypatch, small, sent):
    calls, usual = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: calls.append(df) or usual(df))
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = made_texts(random.Random(4))
    got = jaccard_join.near_groups(frame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows)
    assert len(rows) < 150 and bool(calls) == sent


def test_groups_of_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op6_jaccard_join"](spark, small).collect()
    assert Counter(tuple(r) for r in got) == brute_groups([tuple(r) for r in docs])


def test_one_of_each(frame, odd_documents):
    rows = made_texts(random.Random(9), 4, 8)
    kept = jaccard_join.one_of_each(frame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_groups(rows)})
    odd = jaccard_join.one_of_each(odd_documents)
    assert odd.columns == odd_documents.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    assert ids == [(False, k) for k in (1, 2, 3, 4, 5, 6, 7)]
    assert jaccard_join.one_of_each(odd_documents.filter("false")).count() == 0
    nameless = frame([(None, "same text here"), (None, "same text here"), (None, None)], "doc_id long, text string")
    assert jaccard_join.one_of_each(nameless).count() == 2


def test_tree_keeps_every_link():
    chance = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = chance.integers(0, 2**63, size=int(chance.integers(1, 200))).astype(np.uint64)
        for _ in range(int(chance.integers(1, 9))):
            other = base.copy()
            n = int(chance.integers(0, max(1, len(base) // 6)))
            other[chance.integers(0, len(base), n)] = chance.integers(0, 2**63, n).astype(np.uint64)
            sets.append(np.unique(other))
    tree = {(min(x, y), max(x, y)) for _, x, y in jaccard_join.CountTree(sets, classes=32, leaf=4).pairs()}
    links = {(x, y) for y in range(len(sets)) for x in range(y) if jaccard_join.linked(sets[x], sets[y])}
    assert links and links <= tree and len(tree) < len(sets) * (len(sets) - 1) / 4
