"""Language-model scores, chat formatting, packing, mixing and the whole pipeline."""

import json
import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from math import ceil, floor, log
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from candela.llm import chat, lm_score, mixing, packing


def test_lm_score_against_plain_python(frame, odd_documents):
    target = ["the cat sat", "the cat ran", None]
    background = ["the dog sat on the mat", "a dog ran", "", "the mat"]
    both = [frame([(t,) for t in side], "text string") for side in (target, background)]
    model = lm_score.fit(*both, word_share=0.0, pair_share=0.0)

    def kept(side):
        return [t.split() for t in side if t]

    words = sorted(w for w in {w for s in (target, background) for t in kept(s) for w in t} if max(sum(t.count(w) for t in kept(s)) for s in (target, background)) >= 2)
    assert model.words == words
    pairs = [Counter(p for t in kept(s) for p in zip(["^", *t], t)) for s in (target, background)]

    def loss(text, side):
        texts = kept((target, background)[side])
        name = lambda w: w if w in words else "?"
        ones = Counter(name(w) for t in texts for w in t)
        twos = [Counter((name(a), name(b)) for (a, b), n in pairs[k].items() for _ in range(n)) for k in (0, 1)]
        usual = {p for p in {*twos[0], *twos[1]} if max(twos[0][p], twos[1][p]) >= 2}
        first = Counter()
        for p in usual:
            first[p[0]] += twos[side][p]
        now, total = [name(w) for w in text.split()], 0.0
        for a, b in zip(["?", *now], now):
            alone = (ones[b] + 1) / (sum(ones.values()) + len(words) + 1)
            seen = twos[side][(a, b)] if (a, b) in usual else 0
            total -= log((seen + lm_score.PRIOR * alone) / (first[a] + lm_score.PRIOR))
        return total / len(now)

    for text in ("the cat sat", "the dog sat on a mat", "other", "the the the"):
        n, t, b = model.losses(text)
        assert (n, t, b) == (len(text.split()), pytest.approx(loss(text, 0)), pytest.approx(loss(text, 1)))
    assert model.losses(None) == model.losses(" ") == (0, 0.0, 0.0)
    scored = lm_score.score(odd_documents, model)
    assert scored.count() == odd_documents.count() and scored.columns.count("score") == 1
    empty = lm_score.fit(both[0].filter("false"), both[1].filter("false"))
    assert lm_score.score(both[0], empty).filter("isnan(score) OR score <> 0").count() == 0


@pytest.mark.parametrize("share", [1e-5, 0.1, 2.0])
def test_lm_score_uses_every_word(frame, odd_documents, share):
    target = ["the cat sat", "The cat ran", None]
    background = ["the dog sat on the mat", "a dog ran", "", "the mat \u00dcber", "a dog ran"]
    asked = [*background, "the cat sat", "once here", "the the the", " "]
    kept = [[(t or "").lower().split() for t in side] for side in (target, background)]
    ones = [Counter(w for t in side for w in t) for side in kept]
    twos = [Counter(p for t in side for p in zip(["^", *t], t)) for side in kept]
    n_words = len({*ones[0], *ones[1]})

    def loss(words, side):
        total = 0.0
        for a, b in zip(["^", *words], words):
            alone = (ones[side][b] + 1) / (sum(ones[side].values()) + n_words + 1)
            first = sum(n for (x, _), n in twos[side].items() if x == a)
            total -= log((twos[side][(a, b)] + lm_score.PRIOR * alone) / (first + lm_score.PRIOR))
        return total / len(words) if words else 0.0

    tables = [frame([(t,) for t in side], "text string") for side in (target, background)]
    docs = frame(list(enumerate(asked)), "k long, text string")
    for scored, texts in ((lm_score.score_against(docs, *tables, share=share), asked), (lm_score.score_against(tables[1], *tables, share=share), background)):
        got = sorted((r.text, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in scored.collect())
        for text, row in zip(sorted(texts), got, strict=True):
            words = text.lower().split()
            t, b = loss(words, 0), loss(words, 1)
            assert row == (text, len(words), pytest.approx(t), pytest.approx(b), pytest.approx(t - b))
    odd = lm_score.score_against(odd_documents, *tables, share=share)
    assert odd.count() == odd_documents.count() and odd.columns.count("score") == 1
    assert odd.filter("text IS NULL AND n_tokens = 0 AND score = 0").count() == 1
    assert lm_score.score_against(docs.filter("false"), *tables).count() == 0


@pytest.mark.parametrize("at_once", [1, 40, 10_000])
def test_lm_score_in_blocks_and_parts(frame, at_once):
    chance = random.Random(5)
    made = lambda n, words: [" ".join(chance.choice(words) for _ in range(chance.randint(0, 9))) for _ in range(n)]
    target, background = made(15, "abcd"), [*made(40, "cdefghij"), *["c d \U0001f600 e"] * 20]
    tables = [frame([(t,) for t in side], "text string") for side in (target, background)]
    ones = [Counter(w for t in side for w in t.split()) for side in (target, background)]
    twos = [Counter(p for t in side for p in zip(["^", *t.split()], t.split())) for side in (target, background)]
    firsts = [Counter({a: sum(n for (x, _), n in side.items() if x == a) for a, _ in side}) for side in twos]
    n_words = len({*ones[0], *ones[1]})

    def loss(words, k):
        alone = lambda b: (ones[k][b] + 1) / (ones[k].total() + n_words + 1)
        given = [(twos[k][a, b] + lm_score.PRIOR * alone(b)) / (firsts[k][a] + lm_score.PRIOR) for a, b in zip(["^", *words], words)]
        return -sum(map(log, given)) / len(given) if given else 0.0

    asked = ["a b new", *background, ""]
    cases = [(frame([(t,) for t in asked], "text string"), asked), (tables[1], background), (tables[0], target)]
    for docs, texts in cases:
        got = sorted(tuple(r) for r in lm_score.score_against(docs, *tables, at_once=at_once).collect())
        for text, row in zip(sorted(texts), got, strict=True):
            t, b = (loss(text.split(), k) for k in (0, 1))
            assert row == (text, len(text.split()), pytest.approx(t), pytest.approx(b), pytest.approx(t - b))


def test_lm_columns_round_trip():
    for n in (0, 1, 300):
        hashes = np.sort(np.random.default_rng(n).integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        counts = np.arange(n, dtype=np.int64) * -3
        back = lm_score.opened(lm_score.squeezed(lm_score.steps(hashes), counts), 2)
        assert (np.cumsum(back[0].view(np.uint64), dtype=np.uint64) == hashes).all() and (back[1] == counts).all()


SHUFFLING = """
import random

from candela.llm import lm_score
from candela.session import local_session

chance = random.Random(3)
spark = local_session("4", 4, "candela-shuffle-test")
rows = [(k, " ".join(f"w{chance.randrange(5000)}" for _ in range(1000))) for k in range(300)]
texts = spark.createDataFrame(rows, "k long, text string")
assert len(lm_score.score_against(texts, texts.filter("k < 3"), texts).collect()) == 300
spark.stop()
"""


def test_lm_score_shuffles_few_bytes_a_word(tmp_path):
    """Nearly all bigrams differ, as most do in a large corpus; what goes to disk must still be small beside the text."""
    conf = {
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{tmp_path}", "spark.eventLog.compress": "false",
        "spark.eventLog.rolling.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.ui.enabled": "false",
    }
    args = " ".join(f"--conf {k}={v}" for k, v in conf.items())
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"} | {"PYSPARK_SUBMIT_ARGS": f"{args} pyspark-shell"}
    env["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parents[2]), env.get("PYTHONPATH", "")])
    subprocess.run([sys.executable, "-c", SHUFFLING], env=env, check=True, timeout=300)
    written = 0
    for log in tmp_path.iterdir():
        for line in log.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd":
                written += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    assert 0 < written < 20 * 300_000


def test_lm_vocabulary_is_bounded(frame):
    texts = frame([(" ".join(f"w{k % 7}" for k in range(50)) + f" rare{j}",) for j in range(20)], "text string")
    assert lm_score.fit(texts, texts, word_share=0.05).words == [f"w{k}" for k in range(7)]


HARD = ["", "\\", "\\l", "<turn>", "</turn>", "<text>x</turn>\\<turn>", "a\n\n b\n", "  ", "\U0001f600é<", "\\\\l<text>"]


def test_chat_escapes_are_reversible():
    for text in HARD:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(mark in chat.escape(text) for mark in (chat.TURN, chat.TEXT, chat.CLOSE))


def test_chat_round_trip_and_mask(frame):
    chance, rows, want = random.Random(2), [], defaultdict(list)
    for conv in (None, -3, 2**60 + 1, 5):
        for turn in range(6):
            role, text = chance.choice(("user", "assistant", "system", "<turn>")), chance.choice(HARD) + chance.choice(HARD)
            rows.append((conv, turn, role, text, "x"))
            want[conv].append((role, text))
    rows += [(9, 0, "assistant", None, None), (9, None, None, "first", None), (9, 0, "assistant", None, None)]
    want[9] = [("", "first"), ("assistant", ""), ("assistant", "")]
    turns = frame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(turns, packing.public_tokenizer("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in made.collect()}
    assert got.keys() == want.keys()
    coder = chat.encoder(packing.public_tokenizer("byte_bpe_50k.json"))
    for conv, r in got.items():
        assert chat.parse(r.formatted) == want[conv]
        assert coder.decode(r.input_ids, skip_special_tokens=False) == r.formatted
        said = "".join(t for role, t in want[conv] if role == "assistant")
        assert chat.masked_text(r.formatted, r.starts, r.ends, r.loss_mask) == said
        inside = [i for i, m in zip(r.input_ids, r.loss_mask) if m]
        assert chat.unescape(coder.decode(inside)) == said
    assert chat.format_conversations(turns.filter("false"), packing.public_tokenizer("byte_bpe_50k.json")).count() == 0


def plain_ids(text):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    return [*coder.encode(text or "", add_special_tokens=False).ids, 1]


ODD_TEXTS = [
    "A\x1cb c\x85d", "", None, "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "I'm DON'T 12 34 µªº ß × İ é ǅ",
    "日本語 　 テスト ①", "end.. !! a,b c$$$ ***", "ΟΣ Σ",
]


def test_word_ids_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    coder = packing.WordIds(packing.public_tokenizer("word_bpe_49k.json"))
    for texts in (ODD_TEXTS, ODD_TEXTS[::-1]):
        for text, ids in zip(texts, coder.encode([t or "" for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids(text)[:-1]
    assert len(coder.words) <= 60


def plain_best_fit(lengths, size, most):
    bins, out, n = [], [], 0
    for need in lengths:
        fits = [b for b in bins if b[0] >= need]
        if fits:
            b = min(fits, key=lambda b: b[0])
            # Among equally full sequences the one filled last is taken.
            b = [x for x in bins if x[0] == b[0]][-1]
            bins.remove(b)
        else:
            b, n = [size, n], n + 1
        out.append((b[1], size - b[0]))
        b[0] -= need
        if b[0]:
            bins.append(b)
            if len(bins) > most:
                least = min(x[0] for x in bins)
                bins.remove([x for x in bins if x[0] == least][-1])
    return out


def test_best_fit_against_plain_lists():
    chance = random.Random(6)
    for _ in range(60):
        size, most = chance.choice((1, 7, 40)), chance.choice((1, 3, 50))
        lengths = [chance.randint(1, size) for _ in range(chance.randint(0, 80))]
        assert packing.best_fit(lengths, size, most) == plain_best_fit(lengths, size, most)


def check_packing(rows, texts, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = Counter()
    for doc_id, text in texts:
        ids = plain_ids(text)
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want[(doc_id, k // size, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
        assert sum(r.length for r in found) <= size
    return len(by_sequence)


def test_packing_documents(frame):
    texts = [(k, " ".join(["word"] * (k * 3 % 50))) for k in range(60)] + [(70 + k, t) for k, t in enumerate(ODD_TEXTS)]
    texts += [(None, "none"), (2**60 + 1, "big"), (5, "again"), (5, "again")]
    docs = frame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, piece string, length int")
    tokenizer = packing.public_tokenizer("word_bpe_49k.json")
    for per_group in (10_000, 15):
        rows = packing.pack_documents(docs, tokenizer, size=32, per_group=per_group).collect()
        n = check_packing(rows, texts, 32)
        assert n <= sum(r.length for r in rows) / 32 * 1.1 + 1 + len(texts) / per_group
    assert packing.pack_documents(docs.filter("false"), tokenizer).count() == 0


def test_packing_in_stored_order(spark, frame, tmp_path):
    texts = [(k, " ".join(["word"] * (k * 7 % 40))) for k in range(80)]
    docs = frame(texts, "doc_id long, text string")
    docs.orderBy("doc_id").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    tokenizer = packing.public_tokenizer("word_bpe_49k.json")
    rows = packing.pack_in_order(stored, tokenizer, size=64, per_group=10).collect()
    check_packing(rows, texts, 64)
    groups = {r.doc_id: r.sequence_id >> 32 for r in rows}
    assert [groups[k] for k in sorted(groups)] == sorted(groups.values()) and len(set(groups.values())) >= 8
    check_packing(packing.pack_in_order(docs, tokenizer, size=64).collect(), texts, 64)


def test_schedule_is_pfair(frame):
    chance = random.Random(8)
    for n in (1, 2, 7, 40):
        weights = frame([(f"s{k}" if k else None, chance.random() ** 3 + 0.001) for k in range(n)], "source string, weight double")
        parts, cycle = mixing.shares(weights, 60)
        shares = {r.source: r.parts for r in parts.collect()}
        assert cycle == max(60, 2 * n) and sum(shares.values()) == cycle and min(shares.values()) >= 1
        plan = sorted((r["at"], r.source, r.turn) for r in mixing.schedule(parts, cycle).collect())
        assert [at for at, _, _ in plan] == list(range(cycle))
        done = Counter()
        for at, source, turn in plan:
            w = shares[source] / cycle
            assert turn == done[source] and floor(turn / w + 1e-9) <= at < ceil((turn + 1) / w - 1e-9)
            done[source] += 1
            assert all(abs(done[s] - shares[s] / cycle * (at + 1)) < 1 for s in shares)


def test_mix_keeps_all_rows_and_shares(frame, odd_documents):
    rows = [(k, "abc"[min(2, k % 7)], str(k)) for k in range(3000)]
    docs = frame(rows, "doc_id long, source string, position string")
    mixed = mixing.mix(docs, mixing.target_weights(docs, power=1.0), block=4, cycle=50).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(3000))
    assert len({r.position for r in mixed}) == 3000
    mixed.sort(key=lambda r: r.position)
    parts = {r.source: r.parts for r in mixing.shares(mixing.target_weights(docs, power=1.0), 50)[0].collect()}
    assert all(abs(parts[s] / 50 - n / 3000) < 3 / 50 for s, n in Counter(s for _, s, _ in rows).items())
    done = Counter()
    for k, r in enumerate(mixed[:2000], 1):
        done[r.source] += 1
        if k % 4 == 0:
            assert all(abs(done[s] / 4 - parts[s] / 50 * k / 4) < 1 for s in parts)
        assert r.release <= r.slot < r.deadline
    odd = mixing.mix(odd_documents, mixing.target_weights(odd_documents), ties=["text"])
    assert odd.count() == odd_documents.count() and odd.columns.count("block") == 1
    assert mixing.mix(docs.filter("false"), mixing.target_weights(docs)).count() == 0
    assert mixing.mix(docs.filter("false"), mixing.target_weights(docs.filter("false"))).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        mixing.mix(docs, mixing.target_weights(docs.filter("source = 'a'"))).count()


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "mixing", "packing"]


def test_pipeline_against_stages_by_hand(spark, small):
    from candela.llm import jaccard_join, language, toxicity
    from tests.llm.test_joins import brute_groups

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = toxicity.fit_on_learned_part(docs, labels)
    rows = [r for r in docs.collect() if not toxic.score(r.text)[0] >= toxic.threshold]
    clean = spark.createDataFrame(rows, docs.schema)
    tongue = language.fit_on_learned_part(clean)
    rows = [r for r in rows if not tongue.classify(r.text)[3]]
    firsts = {c for _, _, c in brute_groups([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in firsts]
    packed = corpus_pipeline.run(spark, small).collect()
    n = check_packing(packed, [(r.doc_id, r.text) for r in rows], packing.LENGTH)
    assert len(rows) > 100 and n <= sum(r.length for r in packed) / packing.LENGTH * 1.1 + 1
    assert jaccard_join.NEEDED * 100 == 80 * jaccard_join.OF


def test_stages_take_odd_and_empty_tables(spark, small, odd_documents):
    for docs in (odd_documents, odd_documents.filter("false")):
        names, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == names
            if name == "mixing":
                assert out.count() == before
