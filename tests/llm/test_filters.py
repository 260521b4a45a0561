"""URL rules, quality rules, language and toxicity on small tables."""

import pytest

from candela.llm import language, quality, toxicity, url_filter
from candela.llm.toxicity import FuzzyTrie


def test_url_parts_and_rules(frame, rows_of):
    urls = [
        "HTTP://WWW.Example.NET/en/1?x#y", "http://net/", "http://a.net", "http://b.org/fr/x", "http://b.org?/fr/", "no-scheme.net/",
        None, "", "x://y.example.com:80/de/", "http://xnet/", "http://example.com/de/?q", "http://a.b.c.net/x://y.org/",
        "http://ÄÖ.net/Ä",
    ]
    pages = frame([(k, u, "old", "old") for k, u in enumerate(urls)] + [(0, urls[0], None, None)], "page_id long, url string, rule string, extra string")
    rules = frame(
        [*url_filter.RULE_LIST, (None, "/", "block"), ("", "", "block"), ("org", None, None), ("org", "/fr/", "allow")], url_filter.RULES
    )
    judged = url_filter.judge(pages, rules)
    assert judged.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    got = {r[0]: r[1:] for r in rows_of(judged, "page_id", "host", "path", "rule", "verdict")}
    assert judged.count() == len(urls) + 1
    assert got == {
        0: ("www.example.net", "/en/1", "example.net/en/", "allow"), 1: ("net", "/", "net/", "block"), 2: ("a.net", "", None, "allow"),
        3: ("b.org", "/fr/x", "org/fr/", "allow"), 4: ("b.org", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("y.example.com:80", "/de/", None, "allow"), 9: ("xnet", "/", None, "allow"),
        10: ("example.com", "/de/", "example.com/de/", "block"), 11: ("a.b.c.net", "/x://y.org/", "net/", "block"),
        12: ("ÄÖ.net", "/Ä", "net/", "block"),
    }


def test_url_rule_precedence_and_partial_folders(frame, rows_of):
    rules = frame(
        [("net", "/a/b", "allow"), ("b.net", "/a", "block"), ("net", "/same", "allow"), ("net", "/same", "block"), ("net", "", "block")],
        url_filter.RULES,
    )
    pages = frame([(1, "s://x.b.net/a/bc"), (2, "s://c.net/same/x"), (3, "s://c.net"), (4, "s://c.org")], "page_id long, url string")
    got = rows_of(url_filter.judge(pages, rules, default="block"), "page_id", "rule", "verdict")
    assert got == [(1, "b.net/a", "block"), (2, "net/same", "block"), (3, "net", "block"), (4, None, "block")]
    none = url_filter.judge(pages, rules.filter("false"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_filter.judge(pages.filter("false"), rules).count() == 0


def test_quality_counts_against_plain_python(odd_documents, rows_of, frame):
    import re

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        places = {}
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k : k + 8]), []).append(k)
        again = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(again)

    extra = frame(
        [(8, "a b c d e f g h " * 2 + "x", None, None, None), (9, "one\none\n\n \none ", None, None, None), (10, "a " * 30, None, None, None)],
        "doc_id long, text string, lang string, source string, score string",
    )
    docs = odd_documents.select(*extra.columns).unionByName(extra)
    got = quality.judge(docs)
    assert got.count() == docs.count()
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == plain(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(odd_documents).columns[:4] == ["doc_id", "text", "lang", "source"]
    assert quality.judge(docs.filter("false")).count() == 0


def test_quality_lines(frame):
    good = "This is a line of plain prose that says something and ends well."
    bad = ["Home | About | Contact", "Copyright 2020 by us. All rights reserved.", "short fragment", "a### b*** c$$$ d%%%."]
    docs = frame([(1, "\n".join([good, good.upper(), *bad])), (2, "\n".join([*bad * 5, good]))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[1].clean_text == f"{good}\n{good.upper()}" and got[1].kept
    assert got[2].clean_text == good and not got[2].kept


SPEECH = {
    "en": "the house and the garden were quiet when they came home that evening with their friends ",
    "de": "das haus und der garten waren still als sie an jenem abend mit ihren freunden heimkamen ",
    "fr": "la maison et le jardin \u00e9taient calmes quand ils sont rentr\u00e9s ce soir avec leurs amis ",
}


def test_language(frame, odd_documents):
    texts = [(k, SPEECH[lang] * 3, lang) for k in range(20) for lang in SPEECH]
    docs = frame(texts, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert sorted(model.texts) == sorted(SPEECH)
    for lang, text in SPEECH.items():
        assert model.classify(text)[0] == lang and model.classify(text.upper() + " 42 !!")[0] == lang
    assert model.classify(None)[0] == model.classify("12 ?!")[0] == "und"
    assert model.classify(SPEECH["en"] + SPEECH["fr"])[1] < model.classify(SPEECH["en"] * 2)[1]
    judged = language.identify(odd_documents, model)
    assert judged.count() == odd_documents.count() and judged.columns.count("score") == 1
    assert language.identify(docs.filter("false"), model).count() == 0
    nothing = language.fit(docs.filter("false"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.fit(docs, max_languages=2)


def test_language_held_out(spark, small):
    import os

    from candela.llm.queries import QUERIES

    folder = os.path.join(os.path.dirname(small), "sf0.01")
    got = QUERIES["op3_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id").toPandas()
    assert got.count() == docs.count() and (held.lang == held.lang_pred).mean() > 0.95
    assert got.filter("score < 0 OR score > 1").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_trie_is_edit_distance_one():
    import random

    lexicon = {w: 1.0 for w in ("idiot", "moron", "trash", "scum", "pathetic")}
    trie, chance = FuzzyTrie(lexicon, {"achlich": 1.0}), random.Random(3)
    words = {"idiot", "idot", "idioot", "xdiot", "idiots", "scu", "scums", "trsh", "moronn", "achlichen", "achlic", "", "a"}
    for w in lexicon:
        for _ in range(300):
            letters = list(w)
            for _ in range(chance.choice((1, 1, 2))):
                at = chance.randrange(len(letters) + 1)
                letters[at : at + chance.choice((0, 1))] = chance.choice(["", "e", "o", "t"])
            words.add("".join(letters))
    for w in words:
        found = trie.find(w)
        near = [t for t in lexicon if distance(w, t) <= (1 if len(t) >= 5 else 0)]
        if w.startswith("achlich"):
            assert found == ("achlich", 0)
        else:
            assert (found is not None) == bool(near), w
            assert found is None or found[1] == distance(w, found[0])


def test_toxicity_context_and_odd_rows(odd_documents):
    model = toxicity.ToxicityModel({"idiot": 1.0, "moron": 1.0}, {}, frozenset({"moton"}), (-2.0, 4.0, 0.0, 0.0))
    plain, quote = model.score("you are an idiot, a real idiot")[0], model.score('she said "idiot" and he wrote "idiot" too')[0]
    assert plain > 0.9 > 0.5 > quote
    assert model.score("what an idot")[0] > 0.3 > model.score("what a moton")[0]
    assert model.score(None) == model.score("") and model.score("")[1] == 0
    judged = toxicity.judge(odd_documents, model)
    assert judged.count() == odd_documents.count() and judged.columns.count("rejected") == 1
    assert toxicity.judge(odd_documents.filter("false"), model).count() == 0


def test_toxicity_without_labels(frame):
    docs = frame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = frame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert not model.words and {r.rejected for r in toxicity.judge(docs, model).collect()} == {False}


def test_toxicity_learns_rare_and_short_terms(frame):
    # 60 terms in 10 of 600 toxic texts each, which is less than 2 % of them; one of them has three letters.
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = ["zug"] + [f"q{letters[k // 26]}{letters[k % 26]}xvw" for k in range(59)]
    rows = [(k, f"plain words here and {terms[k % 60]} again", 1) for k in range(600)]
    rows += [(1000 + k, "plain words here and nothing else again", 0) for k in range(2400)]
    docs = frame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    missed = [t for t in terms if model.find(t) is None]
    assert missed == [] and "zug" in model.words and model.find("plain") is None


def test_toxicity_keeps_all_ordinary_words(frame):
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = [f"{letters[k] * 2}{letters[::-1] * 2}" for k in range(8)]
    near = sorted({t[:k] + c + t[k + cut :] for t in terms for k in range(len(t)) for c in letters for cut in (0, 1)} - set(terms))
    rows = [(k, f"plain words {terms[k % 8]}", 1) for k in range(160)]
    rows += [(1000 + k, " ".join(near[k::400]), 0) for k in range(400)]
    docs = frame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    assert set(terms) <= set(model.words) and len(near) > 20_000 and set(near) <= model.ordinary


def test_toxicity_held_out(spark, small):
    import os

    from candela.llm.queries import QUERIES

    folder = os.path.join(os.path.dirname(small), "sf0.1")
    got = QUERIES["op7_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").toPandas()
    right = held[(held.toxic == 1) & (held.predicted == 1)]
    assert len(right) / held.predicted.sum() > 0.85 and len(right) / held.toxic.sum() > 0.85
