"""Subjects of documents: held-out documents with known sentences."""

import random

import numpy as np

from wardloom.llm import topics


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    subjects = ["law", "sport", "cooking", "science"]
    terms = {s: topics.INSPECTED_TERMS[s].split()[:15] + [f"{s}{chr(97 + i)}" for i in range(12)] for s in subjects}
    rows, truth = [], {}
    for doc in range(n):
        mix = rng.sample(subjects, rng.choice([0, 1, 1, 2]))
        sentences = []
        for s in mix:
            for _ in range(rng.randint(4, 6)):
                sentences.append("The {} that had the {} with the {} was in it.".format(*rng.sample(terms[s], 3)))
        other = rng.choice([s for s in subjects if s not in mix])
        sentences += ["More details will follow later.", "Please see the note below."][: rng.randint(0, 2)]
        if len(mix) == 2:
            sentences.append("The {} and the {} of it.".format(*rng.sample(terms[other], 2)))
        rng.shuffle(sentences)
        rows.append((doc, " ".join(sentences)))
        truth[doc] = set(mix)
    return rows, truth, subjects


def test_subjects_of_whole_documents(spark):
    rows, truth, subjects = corpus()
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (1003, rows[0][1]), (1004, "?! ... 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = topics.vocabulary(df, "text")
    assert "the" not in words and "lawa" in words
    bags = topics.word_ids(df, "doc_id", "text", list(words))
    model = topics.fit(bags, "doc_id", words, subjects)
    assert set(model.subjects) == {*subjects, None}
    got = {}
    for r in topics.assign(bags, "doc_id", model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    wrong = sum(got.get(d, set()) != t for d, t in truth.items())
    assert wrong <= 0.02 * len(truth)
    assert got.get(1003) == got.get(0) and not {1000, 1001, 1002, 1004} & set(got)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    words = topics.vocabulary(df, "text")
    bags = topics.word_ids(df, "doc_id", "text", list(words))
    assert words == {} and topics.assign(bags, "doc_id", topics.fit(bags, "doc_id", words, ["law"])).count() == 0


def test_terms_only_name_the_topics_that_the_documents_give(spark, monkeypatch):
    """No term enters the fit, and the terms alone find nothing: without a fit every topic is the language's mean."""
    rows, truth, subjects = corpus(seed=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = topics.vocabulary(df, "text")
    bags = topics.word_ids(df, "doc_id", "text", list(words))
    model = topics.fit(bags, "doc_id", words, subjects)
    # words that no table has lead topics too
    named = {s: terms for s, terms in zip(model.subjects, topics.top_terms(model, 60), strict=True) if s}
    assert set(named) == set(subjects) and all(sum(f"{s}{chr(97 + i)}" in named[s] for i in range(12)) >= 6 for s in subjects)
    flat = topics.Model(model.words, np.repeat(model.phi.mean(axis=1, keepdims=True), model.phi.shape[1], axis=1), [*subjects, None] + [None] * (len(model.subjects) - 5), model.settings, model.spoken)
    found = {(r.doc_id, r.subject) for r in topics.assign(bags, "doc_id", flat).collect()}
    right = {(d, s) for d, of in truth.items() for s in of}
    assert len(found & right) < 0.5 * len(right) or len(found) > 1.5 * len(right)
    monkeypatch.setattr(topics, "INSPECTED_TERMS", {})
    again = topics.fit(bags, "doc_id", words, subjects)
    assert np.allclose(again.phi, model.phi, rtol=1e-4) and set(again.subjects) == {None}
    assert topics.assign(bags, "doc_id", again).count() == 0


def test_vocabulary_is_bounded_by_shares(spark):
    rows = [(i, f"the and of it word{i % 7}x {'rare' if i == 3 else 'often' if i % 2 else ''} {chr(97 + i % 26) * 9}") for i in range(4000)]
    df = spark.createDataFrame([(i, t.replace(f"word{i % 7}x", "abcdefg"[i % 7] * 5)) for i, t in rows], "doc_id long, text string")
    words = topics.vocabulary(df, "text")
    assert "rare" not in words and "often" not in words and "aaaaa" in words and words["aaaaa"][0] == 572 and sum(words["aaaaa"][1:]) == 0


def test_sentences_end_where_they_did(spark):
    texts = ["One two. Three? four!five\n\nsix . . seven", "\n\n.", "...", "a.b c. ", "x" * 10 + "\r\ny", None, "1 2 3. word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = sorted({w for t in texts if t for w in topics._WORD(t.lower())})
    got = {r.doc_id: r.tokens for r in topics.word_ids(df, "doc_id", "text", words).collect()}
    import re

    for i, t in enumerate(texts):
        want = []
        for s in re.split(r"(?<=[.!?…。])\s+|[\r\n]+", (t or "").lower()):
            if found := topics._WORD(s):
                want += [words.index(w) for w in found] + [topics.STOP]
        assert got[i] == want, t
