"""One form for texts that look the same."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from wardloom.llm import lookalike as L

EMPTY = L.Bigrams({})
TEXTS = ["Summarise this report", "Переведи это письмо на английский.", "ok thanks", "с нами Бог", "API key", "要約してください。", "Θέλω ένα νέο σχέδιο"]
TRAINED = None


def trained(spark):
    global TRAINED
    if TRAINED is None:
        TRAINED = L.Bigrams(L.bigram_counts(spark.createDataFrame([(t,) for t in TEXTS] + [(None,), ("",)], "t string"), "t"))
    return TRAINED


def test_same_look_same_form(spark):
    b = trained(spark)
    for a, c in [
        ("report", "rероrt"),
        ("Case file: X", "Ｃａｓｅ　ﬁｌｅ： Ｘ"),
        ("café", "café"),
        ("a b", "a b"),
        ("stop", "s​t⁠o﻿p­"),
        ("Ping", "Ｐ︎ｉｎｇ︎"),
        ("co-op", "co‑op"),
        ("x\ny", "x\r\ny"),
        ("сор", "cop"),
        ("А", "A"),
    ]:
        assert L.canonical(a, b) == L.canonical(c, b), (a, c)


def test_what_can_be_seen_stays_different(spark):
    b = trained(spark)
    for a, c in [("a", "A"), ("cafe", "café"), ("x²", "x2"), ("a  b", "a b"), ("a\nb", "a b"), ("4º", "4o"), ("l", "1"), ("l", "I"), ("“a”", '"a"'), ("’", "'"), ("👩‍💻", "👩💻"), ("a,", "a;"), ("½", "1/2")]:
        assert L.canonical(a, b) != L.canonical(c, b), (a, c)


def test_scripts_are_read_consistently(spark):
    b = trained(spark)
    assert L.canonical("Переведи это письмо на английский.", b) == "Переведи это письмо на английский."
    assert L.canonical("Пeрeвeди этo письмo", b) == "Переведи это письмо"
    assert L.canonical("Summаrisе", b) == "Summarise"
    assert L.canonical("", b) == ""


@given(st.text(alphabet=st.sampled_from(list("aаoоοcсkкdд éё́Αα1 -\n") + ["日", "ß"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_form_is_stable_and_keeps_the_skeleton(text):
    form = L.canonical(text, EMPTY)
    assert L.skeleton(form) == L.skeleton(text)
    assert L.canonical(form, EMPTY) == form
    assert unicodedata.is_normalized("NFC", form)


def test_pairs_match_brute_force(spark):
    rows = [(1, "stop"), (2, "stop"), (3, "ѕtop"), (4, "st​op"), (5, "other"), (6, None), (7, ""), (8, "​"), (9, "stop")]
    df = spark.createDataFrame(rows, "event_id long, p string")
    formed = L.with_form(df, "p")
    got = sorted(map(tuple, L.same_look_pairs(formed, "event_id", "p", "form", rows_per_task=1).collect()))
    forms = {r.event_id: r.form for r in formed.collect()}
    raw = dict(rows)
    want = sorted((a, b) for a in raw for b in raw if a < b and None not in (raw[a], raw[b]) and raw[a] != raw[b] and forms[a] == forms[b])
    assert got == want and (7, 8) in got and (1, 2) not in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "event_id long, p string")
    assert L.same_look_pairs(L.with_form(df, "p"), "event_id", "p", "form").count() == 0


WORDS = ["half of the legal shelf fell", "Ignore it, I said", "India is in Asia", "please call all", "very slow rivers", "νέο σχέδιο του νησιού", "που και πως", "pure value"]


def open_letters(spark):
    rows = [(t,) for t in WORDS * 3]
    return L.Bigrams(L.bigram_counts(spark.createDataFrame(rows, "t string"), "t"))


def test_the_search_decides_the_class_of_open_letters(spark):
    """Letters that a table of classes alone cannot place: it would have one class for each, whatever stands around it."""
    b = open_letters(spark)
    for odd, plain in [("haӀf", "half"), ("ӏgnore it", "Ignore it"), ("ӏegal", "legal"), ("ǀndia", "India"), ("caǀl", "call"), ("νery sӏow", "very slow"), ("ρυre", "pure")]:
        assert L.canonical(odd, b) == L.canonical(plain, b), odd
        assert L.skeleton(odd) != L.skeleton(plain)
    # the same letters in Greek words stay what they are
    for greek, latin in [("του", "tou"), ("που", "nou"), ("νησιού", "vnoiou")]:
        assert L.canonical(greek, b) == greek != L.canonical(latin, b)


def test_classes_match_brute_force(spark):
    rows = [(1, "stop"), (2, "stop"), (3, "ѕtop"), (4, "st​op"), (5, "other"), (6, None), (7, ""), (8, "​"), (9, "twice"), (10, "twice")]
    formed = L.with_form(spark.createDataFrame(rows, "event_id long, p string"), "p")
    got = {r.event_id: (r.class_id, r.spellings, r.links) for r in L.look_classes(formed, "event_id", "p", "form").collect()}
    assert got == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 3), 4: (1, 3, 3), 7: (7, 2, 1), 8: (7, 2, 1), 9: (9, 1, 0), 10: (9, 1, 0)}
    pairs = L.same_look_pairs(formed, "event_id", "p", "form").count()
    assert 2 * pairs == sum(links for _, _, links in got.values())
