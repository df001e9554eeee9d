"""Personal information: what is found, what is not, and readable results."""

import pytest

from wardloom.llm import pii

NAMES = pii.Names(["Maren", "Zoë", "Ivo", "Halina"], [a + b for a in ("Bost", "Carb", "Elm", "Roth", "Wick", "Zand", "Lond") for b in ("acre", "by", "holm", "ley", "oviç", "sson")] + ["Kovač"])

FOUND = [
    ("Write to maren.carbby+x@post.example.org, please", "EMAIL", "maren.carbby+x@post.example.org"),
    ("at <ivo_b (at) mail[dot]example[dot]net> now", "EMAIL", "ivo_b (at) mail[dot]example[dot]net"),
    ("signs in as imke dot wick+n at office dot example dot net on the portal", "EMAIL", "imke dot wick+n at office dot example dot net"),
    ("reach me at ivo dot k at mail dot example today", "EMAIL", "ivo dot k at mail dot example"),
    ("an a＠example.net weiter", "EMAIL", "a＠example.net"),
    ("Call +61 491 570 156 now", "PHONE", "+61 491 570 156"),
    ("tel. 247-555-0154, ext. 12.", "PHONE", "247-555-0154"),
    ("is +1 (249) 555‑0117.", "PHONE", "+1 (249) 555‑0117"),
    ("We dialled 4485550181 twice", "PHONE", "4485550181"),
    ("by the applicant. Llámame al 2115550100 mañana", "PHONE", "2115550100"),
    ("cite the page. +1 255 555 0168; then", "PHONE", "+1 255 555 0168"),
    ("ruf +49 (0)30 23125 325 an", "PHONE", "+49 (0)30 23125 325"),
    ("SSN 936-25-9105 on file", "ID_NUMBER", "936-25-9105"),
    ("person_id=2 19 13 10 852 649 43;", "ID_NUMBER", "2 19 13 10 852 649 43"),
    ("DNI 12345678-Z.", "ID_NUMBER", "12345678-Z"),
    ("Do not store 22491745-P, that is my national insurance", "ID_NUMBER", "22491745-P"),
    ("-- 22491745-E;", "ID_NUMBER", "22491745-E"),
    ("the card 4111 1111 1111 1111, please", "CARD", "4111 1111 1111 1111"),
    ("to DE89 3704 0044 0532 0130 00 by May", "ACCOUNT", "DE89 3704 0044 0532 0130 00"),
    ("to GB82WEST12345698765432 by May", "ACCOUNT", "GB82WEST12345698765432"),
    ("SSN QQ 53 31 59 B ok", "ID_NUMBER", "QQ 53 31 59 B"),
    ("They moved from 375 East Greystoke Hill Street, Apt 26A to a flat", "STREET_ADDRESS", "375 East Greystoke Hill Street, Apt 26A"),
    ("box to Unit 3, 279-281 Hazelmoor Ave. before noon", "STREET_ADDRESS", "Unit 3, 279-281 Hazelmoor Ave."),
    ("at 330 cinder rd", "STREET_ADDRESS", "330 cinder rd"),
    ("to 51 bis, rue des Alouettes-Grises before noon", "STREET_ADDRESS", "51 bis, rue des Alouettes-Grises"),
    ("in Calle del Olmo Viejo 7, 6º C, then", "STREET_ADDRESS", "Calle del Olmo Viejo 7, 6º C"),
    ("Wohnhaft: Alte Kilnstraße 19;", "STREET_ADDRESS", "Alte Kilnstraße 19"),
    ("Ask Maren S. van der Rothsson about it", "PERSON", "Maren S. van der Rothsson"),
    ("My name is DE CARBBY, Ivo.", "PERSON", "DE CARBBY, Ivo"),
    ("by zoë elmholm at the desk", "PERSON", "zoë elmholm"),
    ("Dr. P. Londley wants", "PERSON", "P. Londley"),
    ("Herr Kamala Wickby-Zandacre hat", "PERSON", "Kamala Wickby-Zandacre"),
]


def test_gates_let_all_shapes_through():
    names = pii.Names(["Maren"], ["O'Wickby", "Großholm"])
    for text, value in (("NIE X-1234567-L noted", "X-1234567-L"), ("Ask Maren O'Wickby about it", "Maren O'Wickby"), ("Ask Maren Großholm about it", "Maren Großholm")):
        assert [text[s.start : s.end] for s in pii.find_spans(text, names)] == [value]


@pytest.mark.parametrize(("text", "kind", "value"), FOUND)
def test_found(text, kind, value):
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text, NAMES)] == [(kind, value)]


@pytest.mark.parametrize(
    "text",
    [
        "Project Carbholm starts in May",
        "The Rothby & Sons contract has 26 pages",
        "Order 3944679779 left the warehouse",
        "Order 0059676088 left the warehouse",
        "Invoice INV-2068-13-8435 is closed",
        "Ratio 804/77/7768 looks wrong",
        "See section 12 Road works and lane closures",
        "Install @legal/kit@4.5.0 first",
        "Ping @legal_bot or write",
        "The date was 2022-09-12",
        "Reference TJ-00001189.",
        "Between 441-774 calls per day",
        "Hash 292477c8680e5f0036cb did not match",
        "we meet at noon, dot it",
        "-- 22491745-P;",
        "see 2 55 08 14 168 025 39 in the table",
        "the card 4111 1111 1111 1112, please",
        "to GB82WEST12345698765431 by May",
        "",
        "   ",
        None,
    ],
)
def test_not_found(text):
    assert pii.find_spans(text, NAMES) == []


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97_key("255081416802538") and not pii.mod97_key("255081416802539")
    assert pii.mod23_letter("12345678", "Z")


def test_a_failing_checksum_needs_company():
    """The validators decide: with them passing the numbers count by themselves, failing only beside other personal information."""
    kinds = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text, NAMES)]
    for good, bad in (("22491745-E", "22491745-P"), ("2 55 08 14 168 025 38", "2 55 08 14 168 025 39")):
        assert kinds(f"about {good} or so") == [("ID_NUMBER", good)] and kinds(f"about {bad} or so") == []
        assert kinds(f"a@b.example | {bad}") == [("EMAIL", "a@b.example"), ("ID_NUMBER", bad)]
        assert kinds(f"{bad} -- +61 491 570 156") == [("ID_NUMBER", bad), ("PHONE", "+61 491 570 156")]
        assert kinds(f"{bad} and a@b.example") == [("EMAIL", "a@b.example")]


def test_names_are_made_of_parts_without_their_product():
    parts = pii.Names([], [a + b for a in ("bost", "carb", "elm", "roth", "wick", "zand") for b in ("acre", "by", "holm", "ley")] + ["lonby", "lonacre", "lonley", "lonholm"])
    assert parts.is_family("bostacre") and parts.is_family("lonby") and not parts.is_family("bost") and not parts.is_family("acre")
    fewer = pii.Names([], [a + b for a in ("bost", "carb", "marl", "roth", "wick", "pell", "gard", "zand") for b in ("acre", "by", "holm", "ley", "son")][:-1])
    assert fewer.is_family("zandson") and "zandson" not in fewer.known
    assert len(fewer.stems) <= len(fewer.known) and len(fewer.ends) <= len(fewer.known)


def test_placeholders_keep_the_rest():
    text = "Maren Carbby (a@b.example) met Maren Carbby at 12 Elm Street."
    assert pii.placeholder_text(text, pii.find_spans(text, NAMES)) == "[PERSON_1] ([EMAIL_1]) met [PERSON_1] at [STREET_ADDRESS_1]."


def test_very_long_text_is_searched_to_its_end():
    text = "no one here. " * 40_000 + "Write to a@b.example"
    assert [text[s.start : s.end] for s in pii.find_spans(text, NAMES)] == ["a@b.example"]


def test_frames(spark):
    df = spark.createDataFrame([(1, "a@b.example and a@b.example", 5), (2, None, 6), (3, "", 7)], "id long, t string, pii_text int")
    rows = {r.id: r for r in pii.find_pii(df, "t", NAMES).collect()}
    assert [x.pii_text for x in rows[1].pii] == ["a@b.example"] * 2 and rows[2].pii == [] and rows[3].pii == []
    out = {r.id: r.redacted for r in pii.redact_pii(df, "t", NAMES).collect()}
    assert out == {1: "[EMAIL_1] and [EMAIL_1]", 2: None, 3: ""}
