"""SQL of the text problems that SQL can express over whole tables: look-alike pairs and edited copies by brute force.

The SQL has no search and no signatures: texts are brought to their letter classes by one ``translate``, and
all texts that share a three-word sequence are compared.
"""

from __future__ import annotations

import unicodedata

from wardloom.llm.lookalike import skeleton

#: Blocks whose letters, blanks and signs the SQL brings to one form: Latin to Greek extended, punctuation, symbols, CJK punctuation, presentation and wide forms.
BLOCKS = (range(0x80, 0x600), range(0x115F, 0x1161), range(0x17B4, 0x17B6), range(0x180B, 0x1810), range(0x1E00, 0x2100), range(0x2160, 0x2180), range(0x3000, 0x3001), range(0x3164, 0x3165), range(0xFB00, 0xFB07), range(0xFE00, 0xFE10), range(0xFEFF, 0xFF00), range(0xFF01, 0xFF5F))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(value: str) -> str:
    """A text's letter classes in SQL: composed, line ends as one, unseen signs gone, wide and look-alike letters plain."""
    single, gone, longer = {}, "", {}
    for block in BLOCKS:
        for code in block:
            c = chr(code)
            plain = unicodedata.normalize("NFC", skeleton(c))
            if plain == "":
                gone += c
            elif plain != unicodedata.normalize("NFC", c):
                (single if len(plain) == 1 else longer)[c] = plain
    out = f"replace(nfc_normalize({value}), chr(13) || chr(10), chr(10))"
    # a joiner between pictographs can be seen; it is held by a private sign meanwhile, every second one at a time
    pictograph = "[\u2190-\u2bff\U0001f000-\U0001faff]"
    for _ in range(2):
        out = f"regexp_replace({out}, '({pictograph}[\ufe00-\ufe0f\U0001f3fb-\U0001f3ff]*)\u200d({pictograph})', '\\1\ue000\\2', 'g')"
    out = f"translate({out}, {_quoted(''.join(single) + gone)}, {_quoted(''.join(single.values()))})"
    for c, plain in longer.items():
        out = f"replace({out}, {_quoted(c)}, {_quoted(plain)})"
    return f"replace(nfc_normalize(regexp_replace({out}, '[\\x00-\\x08\\x0e-\\x1f\\x7f]', '', 'g')), '\ue000', '\u200d')"


_PROMPTS = f"(select event_id, text, {form_sql('text')} as form from (select event_id, any_value(input_prompt) as text from audit_events group by event_id) where text is not null)"

SQL = {
    "p4_found": f"""
with p as materialized {_PROMPTS}
select a.event_id as event_id_a, b.event_id as event_id_b from p a join p b on a.form = b.form and a.event_id < b.event_id where a.text <> b.text""",
    "p4_classes": f"""
with p as materialized {_PROMPTS},
c as (select form, min(event_id) as class_id, count(distinct text) as spellings, count(*) as n from p group by form having count(*) > 1),
s as (select form, text, count(*) as same from p group by 1, 2)
select event_id, class_id, spellings, n - same as links from p join c using (form) join s using (form, text)""",
    "p6_found": f"""
with p as materialized {_PROMPTS},
w as (select event_id, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') as words from p),
g as materialized (select event_id, unnest(list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)])) as gram from w where len(words) >= 40),
n as (select event_id, count(*) as size from g group by event_id),
b as (select x.event_id as a, y.event_id as b, count(*) as common from g x join g y on x.gram = y.gram and x.event_id < y.event_id group by 1, 2)
select a as event_id_a, b as event_id_b from b join n s on s.event_id = a join n t on t.event_id = b where common >= 0.6 * (s.size + t.size - common) - 1e-9""",
}
