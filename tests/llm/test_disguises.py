"""Disguised personal data: mixed digits and spoken signs of four languages."""

import pytest

from vitrina.llm import pii


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("call +49 170 one two three 4567 now", "phone", "+49 170 one two three 4567"),
        ("pay 4539 five seven eight seven 6362 1486 now", "card", "4539 five seven eight seven 6362 1486"),
        ("pay 4539 5787 6362 148 six now", "card", "4539 5787 6362 148 six"),
        ("pay 4539, five seven eight seven, 6362 1486", "card", "4539, five seven eight seven, 6362 1486"),
        ("ruf plus vier neun 170 1234567 an", "phone", "plus vier neun 170 1234567"),
        ("write bob at example.com today", "email", "bob at example.com"),
        ("to john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("to john dot doe@example.com now", "email", "john dot doe@example.com"),
        ("to john.j dot doe at mail.example.com now", "email", "john.j dot doe at mail.example.com"),
        ("an max punkt muster ät beispiel punkt de heute", "email", "max punkt muster ät beispiel punkt de"),
        ("à jean point dupont arobase exemple point fr merci", "email", "jean point dupont arobase exemple point fr"),
        ("a juan punto perez arroba ejemplo punto es hoy", "email", "juan punto perez arroba ejemplo punto es"),
        ("an max [Klammeraffe] beispiel [Punkt] de", "email", "max [Klammeraffe] beispiel [Punkt] de"),
        ("bob(arobase)exemple(point)fr", "email", "bob(arobase)exemple(point)fr"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 192.168 punto 0 punto 1 up", "ip", "192.168 punto 0 punto 1"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192.168.zero.one up", "ip", "192.168.zero.one"),
        ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"),
        ("host 192 (.) 168(.)0(.)1 up", "ip", "192 (.) 168(.)0(.)1"),
        ("to bob[@]example[.]com now", "email", "bob[@]example[.]com"),
        ("write bob at example . com today", "email", "bob at example . com"),
        ("write bob -at- example -dot- com today", "email", "bob -at- example -dot- com"),
        ("write bob_at_example_dot_com today", "email", "bob_at_example_dot_com"),
        ("mail jane \"at\" example \"dot\" org now", "email", "jane \"at\" example \"dot\" org"),
        ("to 𝐛𝐨𝐛@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦 now", "email", "𝐛𝐨𝐛@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦"),
        ("to αnnα@exαmple.com now", "email", "αnnα@exαmple.com"),
        ("call +49 17O l234567 now", "phone", "+49 17O l234567"),
        ("host l92.168.O.1 up", "ip", "l92.168.O.1"),
        ("pay 4539 5787 6362 I486 now", "card", "4539 5787 6362 I486"),
        ("pay 4539.5787.6362.1486 now", "card", "4539.5787.6362.1486"),
        ("pay 4539_5787_6362_1486 now", "card", "4539_5787_6362_1486"),
        ("pay 4539  5787  6362  1486 now", "card", "4539  5787  6362  1486"),
        ("pay 3782.822463.10005 now", "card", "3782.822463.10005"),
    ],
)
def test_disguises_map_back(text, kind, part):
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(k, text[s:e]) for k, s, e in found] == [(kind, part)]
    assert pii.masked(text) == text.replace(part, f"[{kind}]")


def test_prose_stays():
    for text in (
        "Look at example.com for more.", "one of 3 or two of 12", "at 3 point 5 percent", "one plus two is three",
        "He met us at noon.Then we left.", "un deux 3 quatre 5", "Der Punkt ist klar. Le point est clair.",
        "file created_at_load.csv and updated_at_2020.log", "a polka-dot-dress at home", "about 1.234.567.890.123 and 4539.5787.6362.1487",
        "in 1990 I saw 20 Oo", "see [.] or (.) and [@] alone", "Look at home . we left", "She ate at home . de la", "Look at example . com for more",
    ):
        assert pii.masked(text) == text
    assert pii.masked("appelez +33 6 12 34 56 78 un jour") == "appelez [phone] un jour"


def test_time_is_linear():
    for part in ("a dot ", "one ", "1.", "1 dot ", "a at ", "one 2 ", "a.", "@ ", "O", "1O ", "1O.", "[.]", "_at_a", "-dot-", "4539.", "'at' a "):
        pii.disguised_spans(part * 60_000, [])
