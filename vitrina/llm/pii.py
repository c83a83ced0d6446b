"""Personal data with offset-preserving deobfuscation.

Plain detectors find e-mail addresses, IPv4 addresses, card numbers and phone numbers. For disguised
ones a chain of transducers rewrites a text (look-alike characters, spelled digits, "at" and "dot")
and keeps for every character of the result the span of the source it came from; the same detectors
run on the result and what they find is mapped back to source characters. A mapped span counts when
a rewrite took part in it and no plain span of its kind contains it (one that holds a plain number
must add two rewritten digits to it); plain spans always stay.

Offsets are code points, ends exclusive. NULL and empty texts have no spans. Texts are searched
whole, in time linear in their length. Repeated rows give equal spans; other columns pass through
(a column named like the output is replaced).
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import short_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An address matches from the start of its digit run or not at all, so later starts need no look.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost addresses: from each "@" back over the local part, at most to the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (domain := DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                found.append(("email", start, done))
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans of all kinds, by start and then kind."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters that look like ASCII ones (Cyrillic and Greek), and characters that do not show.
LOOK_ALIKE = str.maketrans(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαειικνρτυχωη",
    "ABESIJKMHOPCTXYaesijopcyxdqwABEZHIKMNOPTYXoaeiikvptuxwn",
)
HIDDEN = "­​‌‍⁠﻿"
# Spaces and dashes that stand for the plain ones.
PLAIN_MARKS = {**dict.fromkeys("\u00a0\u2007\u2009\u202f", " "), **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-")}
# Digits as they are spelled in English, German, French and Spanish.
SPELLED = {
    "0": "zero oh null zéro cero",
    "1": "one eins un uno",
    "2": "two zwei deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
DIGIT_OF = {word: digit for digit, words in SPELLED.items() for word in words.split()}
_digit = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_open, _close = r"[\[({<]", r"[\])}>]"
# The sign and the dot as they are spoken in the same languages.
_at = "at|ät|aet|arroba|arobase|klammeraffe"
_dot = "dot|punkt|point|punto"
# Fixed value: words before "at" that make "at example.com" a place.
PLACE = frozenset(
    "look looks looked looking is are was were be been him her it them us me you available found sold more visit site page here "
    "there shop store online see read and or work works worked working meet job jobs start starts".split()
)

LOOKS = re.compile(f"[{''.join(map(chr, LOOK_ALIKE))}{HIDDEN}{''.join(PLAIN_MARKS)}\uff01-\uff5e\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\U0001d400-\U0001d7ff]")
# A run of spelled digits and numerals, of any length; it counts when a word is among them. The detectors decide.
_unit = rf"(?:plus|{_digit}|[0-9]++)(?!\w)"
DIGITS = re.compile(rf"(?<!\w){_unit}(?:[ ,.()-]{{1,3}}{_unit})*+", re.IGNORECASE)
WORD = re.compile("[a-z]", re.IGNORECASE)
ONE_DIGIT = re.compile(_unit, re.IGNORECASE)
MARKED = re.compile(
    rf" ?{_open} ?(?:({_at}|@)|(?:{_dot}|\.)) ?{_close} ?|(&#64;|&#x40;|&commat;)|&#46;|&#x2e;|&period;", re.IGNORECASE
)
# "at" and "dot" between equal marks; the sign needs such a dot behind it, since names in code hold "_at_".
_mark = r"""["'*~_-]"""
WRAPPED = re.compile(
    rf""" ?({_mark})(?:(?:{_at})\1 ?(?=[A-Za-z0-9-]+? ?({_mark})(?:{_dot})\2 ?[A-Za-z])|({_dot})\1 ?(?=[A-Za-z]))""", re.IGNORECASE
)
# Letters that stand for digits in a run with more digits than these, and cards grouped by other separators.
DIGIT_LETTERS = str.maketrans("OoIl", "0011")
LOOKED_RUN = re.compile(r"(?<![\w.])\+?[0-9OoIl]++(?:[ .()-]{1,2}[0-9OoIl]++)*+(?![\w])")
GROUPED = re.compile(r"(?<![\w.])[0-9]{4}(?:([._/]| {2,3})(?:[0-9]{4}\1){2}[0-9]{4}(?:\1[0-9]{3})?|([._/]| {2,3})[0-9]{6}\2[0-9]{5})(?![\w])")
GROUP_END = re.compile(r"[._/]| {2,3}")
# What a dot with space around it has to stand before where the sign is spoken, since sentences end so too.
_endings = "com|org|net|edu|gov|info|io|eu"
_loose = rf" \. ?(?=(?-i:{_endings})(?!\w))"
_dotted = rf"[A-Za-z0-9-]+(?: (?:{_dot}) [A-Za-z]| ?\.(?-i:[a-z]{{2}})|{_loose})"
SPOKEN = re.compile(rf"(?<=[\w.+-]) (?:{_at}) (?={_dotted})", re.IGNORECASE)
_label = "[A-Za-z0-9_%+-]++"
_heads = "".join(f"(?<!{w} )" for w in _dot.split("|"))  # a row of labels is read from its first one only
SPOKEN_LOCAL = re.compile(
    rf"(?<![\w.%+-]){_heads}{_label}(?:\.{_label})*+(?:(?: (?:{_dot}) |\.){_label})++(?= ?@| (?:{_at}) {_dotted})", re.IGNORECASE
)
SPOKEN_IP = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:(?: (?:{_dot}) |\.)[0-9]{{1,3}}){{3}}(?!\w)", re.IGNORECASE)
INNER_DOT = re.compile(rf" (?:{_dot}) ", re.IGNORECASE)
LABEL = re.compile(r"[A-Za-z0-9-]+")
SPOKEN_DOT = re.compile(rf" (?:{_dot}) (?=[A-Za-z])", re.IGNORECASE)
SPACED = re.compile(rf"(?<=[\w+-])(?: @ ?|@ )(?=[A-Za-z0-9-]+(?: \. ?|\. ?| (?:{_dot}) )[A-Za-z]{{2}})", re.IGNORECASE)
SIGN = re.compile("@")
LOOSE_DOT = re.compile(_loose)
SPACED_DOT = re.compile(r" \. ?(?=[a-z])|\. (?=[a-z])")


class Tracked:
    """A text with the source span of each of its characters, and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts, self.ends = array("l", range(len(text))), array("l", range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ordered, disjoint spans; each new character stands for its whole span."""
        if not edits:
            return
        pieces, starts, ends, changed, done = [], array("l"), array("l"), bytearray(), 0
        for start, end, new in edits:
            pieces += self.text[done:start], new
            starts += self.starts[done:start]
            ends += self.ends[done:start]
            changed += self.changed[done:start]
            starts.extend([self.starts[start]] * len(new))
            ends.extend([self.ends[end - 1]] * len(new))
            changed += b"\1" * len(new)
            if not new and changed:  # what vanishes belongs to the character before it
                ends[-1], changed[-1] = self.ends[end - 1], 1
            done = end
        self.text = "".join([*pieces, self.text[done:]])
        self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]
        self.changed = changed + self.changed[done:]


def _plain_looks(c: str) -> str:
    if c in HIDDEN or c in PLAIN_MARKS:
        return PLAIN_MARKS.get(c, "")
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    if ord(c) in LOOK_ALIKE:
        return c.translate(LOOK_ALIKE)
    if ord(c) >= 0x1D400:  # mathematical letters and digits
        return unicodedata.normalize("NFKC", c).translate(LOOK_ALIKE)
    return str(unicodedata.digit(c))


def _plain_digits(run: re.Match) -> list[tuple[int, int, str]]:
    """Words become digits, close together; a space or a dash stays next to numerals, and so do the
    dots of a run with numerals that has no other separators."""
    edits, base = [], run.start()
    units = list(ONE_DIGIT.finditer(run[0]))
    gaps = [run[0][x.end() : y.start()] for x, y in zip(units, units[1:])]
    dotted = any(x[0].isdecimal() for x in units) and all(g == "." for g in gaps)
    for unit, following, gap in zip(units, [*units[1:], None], [*gaps, ""]):
        word, end = not unit[0].isdecimal(), unit.end()
        plus = unit[0].lower() == "plus"
        joined = following and word and (plus or not following[0].isdecimal()) and not dotted
        if word:
            end = following.start() if joined else end
            edits.append((base + unit.start(), base + end, "+" if plus else DIGIT_OF[unit[0].lower()]))
        if following and not joined and (word or not following[0].isdecimal()) and gap not in (" ", "-") and not dotted:
            edits.append((base + end, base + following.start(), " "))
    return edits


def _inner_dots(found: re.Match) -> list[tuple[int, int, str]]:
    return [(found.start() + m.start(), found.start() + m.end(), ".") for m in INNER_DOT.finditer(found[0])]


def _digit_letters(run: re.Match) -> list[tuple[int, int, str]]:
    letters = [i for i, c in enumerate(run[0]) if c in "OoIl"]
    if not letters or sum(map(run[0].count, "0123456789")) <= len(letters):
        return []
    return [(run.start() + i, run.start() + i + 1, run[0][i].translate(DIGIT_LETTERS)) for i in letters]


def normalise(text: str) -> Tracked:
    """Look-alikes, then spelled digits, look-alikes and separators within numbers, then "at" and "dot"."""
    out = Tracked(text)
    out.rewrite([(m.start(), m.end(), _plain_looks(m[0])) for m in LOOKS.finditer(text)])
    out.rewrite([e for run in DIGITS.finditer(out.text) if WORD.search(run[0]) for e in _plain_digits(run)])
    out.rewrite([e for m in LOOKED_RUN.finditer(out.text) for e in _digit_letters(m)])
    out.rewrite([(m.start() + g.start(), m.start() + g.end(), " ") for m in GROUPED.finditer(out.text) for g in GROUP_END.finditer(m[0])])
    out.rewrite([(m.start(), m.end(), "@" if m[1] or m[2] else ".") for m in MARKED.finditer(out.text)])
    out.rewrite([(m.start(), m.end(), "." if m[3] else "@") for m in WRAPPED.finditer(out.text)])
    for dotted in (SPOKEN_IP, SPOKEN_LOCAL):
        out.rewrite([e for m in dotted.finditer(out.text) for e in _inner_dots(m)])
    for sign, dots in ((SPOKEN, (SPOKEN_DOT, LOOSE_DOT)), (SPACED, (SPOKEN_DOT, SPACED_DOT)), (SIGN, (SPOKEN_DOT,))):
        out.rewrite(_address(out.text, sign, dots))
    return out


def _is_place(text: str, sign: re.Match) -> bool:
    """Whether "at" before a plain domain follows a word of prose."""
    end = LABEL.match(text, sign.end()).end()
    if text.startswith(" ", end) and not text.startswith(" .", end):
        return False
    words = text[max(0, sign.start() - 12) : sign.start()].split(" ")
    return words[-1].lower() in PLACE


def _address(text: str, sign: re.Pattern, dots: tuple[re.Pattern, ...]) -> list[tuple[int, int, str]]:
    """Edits that make addresses plain: the sign, and the dots between the labels behind it."""
    edits, done = [], 0
    for m in sign.finditer(text):
        if m.start() < done or sign is SPOKEN and _is_place(text, m):
            continue
        if m[0] != "@":
            edits.append((m.start(), m.end(), "@"))
        done = m.end()
        while label := LABEL.match(text, done):
            done = label.end()
            if dot := next(filter(None, (d.match(text, done) for d in dots)), None):
                edits.append((dot.start(), dot.end(), "."))
                done = dot.end()
            elif text[done : done + 1] == ".":
                done += 1
            else:
                break
    return edits


SPELLED_WORDS, AT_WORDS, DOT_WORDS = frozenset([*DIGIT_OF, "plus"]), frozenset(_at.split("|")), frozenset(_dot.split("|"))
ANY_WORD = re.compile(r"\w+")
BRACKETED = re.compile(rf"{_open} ?[.@] ?{_close}")
# A run with a letter next to a numeral or between dots, as a first look.
LOOKED_NUMBER = re.compile(r"(?<![\w.])\+?(?=[0-9OoIl .()-]{7})[0-9OoIl]++(?:[ .()-]{1,2}[0-9OoIl]++)++(?![\w])|(?<![\w.])\+?[0-9OoIl]{7,}+(?!\w)")


def is_disguised(text: str) -> bool:
    """Whether any transducer could change what the detectors find in ``text``; a cheap test that may
    err towards yes. The first transducer that changes a text sees it as it is."""
    if not text.isascii() and LOOKS.search(text):
        return True
    low = text.lower()
    if " @" in low or "@ " in low or "&" in low and MARKED.search(low):
        return True
    if BRACKETED.search(text) or GROUPED.search(text) or any(_digit_letters(m) for m in LOOKED_NUMBER.finditer(text)):
        return True
    if any(w in low for w in DOT_WORDS) and WRAPPED.search(text):
        return True
    words = ANY_WORD.findall(low)
    if not DOT_WORDS.isdisjoint(words) and any(t.search(text) for t in (MARKED, SPOKEN_IP, SPOKEN_LOCAL, SPOKEN, SPOKEN_DOT)):
        return True
    if not AT_WORDS.isdisjoint(words) and (SPOKEN.search(text) or MARKED.search(text)):
        return True
    # a spelled digit next to another or to numerals
    flags, at = bytes(map(SPELLED_WORDS.__contains__, words)), -1
    while (at := flags.find(1, at + 1)) >= 0:
        if any(w.isdecimal() or w in SPELLED_WORDS for w in (*words[max(0, at - 1) : at], *words[at + 1 : at + 2])):
            return True
    return False


NUMBER = re.compile(r"[0-9]{9,19}")


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, in source offsets."""
    if not is_disguised(text):
        return []
    seen = normalise(text)
    found = plain_spans(seen.text)
    for m in NUMBER.finditer(seen.text):  # digits spelled throughout need no plus sign
        if all(seen.changed[m.start() : m.end()]) and not any(s < m.end() and m.start() < e for _, s, e in found):
            if len(m[0]) <= 15:
                found.append(("phone", *m.span()))
    kept = []
    for kind, start, end in found:
        if any(seen.changed[start:end]):
            origin = [seen.starts[k] for k in range(start, end) if seen.changed[k]]
            start, end = seen.starts[start], seen.ends[end - 1]
            within = [(s, e) for k, s, e in plain if k == kind and s < end and start < e]
            if any(s <= start and end <= e for s, e in within):
                continue
            # one word next to a plain number ("+33 6 12 34 56 78 un jour") is prose
            if kind in ("card", "phone") and within and sum(not any(s <= o < e for s, e in within) for o in origin) < 2:
                continue
            kept.append((kind, start, end))
    return kept


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def private_spans(text: Column) -> Column:
    """Struct of ``base`` and ``spans``: ``kind:start:end`` of the plain spans and of all spans, by
    start and then kind, comma-joined."""

    @F.pandas_udf("base string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            plain = plain_spans(text)
            base, more = written(plain), disguised_spans(text, plain)
            rows.append((base, written(plain + more) if more else base))
        return pd.DataFrame(rows, columns=["base", "spans"])

    return find(F.coalesce(text, F.lit("")))


def find_private(docs: DataFrame, out: str = "private") -> DataFrame:
    """``docs(text, ...)`` with the spans struct in column ``out``."""
    short_batches(docs.sparkSession)
    return docs.withColumn(out, private_spans(F.col("text")))


def masked(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are one."""
    if not text:
        return text
    plain = plain_spans(text)
    spans = sorted(plain + disguised_spans(text, plain), key=lambda s: s[1])
    pieces, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            pieces += text[done:start], f"[{kind}]"
        done = max(done, end)
    return "".join([*pieces, text[done:]])


def mask_private(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked. Texts without any are unchanged."""
    short_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(x) for x in texts], dtype=object)

    return docs.withColumn("text", mask("text"))
