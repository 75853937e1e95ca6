"""Personal information inside free text: where it stands, and the text with typed placeholders in its stead."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import ship_package

KINDS = ("email", "identity_no", "phone", "street_address", "person_name")
#: The lexicon of names is broadcast; more rows than this are refused.
MAX_NAMES = 2_000_000

# --- normalising, one character for one -------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones, and the Latin ones.
_LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵ", "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXov", strict=True))
_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
#: What "at" and "dot" as words become; only together do they make an address.
_WEAK_AT, _WEAK_DOT = "\ue000", "\ue001"
_SPACES = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _table() -> dict[int, str]:
    t = {ord(a): b for a, b in _LOOKALIKES.items()}
    t |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    t |= {0x130: "I"}  # its lower case is two characters long
    t |= {ord(c): "-" for c in _DASHES} | {ord(c): " " for c in _SPACES} | {0xFE6B: "@"}
    t |= {ord(_WEAK_AT): "\ufffd", ord(_WEAK_DOT): "\ufffd"}
    for first in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        t |= {first + k: str(k) for k in range(10)}
    return t


_ONE_TO_ONE = _table()
_GONE = "­​‌‍⁠﻿"
#: Digits in words.
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: What stands between them: marks, or a mark in words.
_GAP = r"(?:[\s,.\-/]{1,4}|\s{1,4}(?:dash|hyphen|minus|space)\s{1,4})"
_TIMES = r"(?:(?:double|triple)[\s\-]{1,4})?"
_ONE = _TIMES + "(?:" + "|".join(_DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"\b(?:plus[\s\-]{{1,4}})?{_ONE}(?:{_GAP}{_ONE}\b)+", re.I)
#: The longest gap of the pattern above between two digit words.
_LONGEST_GAP = 4 + len("hyphen") + 4 + len("double") + 4
_REPEAT = re.compile(r"\bplus\b|(?:(double|triple)[\s\-]+)?({})".format("|".join(_DIGIT_WORDS)), re.I)
#: Fewer digits in words are no number.
_LEAST_SPELLED = 6
_REWRITE = re.compile(rf"[{_GONE}]|&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[a-zA-Z]{{2,10}});")
_MAY_REWRITE = re.compile(rf"[{_GONE}&]")
_TRANSLATED = re.compile("[" + re.escape("".join(map(chr, _ONE_TO_ONE))) + "]")


class Normal:
    """A text in plain letters and the way back: ``source(i)`` is the source position of character i, ``after(i)`` that behind character i - 1."""

    def __init__(self, text: str, spelled: bool = False, gaps: bool = True, disguised: bool = False) -> None:
        """``disguised``: at and dot, in brackets or as words, become signs. ``spelled``: digits in words become digits, and what stands between them goes unless ``gaps``. ``runs`` then has
        (from, places behind a gap that is more than one space or hyphen, to) of each row of such words."""
        self.text = text if text.isascii() else _TRANSLATED.sub(lambda m: _ONE_TO_ONE[ord(m[0])], text)
        self.layers: list[tuple[list, list]] = []
        self.runs: list[tuple[int, list[int], int]] = []
        edits = []
        if _MAY_REWRITE.search(self.text):
            for m in _REWRITE.finditer(self.text):
                new = "" if m[0][0] != "&" else html.unescape(m[0]).replace("\xa0", " ")
                if new != m[0]:
                    edits.append((m.start(), m.end(), new))
        self._edit(edits)
        if spelled:
            self._spell(gaps)
        if disguised:
            self._edit([(m.start(), m.end(), "@" if m[1] else "." if m[2] else _WEAK_AT if m[3] else _WEAK_DOT) for m in _DISGUISE.finditer(self.text)])

    def _spell(self, gaps: bool) -> None:
        edits, runs = [], []
        for m in _SPELLED.finditer(self.text):
            own, cuts = [], []
            for w in _REPEAT.finditer(self.text, m.start(), m.end()):
                if own and not gaps:
                    own.append((own[-1][1], w.start(), ""))
                    if self.text[own[-1][0] : w.start()] not in (" ", "-"):
                        cuts.append(w.start())
                own.append((w.start(), w.end(), _DIGIT_WORDS[w[2].lower()] * {"double": 2, "triple": 3}.get((w[1] or "").lower(), 1) if w[2] else "+"))
            if _digits("".join(new for _, _, new in own)) >= _LEAST_SPELLED:
                edits += own
                runs.append((m.start(), cuts, m.end()))
        ends = [b for _, b, _ in edits]
        moved = [0, *accumulate(len(new) - (b - a) for a, b, new in edits)]
        to = lambda p: p + moved[bisect_right(ends, p)]
        self.runs = [(to(a), [to(c) for c in cuts], to(b)) for a, cuts, b in runs]
        self._edit(edits)

    def _edit(self, edits: list[tuple[int, int, str]]) -> None:
        if edits:
            out, at, frm, pos, size = [], [0], [0], 0, 0
            for a, b, new in edits:
                out.append(self.text[pos:a])
                size += a - pos
                # each new character stands for all of the old ones
                at.append(size), frm.append((a, b, len(new)))
                out.append(new)
                size += len(new)
                at.append(size), frm.append(b)
                pos = b
            out.append(self.text[pos:])
            self.text = "".join(out)
            self.layers.append((at, frm))

    def source(self, i: int) -> int:
        for at, frm in reversed(self.layers):
            k = bisect_right(at, i) - 1
            f = frm[k]
            i = f[0] if isinstance(f, tuple) else f + i - at[k]
        return i

    def after(self, i: int) -> int:
        for at, frm in reversed(self.layers):
            k = bisect_right(at, i - 1) - 1
            f = frm[k]
            i = f[1] if isinstance(f, tuple) else f + i - at[k]
        return i


# --- what identifiers look like ----------------------------------------------------------------------------------------

_SHUT = r"[(\[{<]\s*%s\s*[)\]}>]"
_AT_B, _DOT_B = _SHUT % "at", _SHUT % "(?:dot|punkt|point)"
_SHUT_AT = re.compile(_AT_B, re.I)
_DOTS = re.compile(rf"{_DOT_B}|\sdot\s", re.I)
#: At and dot in disguise, with the space around them; a word's space also serves the word behind it.
_DISGUISE = re.compile(rf"(\s?{_AT_B}\s?)|(\s?{_DOT_B}\s?)|(\s+at\s+)|(\s+dot\s+)", re.I)
_LABEL, _TLD = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?", r"[A-Za-z]{2,}(?![A-Za-z0-9]|-[A-Za-z0-9])"
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
_AT = re.compile(f"[@{_WEAK_AT}]")
_DOMAIN = {"@": re.compile(f"(?:{_LABEL}[.{_WEAK_DOT}])+{_TLD}"), _WEAK_AT: re.compile(f"(?:{_LABEL}{_WEAK_DOT})+{_TLD}")}
_CUE = re.compile(
    r"\b(?:passport|identity|identification|id|i\.d\.|national(?:\s+(?:id|identity|insurance))?|insurance|social\s+security|ssn|tax(?:payer)?|ni|nino|personal)"
    r"(?:\s*(?:card|id|number|insurance|security|code))*\s*(?:no\.?|nr\.?|number|num\.?|card|id|\#|№)?\s*(?:is|was|of)?\s*[:#=]?\s*",
    re.I,
)
_IDENTITY = re.compile(
    r"[A-Z]{2}-\d{4}-\d{4}-\d(?![\w-])|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]\b|\d{3}-\d{2}-\d{4}(?![\w-])|\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])|\d{2} \d{4} \d{5} [A-Z]\b|\d{9,12}(?![\w-])|[A-Z]{1,2}\d{6,9}\b",
    re.I,
)

#: Numbers as the public plans of +1, +44 and +49 write them, and any with a country code.
_PHONE = re.compile(
    r"(?<![\w.+/\-])(?:"
    r"\+\s?\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}"
    r"|\((?:[2-9]\d{2})\)[ .\-]?\d{3}[ .\-]?\d{4}"
    r"|(?:1[ .\-]?)?[2-9]\d{2}([ .\-])[2-9]\d{2}\1\d{4}"
    r"|1[2-9]\d{2}[2-9]\d{6}"
    r"|\(0\d{1,4}\)[ .\-/]?\d{2,4}(?:[ .\-]?\d{2,5}){1,3}"
    r"|0\d{4}[ .\-]?\d{3}[ .\-]?\d{3}"
    r"|0 ?\d{2,4}(?: ?[/\-] ?)\d{2,8}(?:[ \-]?\d{2,5}){0,3}"
    r"|0\d{2} \d{4} \d{4}"
    r"|555-\d{4}"
    r")(?![\w]|[.\-/]\d)"
)
#: The same plans, and identity numbers, where the digits stand in words: nothing tells their groups.
_SPOKEN_PHONE = re.compile(r"\+\s?\d{7,15}|1?[2-9]\d{2}[2-9]\d{6}|0\d{8,11}|555\d{4}")
_SPOKEN_IDENTITY = re.compile(r"(?i:[A-Z]{2})[ \-]?(?:\d{9}(?![\w-])|\d{6}[ \-]?[A-Z]\b)|(?i:[A-Z]{1,2})[ \-]?\d{6,9}(?!\w)|\d{11}[ \-]?[B-HJ-Z]\b")
_MAY_DIGITS = re.compile(r"\d[\d\s().\-/]{5,}\d")

_NAME_WORD = r"[^\W\d_]+(?:[\-'’][^\W\d_]+)*"
_TYPE = r"(?:street|st|avenue|ave|road|rd|lane|ln|terrace|close|drive|dr|court|ct|square|sq|way|boulevard|blvd|crescent|row|place|gardens?)"
_FLAT = r"(?:flat|apt\.?|apartment|unit|suite)\s+\d{1,4}[A-Za-z]?"
_STREET = re.compile(rf"(?<![\w\-.,/])(?:{_FLAT},\s+)?\d{{1,3}}[A-Za-z]?\s+(?:{_NAME_WORD}\s+){{1,3}}?{_TYPE}\b(?:,\s+{_FLAT}\b)?", re.I)
#: House numbers of four or five digits count before a capitalised street's name only.
_LONG_STREET = re.compile(rf"(?<![\w\-.,/])(?:(?i:{_FLAT}),\s+)?(\d{{4,5}})[A-Za-z]?\s+(?:(?=[^\W\d_a-z]){_NAME_WORD}\s+){{1,3}}?(?=[A-Z])(?i:{_TYPE})\b(?:,\s+(?i:{_FLAT})\b)?")
#: What stands before a year (fixed values).
_BEFORE_YEAR = re.compile(r"\b(?:in|since|by|from|until|till|during|after|before|of|circa|c\.|to|and|early|late|mid|spring|summer|autumn|winter|[a-z]{3,9}|\d{1,2}),?\s+\Z", re.I)
_FRENCH = re.compile(rf"(?<![\w\-.,/])\d{{1,4}}[A-Za-z]?,?\s+(?:rue|avenue|boulevard|place|chemin|allée)\s+(?:(?:de|du|des|de\s+la)\s+|d['’]|de\s+l['’])?{_NAME_WORD}", re.I)
_SPANISH = re.compile(rf"(?:calle|avenida|plaza|paseo)\s+(?:(?:de|del|de\s+la)\s+)?{_NAME_WORD},?\s+(?:n[.º°o]*\s*)?\d{{1,4}}[A-Za-z]?\b(?!\s*[%€])", re.I)
_GERMAN_NUMBER = re.compile(r"\s+\d{1,4}[A-Za-z]?\b")
_TURKISH = re.compile(r"(?:sokak|sokağı|cadde|caddesi|bulvarı)\s+no\s*[:.]?\s*\d{1,4}[A-Za-z]?\b", re.I)
#: A street's name is no ordinary word of this short list (fixed values: English words that stand between a number and "way", "place", ...).
_NO_STREET = frozenset("of in on at by to for from with and or the a an its this that was were is are as than when while within along beside near years days metres km crowns".split())

_TITLE = re.compile(r"\b(?:mr|mrs|ms|miss|dr|prof|sir|dame|herr|frau)\b\.?[ \t]+", re.I)
#: What makes a text worth a look, by kind, in lower case. Expressions start at these or, where they begin with a number, run
#: over the whole text; none is cut off by a window.
_TRIGGERS = {
    "dot": ("dot", "punkt", "point"),
    "identity": ("passport", "identi", "id", "i.d.", "national", "insurance", "social", "ssn", "tax", "ni", "personal"),
    "street": tuple(" " + w for w in "street st avenue ave road rd lane ln terrace close drive dr court ct square sq way boulevard blvd crescent row place garden gardens".split()),
    "french": ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée "),
    "spanish": ("calle", "avenida", "plaza", "paseo"),
    "german": ("straße", "strasse", "gasse", "weg", "platz", "allee"),
    "turkish": ("sokak", "sokağı", "cadde", "bulvarı"),
    "digit": tuple(_DIGIT_WORDS),
    "title": tuple(x + y for x in "mr mrs ms miss dr prof sir dame herr frau".split() for y in (" ", ".", "\t")),
}
_SEP = r"(?:[ \t]+|\s?\n[ \t]*(?!\n))"


#: The same, read from right to left.
_SEP_R = r"(?:[ \t]+|[ \t]*\n\s?)"
_WORD_R = re.compile(_NAME_WORD)
_COMPOUND_R = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_BEFORE_R = re.compile(rf"\s+{_NAME_WORD}")
_LETTERS = re.compile(r"[^\W\d_]+")


def _inside_word(t: str, i: int) -> bool:
    """Whether place i is not the start of a word."""
    return i > 0 and (t[i - 1].isalnum() or t[i - 1] == "_")


def _trim_tail(s: str, end: int) -> int:
    while end and not s[end - 1].isdigit():
        end -= 1
    return end


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


class _Taken:
    """Places without overlaps: those added first go first; of those added together, the longer, then the earlier."""

    def __init__(self) -> None:
        self.at: list[tuple[int, int, str]] = []

    def add(self, kind: str, spans: Iterable[tuple[int, int]]) -> None:
        for a, b in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
            i = bisect_right(self.at, (a, b, ""))
            if a < b and (i == 0 or self.at[i - 1][1] <= a) and (i == len(self.at) or self.at[i][0] >= b):
                self.at.insert(i, (a, b, kind))

    def places(self) -> list[tuple[int, int, str]]:
        return self.at


class Finder:
    """Finds the places of one text. ``names`` maps kind (given, family) to casefolded names; endings seen at least twice in
    the lists vouch for names that are not in them, which count only beside a title or where the same text gives them one."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        import ahocorasick

        self.given, self.family = given, family
        self.ends = [self._endings(given, 2), self._endings(family, 3)]
        words: dict[str, list[str]] = {}
        for kind, ws in (*_TRIGGERS.items(), ("family", family)):
            for w in ws:
                words.setdefault(w, []).append(kind)
        self.trie = ahocorasick.Automaton()
        for w, kinds in words.items():
            self.trie.add_word(w, (len(w), tuple(kinds)))
        self.trie.make_automaton()

    def triggers(self, t: str) -> dict[str, list[tuple[int, int]]]:
        hits: dict[str, list[tuple[int, int]]] = {}
        low = t.lower()
        for last, (size, kinds) in self.trie.iter(low):
            for k in kinds:
                hits.setdefault(k, []).append((last + 1 - size, last + 1))
        return hits

    @staticmethod
    def _endings(names: set[str], k: int) -> frozenset[str]:
        n: dict[str, int] = {}
        for x in names:
            n[x[-k:]] = n.get(x[-k:], 0) + 1
        return frozenset(e for e, c in n.items() if c >= 2)

    def _fits(self, word: str, kind: int) -> bool:
        w = word.casefold()
        known = self.family if kind else self.given
        return w in known or (len(w) > 3 and w[-3 if kind else -2 :] in self.ends[kind])

    def _fits_family(self, word: str) -> bool:
        return all(self._fits(p, 1) for p in word.split("-"))

    @staticmethod
    def emails(t: str) -> Iterator[tuple[int, int]]:
        """The addresses of a text in which at and dot are signs: from each at to both sides."""
        least = 0
        for m in _AT.finditer(t):
            p = a = m.start()
            while a > least and t[a - 1] in _LOCAL:
                a -= 1
            while a < p and not t[a].isalnum():
                a += 1
            if a < p and (t[p - 1] != "." or p - a == 1) and (d := _DOMAIN[m[0]].match(t, p + 1)):
                yield a, d.end()
                least = d.end()

    def identities(self, t: str, hits: dict) -> Iterator[tuple[int, int]]:
        for a, _ in hits.get("identity", ()):
            if _inside_word(t, a) or not (m := _CUE.match(t, a)):
                continue
            v = _SPOKEN_IDENTITY.match(t, m.end()) if "spoken" in hits else None
            if v and any(x < v.end() and v.start() < y for x, _, y in hits["spoken"]):
                yield v.span()
            elif (v := _IDENTITY.match(t, m.end())) and _digits(v[0]) >= 6:
                yield v.span()

    def phones(self, t: str, hits: dict) -> Iterator[tuple[int, int]]:
        for a, cuts, b in hits.get("spoken", ()):
            # a + in figures before the words belongs to them
            a -= (t[a - 1 : a] == "+") or 2 * (t[a - 2 : a] == "+ " and a > 1)
            ends = [*cuts, b]
            at = 0
            while at < len(ends):
                # a number has at most 15 digits, so no more parts
                for to in range(min(len(ends), at + 16) - 1, at - 1, -1):
                    if _SPOKEN_PHONE.fullmatch(t, a, ends[to]):
                        yield a, ends[to]
                        at = to
                        break
                a = ends[at]
                at += 1
        if not _MAY_DIGITS.search(t):
            return
        for m in _PHONE.finditer(t):
            end = m.start() + _trim_tail(m[0], len(m[0]))
            if 7 <= _digits(t[m.start() : end]) <= 15:
                yield m.start(), end

    @staticmethod
    def _ordinary(street: str) -> bool:
        return any(w.lower() in _NO_STREET for w in re.findall(r"(?<!\w)[^\W\d_]+", street)[:-1])

    def addresses(self, t: str, hits: dict) -> Iterator[tuple[int, int]]:
        if any(b == len(t) or not (t[b].isalnum() or t[b] == "_") for _, b in hits.get("street", ())):
            for m in _STREET.finditer(t):
                if not self._ordinary(m[0]):
                    yield m.span()
            for m in _LONG_STREET.finditer(t):
                year = 1000 <= int(m[1]) < 2100 and _BEFORE_YEAR.search(t, 0, m.start())
                if not year and not self._ordinary(m[0]):
                    yield m.span()
        if "french" in hits:
            for m in _FRENCH.finditer(t):
                yield m.span()
        for a, _ in hits.get("spanish", ()):
            if not _inside_word(t, a) and (m := _SPANISH.match(t, a)):
                yield m.span()
        if "german" in hits or "turkish" in hits:
            r, n = t[::-1], len(t)
            for a, b in hits.get("german", ()):
                if (m := _GERMAN_NUMBER.match(t, b)) and (w := _COMPOUND_R.match(r, n - a)) and not _inside_word(t, n - w.end()):
                    yield n - w.end(), m.end()
            for a, _ in hits.get("turkish", ()):
                if (m := _TURKISH.match(t, a)) and (w := _BEFORE_R.match(r, n - a)) and not _inside_word(t, n - w.end()):
                    yield n - w.end(), m.end()

    #: Read from right to left, from a family name on: initials and a given name; initials alone.
    _LISTED_R = re.compile(rf"(?:{_SEP_R}?\.[^\W\d_])*{_SEP_R}({_NAME_WORD})")
    _INITIALS_R = re.compile(rf"(?:{_SEP_R}?\.[^\W\d_])+(?![\w.])")
    _COMMA_GIVEN = re.compile(rf",{_SEP}({_NAME_WORD})(?:{_SEP}[^\W\d_]\.(?!\w))*")
    _TITLED = re.compile(rf"(?:(?:([^\W\d_])\.{_SEP}?)+|({_NAME_WORD}){_SEP}(?:[^\W\d_]\.{_SEP}?)*)({_NAME_WORD})")
    _TITLED_COMMA = re.compile(rf"({_NAME_WORD}),{_SEP}({_NAME_WORD})(?:{_SEP}[^\W\d_]\.(?!\w))*")

    _LINKED = re.compile(rf"\[\[(?:[a-z]{{2,3}}:)?(?=((?:[^\W\d_]\.{_SEP}?)+|{_NAME_WORD}{_SEP}|{_NAME_WORD},{_SEP})(?:[^\W\d_]\.{_SEP}?)*{_NAME_WORD}(?:{_SEP}[^\W\d_]\.)*\]\])")

    def names(self, t: str, hits: dict) -> Iterator[tuple[int, int]]:
        seen: set[tuple[int, int]] = set()
        if "family" in hits:
            r, size = t[::-1], len(t)
            for a, b in hits["family"]:
                if _inside_word(t, a) or (b < size and (t[b].isalnum() or t[b] == "_")):
                    continue
                # double-barrelled: take in the parts before and behind
                while a > 1 and t[a - 1] == "-" and (m := _LETTERS.match(r, size - a + 1)):
                    a = size - m.end()
                while b < size - 1 and t[b] == "-" and (m := _LETTERS.match(t, b + 1)):
                    b = m.end()
                if not self._fits_family(t[a:b]):
                    continue
                if (m := self._LISTED_R.match(r, size - a)) and m[1][::-1].casefold() in self.given:
                    span = size - m.end(1), b
                elif (m := self._COMMA_GIVEN.match(t, b)) and m[1].casefold() in self.given:
                    span = a, m.end()
                elif m := self._INITIALS_R.match(r, size - a):
                    span = size - m.end(), b
                else:
                    continue
                if span not in seen:
                    seen.add(span)
                    yield span
        titled: set[str] = set()
        # a link to a page about a person: nothing but a name
        for m in self._LINKED.finditer(t):
            at = m.end()
            if (n := self._TITLED_COMMA.match(t, at)) and self._fits_family(n[1]) and self._fits(n[2], 0):
                span = n.span()
            elif (n := self._TITLED.match(t, at)) and self._fits_family(n[3]) and (n[2] is None or self._fits(n[2], 0)):
                span = n.span()
            else:
                continue
            if t.startswith("]]", span[1]) and span not in seen:
                seen.add(span)
                yield span
        for a, _ in hits.get("title", ()):
            if _inside_word(t, a) or not (m := _TITLE.match(t, a)):
                continue
            at = m.end()
            if (n := self._TITLED_COMMA.match(t, at)) and self._fits_family(n[1]) and self._fits(n[2], 0):
                span = n.span()
            elif (n := self._TITLED.match(t, at)) and self._fits_family(n[3]) and (n[2] is None or self._fits(n[2], 0)):
                span = n.span()
            else:
                continue
            titled.add(t[span[0] : span[1]])
            if span not in seen:
                seen.add(span)
                yield span
        # the same person again in this text, without a title
        for name in titled:
            at = t.find(name)
            while at >= 0:
                end = at + len(name)
                if (at, end) not in seen and not (at and t[at - 1].isalnum()) and not (end < len(t) and t[end].isalnum()):
                    seen.add((at, end))
                    yield at, end
                at = t.find(name, end)

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points of the source, in order, without overlaps; kinds earlier in KINDS go first, then longer places."""
        if not text:
            return []
        n = Normal(text)
        hits = self.triggers(n.text)
        digit = hits.get("digit", ())
        if any(y[0] - x[1] <= _LONGEST_GAP for x, y in zip(digit[:-1], digit[1:])) and _SPELLED.search(n.text):
            n = Normal(text, spelled=True, gaps=False)
            hits = self.triggers(n.text)
            if n.runs:
                hits["spoken"] = n.runs
        taken = _Taken()
        # an address may be in disguise; what else a text has is looked for with its own words at and dot
        e = n
        if _SHUT_AT.search(n.text) or ("dot" in hits and _DOTS.search(n.text)):
            e = Normal(text, disguised=True)
        taken.add("email", ((e.source(a), e.after(b)) for a, b in self.emails(e.text)))
        for kind, found in zip(KINDS[1:], (self.identities, self.phones, self.addresses, self.names), strict=True):
            taken.add(kind, ((n.source(a), n.after(b)) for a, b in found(n.text, hits)))
        return taken.places()

    def mask(self, text: str | None) -> str | None:
        if not text:
            return text
        out, pos = [], 0
        for a, b, k in self.find(text):
            out += [text[pos:a], f"[{k.upper()}]"]
            pos = b
        return "".join(out) + text[pos:]


def _finder(shared, cache: list = []) -> Finder:  # noqa: B006
    if not cache or cache[0] is not shared.value:
        cache[:] = [shared.value, Finder(*shared.value)]
    return cache[1]


def _places(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for b in batches:
            rows = [(d, *p) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for p in finder.find(t.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["doc_id", "start_pos", "end_pos", "kind"])

    return f


def _masked(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([finder.mask(t.as_py()) for t in b.column("text")], pa.string())], names=["doc_id", "text"])

    return f


def _lexicon(names: DataFrame):
    rows = names.select(F.col("name"), F.col("kind")).filter("name is not null").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    of = lambda kind: {r["name"].strip().lower() for r in rows if r["kind"] == kind and r["name"].strip()}
    return names.sparkSession.sparkContext.broadcast((of("given"), of("family")))


def _texts(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def personal_places(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, kind) of every place, in code points from 0, the end behind it.

    A transducer brings each text into plain form (full-width and look-alike characters, entities, invisible characters,
    digits in words and, for addresses, at and dot in disguise) and remembers where every character came from; detection runs on
    the plain form and the spans are mapped back. Expressions start at what may begin or end a place, or run over the whole
    text, so no place is cut off by a window. Null and empty texts have no places; repeated rows give theirs each time; places never
    overlap. One pass without shuffle; the lexicon is the only thing broadcast, behind a bound of MAX_NAMES rows.
    """
    return _texts(docs).mapInArrow(_places(_lexicon(names)), "doc_id bigint, start_pos int, end_pos int, kind string")


def mask_personal(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text) with [EMAIL], [PHONE], [IDENTITY_NO], [STREET_ADDRESS] or [PERSON_NAME] in place of each place and all else unchanged; null stays null."""
    return _texts(docs).mapInArrow(_masked(_lexicon(names)), "doc_id bigint, text string")
