"""Problem 1: personal data in free text, found in a normalised copy and mapped back to the source characters.

Texts are joined, with a separator that no pattern matches, and looked at as one array of code points. Transducers rewrite
it: full-width and other digits, dashes and look-alike letters inside Latin words (one character for one, by table), then
spelled-out digits and disguised "at" and "dot" (with a table of offsets). Where an identifier can be is found on the array:
"@" signs, clusters of digits, numbers before or after street words, capitalised words (each distinct one is looked up once).
Patterns only run there; their spans go back through the table, so only the found source characters are replaced. Names are
anchored on family names of the name list, or words with the list's endings.

Results: null texts give null, empty ones themselves; spans never overlap; start_char counts code points of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
MAX_NAMES = 1_000_000  # rows of the name list that a worker may hold

# Look-alikes of Latin letters, digit words, disguises, street words, titles, company words.
LOOKALIKES = str.maketrans("АВЕКМНОРСТУХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaeopcyxijsdABEZHIKMNOPTYXo")
DIGIT_WORDS = {"0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve"}
STREETS_EN = "Street St Avenue Ave Road Rd Lane Ln Court Ct Drive Dr Place Pl Square Sq Terrace Way Close Crescent Gardens Grove Boulevard Blvd Row Walk Mews Hill Parade Highway Parkway Circle".split()
STREETS_DE = "straße strasse str. weg platz gasse allee ring damm ufer steig graben pfad hof chaussee".split()
STREETS_FR = "rue avenue av. boulevard bd impasse place allée chemin quai cours route square passage sentier ruelle faubourg".split()
STREETS_ES = "Calle C/ Avda. Avda Avenida Av. Plaza Pza. Paseo P.º Camino Ronda Travesía Carretera Ctra. Glorieta Callejón".split()
TITLES = set("mr mrs ms miss dr prof herr frau fräulein hr fr mme mlle monsieur madame m sr sra srta señor señora don doña sir madam".split())
COMPANY = re.compile(r"\s*(?:&|,?\s(?:GmbH|AG|KG|Ltd|LLC|Inc|Corp|plc|PLC|S\.?A\.?|S\.?L\.?|SARL|SAS|Limited|Group|Holding|Hermanos|Hnos|et Cie|und Söhne|and Sons|y Cía)\b)")

WORD_DIGIT = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_dw = "|".join(sorted(WORD_DIGIT, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)\b(?:{_dw})(?:[ \-]+(?:{_dw})){{5,}}\b")
SPELLED_KEYS = sorted({(ord(f) << 32) | (ord(g) << 8) | len(w) for w in WORD_DIGIT for f in (w[0], w[0].upper()) for g in (w[1], w[1].upper())})
DOTW = r"(?:\s?[\[({<]\s?(?i:dot|punkt|point|punto)\s?[\])}>]\s?|[ ](?i:dot|punkt|punto)[ ])"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
LOCAL = r"[A-Za-z0-9_%+\-]{1,64}(?:\.[A-Za-z0-9_%+\-]{1,64}){0,8}"
AT_WORDS = ["at", "AT", "arobase", "arroba", "klammeraffe"]
BRACKETED_AT = re.compile(r"[\[({<]\s?(?i:at|ät|arobase|arroba|klammeraffe)\s?[\])}>]\s?")
DOT = re.compile(DOTW)
DOT_BEFORE = re.compile(rf"(?:{DOTW})$")
DOMAIN = re.compile(rf"{LABEL}(?:(?:{DOTW}|\.){LABEL})+")
EMAIL = re.compile(rf"(?<![\w.+\-]){LOCAL}@(?:{LABEL}\.){{1,8}}[A-Za-z]{{2,24}}(?![\w@])")

ID_NUMBER = re.compile(
    r"(?<![\w.\-/])(?:\d{3}([-. ])\d{2}\1\d{4}|\d{9}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2}\.\d{3}\.\d{3}[- ]?[A-Z]|\d{8}[- ]?[A-Z]|[XYZ][- ]?\d{7}[- ]?[A-Z]"
    r"|[1-478] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[1-478]\d{14}|\d{2} \d{6} [A-Z] \d{3}|\d{8}[A-Z]\d{3})(?![\w/]|[.\-]\d)"
)
PHONE = re.compile(
    r"(?<![\w/.\-+(])(?:\+\d{1,3}[ .\-]?(?:\(0\) ?)?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-/]?\d{2,8}){1,5}|00\d{1,3}[ .\-](?:\(0\) ?)?\d{1,4}(?:[ .\-/]?\d{2,8}){1,5}"
    r"|(?:1[-. ])?\([2-9]\d{2}\)[-. ]?\d{3}[-. ]?\d{4}|(?:1[-. ])?[2-9]\d{2}([-. ])\d{3}\1\d{4}|1?[2-9]\d{2}[2-9]\d{6}|\(0\d{2,4}\) ?\d{3,4}[ \-]?\d{3,5}|0\d{2,4} \d{3,4} \d{4}|0\d(?:[ .\-]?\d{2}){4}|0\d{2,5}/\d{3,8}(?:-\d{1,5})?)(?![\w/]|[.\-]\d)"
)
_up = lambda words: "|".join(re.escape(v) for w in sorted(words, key=len, reverse=True) for v in (w, w.upper()))
_cap = r"[A-ZÀ-ÖØ-Þ][\w’'\-]+"
NUMBERED = re.compile(
    rf"(?<![\w.,/\-])(?:\d{{1,5}}(?:-\d{{1,5}})?[A-Za-z]?,? (?:{_cap} ){{1,3}}(?:{_up(STREETS_EN)})\b"
    rf"|\d{{1,5}}(?: ?(?:bis|ter|quater|BIS))?,? (?:{_up(STREETS_FR)}) (?:(?i:de la|de l’|de|des|du|d’) ?)?{_cap})"
)
FLAT = re.compile(r"(?<![\w.,/\-])(?:Flat|Apt|Unit|Suite|FLAT)\.? \d{1,4}[A-Za-z]?, ?$")
CALLE = re.compile(rf"(?<![\w.,/\-])(?:{_up(STREETS_ES)}) ?(?:(?i:de la|de los|de las|del|de) )?{_cap}(?: {_cap})?,? (?:n\.º |nº |núm\. )?\d{{1,5}}\b")
STREET_DE = re.compile(rf"(?:(?<=[a-zäöüß])(?:{'|'.join(map(re.escape, STREETS_DE))})|(?<=[A-ZÄÖÜ])(?:STRASSE|STR\.|WEG|PLATZ|GASSE|ALLEE|RING|DAMM|UFER)|[ \-](?:Straße|Str\.|Weg|Platz|Allee))[ ]\d{{1,4}}(?:-\d{{1,4}})?[ ]?[a-z]?\b")
STREET_ENDS = tuple(STREETS_DE + [w.upper().replace("ß", "SS") for w in STREETS_DE] + ["Straße", "Str.", "Weg", "Platz", "Allee"])
STREET_DE_HEAD = re.compile(r"[A-ZÄÖÜ][\wäöüß\-]*(?:[ \-][A-ZÄÖÜ][\wäöüß]+)?$")
STREET_AM = re.compile(r"(?<![\w])(?:Am|Im|An der|An den|Auf der|Auf dem|In der|Zum|Zur|AM) [A-ZÄÖÜ][\wäöüß\-]+ \d{1,4}[ ]?[a-z]?(?=,|\s+(?:D-)?\d{5}|\r?\n)")

HEADS = {w: 2 for w in re.findall(r"[^\W\d_]+", _up(STREETS_ES)) if w[0].isupper()} | {w: 4 for w in "Am Im An Auf In Zum Zur AM".split()}
BEFORE = re.compile(rf"(?:{DOTW})$")
DOMAIN = re.compile(rf"{LABEL}(?:(?:{DOTW}|\.){LABEL})+")
EMAIL = re.compile(rf"(?<![\w.+\-]){LOCAL}@(?:{LABEL}\.){{1,8}}[A-Za-z]{{2,24}}(?![\w@])")

ID_NUMBER = re.compile(
    r"(?<![\w.\-/])(?:\d{3}([-. ])\d{2}\1\d{4}|\d{9}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{2}\.\d{3}\.\d{3}[- ]?[A-Z]|\d{8}[- ]?[A-Z]|[XYZ][- ]?\d{7}[- ]?[A-Z]"
    r"|[1-478] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[1-478]\d{14}|\d{2} \d{6} [A-Z] \d{3}|\d{8}[A-Z]\d{3})(?![\w/]|[.\-]\d)"
)
PHONE = re.compile(
    r"(?<![\w/.\-+(])(?:\+\d{1,3}[ .\-]?(?:\(0\) ?)?(?:\(\d{1,4}\)[ .\-]?)?\d{1,5}(?:[ .\-/]?\d{2,8}){1,5}|00\d{1,3}[ .\-](?:\(0\) ?)?\d{1,4}(?:[ .\-/]?\d{2,8}){1,5}"
    r"|(?:1[-. ])?\([2-9]\d{2}\)[-. ]?\d{3}[-. ]?\d{4}|(?:1[-. ])?[2-9]\d{2}([-. ])\d{3}\1\d{4}|1?[2-9]\d{2}[2-9]\d{6}|\(0\d{2,4}\) ?\d{3,4}[ \-]?\d{3,5}|0\d{2,4} \d{3,4} \d{4}|0\d(?:[ .\-]?\d{2}){4}|0\d{2,5}/\d{3,8}(?:-\d{1,5})?)(?![\w/]|[.\-]\d)"
)
_up = lambda words: "|".join(re.escape(v) for w in sorted(words, key=len, reverse=True) for v in (w, w.upper()))
_cap = r"[A-ZÀ-ÖØ-Þ][\w’'\-]+"
NUMBERED = re.compile(
    rf"(?<![\w.,/\-])(?:\d{{1,5}}(?:-\d{{1,5}})?[A-Za-z]?,? (?:{_cap} ){{1,3}}(?:{_up(STREETS_EN)})\b"
    rf"|\d{{1,5}}(?: ?(?:bis|ter|quater|BIS))?,? (?:{_up(STREETS_FR)}) (?:(?i:de la|de l’|de|des|du|d’) ?)?{_cap})"
)
FLAT = re.compile(r"(?<![\w.,/\-])(?:Flat|Apt|Unit|Suite|FLAT)\.? \d{1,4}[A-Za-z]?, ?$")
CALLE = re.compile(rf"(?<![\w.,/\-])(?:{_up(STREETS_ES)}) ?(?:(?i:de la|de los|de las|del|de) )?{_cap}(?: {_cap})?,? (?:n\.º |nº |núm\. )?\d{{1,5}}\b")
STREET_DE = re.compile(rf"(?:(?<=[a-zäöüß])(?:{'|'.join(map(re.escape, STREETS_DE))})|(?<=[A-ZÄÖÜ])(?:STRASSE|STR\.|WEG|PLATZ|GASSE|ALLEE|RING|DAMM|UFER)|[ \-](?:Straße|Str\.|Weg|Platz|Allee))[ ]\d{{1,4}}(?:-\d{{1,4}})?[ ]?[a-z]?\b")
STREET_ENDS = tuple(STREETS_DE + [w.upper().replace("ß", "SS") for w in STREETS_DE] + ["Straße", "Str.", "Weg", "Platz", "Allee"])
STREET_DE_HEAD = re.compile(r"[A-ZÄÖÜ][\wäöüß\-]*(?:[ \-][A-ZÄÖÜ][\wäöüß]+)?$")
STREET_AM = re.compile(r"(?<![\w])(?:Am|Im|An der|An den|Auf der|Auf dem|In der|Zum|Zur|AM) [A-ZÄÖÜ][\wäöüß\-]+ \d{1,4}[ ]?[a-z]?(?=,|\s+(?:D-)?\d{5}|\r?\n)")

CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ][^\W\d_]{2,}(?:[-‐][^\W\d_a-z][^\W\d_]{2,})?")
BEFORE = re.compile(r"(?:([^\W\d_][^\W\d_’']{1,})|(?<![\w.])([^\W\d_a-z]\.))((?:[ \t]|\r?\n)(?:[^\W\d_a-z]\. ?){1,2}|[ \t]|\r?\n)$")
AFTER = re.compile(r",[ \t]([^\W\d_a-z][^\W\d_]{2,})(?:[ \t][^\W\d_a-z]\.)?")
NEXT = re.compile(r"[ \t](?:[^\W\d_a-z]\. ?)?([^\W\d_a-z][^\W\d_]{2,}(?:-[^\W\d_a-z][^\W\d_]{2,})?)")


class Names:
    """Given and family names, and the endings that many of them share."""

    def __init__(self, rows: Iterable[tuple[str, str]]):
        rows = [(n.strip().capitalize(), k) for n, k in rows if n and k]
        self.sets = {kind: {n for n, k in rows if k == kind} for kind in ("given", "family")}
        self.ends = {k: {e for e, c in Counter(n[-3:] for n in s).items() if c >= (4 if k == "family" else 2)} for k, s in self.sets.items()}
        self.heads = {k: {n[:2] for n in s} for k, s in self.sets.items()}
        self.cache: dict[str, int] = {}

    def flags(self, word: str) -> int:
        """8 * the rank as a family name, plus 2 for the beginning of a Spanish street and 4 for that of a German one."""
        known = self.cache[word] = HEADS.get(word, 0) | (8 * self.like(word, "family") if len(word) > 2 else 0)
        return known

    def like(self, word: str, kind: str) -> int:
        """2: listed; 1: with the ending and beginning of listed ones; 0: neither."""
        w = word.capitalize()
        if w in self.sets[kind]:
            return 2
        return int(len(w) >= 4 and w[-3:] in self.ends[kind] and w[:2] in self.heads[kind])

    def family(self, word: str) -> int:
        return min(self.like(p, "family") for p in re.split("[-‐]", word))


WORD, DIGIT, CAPITAL, LETTER, LATIN, LOOK, LOCAL_CHAR, NUMERIC = (1 << k for k in range(8))
SEPARATOR = "\0"
CHUNK = 1 << 20  # characters joined at a time; a longer text is a chunk of its own


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its plain form, its classes, and the Latin letter it looks like."""
    chars = [chr(c) for c in range(0x110000)]
    word = np.fromiter((c.isalnum() for c in chars), bool, len(chars))
    digit = np.fromiter((c.isdecimal() for c in chars), bool, len(chars))
    letter = word & ~digit
    small = np.zeros(len(chars), bool)
    small[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = True
    classes = WORD * word.astype(np.uint8) + DIGIT * digit + CAPITAL * (letter & ~small) + LETTER * letter
    classes[ord("_")] |= WORD
    classes[[c for c in range(128) if chr(c).isalpha()]] |= LATIN
    classes[list(LOOKALIKES)] |= LOOK
    classes[[c for c in range(128) if chr(c).isalnum() or chr(c) in "_%+-."]] |= LOCAL_CHAR
    classes[digit] |= NUMERIC
    classes[[ord(c) for c in " .-/()+"]] |= NUMERIC
    plain = np.arange(len(chars), dtype=np.uint32)
    for m in PLAIN.finditer("".join(chars[:0xD800]) + "".join(chars[0xE000:0x10000])):
        plain[ord(m.group())] = ord(_plain(m.group()))
    look = np.arange(len(chars), dtype=np.uint32)
    look[list(LOOKALIKES)] = list(LOOKALIKES.values())
    return plain, classes.astype(np.uint8), look


PLAIN = re.compile(r"[\uff00-\uffef\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2010-\u2015\u2212\u00a0\u202f\u2007]")


def _plain(c: str) -> str:
    if c in "\u00a0\u202f\u2007":
        return " "
    if unicodedata.category(c) == "Pd" or c == "−":
        return "-"
    d = unicodedata.normalize("NFKC", c)
    return str(unicodedata.digit(c)) if c.isdigit() else d if len(d) == 1 else c


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of a mask."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


class Scan:
    """Personal data of a normalised text, whose places are found on its code points."""

    def __init__(self, text: str, codes: np.ndarray, classes: np.ndarray, names: Names):
        self.text, self.codes, self.classes, self.names = text, codes, classes, names
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str] = []

    def add(self, kind: str, a: int, b: int) -> None:
        """A span counts unless an earlier one overlaps it."""
        k = bisect_right(self.begins, a)
        if (k and self.ends[k - 1] > a) or (k < len(self.begins) and self.begins[k] < b):
            return
        for values, value in ((self.begins, a), (self.ends, b), (self.kinds, kind)):
            values.insert(k, value)

    def run(self) -> None:
        self.emails()
        begins, ends = _runs(self.classes & DIGIT != 0)
        if len(begins):
            self.numbers()
            self.streets(begins, ends)
        self.words()

    def emails(self) -> None:
        at = np.flatnonzero(self.codes == ord("@"))
        if not len(at):
            return
        outside = np.concatenate([[-1], np.flatnonzero(self.classes & LOCAL_CHAR == 0), [len(self.codes)]])
        k = np.searchsorted(outside, at)
        for low, high in zip((outside[k - 1] + 1).tolist(), (outside[k + 1] + 1).tolist()):
            if m := EMAIL.search(self.text, low, high):
                self.add("email", *m.span())

    def numbers(self) -> None:
        """Identity and phone numbers, in clusters of at least six digits."""
        begins, ends = _runs(self.classes & NUMERIC != 0)
        digits = np.concatenate([[0], np.cumsum(self.classes & DIGIT != 0)])
        for least, kind, pattern in ((6, "id_number", ID_NUMBER), (9, "phone", PHONE)):
            enough = digits[ends] - digits[begins] >= least
            low, high = begins[enough] - 3, ends[enough] + 8
            if not len(low):
                continue
            first = np.concatenate([[True], low[1:] > high[:-1]])  # windows that meet are one
            last = np.concatenate([first[1:], [True]])
            for a, b in zip(low[first].tolist(), high[last].tolist()):
                for m in pattern.finditer(self.text, max(0, a), b):
                    if kind == "id_number" or 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                        self.add(kind, *m.span())

    def streets(self, begins: np.ndarray, ends: np.ndarray) -> None:
        """Street addresses by their numbers: those that begin with one and German ones, which end with one."""
        short = ends - begins <= 5
        begins, ends = begins[short], ends[short]
        before = self.codes[np.maximum(begins, 1) - 1]
        inside = np.concatenate([self.classes, [0]])[ends] & LATIN
        after = np.concatenate([self.codes, [0]])[ends]
        open_ = ~np.isin(before, [ord(c) for c in ".,/-_"]) & (self.classes[np.maximum(begins, 1) - 1] & WORD == 0) | (begins == 0)
        for a in begins[open_ & (np.isin(after, [ord(c) for c in " ,-"]) | (inside != 0))].tolist():
            if m := NUMBERED.match(self.text, a):
                flat = FLAT.search(self.text, max(0, a - 16), a)
                self.add("address", flat.start() if flat else a, m.end())
        for a in begins[(before == 32) & (begins > 0)].tolist():
            if self.text.endswith(STREET_ENDS, max(0, a - 12), a - 1):
                m = STREET_DE.search(self.text, max(0, a - 14), a + 14)
                if m and (head := STREET_DE_HEAD.search(self.text, self.back(self.back(m.start()) - 1), m.start())):
                    self.add("address", head.start(), m.end())

    def back(self, at: int) -> int:
        """Where the word, hyphens included, before ``at`` begins."""
        while at > 0 and (self.text[at - 1] == "-" or self.classes[at - 1] & WORD):
            at -= 1
        return max(at, 0)

    def letters(self, at: int) -> int:
        """Where the letters before ``at`` begin."""
        while at > 0 and self.classes[at - 1] & LETTER:
            at -= 1
        return max(at, 0)

    def words(self) -> None:
        """Streets that begin with a word, and names."""
        begins, ends = _runs(self.classes & LETTER != 0)
        capital = self.classes[begins] & CAPITAL != 0
        begins, ends = begins[capital], ends[capital]
        text, known, flags = self.text, self.names.cache, self.names.flags
        if len(known) > 500_000:
            known.clear()
        get = known.get
        words = [text[a:b] for a, b in zip(begins.tolist(), ends.tolist())]
        found = np.fromiter((flags(w) if (k := get(w)) is None else k for w in words), np.int8, len(words))
        for mark, pattern in ((2, CALLE), (4, STREET_AM)):
            for a in begins[found & mark != 0].tolist():
                if m := pattern.match(text, a):
                    self.add("address", *m.span())
        long = ends - begins > 2
        hyphen = np.zeros(len(begins), bool)
        if len(begins):
            hyphen[:-1] = long[:-1] & long[1:] & (begins[1:] == ends[:-1] + 1) & np.isin(self.codes[ends[:-1]], [0x2D, 0x2010])
        taken = second = 0
        for k in np.flatnonzero((found >= 8) | hyphen).tolist():
            a, b = int(begins[k]), int(ends[k])
            if a < second:
                continue
            rank = int(found[k]) >> 3
            if hyphen[k]:
                b = second = int(ends[k + 1])
                rank = min(rank, int(found[k + 1]) >> 3)
            if rank and a >= taken and (span := self.name(a, b, rank, taken)):
                taken = span[1]
                self.add("name", *span)

    def name(self, start: int, end: int, rank: int, taken: int) -> tuple[int, int] | None:
        """The name whose family name is text[start:end], not before ``taken``."""
        text, names = self.text, self.names
        if COMPANY.match(text, end) or text[end : end + 1] in ("_", "@") or text[start - 1 : start] in ("@", "_", ".", "+", "-"):
            return None
        before = BEFORE.search(text, self.letters(max(0, start - 10)), start)
        if before and before.start() >= taken:
            given, at = before.group(1), before.start()
            initials = before.group(2) or before.group(3).strip()
            whole = bool(given) and given[0].isupper() and given.lower() not in TITLES and (g := names.like(given, "given")) > 0 and g + rank >= 2
            if whole or initials:
                if given and not whole:  # only the initials belong to the name
                    at = start - len(before.group(3).lstrip())
                elif not given:  # a given name or another initial before it
                    earlier = EARLIER.search(text, self.letters(max(0, at - 2)), at)
                    if earlier and (not earlier.group(1) or names.like(earlier.group(1), "given")) and earlier.start() >= taken:
                        at = earlier.start()
                return at, end
        after = AFTER.match(text, end)
        if after and (g := names.like(after.group(1), "given")) and g + rank >= 3:
            following = NEXT.match(text, after.end(1))
            if not (following and names.family(following.group(1))):  # else the given name belongs to the next name
                return start, after.end()
        return None


EARLIER = re.compile(r"(?:([^\W\d_a-z][^\W\d_]{2,})|[^\W\d_a-z]\.)[ \t]$")


def _disguised(text: str, codes: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Edits that undo the disguises of e-mail addresses: (start, end, sign)."""
    places = [(a, a + 1, False) for a in np.flatnonzero(codes == ord("@")).tolist()]
    for word in AT_WORDS:
        spaced, at = f" {word} ", 0
        while (at := text.find(spaced, at)) >= 0:
            places.append((at, at + len(spaced), True))
            at += 1
    for a in np.flatnonzero(np.isin(codes, [ord(c) for c in "[({<"])).tolist():
        if m := BRACKETED_AT.match(text, a):
            places.append((a - (text[a - 1 : a].isspace()), m.end(), False))
    for a, b, prose in places:
        if text[a] == "@":
            a, b = a - (text[a - 1 : a] == " "), b + (text[b : b + 1] == " ")
        domain = DOMAIN.match(text, b)
        if not domain or (prose and not DOT.search(domain.group())):
            continue
        low, dots = a, []
        while True:
            begin = low
            while begin > 0 and classes[begin - 1] & LOCAL_CHAR:
                begin -= 1
            if begin == low:
                break
            low = begin
            dot = DOT_BEFORE.search(text, max(0, low - 12), low)
            if not dot or not dot.start() or not classes[dot.start() - 1] & LOCAL_CHAR:
                break
            dots.append((dot.start(), dot.end(), "."))
            low = dot.start()
        if low == a or (low > 0 and classes[low - 1] & WORD):
            continue
        dots += [(b + d.start(), b + d.end(), ".") for d in DOT.finditer(domain.group())]
        if b - a > 1 or dots:
            yield a, b, "@"
            yield from dots


def _spelled(text: str, codes: np.ndarray, classes: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Edits that write at least six spelled digits in a row as digits."""
    begins, ends = _runs(classes & WORD != 0)
    size = ends - begins
    key = codes[begins].astype(np.int64) << 32 | codes[np.minimum(begins + 1, len(codes) - 1)].astype(np.int64) << 8 | np.minimum(size, 255)
    for a, b in zip(*_runs(np.isin(key, SPELLED_KEYS))):
        if b - a >= 6:
            for m in SPELLED.finditer(text, int(begins[a]), int(ends[b - 1])):
                yield m.start(), m.end(), "".join(WORD_DIGIT[w.lower()] for w in re.split(r"[ \-]+", m.group()))


def scan(text: str, names: Names) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Begins, ends and types of the personal data of a text, in order, in source offsets."""
    plain, class_of, look = tables()
    codes = _codes(text)
    if not text.isascii():
        codes = plain[codes]
        classes = class_of[codes]
        if (classes & LOOK).any():
            begins, ends = _runs(classes & WORD != 0)
            latin = np.concatenate([[0], np.cumsum(classes & LATIN != 0)])
            mixed = np.repeat(latin[ends] > latin[begins], ends - begins)
            at = np.flatnonzero(classes & WORD != 0)[mixed]
            codes[at] = look[codes[at]]
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    classes = class_of[codes]
    edits = sorted([*_disguised(text, codes, classes), *_spelled(text, codes, classes)])
    begins, source = [0], [0]
    if edits:
        out, at, size = [], 0, 0
        for a, b, new in edits:
            if a < at:
                continue
            out += [text[at:a], new]
            size += a - at
            begins += [size, size + len(new)]
            source += [a, b]
            size += len(new)
            at = b
        text = "".join([*out, text[at:]])
        codes = _codes(text)
        classes = class_of[codes]
    found = Scan(text, codes, classes, names)
    found.run()
    a, b = np.array(found.begins, np.int64), np.array(found.ends, np.int64)
    if edits:
        begins, source = np.array(begins), np.array(source)
        k = np.searchsorted(begins, a, side="right") - 1
        a = np.where(k % 2, source[k], source[k] + a - begins[k])  # odd: within a replacement, which stands for the source from source[k] on
        k = np.searchsorted(begins, b - 1, side="right") - 1
        b = np.where(k % 2, source[np.minimum(k + 1, len(source) - 1)], source[k] + b - begins[k])
    return a, b, found.kinds


def scans(texts: list[str | None], names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Row, begin, end and type of the personal data of many texts."""
    rows, starts, stops, kinds = [], [], [], []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or "") < CHUNK):
            size += len(texts[to] or "") + 1
            to += 1
        part = [t or "" for t in texts[at:to]]
        a, b, k = scan(SEPARATOR.join(part), names)
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])[:-1]]).astype(np.int64)
        row = np.searchsorted(first, a, side="right") - 1
        rows.append(row + at)
        starts.append(a - first[row])
        stops.append(b - first[row])
        kinds += k
        at = to
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(rows), join(starts), join(stops), kinds


SPANS = "array<struct<start: int, stop: int, type: string>>"


def _finder(names):
    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Names(names.value)
        for batch in batches:
            texts = batch.to_pylist()
            row, start, stop, kind = scans(texts, known)
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(kind, pa.string())], ["start", "stop", "type"])
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), spans, mask=pa.array([t is None for t in texts], pa.bool_()))

    return find


def _redactor(names):
    @F.arrow_udf("struct<text: string, n_found: int>")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Names(names.value)
        for batch in batches:
            texts = batch.to_pylist()
            row, start, stop, kind = scans(texts, known)
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
            start, stop = start.tolist(), stop.tolist()
            out = []
            for k, text in enumerate(texts):
                parts, at = [], 0
                for x in range(offsets[k], offsets[k + 1]):
                    parts += [text[at : start[x]], PLACEHOLDERS[kind[x]]]
                    at = stop[x]
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(np.diff(offsets), pa.int32())], ["text", "n_found"])

    return redact


def _shared(df: DataFrame, name_list: DataFrame):
    """The name list for the workers; it must have at most MAX_NAMES rows."""
    rows = name_list.select("name", "kind").where("name is not null").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the name list has more than {MAX_NAMES} rows")
    return df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def personal_data(df: DataFrame, name_list: DataFrame, text: str = "text") -> Column:
    """Spans of a text column."""
    return _finder(_shared(df, name_list))(F.col(text))


def redacted(df: DataFrame, name_list: DataFrame, key: str = "parsed_id", text: str = "text") -> DataFrame:
    """``key``, text with placeholders, n_found."""
    found = df.select(F.col(key), _redactor(_shared(df, name_list))(F.col(text)).alias("_r"))
    return found.select(key, "_r.text", F.when(F.col("_r.text").isNotNull(), F.col("_r.n_found")).alias("n_found"))


def found(df: DataFrame, name_list: DataFrame) -> DataFrame:
    flat = df.select("parsed_id", F.explode(personal_data(df, name_list)).alias("s"))
    return flat.select("parsed_id", F.col("s.type").alias("pii_type"), F.col("s.start").alias("start_char"))
