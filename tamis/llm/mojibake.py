"""Problem 3: text that was decoded with the wrong character encoding.

A multinomial classifier over hashed byte bigrams is trained on words that are garbled by every chain of encodings below: those
of a small seed text and those of all values of the input that the seeds' model finds clean (``fit``). It predicts a chain (or none) for
each word with characters beyond ASCII, and from the scores of all words of a field one chain for the field. The chain is
inverted on the runs of such characters, which must decode strictly, and the result must be likelier to be clean than
the word was; then the word counts as garbled and is restored. Words of single-byte chains look clean too often to be judged
alone: what settles them is a spelling that no clean word has, the evidence pooled over the field, or that the inverted word
is one of the input's clean words and the word itself is none, or a far rarer one. U+FFFD and words of lone C1 controls count as garbled without a
restoration.

Results: null and empty values and ASCII text are never affected; a field is affected if any of its words is;
``restored`` is null where nothing could be restored, and ``complete`` tells whether all affected words were.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
CLEAN = "clean"
#: (right encoding, wrong encoding, how often)
CHAINS = [
    *(("utf-8", w, n) for w, n in [("cp1252", 1), ("latin-1", 1), ("cp1251", 1), ("cp437", 1), ("cp850", 1), ("mac_roman", 1), ("cp1250", 1), ("koi8-r", 1), ("cp866", 1), ("cp1252", 2), ("latin-1", 2), ("cp1251", 2)]),
    *((r, w, 1) for r, w in [("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp1250"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252")]),
    *((r, w, 1) for r, w in [("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"), ("cp1251", "mac_roman")]),
]
SINGLE_BYTE = {f"{r}>{w}" for r, w, _ in CHAINS if r != "utf-8"}
SEED_WESTERN = """Die Prüfer übernahmen die Schlüssel früher, weil die Bögen fehlten – insgesamt über 40 €. „Wärter“, hieß es, müssen größere Räume öffnen. Außenstellen in Köln, Jürgen zählt Fässer.
Für Änderungen, Öfen und Übersicht: Maßnahmen, Anhänge, Prüfbericht, Köche, Müllfahrer, Fräulein, Schülerzahlen, Zählerstände, vergaßen, verließen, berührten, schätzten, stützten, kürzten, änderten, größter, Geräte, Gebäude, Verträge, Anträge, Pläne, bestätigten.
Les contrôleurs ont reçu les procès-verbaux à la hâte. « Où sont les élèves ? », disait-on dès l’aube. Après la réunion, l’hôte a complété à nouveau les relevés, malgré le gel d’été; ça coûte 30 €. À l’étage, Été, Éléments, œuvre, naïve, café, Noël, dépôts, bâtiments, clés, congés, délégués, employés, véhicules, entrepôts, échantillons, protégé, écarté, évoqué, oublié, rangé, déplacé, dépassé, retardé, vérifié, noté, remplacé, numéro n° 3, Référence, Résumé, société, février, présence, très, père, même, fenêtre, île, sûr, août, aiguë, garçon, français, d’assuré, n’a, habitude.
¿Por qué los años señalaron más tarde? ¡Nadie sabía! El niño soñó que el buzón está vacío; costó 20 €. Los vehículos, módulos, exámenes, diseños, señores, técnicos, médicos, álbumes, lápices, números, almacenes acompañaron, añadieron, midió, petición, acción, después, todavía, según, Expediente n.º 14 «así», útil, ánimo, época, índice, óptimo, pingüino, mañana, otoño, sueños, dueños, auditoría, última, página, revisión, Año, Ñandú, Ó, Í, Á, É, 2.ª.
It isn’t known — all 40 of them — why “the applicants’ letters” cost €20 – or £5, ½ of it… naïve résumé, façade, coöperate, • item, ™ mark, © 2020, ® sign, 20 °C, ±3, × 2, § 4, ¶ end. SÃO PAULO, CÂMARA DE AVEIRO, ÆTHER, Ørsted, Ångström, Łódź, Škoda, Čapek, žena, İstanbul, ÎLE, ÀS ÂNGULO, MAÇÃ, IRMÃ, NÃO, PÂTÉ, Ð, ß, Ü, Ö, Ä, ý, þ, ¡, ¿, µm, m², m³, ¼, ¾, ‰, †, ‡, ‹x›, « x »"""
SEED_CYRILLIC = """Никто не знал, что повара отметили инспекторы. Архивы подтвердили жильцы по просьбе, а графики задержали договоры. Ещё вчера накладные передали отчёты «без предупреждения» — дважды в месяц. Курьеры собрали чертежи в спешке; образцы нашли ключи. Для склада приборы описали протоколы до закрытия. В деле № 17 справки сократили журналы. Переводчики разобрали заявки к обеду. Склады забыли счета после проверки. Почему объект съёмки эхо юность щука Хлеб Фонд Цех Шум Эра Юг Яма Жизнь Зима Игра Йод Конец Лес Мир Ночь Осень Право Река Снег Труд Утро Человек Большой дом стоит на берегу; люди живут хорошо, работают много, читают книги, пишут письма. Смета Протокол Накладная Договор Сроки Бюджет Отчёт Приложение к совещанию исправили проверили учли заменили переписали. ПРОТОКОЛ ОТЧЁТ ДОГОВОР СКЛАД"""
DECOYS = "Θ-Modul ΔT Δx Σ(x) α-Wert β-Test π≈3 µ-Faktor Ω-Form λ→0 λ φ=1 σ² Φ-Modul Γ-Wert τ-Wert δ=2 ε>0 √2 ≤5 ≥3 ≠0 ∞ │ ─ ┌──┐ └──┘ ├── └── ║ ═══ █ ░ ▒ ▓ ■ ● ☆ ✓ → 📄 💻 🧾 ✅ 👩‍💻 🇪🇺 café naïve résumé 日本 東京 한국 ไทย हिन्दी العربية Αθήνα Ελλάδα № 5 №17 ﻿Text   x y 5 € soft­hyphen ​x x y".split(" ")
LEAST_SHAPES = 10  # clean values in which a sign must stand in a shape for it to count
LEAST_SEEN = 4  # clean values in which a shape with a letter beyond ASCII must stand to be clean
LEAST_WORDS = 2  # clean values in which a word must stand to be in the vocabulary
RARER = 0.005  # times as often as another a word or shape may stand in values that pass for clean, and still be a garbled form of it
LEAST_VOTE = 4  # letters of an inverted word that must be in the vocabulary to count by itself


@lru_cache(None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters of a one-byte encoding; bytes that it leaves undefined stand for the control of the same number."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@lru_cache(None)
def _chars_of(encoding: str) -> list[str]:
    return [c for c, _ in sorted(_bytes_of(encoding).items(), key=lambda x: x[1])]


def odd_words(text: str) -> set[str]:
    """The different words with a character beyond ASCII; only blanks, tabs and line ends part words."""
    return {w for w in set(text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")) if not w.isascii()}


def name(chain: tuple[str, str, int]) -> str:
    return f"{chain[0]}>{chain[1]}" + ("" if chain[2] == 1 else f" x{chain[2]}")


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    right, wrong, times = chain
    for _ in range(times):
        try:
            data = text.encode(right)
        except UnicodeEncodeError:
            return None
        chars = _chars_of(wrong)
        text = "".join(chars[b] for b in data)
    return text


@lru_cache(None)
def _back(chain: tuple[str, str, int]) -> dict:
    """Of each character of the wrong encoding its byte or, for single-byte chains, the right character; ASCII stays."""
    right, wrong, _ = chain
    table = _bytes_of(wrong) | {chr(b): b for b in range(128)}
    return table if right == "utf-8" else {c: _chars_of(right)[b] if b > 127 else c for c, b in table.items()}


CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f�]")


def invert(word: str, chain: tuple[str, str, int]) -> str | None:
    """The word before the chain; None unless all runs of its characters beyond ASCII decode strictly."""
    table, restored = _back(chain), word
    try:
        for _ in range(chain[2]):
            back = [table[c] for c in restored]
            restored = bytes(back).decode() if chain[0] == "utf-8" else "".join(back)
    except (KeyError, UnicodeDecodeError):
        return None
    return None if restored == word or CONTROL.search(restored) else restored


def features(word: str) -> np.ndarray:
    """Buckets of the byte bigrams of a word, its ends marked."""
    data = np.frombuffer(b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint32)
    pair = data[:-1] << 8 | data[1:]
    return (pair * np.uint32(2654435761)) >> np.uint32(32 - 13)


def bigrams(words: list[str]) -> np.ndarray:
    """How often each bucket is in all words together."""
    if not words:
        return np.zeros(BUCKETS, np.int64)
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 2 for w in words])[:-1] - 1
    pair = np.delete(data[:-1] << 8 | data[1:], ends)
    return np.bincount((pair * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BUCKETS)


def garbled(words: list[str], chain: tuple[str, str, int]) -> list[str]:
    """The words that the chain changes, garbled; none may hold a line feed."""
    right, wrong, times = chain
    try:
        "".join(words).encode(right)
    except UnicodeEncodeError:
        words = [w for w in words if garble(w, (right, wrong, 1)) is not None]
    made = (garble("\n".join(words), chain) or "").split("\n") if words else []
    return [g for w, g in zip(words, made, strict=True) if g != w]


def training(western: Iterable[str], cyrillic: Iterable[str]) -> np.ndarray:
    """Bigrams of clean words: of all as they are, garbled by each chain, and as they are by script. Those of parts add up to those of the whole."""
    western, cyrillic = [w for w in western if not w.isascii()], [w for w in cyrillic if not w.isascii()]
    rows = [bigrams(western + cyrillic)]
    for chain in CHAINS:
        rows.append(bigrams(garbled(cyrillic if chain[0] in ("cp1251", "koi8-r", "cp866") else western if chain[0] != "utf-8" else western + cyrillic, chain)))
    # clean words of one script each: a text is held against the likelier one, as the chains know one script too
    return np.stack([*rows, bigrams(western), bigrams(cyrillic), np.zeros(BUCKETS, np.int64)])


@lru_cache(1)
def _seeds() -> np.ndarray:
    western, cyrillic = SEED_WESTERN.split(), SEED_CYRILLIC.split()
    western += [w.upper() for w in western] + [w.lower() for w in western]
    cyrillic += [w.upper() for w in cyrillic]
    counts = training(western, cyrillic)
    decoys = bigrams([w for w in DECOYS * 5 if not w.isascii()])
    counts[0] += decoys
    counts[-1] += decoys
    return counts


def hashed(key: str) -> int:
    return int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Known:
    """In how many clean values the words and shapes stand: 64-bit hashes of their keys (see ``keys``) and numbers, 16 bytes each."""

    def __init__(self, hashes: Iterable[int] = (), times: Iterable[int] = ()):
        hashes, times = np.asarray(hashes, np.int64), np.asarray(times, np.int64)
        order = np.argsort(hashes)
        self.hashes, self.times = hashes[order], times[order]

    def of(self, key: str) -> int:
        h = hashed(key)
        k = int(np.searchsorted(self.hashes, h))
        return int(self.times[k]) if k < len(self.hashes) and self.hashes[k] == h else 0

    def word(self, word: str) -> int:
        c = core(word)
        return self.of("w" + c) if counted(c) else 0


class Classifier:
    """Multinomial naive Bayes over BUCKETS bigram buckets; classes: CLEAN and each chain."""

    def __init__(self, more: np.ndarray | int = 0, known: Known | None = None):
        """``more``: ``training`` of clean words besides those of the seeds; ``known``: what stands in clean values."""
        self.known = known or Known()
        self.classes: list = [None, *CHAINS]
        counts = _seeds() + more + 0.02
        self.log = np.log(counts / counts.sum(1, keepdims=True))

    def scores(self, word: str) -> np.ndarray:
        return self.log[: len(self.classes), features(word)].sum(1)

    def ratios(self, word: str) -> np.ndarray:
        """Log likelihood ratio of each class to clean text of the likeliest script."""
        all_of = self.log[:, features(word)].sum(1)
        return all_of[: len(self.classes)] - max(all_of[0], *all_of[len(self.classes) :])


@lru_cache(1)
def _of_seeds() -> Classifier:
    return Classifier()


_installed: Classifier | None = None


def classifier() -> Classifier:
    return _installed or _of_seeds()


def install(model: Classifier | None) -> None:
    """Has this process judge by a fitted model (None: that of the seeds)."""
    global _installed
    if _installed is not model:
        _installed = model
        ratios.cache_clear()
        peak.cache_clear()
        judge.cache_clear()
        known_as.cache_clear()


def core(word: str) -> str:
    """A word without what is no letter at its ends, in lower case."""
    return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", word).lower()


def shape(word: str) -> str:
    """A word with its ASCII letters and digits as one each and without ASCII signs at its ends: that of "€12," is "€0"."""
    return re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", re.sub("[0-9]+", "0", re.sub("[A-Za-z]+", "a", word)))


def training_of(keys: Iterable[str]) -> np.ndarray:
    """``training`` of the words among the keys."""
    by_script: tuple[list, list] = [], []
    for k in keys:
        if k[0] == "f":
            by_script[bool(re.search("[\u0400-\u04ff]", k))].append(k[1:])
    return training(*by_script)


def lettered(of: str) -> bool:
    """Whether a shape has a letter beyond ASCII."""
    return any(c.isalpha() and not c.isascii() for c in of)


def counted(of: str) -> bool:
    """Whether a core is counted."""
    return len(of) >= 3 and not of.isascii()


@lru_cache(400_000)
def keys(word: str) -> tuple[str, ...]:
    """What a word of a clean value is counted as: itself (f), its core (w), its shape (s)."""
    if word.isascii() or unnatural(word):
        return ()
    return "f" + word, "s" + shape(word), *(["w" + core(word)] if counted(core(word)) else [])


def count(values: Iterable[str], times: Counter) -> None:
    """Adds the values in which each key stands, of those that the model of the seeds finds clean."""
    install(None)
    for value in values:
        if repair(value) is None:
            times.update({k for w in odd_words(value) for k in keys(w)})


def counts(key: str, n: int) -> bool:
    """Whether a word or shape that stands in ``n`` values is known. A few garbled signs that the seeds miss pass for clean as single letters."""
    return key[0] == "w" and n >= LEAST_WORDS or key[0] == "s" and n >= (LEAST_SEEN if lettered(key[1:]) else 1)


def learn(values: Iterable[str]) -> Classifier:
    """The model of values that are at hand: words of those that the model of the seeds finds clean, garbled by all chains, and how many stand
    in how many of them. ``fit`` makes the same of a column."""
    times: Counter = Counter()
    count(values, times)
    known = {k: n for k, n in times.items() if counts(k, n)}
    return Classifier(training_of(times), Known([hashed(k) for k in known], list(known.values())))


@lru_cache(50_000)
def ratios(word: str) -> np.ndarray:
    return classifier().ratios(word)


@lru_cache(400_000)
def peak(word: str) -> float:
    """The most that a word can add to the evidence of a chain."""
    return max(0.0, float(ratios(word).max()))


# Signs that stand beside letters in clean text, and letters that Russian does not have.
BESIDE = set("’‘“”–—«»…„¿¡ºª°§№€£·•™®©\xad\u200b\u200d\ufeff\xa0")
CLOSE = 6.0  # log likelihood ratio within which the spelling decides on a word of a garbled text
EVIDENCE = 20.0  # least pooled log likelihood ratio of a garbled text without a word garbled beyond doubt
FOREIGN_CYRILLIC = set("ЂЃѓЉЊЌЋЏђљњќћџЎўЈјҐґЄєЇїІіЅѕ")


def unnatural(word: str) -> bool:
    """Whether a word is spelled as no clean word is: signs or capitals inside a lower-case word, Latin words of
    accented letters only, Cyrillic words with inner capitals or foreign letters."""
    latin = any(c.isascii() and c.isalpha() for c in word)
    accented = [c for c in word if c.isalpha() and not c.isascii()]
    if not latin and len(accented) >= 2 and all(0xC0 <= ord(c) <= 0x24F or c in "ŒœŠšŽžƒ" for c in accented):
        return True
    for k, c in enumerate(word):
        if c.isascii() or c in BESIDE or 0x300 <= ord(c) < 0x370 or ord(c) > 0xFFFF:
            continue
        before, after = word[k - 1 : k], word[k + 1 : k + 2]
        if "\u0400" <= c < "\u0500":
            if c in FOREIGN_CYRILLIC or (before.isascii() and before.isalpha()) or (c.isupper() and before.islower()):
                return True
        elif 0xC0 <= ord(c) <= 0x24F and c not in "×÷":
            if c.isupper() and before.islower() and before.isascii():
                return True
        elif "\u0370" <= c < "\u0400":
            if latin and (before.isascii() and before.isalpha() or len(word) > 3 and after.isascii() and after.islower()):
                return True
        elif before.isascii() and before.isalpha() and (after.isascii() and after.isalpha() or not c.isalpha()) or (after.isascii() and after.islower() and len(word) > 3):
            return True
    return False


@lru_cache(400_000)
def judge(word: str) -> tuple[str, str | None] | None:
    """(chain, restored word or None) of a garbled word; None of a clean one."""
    model = classifier()
    if "�" in word:
        return "lossy", None
    scores, odd = model.scores(word), unnatural(word)
    ranked = [model.classes[k] for k in np.argsort(-scores)]
    # several UTF-8 bytes of a character hardly ever decode by chance, so those chains are tried first, and twice before once
    for chain in sorted((c for c in ranked if c), key=lambda c: (c[0] != "utf-8", -c[2])):
        if chain[0] != "utf-8" and not odd:
            break
        restored = invert(word, chain)
        if restored is None:
            continue
        if chain[0] == "utf-8":
            likely = scores[model.classes.index(chain)] > scores[0] or odd
            if likely and not re.search("[\u0530-\u058f\u0700-\u08ff\u1000-\u1dff]", restored):  # scripts that such bytes form by chance
                return name(chain), restored
            continue
        gain = model.scores(restored)[0] / (len(restored.encode()) + 1) - scores[0] / (len(word.encode()) + 1)
        if gain > 0 and not unnatural(restored) and all(c.isalpha() or c in BESIDE for c in restored if not c.isascii()):
            return name(chain), restored
    if re.search(r"[\x80-\x9f]", word):
        return "unknown", None
    return None


class Field(NamedTuple):
    chain: tuple[str, str, int]
    evidence: float  # log likelihood ratio of the chain to clean text, pooled over the words
    share: float  # of the words, those likelier made by the chain


def pooled(words: list[str], least: float = 0.0) -> Field | None:
    """The single-byte chain that explains the words of a field best; None if clean text or a UTF-8 chain explains them
    better, or if the evidence is not over ``least``. Words that a chain cannot have made count as clean in it."""
    if sum(map(peak, words)) < least - 1e-6:
        return None
    model = classifier()
    of = np.stack([ratios(w) for w in words])
    most = np.maximum(of, 0).sum(0)
    best = None
    for k in np.argsort(-most):
        chain = model.classes[k]
        if most[k] <= (best.evidence if best else least):
            break
        if chain:
            fit = [float(r) for w, r in zip(words, of[:, k]) if (r > 0 or chain[0] != "utf-8") and invert(w, chain)]
            if sum(fit) > (best.evidence if best else least):
                best = Field(chain, sum(fit), sum(r > 0 for r in fit) / len(words))
    return best if best and best.chain[0] != "utf-8" else None


def restores(field: Field, words: list[str]) -> bool:
    """Whether the words are likelier as clean text, and spelled no worse, once restored."""
    pairs = [(w, r) for w in words if (r := invert(w, field.chain))]
    clean = lambda w: classifier().scores(w)[0] / (len(w.encode()) + 1)
    return sum(clean(r) - clean(w) for w, r in pairs) > 0 and sum(unnatural(r) for _, r in pairs) <= sum(unnatural(w) for w, _ in pairs)


def likelier(word: str, chain: tuple[str, str, int], other: tuple[str, str, int] | None) -> float:
    """Log likelihood ratio of a word made by ``chain`` to one made by the other (None: a clean word)."""
    classes, of = classifier().classes, ratios(word)
    return of[classes.index(chain)] - (of[classes.index(other)] if other else 0.0)


def in_chain(word: str, field: Field) -> str | None:
    """The word restored by the chain of its field, unless it is likelier clean; close cases go by spelling. Where nearly
    all words are of the chain, only much likelier clean ones are kept."""
    restored = invert(word, field.chain)
    if restored is None:
        return None
    odd = unnatural(restored) - unnatural(word)
    return restored if likelier(word, field.chain, None) > CLOSE * (odd - (4 if field.share > 0.8 else 1)) else None


@lru_cache(400_000)
def known_as(word: str) -> dict[int, tuple[str, bool]]:
    """By class: what a word becomes by inverting the chain, if that is in the vocabulary or a frequent sign and the word is unknown or far
    rarer; and whether it is enough by itself."""
    model, out = classifier(), {}
    if not len(model.known.hashes):
        return out
    seen = model.known.of("s" + shape(word))
    own = model.known.word(word) if counted(core(word)) else seen
    for k, chain in enumerate(model.classes[1:], 1):
        if r := invert(word, chain):
            n, letters = model.known.word(r), lettered(r)
            if letters and not n:
                continue
            s = model.known.of("s" + shape(r))
            sign = s >= LEAST_SHAPES and not letters
            # one word that is far more frequent than the other is evidence enough; else the shape must be unusual, too
            if n and max(own, 1) <= RARER * n or (sign or n) and own <= RARER * max(n, s if sign else 0) and seen <= RARER * s:
                out[k] = r, sign or len(core(r)) >= LEAST_VOTE
    return out


def stays(word: str, chain: tuple[str, str, int]) -> bool:
    """Whether a word is in the vocabulary and no garbled form of another by the chain."""
    model = classifier()
    return model.known.word(word) > 0 and model.classes.index(chain) not in known_as(word)


def votes(words: list[str], certain: bool = False) -> tuple[tuple[str, str, int], set[str]] | None:
    """The chain by which most words that are not known become words that are in the vocabulary or signs, and these words. None unless
    two of them, a long one or a sign do (any, if the text is garbled for ``certain``), and more than stay words of the vocabulary as they are although the chain changes them."""
    model = classifier()
    made: dict[int, list[str]] = {}
    sure: set[int] = set()
    for w in words:
        for k, (_, enough) in known_as(w).items():
            made.setdefault(k, []).append(w)
            if certain or enough or len(made[k]) > 1:
                sure.add(k)
    if not sure:
        return None
    best = max(sorted(sure), key=lambda k: (len(made[k]), float(sum(ratios(w)[k] for w in made[k]))))
    chain = model.classes[best]
    kept = [w for w in words if stays(w, chain) and invert(w, chain)]
    return (chain, set(made[best])) if len(made[best]) > len(kept) else None


def repair(text: str) -> tuple[str | None, list[str], bool] | None:
    """(restored text or None, chains, complete) of an affected text; None of a clean one.

    Each word is judged alone first. A single-byte chain is then chosen once for the whole text, and all its words follow."""
    if text.isascii():
        return None
    words = sorted(odd_words(text))
    found = {w: j for w in words if (j := judge(w))}
    field, complete, elected = None, True, set()
    if not found or any(c in SINGLE_BYTE for c, _ in found.values()):
        whole = [w for w in words if "�" not in w]
        vote = votes(whole, bool(found))
        if vote and vote[0][0] != "utf-8":
            elected = vote[1]
            fit = [w for w in whole if invert(w, vote[0])]
            field = Field(vote[0], 0.0, len(fit) / len(whole))
        else:
            # a text without a word that is garbled beyond doubt needs strong evidence
            field = pooled(whole, 0.0 if found else max(EVIDENCE, 3.0 * len(whole)))
            if not found and not (field and restores(field, whole)):
                return None
    if field:
        for w in whole:
            own = next((c for c in CHAINS if c[0] == "utf-8" and w in found and name(c) == found[w][0]), None)
            if own and likelier(w, own, field.chain) > CLOSE:
                continue
            if w in elected:
                found[w] = name(field.chain), invert(w, field.chain)
            elif w not in found and stays(w, field.chain):
                continue
            elif restored := in_chain(w, field):
                found[w] = name(field.chain), restored
            elif w not in found and garble(w, field.chain) != w and (invert(w, field.chain) is None or likelier(w, field.chain, None) > -CLOSE):
                complete = False
    if not found:
        return None
    chains = sorted({c for c, _ in found.values()})
    if not any(r for _, r in found.values()):
        return None, chains, False
    restored = re.sub(r"[^ \t\r\n]+", lambda m: found[m.group()][1] or m.group() if m.group() in found else m.group(), text)
    return restored, chains, complete and all(r for _, r in found.values())


RESULT = "struct<restored: string, chains: array<string>, complete: boolean>"


def repaired(text: Column, model=None) -> Column:
    """Struct of restored, chains, complete; null for clean and null texts. ``model``: the broadcast of a fitted one."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        install(model.value if model is not None else None)
        for batch in batches:
            out = [t and repair(t) for t in batch.to_pylist()]
            yield pa.array([dict(zip(("restored", "chains", "complete"), r)) if r else None for r in out], pa.struct([("restored", pa.string()), ("chains", pa.list_(pa.string())), ("complete", pa.bool_())]))

    return run(text)


def values(df: DataFrame, key: str = "parsed_id") -> DataFrame:
    """``key``, field, value of the values of ``text`` and ``metadata`` with a character beyond ASCII; only these go to Python."""
    text = df.select(key, F.lit("text").alias("field"), F.col("text").alias("value"))
    meta = df.select(key, F.explode("metadata").alias("_k", "value")).select(key, F.concat(F.lit("metadata."), "_k").alias("field"), "value")
    return text.unionByName(meta).where(F.col("value").rlike(r"[^\x00-\x7f]"))


KEYS = 1 << 18  # keys that a task holds before it hands them on


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key`` and ``n``, partial sums, of a column of values."""
    times: Counter = Counter()
    for batch in batches:
        count(batch.column(0).to_pylist(), times)
        if len(times) >= KEYS:
            yield pa.record_batch({"key": pa.array(times.keys(), pa.string()), "n": pa.array(times.values(), pa.int64())})
            times.clear()
    yield pa.record_batch({"key": pa.array(times.keys(), pa.string()), "n": pa.array(times.values(), pa.int64())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys and their sums: ``at`` (-1), ``hash`` and ``n`` of those that are known; place in the table, 0 and ``n`` of the training counts."""
    table = np.zeros((len(CHAINS) + 4, BUCKETS), np.int64)
    for batch in batches:
        pairs = list(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()))
        table += training_of(k for k, _ in pairs)
        known = [(hashed(k), n) for k, n in pairs if counts(k, n)]
        yield pa.record_batch({"at": pa.array([-1] * len(known), pa.int32()), "hash": pa.array([h for h, _ in known], pa.int64()), "n": pa.array([n for _, n in known], pa.int64())})
    at = np.flatnonzero(table)
    yield pa.record_batch({"at": pa.array(at.astype(np.int32)), "hash": pa.array(np.zeros(len(at), np.int64)), "n": pa.array(table.ravel()[at])})


def fit(odd: DataFrame) -> Classifier:
    """The model of all different values: ``learn`` of them, with the values judged and counted where they are. The driver gets the training counts,
    at most one for each class and bucket, and 16 bytes for each word and shape that is known; no words and no values."""
    keyed = odd.select("value").distinct().mapInArrow(_key_counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = keyed.mapInArrow(_summed, "at int, hash long, n long").groupBy("at", "hash").agg(F.sum("n").alias("n")).toArrow()
    at, hashes, n = (rows.column(c).to_numpy() for c in ("at", "hash", "n"))
    table = np.zeros((len(CHAINS) + 4) * BUCKETS, np.int64)
    table[at[at >= 0]] = n[at >= 0]
    return Classifier(table.reshape(-1, BUCKETS), Known(hashes[at < 0], n[at < 0]))


def affected(df: DataFrame, key: str = "parsed_id") -> DataFrame:
    """``key``, field, value, restored, chains, complete of the affected values of ``text`` and ``metadata``."""
    odd = values(df, key)
    model = df.sparkSession.sparkContext.broadcast(fit(odd))
    return odd.withColumn("_r", repaired(F.col("value"), model)).where("_r is not null").select(key, "field", "value", "_r.restored", "_r.chains", "_r.complete")


def found(df: DataFrame) -> DataFrame:
    return affected(df).select("parsed_id", "field").distinct()
