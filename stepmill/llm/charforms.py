"""Problem 1: one consistent form for text that looks the same.

``canonicalise`` works on one string; ``canonical_form`` is its Column form.
Within every token the sets of scripts in which each letter could be written
are intersected.  A token written in several scripts is spelled in the script
that is left; a token written wholly in look-alikes of another script (a
whole-script confusable) follows the script of the words around it; then
invisible characters, odd blanks, width and accent forms are normalised.

Which letters look alike in all scripts of Unicode comes from the confusables
that the ICU library on Spark's class path ships (``look_alikes``); the short
lists here hold only what those lack or leave open for the scripts that are
mixed most.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepmill.session import spread

#: Bits of the kinds of unusual characters found in a text.
INVISIBLE, BLANK, WIDTH, ACCENT, SCRIPT = 1, 2, 4, 8, 16

# Letters of other scripts that look like a Latin letter, each
# line in the order of the Latin letters beside it.
LOOKALIKES = {
    "C": [
        ("асеорхуіјѕһԁԛԝӏ", "aceopxyijshdqwl"),
        ("АВЕКМНОРСТХУЅІЈԌԚԜҮӀ", "ABEKMHOPCTXYSIJGQWYI"),
    ],
    "G": [
        ("ονϲϳ", "ovcj"),
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ],
    "A": [("օսոհցՕՏՍԼ", "ounhgOSUL")],
    "K": [("ᎪᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ACDEHJKLMPSTVWZ")],
    "S": [("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ")],
}
# Letters that pass for a Latin letter only inside a Latin word.
NEAR_LOOKALIKES = {"G": [("αιρυκχγ", "aipukxy")], "C": [("кп", "kn")]}
# Latin letters that look like another Latin letter.
LATIN_VARIANTS = {"ɑ": "a", "ɡ": "g"}
# Greek and Cyrillic letters that look alike and unlike any Latin one.
GREEK_CYRILLIC = [("ΓΠΦ", "ГПФ")]
# Letters of one Japanese script that look like one of another.
KATAKANA_FOR = {"力": "カ", "口": "ロ", "二": "ニ", "八": "ハ", "夕": "タ", "工": "エ", "卜": "ト", "へ": "ヘ"}

#: Letters of the scripts that are mistaken for each other, with Latin first; ``extend`` adds more.
LATIN_CLASS = "A-Za-zªºÀ-ÖØ-öø-ɏɐ-ʯḀ-ỿ"
OTHER_CLASS = "Ͱ-ͳͶ-ͷͿΆΈ-Ͽἀ-\u1fffЀ-ҁҊ-ԯᲀ-\u1c8fԱ-Ֆա-ևᎠ-Ᏽꓐ-ꓷ"
_MARKS = "\u0300-\u036f\u0483-\u0487"
_CJK = re.compile("[\u3040-ヿ㐀-鿿豈-\ufaff가-힣]")
_KATAKANA_PAIR = re.compile("(?<=[ァ-ヺー])([力口二八夕工卜へ])(?=[ァ-ヺー])")

#: Java pattern of the characters of which at least one must occur in a text
#: that is not in its canonical form; all other texts skip Python.
SUSPECT = (
    "[^\\x00-\\x7F¡-¬®-ıĴ-ňŊ-ǃǍ-ǰǴ-ɏ"
    "‐-‧‰-⁞₠-₿℀-℥Ⅎ-⅒←-⯿"
    "、-ぷべ-\u3098゛-ヿ一-事亍-兪公-劚劜-卛卝-叢古-夔外-巤左-鿿"
    "가-힣]"
)

_PROTO: dict[str, str] = {}
_NEAR: dict[str, str] = {}
_SPELL: dict[tuple[str, str], str] = {}
_SCRIPTS: dict[str, frozenset[str]] = {}
_NEAR_SCRIPTS: dict[str, frozenset[str]] = {}


@lru_cache(100_000)
def _script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x250 <= cp <= 0x2AF or 0x1E00 <= cp <= 0x1EFF:
        return "L"
    if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF:
        return "G"
    if 0x400 <= cp <= 0x52F or 0x1C80 <= cp <= 0x1C8F:
        return "C"
    if 0x530 <= cp <= 0x58F:
        return "A"
    if 0x13A0 <= cp <= 0x13FF or 0xAB70 <= cp <= 0xABBF:
        return "K"
    if 0xA4D0 <= cp <= 0xA4FF:
        return "S"
    name = unicodedata.name(ch, "")
    return "L" if name.startswith("LATIN ") else name.partition(" ")[0]


def _fill() -> None:
    for script, rows in LOOKALIKES.items():
        for own, latin in rows:
            for a, b in zip(own, latin, strict=True):
                _PROTO[a] = b
                _SPELL.setdefault((b, script), a)
    for script, rows in NEAR_LOOKALIKES.items():
        for own, latin in rows:
            for a, b in zip(own, latin, strict=True):
                _NEAR[a] = b
                _SPELL.setdefault((b, script), a)
    for a, b in zip(*GREEK_CYRILLIC[0], strict=True):
        _PROTO[a] = _PROTO[b] = "\x00" + b
        _SPELL["\x00" + b, "G"], _SPELL["\x00" + b, "C"] = a, b
    _share_scripts()


def _share_scripts() -> None:
    """The scripts in which each letter could be written: those of all letters that look like it."""
    exact: dict[str, set[str]] = {}
    for a, b in _PROTO.items():
        exact.setdefault(b, set()).add(_script(a))
    shared = {b: frozenset(scripts | ({"L"} if b[0] != "\x00" else set())) for b, scripts in exact.items()}
    _SCRIPTS.update(shared)
    _SCRIPTS.update({a: shared[b] for a, b in _PROTO.items()})
    for a, b in _NEAR.items():
        _NEAR_SCRIPTS[a] = frozenset({_script(a), "L"})


_fill()


def _letters() -> Iterator[str]:
    """All letters and digits beyond ASCII but those of Chinese, Korean and Japanese."""
    for cp in [*range(0x80, 0x3040), *range(0xA000, 0xAC00), *range(0xFB00, 0xFE00), *range(0x10000, 0x1D400), *range(0x1E000, 0x20000)]:
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L" or kind == "Nd":
            yield chr(cp)


def _joined_scripts() -> frozenset[str]:
    """Scripts left out of the look-alikes: those whose words are made of letters with vowel signs, and Arabic, whose letters join."""
    names = (unicodedata.name(chr(cp), "") for cp in [*range(0x900, 0x1C00), *range(0xA800, 0xAB00), *range(0x11000, 0x12000), *range(0x16F00, 0x17000)])
    return frozenset({"ARABIC", *(n.partition(" ")[0] for n in names if " VOWEL SIGN " in n)})


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters and digits of all scripts that look like one Latin letter, with that letter; worked out once for a Spark context.

    Two characters look alike where ICU gives them the same skeleton; of the
    Latin letters of a skeleton the one of the same case is taken.  A small
    letter that looks like a small capital stands for the capital.  Letters
    without case that are a mere stroke are left out, since they look like too
    many things.
    """
    sc = spark.sparkContext
    if (made := getattr(sc, "_stepmill_look_alikes", None)) is not None:
        return made
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    except TypeError:
        warnings.warn("no ICU library on Spark's class path: only the short lists of look-alikes are used", stacklevel=2)
        sc._stepmill_look_alikes = {}
        return {}
    own = [*map(chr, range(65, 91)), *map(chr, range(97, 123)), "ß"]
    asked = [*own, *_letters()]
    seen = dict(zip(asked, checker.getSkeleton("\n".join(asked)).split("\n"), strict=True))
    latin: dict[str, list[str]] = {}
    for c in own:
        latin.setdefault(seen[c], []).append(c)
    for c in asked:
        m = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, ""))
        if m and seen[c] == c:
            latin[c] = [m.group(1)]
    joined = _joined_scripts()
    made = {}
    for c in asked[len(own) :]:
        fits = latin.get(seen[c], [])
        name = unicodedata.name(c, "")
        digit, ours = unicodedata.category(c) == "Nd", name.startswith("LATIN ")
        if not fits or (ours and (ord(c) < 0x180 or not (c.islower() or c.isupper()) or "SMALL CAPITAL" in name)):
            continue
        if unicodedata.decomposition(c).startswith("<") or unicodedata.normalize("NFC", c) != c or (not digit and name.partition(" ")[0] in joined):
            continue
        if len(fits) > 1 and not (c.islower() or c.isupper()) and not digit:
            continue
        made[c] = next((x for x in fits if x.isupper() == c.isupper()), fits[0])
    sc._stepmill_look_alikes = made
    return made


#: Digits of other scripts that look like a letter; read as one only between letters of ASCII.
DIGITS_FOR: dict[str, str] = {}
_TOKEN = _OTHER = _VARIANT = _DIGIT = re.compile("")
_extended: frozenset[str] | None = None


def extend(more: dict[str, str]) -> bool:
    """Take ``more`` look-alikes (as from ``look_alikes``) into the tables of this process; the lists above come first. True if they are new."""
    global _TOKEN, _OTHER, _VARIANT, _DIGIT, _extended
    if _extended is not None and _extended >= more.keys():
        return False
    scripts = set()
    for a, b in more.items():
        if unicodedata.category(a) == "Nd":
            DIGITS_FOR[a] = b
        elif _script(a) == "L":
            LATIN_VARIANTS.setdefault(a, b)
        elif a not in _PROTO and a not in _NEAR and not ("α" <= a <= "ω" or "а" <= a <= "я" or "А" <= a <= "Я" or "Α" <= a <= "Ω"):
            _PROTO[a] = b
            _SPELL.setdefault((b, _script(a)), a)
            scripts.add(_script(a))
    _share_scripts()
    _scripts_of.cache_clear()
    _read_kept.cache_clear()
    wider = "".join(_ranges(c for c in _letters() if unicodedata.category(c)[0] == "L" and _script(c) in scripts)) if scripts else ""
    latin = LATIN_CLASS + "".join(map(re.escape, LATIN_VARIANTS))
    _TOKEN = re.compile(f"[{latin}{OTHER_CLASS}{wider}][{latin}{OTHER_CLASS}{wider}{_MARKS}]*")
    _OTHER = re.compile(f"[{OTHER_CLASS}{wider}]")
    _VARIANT = re.compile(_class(LATIN_VARIANTS))
    _DIGIT = re.compile(f"(?<=[A-Za-z]){_class(DIGITS_FOR)}(?=[A-Za-z])") if DIGITS_FOR else re.compile("(?!)")
    _extended = (_extended or frozenset()) | more.keys()
    return True


def _simple_forms() -> tuple[dict[int, str], frozenset[str], dict[int, str]]:
    """Width and presentation forms, invisible characters, odd blanks."""
    forms: dict[int, str] = {}
    invisible: set[str] = set()
    blanks: dict[int, str] = {}
    visible_format = {0x6DD, 0x70F, 0x8E2, 0x890, 0x891, *range(0x600, 0x606), *range(0xFFF9, 0xFFFC)}
    for cp in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" and cp not in visible_format:
            invisible.add(ch)
        elif kind == "Zs" and cp not in (0x1680, 0x3000):
            blanks[cp] = " "
        spelled = unicodedata.decomposition(ch)
        if not spelled.startswith("<"):
            continue
        tag, plain = spelled[1 : spelled.index(">")], unicodedata.normalize("NFKC", ch)
        alike = (
            tag in ("wide", "narrow")
            or (tag == "font" and 0x1D400 <= cp < 0x1D800)
            or tag in ("isolated", "initial", "medial", "final")
            or (tag == "compat" and (0x2160 <= cp < 0x2180 or 0xFB00 <= cp <= 0xFB04 or cp == 0xFB06 or 0x2F00 <= cp < 0x2FD6 or cp in (0x132, 0x133) or 0x1C7 <= cp <= 0x1CC))
        )
        if alike and plain != ch and (plain.isalnum() or plain in ("\u3099", "\u309a", "ー")):
            forms[cp] = plain
    for cp in [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]:
        invisible.add(chr(cp))
        forms.pop(cp, None)
    for cp in (0x85, 0x2028, 0x2029):
        blanks[cp] = "\n"
    return forms, frozenset(invisible), blanks


FORMS, INVISIBLES, BLANKS = _simple_forms()
#: Full-width ASCII signs; plain in a text without any East Asian letter.
WIDE_SIGNS = {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F) if cp not in FORMS} | {0x3000: " "}


def _ranges(chars: Iterable[str]) -> list[str]:
    """Characters as the ranges of a pattern class."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return [f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs]


def _class(chars: Iterable[str]) -> str:
    """A pattern class with neighbours as ranges: classes with many single astral characters are searched slowly."""
    return "[" + "".join(_ranges(chars)) + "]"


_INVISIBLE_RE = re.compile(_class(INVISIBLES))
_FORMS_RE = re.compile(_class(map(chr, FORMS)))
_BLANKS_RE = re.compile(_class(map(chr, BLANKS)))
_WIDE_SIGNS_RE = re.compile(_class(map(chr, WIDE_SIGNS)))
#: Letters that fill the holes of the mathematical alphabets, with the plain one; read so only beside letters of ASCII (and not the litre).
HOLES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2100, 0x2150) if c != 0x2113 and unicodedata.decomposition(chr(c)).startswith("<font>") and unicodedata.normalize("NFKC", chr(c)).isascii()}
_HOLE = re.compile(f"(?<=[A-Za-z]){_class(HOLES)}|{_class(HOLES)}(?=[A-Za-z])")


def _arabic(ch: str) -> bool:
    return "ؠ" <= ch <= "ۿ" or "ݐ" <= ch <= "ݿ"


def _pictograph(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk") or "\U0001f3fb" <= ch <= "\U0001f3ff" or ch == "\ufe0f"


def _needed(text: str, at: int) -> bool:
    """Whether the invisible character at ``at`` is one that spelling needs."""
    ch = text[at]
    before = text[at - 1] if at else ""
    after = text[at + 1] if at + 1 < len(text) else ""
    if not before:
        return False
    if ch == "\u200c" and after and _arabic(before) and _arabic(after):
        return True
    if ch in "\u200c\u200d" and after and unicodedata.combining(before) == 9 and unicodedata.category(after)[0] == "L":
        return True
    if ch == "\u200d" and after:
        return _pictograph(before) and unicodedata.category(after) == "So"
    if ch in "\ufe0e\ufe0f":
        return unicodedata.category(before) in ("So", "Sm") or before in "0123456789#*‼⁉™ℹ"
    return "\U000e0020" <= ch <= "\U000e007f" and (_pictograph(before) or "\U000e0020" <= before <= "\U000e007f")


def _strip_invisible(text: str) -> str:
    return "".join(c for i, c in enumerate(text) if c not in INVISIBLES or _needed(text, i))


def _base(ch: str) -> tuple[str, str]:
    spelled = unicodedata.normalize("NFD", ch)
    return spelled[0], spelled[1:]


@lru_cache(100_000)
def _scripts_of(ch: str, near: bool) -> frozenset[str]:
    base, _ = _base(ch)
    found = _SCRIPTS.get(base)
    if near and base in _NEAR_SCRIPTS:
        found = (found or frozenset()) | _NEAR_SCRIPTS[base]
    return found or frozenset({_script(base)})


def _spell(ch: str, script: str) -> str:
    base, marks = _base(ch)
    if _script(base) == script:
        return ch
    proto = _PROTO.get(base) or _NEAR.get(base) or base
    new = proto if script == "L" else _SPELL.get((proto, script), base)
    return unicodedata.normalize("NFC", new + marks)


def _respell(run: str, script: str) -> str:
    return "".join(_spell(c, script) if not unicodedata.combining(c) else c for c in run)


def _runs(token: str) -> list[tuple[str, frozenset[str]]]:
    """The token cut where the intersection of its letters' script sets would become empty."""
    out: list[tuple[str, frozenset[str]]] = []
    run, left = "", frozenset()
    for c in token:
        if unicodedata.combining(c):
            run += c
            continue
        own = _scripts_of(c, True)
        both = left & own if run else own
        if not both:
            out.append((run, left))
            run, both = "", own
        run, left = run + c, both
    return [*out, (run, left)]


def _plain_halves(token: str) -> bool:
    """Two words of different scripts written together, each of them plain."""
    parts = ["".join(p) for p in _same_script(token)]
    return len(parts) == 2 and all(len(p) > 2 and any(len(_scripts_of(c, False)) == 1 for c in p) for p in parts)


def _same_script(token: str) -> list[list[str]]:
    out: list[list[str]] = []
    last = ""
    for c in token:
        if unicodedata.combining(c) and out:
            out[-1].append(c)
            continue
        s = _script(_base(c)[0])
        if s != last:
            out.append([])
            last = s
        out[-1].append(c)
    return out


def _read(token: str) -> tuple[str | None, tuple[str, ...], bool]:
    """What a token says by itself: its new spelling if it has one, the scripts it is surely written in, and whether the words around it must decide."""
    letters = [c for c in token if not unicodedata.combining(c)]
    if not _OTHER.search(token):
        new = None
        if _VARIANT.search(token) and re.search("[A-Za-z]", token):
            plain = "".join(LATIN_VARIANTS.get(c, c) for c in token)
            # phonetic writing keeps its letters: only a word that is then plain is respelled
            if not any("\u0180" <= c <= "\u02af" or "\u1d00" <= c <= "\u1dbf" for c in plain):
                token = new = plain
        only_latin = frozenset.intersection(*(_scripts_of(c, False) for c in letters)) == {"L"}
        return new, ("L",) if only_latin else (), False
    scripts = {_script(_base(c)[0]) for c in letters}
    if len(scripts) == 1:
        own = any("L" not in _scripts_of(c, False) for c in letters)
        return None, tuple(scripts) if own else (), not own
    if _plain_halves(token):
        return None, (), False
    spelled, sure, still_open = "", [], False
    for run, left in _runs(token):
        if len(left) == 1:
            sure += left
            spelled += _respell(run, next(iter(left)))
        else:
            spelled += run
            still_open = True
    return spelled, tuple(sure), still_open


_read_kept = lru_cache(100_000)(_read)


def _fix_scripts(text: str) -> str:
    """Every token in the script it belongs to (method step one to three)."""
    tokens = list(_TOKEN.finditer(text))
    sure: Counter[str] = Counter()
    open_tokens: list[int] = []
    new: dict[int, str] = {}
    for i, m in enumerate(tokens):
        token = m.group()
        spelled, scripts, still_open = (_read_kept if len(token) < 40 else _read)(token)
        if spelled is not None:
            new[i] = spelled
        sure.update(scripts)
        if still_open:
            open_tokens.append(i)
    for i in open_tokens:
        token = new.get(i, tokens[i].group())
        spelled = ""
        for run, left in _runs(token):
            own = {_script(_base(c)[0]) for c in run if not unicodedata.combining(c)}
            if len(own) == 1:
                script = next(iter(own))
                target = "L" if script != "L" and "L" in left and not sure[script] and sure["L"] else script
            else:
                best = [s for s, _ in sure.most_common() if s in left]
                target = best[0] if best else "L" if "L" in left else sorted(left)[0]
            spelled += _respell(run, target)
        new[i] = spelled
    if not new:
        return text
    out, at = [], 0
    for i, m in enumerate(tokens):
        if i in new:
            out += [text[at : m.start()], new[i]]
            at = m.end()
    return "".join(out) + text[at:]


def canonicalise(text: str | None) -> tuple[str | None, int]:
    """The canonical form of ``text`` and the kinds of what had to be replaced (0: none).

    Null gives null, the empty text itself.  Runs of ordinary blanks, tabs and
    line breaks stay as they are, since they look different.
    """
    if text is None or text.isascii():
        return text, 0
    kinds = 0
    if _INVISIBLE_RE.search(text):
        new = _strip_invisible(text)
        if new != text:
            text, kinds = new, kinds | INVISIBLE
    if _BLANKS_RE.search(text):
        text, kinds = text.translate(BLANKS), kinds | BLANK
    if _FORMS_RE.search(text):
        text, kinds = text.translate(FORMS), kinds | WIDTH
    if _WIDE_SIGNS_RE.search(text) and not _CJK.search(text):
        text, kinds = text.translate(WIDE_SIGNS), kinds | WIDTH
    if not unicodedata.is_normalized("NFC", text):
        text, kinds = unicodedata.normalize("NFC", text), kinds | ACCENT
    if _HOLE.search(text):
        text, kinds = _HOLE.sub(lambda m: HOLES[m.group()], text), kinds | WIDTH
    if _DIGIT.search(text):
        text, kinds = _DIGIT.sub(lambda m: DIGITS_FOR[m.group()], text), kinds | SCRIPT
    if _OTHER.search(text) or _VARIANT.search(text):
        new = _fix_scripts(text)
        if new != text:
            text, kinds = unicodedata.normalize("NFC", new), kinds | SCRIPT
    if _KATAKANA_PAIR.search(text):
        text, kinds = _KATAKANA_PAIR.sub(lambda m: KATAKANA_FOR[m.group()], text), kinds | SCRIPT
    return text, kinds


extend({})

_STATE_LINE = re.compile(r'^(\[\d+\] <[^>]*> role=\S+ ")(.*)("?)$', re.S)


def canonicalise_state(state: str | None) -> tuple[str | None, int]:
    """``canonicalise`` by line: the words around a token are those of its own line's text."""
    if state is None or state.isascii():
        return state, 0
    out, kinds = [], 0
    for line in state.split("\n"):
        m = _STATE_LINE.match(line)
        head, body = (m.group(1), line[m.end(1) :]) if m else ("", line)
        if not m and line[:6] == "Goal: ":
            head, body = line[:6], line[6:]
        new, k = canonicalise(body)
        out.append(head + new)
        kinds |= k
    return "\n".join(out), kinds


_SCHEMA = T.StructType([T.StructField("canonical", T.StringType()), T.StructField("kinds", T.IntegerType())])
#: Characters of texts and forms that a task remembers, and the longest text worth it.
_KEPT, _KEPT_LENGTH = 20_000_000, 500


def _batches(one, more: dict[str, str]):
    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        extend(more)
        seen: dict[str, tuple[str, int]] = {}
        held = 0
        for batch in batches:
            out = []
            for text in batch:
                hit = seen.get(text) if text is not None else (None, 0)
                if hit is None:
                    hit = one(text)
                    if len(text) <= _KEPT_LENGTH:
                        if held > _KEPT:
                            seen.clear()
                            held = 0
                        seen[text] = hit
                        held += 2 * len(text)
                out.append(hit)
            yield pd.DataFrame(out, columns=["canonical", "kinds"])

    return run


def canonical_form(text: Column, state: bool = False) -> Column:
    """Struct (canonical, kinds) of a string column; Python runs only on ``suspect`` texts if filtered first."""
    return _batches(canonicalise_state if state else canonicalise, look_alikes(SparkSession.active()))(text)


@lru_cache(10)
def _suspect_pattern(odd: frozenset[str]) -> str:
    """``SUSPECT`` with the characters ``odd`` as well; the first, cheap class keeps plain letters from the long one."""
    plain = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in odd and not re.match(SUSPECT, chr(c))]
    return f"[[^\\x00-\\x7F]&&[^{''.join(_ranges(plain))}]]"


def suspect(text: Column) -> Column:
    """Whether the text has a character that may be unusual; evaluated in the JVM."""
    return text.rlike(_suspect_pattern(frozenset({*look_alikes(SparkSession.active()), *HOLES})))


def texts_of(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(id, field, idx, text) of all goals, candidate texts and states; repeated deliveries included."""
    goals = rows.select("id", F.lit("goal").alias("field"), F.lit(-1).alias("idx"), F.col("goal").alias("text"))
    cands = rows.select("id", F.explode("candidates").alias("c")).select("id", F.lit("candidate").alias("field"), F.col("c.idx").alias("idx"), F.col("c.text").alias("text"))
    states = records.select(F.col("_meta.id").alias("id"), F.lit("state").alias("field"), F.lit(-1).alias("idx"), F.col("state").alias("text"))
    return goals.unionAll(cands).unionAll(states)


def unify(texts: DataFrame) -> DataFrame:
    """``texts`` (id, field, idx, text) with canonical and kinds.

    Only suspect texts go through Python; each class of fields is one narrow
    stage, nothing is shuffled.  Null texts stay null with kinds 0.
    """

    def done(part: DataFrame, state: bool) -> DataFrame:
        # one look at each text: those that are plain go as nulls
        r = part.withColumn("r", canonical_form(F.when(suspect(F.col("text")), F.col("text")), state=state))
        return r.select("id", "field", "idx", "text", F.coalesce("r.canonical", "text").alias("canonical"), F.coalesce("r.kinds", F.lit(0)).alias("kinds"))

    return done(texts.where(F.col("field") != "state"), False).unionAll(done(texts.where(F.col("field") == "state"), True))


def unusual(texts: DataFrame) -> DataFrame:
    """The distinct (id, field, idx, canonical, kinds) of texts not written in their ordinary characters."""
    odd = texts.where(suspect(F.col("text")))
    short = spread(odd.where(F.col("field") != "state")).withColumn("r", canonical_form(F.col("text")))
    states = spread(odd.where(F.col("field") == "state")).withColumn("r", canonical_form(F.col("text"), state=True))
    cases = short.unionAll(states).select("id", "field", "idx", "r.canonical", "r.kinds").where("kinds > 0")
    return cases.dropDuplicates(["id", "field", "idx"])
