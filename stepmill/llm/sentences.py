"""Problem 8: sentence boundaries across languages and scripts.

A text is cut into blocks at empty lines and before bullet lines.  Inside a
block every run of final marks, with what closes there, is a candidate; the
rule tables below are read in order (those for all languages first, then those
of the languages written in the script before the mark, then the closing
ones) and the first pair of patterns (before, after) that matches decides it.
Thai has no marks: there blanks between two Thai characters are boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from stepmill.session import spread

_EOL = "\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"
_LINE = re.compile(f"(?:{_EOL})")
_BULLET = re.compile(r"[^\S\r\n]*(?:[-•*]|\d{1,9}\.)(?=[^\S\r\n])")

_MARKS = "[.!?…‼⁇⁈⁉。！？｡．।॥؟۔։።။។]"
_CLOSERS = "[\"'”’»›)\\]}」』）】》〉］｝“]"
#: A final mark, or a semicolon (a mark after Greek letters), with the marks and what closes after it.
_CANDIDATE = re.compile(rf"[{_MARKS[1:-1]};\u037e](?:{_MARKS}|[ \u00a0\u202f]?»|{_CLOSERS})*")
_THAI_BLANK = re.compile(r"(?<=[ก-\u0e3eเ-๛])\s+(?=[ก-\u0e3eเ-๛])")

_THAI = re.compile("[ก-๛]")

_UP = "A-ZÀ-ÖØ-ÞŒА-ЯЁΑ-ΩΆ-Ώ"
_LOW = "a-zß-öø-ÿœа-яёα-ωά-ώ"
_OPEN = "[\"'“”„«‘(\\[¿¡]*"
#: Letters of scripts without capitals.
_FLAT = "\u0600-ۿऀ-\u0dffก-๛\u3040-ヿ㐀-鿿가-힣"
_CJK = "\u3040-ヿ㐀-鿿"

# Abbreviations after which a sentence goes on, by language; a blank may follow a full stop inside.
NEVER = {
    "en": "Mr Mrs Ms Dr Prof St Fig Figs Eq Vol Ch Sec vs cf e.g i.e viz approx al Gen Col Sgt Lt Capt Rev Hon Gov Sen Rep Mt Ft pp incl excl resp tel ext dept est misc",
    "de": "ca bzw bspw evtl ggf inkl exkl zzgl vgl Nr Nrn Dr Prof Hr Fr Frl Hrn Abs Art Bd Kap Str Tel Mio Mrd max geb gest lt sog Abb Aufl Ing Dipl St",
    "es": "Sr Sra Srta Sres Dr Dra Dña Ud Uds Vd Vds aprox núm nro pág págs p.ej ej art cap Lic Ing Prof av avda tel fig",
    "fr": "MM Mme Mlle Dr Pr Me Ste p.ex ex env éd cf art chap fig vol tél av apr boul réf",
    "ru": "ул просп пл пер наб кв корп гр им проф акад доц см ср напр рис табл тел стр обл оз пос т.е т.к т.н",
    "el": "κ κα κος κκ δηλ Δρ καθ αρ σελ τηλ π.χ βλ πρβλ",
    "hi": "डॉ श्री श्रीमती प्रो कु सुश्री पं स्व रु नं पृ इं",
}
# Abbreviations that may end a sentence; a capital after them tells.
MAYBE = {
    "en": "etc a.m p.m A.M P.M Inc Ltd Co Corp Jr Sr hrs min sec kg km ft lb oz Ave Rd Blvd",
    "de": "usw etc Std Min Sek u.a o.ä u.ä",
    "es": "etc EE.UU a.m p.m",
    "fr": "etc",
    "ru": "т.д т.п др пр руб коп тыс млн млрд кг гг г",
    "el": "κ.λπ κ.λ.π κ.τ.λ κ.ά κ.α μ.μ π.μ λπ",
}
# Words that begin a sentence when capitalised in its middle.
STARTERS = (
    "The A An It Its This That These Those He She They We You In On At As When With For After Before If Then There "
    "Here Use Open Choose Press Does Do Is Are Was Where What Which Who How Why No Not But And Or So By From To Of All "
    "Der Die Das Ein Eine Es Er Sie Wir Ich Im Am Bei Nach Vor Wenn Dann Danach Hier Wo Was Wer Wie Bitte Laut Und "
    "El La Los Las Un Una En Después Cuando Si Dónde Qué Le Les Une Des Où Après Quand Il Elle On Ce Cette "
    "В На По Из Где Это Он Она Они Мы Когда После Если"
).split()
# Verbs of saying, after a quotation with a name before them.
SAYING = "asked said says wrote replied answered shouted added whispered cried fragte sagte rief preguntó dijo demanda dit"
# Names of days and months that follow a time or a day's number.
DATES = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August "
    "September October November December Januar Februar März Mai Juni Juli Oktober Dezember"
)


def _words(text: str) -> str:
    return "(?:" + "|".join(text.split()) + ")"


class Words(NamedTuple):
    """The pattern of a full stop after one of ``words``, before which no letter or digit stands."""

    words: str

    def pattern(self) -> str:
        return rf"(?<![^\W_]){_words(self.words.replace('.', r'[.]\s?'))}\.$"


def _lower(extra: str = "") -> str:
    return rf"\s*{_OPEN}[{_LOW}]{extra}"


#: (break?, pattern that ends at the position, pattern that begins there)
Rule = tuple[bool, str | Words, str]

#: What stands before a mark and is no name of a file or host.
_TOKEN = r"[^\s.@/_\\]*+"
_QUOTE = "[\"'”’»›」』》〉“]"

FIRST: list[Rule] = [
    # a number, or a dot before one
    (False, r"\.$", r"\d"),
    # what cannot begin a sentence
    (False, r"", r"\s*[,;:،؛，；、：\])}）]"),
    # the number sign, and the answer "no"
    (True, r"\b(?:was|is|were|be|said|says|answer|answered|simply|just)\s+no\.$", r"\s"),
    (False, r"(?:^|\W)(?:[Nn]os?|N[oº]|[Pp]|[Pp]p|[Ss])\.$", r"\s?\d"),
    # file and host names: no blank follows and no sentence begins
    (False, r"(?<![^\W_])[A-Z][a-z]?\.$", r"[A-Z]\."),
    (True, rf"(?:^|\s){_TOKEN}(?<=[^\W\d_]{{2}})\.$", rf"{_OPEN}[{_UP}](?:[{_LOW}’']*[\s,;:-]|[{_LOW}]{{0,3}}\.\s|[{_LOW}]+[.!?]?$)"),
    (True, rf"(?:^|\s){_TOKEN}(?<=\d)\.$", rf"{_OPEN}[{_UP}][{_LOW}]*[\s,;:-]"),
    (True, rf"[{_FLAT}]{{3,}}\.$", rf"[{_FLAT}]"),
    (True, r"[!?…]$", rf"{_OPEN}(?:[{_UP}]|[{_FLAT}]|\d)"),
    (True, rf"\.[\"”»)\]’“]+$", rf"{_OPEN}[{_UP}]"),
    (False, r"(?<![。！？｡।॥؟۔])[.!?…\"'”’»›)\]}“]$", r"[^\s]"),
    # a quotation whose sentence goes on
    (False, rf"{_QUOTE}$", r"\s*[—–-]\s"),
    (False, rf"[!?！？؟‼⁉…।॥]+{_QUOTE}$", rf"\s*[\u0600-ۿऀ-\u0dff]"),
    (False, rf"[!?]{_QUOTE}$", rf"\s+(?!(?:He|She|They|It|We|I|You|Er|Sie|Il|Elle|On)\b)[{_UP}][\w’'-]*\s+{_words(SAYING)}\b"),
    # Japanese particles after a closing bracket
    (False, r"[」』）】》〉”]$", r"\s?[ぁ-ゖ]"),
    # Chinese: said without a colon before the quotation
    (False, r"(?:^|[。！？\s])[“「『][^“”「」『』]*[！？…][”」』]$", rf"[{_CJK}]{{0,8}}?[说問问道喊叫答]"),
    (False, r"(?<![：:，,])[“「『][^“”「」『』]*[！？…]+[”」』]$", rf"[{_CJK}]"),
    # Chinese and Japanese ellipsis in the middle
    (False, r"…$", rf"[{_CJK}]"),
]

LAST: list[Rule] = [
    # an ellipsis, a quotation or a bracket after which the sentence goes on
    (False, r"(?:…|\.\.)[\"'”’»›)\]]*$", _lower()),
    (False, r"[.!?…](?:[\"'”’»›)\]“]|\s»)+$", _lower()),
    # initials and single letters, unless a new sentence plainly begins
    (True, rf"(?<![^\W_])(?:[A-Z]\.){{2}}$", rf"\s+(?:{'|'.join(STARTERS)})\b"),
    (False, rf"(?<![^\W_])[{_UP}]\.$", rf"\s+(?!(?:{'|'.join(STARTERS)})\b)"),
    (False, rf"(?<![^\W_])[{_LOW}]\.$", r"\s+"),
    (False, rf"(?<![^\W_])(?:[{_UP}]\.){{2}}$", r"\s+"),
]

BY_LANGUAGE: dict[str, list[Rule]] = {
    "en": [
        (False, Words(NEVER["en"]), r"\s"),
        (False, Words(MAYBE["en"]), rf"\s+(?:{_words(DATES)}\b|{_OPEN}[{_LOW}])"),
        (True, Words(MAYBE["en"]), r"\s+"),
        (False, Words("Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"), r"\s+\d"),
    ],
    "de": [
        (False, Words(NEVER["de"]), r"\s"),
        (False, Words(MAYBE["de"]), _lower()), (True, Words(MAYBE["de"]), r"\s+"),
        (False, r"(?:^|\s)\d{1,2}\.$", rf"\s+{_words(DATES)}\b"),
        (False, r"\b(?:[Aa]m|[Ii]m|[Vv]om|[Zz]um|[Bb]eim|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Dd]em|[Dd]es|[Jj]ede[rsnm]?|[Ss]eit|[Bb]is)\s+\d{1,2}\.$", rf"\s+[{_UP}{_LOW}]"),
        (False, Words("z.B z.T z.b Z.B Z.T Z.b d.h v.a u.a i.d.R"), r"\s"),
    ],
    "es": [(False, Words(NEVER["es"]), r"\s"), (False, Words(MAYBE["es"]), _lower()), (True, Words(MAYBE["es"]), r"\s+")],
    "fr": [(False, Words(NEVER["fr"]), r"\s"), (False, Words(MAYBE["fr"]), _lower()), (True, Words(MAYBE["fr"]), r"\s+")],
    "ru": [
        (False, Words(NEVER["ru"]), r"\s"),
        (True, r"\bт\.\s?[дп]\.$|\bдр\.$|\d\s?(?:г|гг|руб|коп|тыс|млн|кг)\.$", rf"\s+{_OPEN}[{_UP}]"),
        (False, Words(MAYBE["ru"]), rf"\s+{_OPEN}[{_LOW}]"),
        (False, Words("г"), rf"\s+[{_UP}]"),
    ],
    "el": [
        (False, Words(NEVER["el"]), r"\s"),
        (True, r"(?:λπ|τ\.\s?λ|[κπμ]\.\s?[άαμ])\.$", rf"\s+{_OPEN}[{_UP}]"),
        (False, Words(MAYBE["el"]), _lower()), (True, Words(MAYBE["el"]), r"\s+"),
    ],
    "hi": [(False, Words(NEVER["hi"]), r"\s")],
    "ar": [(False, r"(?<![^\W_])[ء-ي]\.$", r"\s")],
}
#: The languages whose tables apply after a letter of a script.
LATIN, CYRILLIC, GREEK, INDIC, ARABIC = ("en", "de", "es", "fr"), ("ru",), ("el",), ("hi",), ("ar",)

#: Characters before the marks that a pattern without a part of any length can see; others look back as far as they need.
_NEAR = 24
_ENDS = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA0, 0x3100), *range(0xFF00, 0xFF70)]) if re.match(f"{_MARKS}|{_CLOSERS}|[;\u037e»]", c)]


class _First(NamedTuple):
    """What a pattern can begin with: blanks (None: as it likes, else whether they must be there), then a sign of ``sign`` (None: any or none)."""

    blank: bool | None
    sign: re.Pattern | None

    def allows(self, blank: bool, sign: str) -> bool:
        if self.blank and not blank:
            return False
        if self.blank is False and blank:
            return self.sign is None or bool(self.sign.match(" "))
        return self.sign is None or bool(self.sign.match(sign))


_ELEMENT = re.compile(r"(\[(?:[^\]\\]|\\.)*\]|\\[sd]|[\w/])([*+?]?)")


def _first(after: str) -> _First:
    """``_First`` of a pattern, read off its leading elements; where they are not plain, nothing is ruled out."""
    blank: bool | None = False
    at = 0
    if after.startswith("\\s"):
        follows = after[2:3]
        blank, at = (None if follows in ("*", "?") else True), 3 if follows in ("*", "?", "+") else 2
    classes = []
    while m := _ELEMENT.match(after, at):
        classes.append(m.group(1))
        if m.group(2) not in ("*", "?"):
            return _First(blank, re.compile("|".join(classes)))
        at = m.end()
    return _First(None if blank is False else blank, None)


class _Test(NamedTuple):
    """A rule made ready: a bit of ``Table.held`` for words, else a pattern, what must stand before its last sign, and what ends its way back."""

    breaks: bool
    after: Callable
    bit: int
    before: Callable
    tail: Callable | None
    far: re.Pattern | None


class Table(NamedTuple):
    """Rules by the character before the position, and the bits of the rules that each word belongs to, words with a stop inside apart.

    ``near`` narrows the rules to those that can match given what follows: a
    blank or none, and the first character that is none.
    """

    tests: dict[str, list[tuple[_Test, _First]]]
    near: dict[tuple[str, bool, str], list[_Test]]
    held: dict[str, int]
    dotted: dict[str, int]
    sizes: list[int]

    def given(self, last: str, blank: bool, sign: str) -> list[_Test]:
        key = (last, blank, sign)
        if (found := self.near.get(key)) is None:
            found = self.near[key] = [test for test, first in self.tests[last] if first.allows(blank, sign)]
        return found


def _may_end(before: str, c: str) -> bool:
    """Whether a text that ends in ``c`` can match; decided by the pattern's last element where that is plain."""
    if before.endswith("\\.$") and "|" not in before.rsplit(")", 1)[-1]:
        return c == "."
    m = re.search(r"(\[(?:[^\]\\]|\\.)*\])\+?\$$", before)
    return not m or bool(re.match(m.group(1), c))


def _looks_back_to(before: str) -> re.Pattern | None:
    """What ends the way back for a pattern with a part of any length: a quotation, a token or blanks."""
    if "[“「『]" in before:
        return re.compile("[“”「」『』]")
    if _TOKEN in before:
        return re.compile(r"[\s.@/_\\]")
    return re.compile(r"\S\s") if r"\s+" in before else None


def _tail(before: str) -> Callable | None:
    """The test of the character before a full stop at the end, where the pattern's last element says it plainly."""
    m = re.search(r"(\[(?:[^\]\\]|\\.)*\]|\\d)(?:\+|\{\d(?:,\d)?\})?\\\.\$$", before) or re.search(r"[+)\]}]([^\W\d_])+\\\.\$$", before)
    return re.compile(m.group(1)).match if m and not re.search(r"\|(?![^(]*\))", before) else None


def _compile(rules: Iterable[Rule]) -> Table:
    held: dict[str, int] = {}
    made = []
    for i, (breaks, before, after) in enumerate(rules):
        bit = 0
        if isinstance(before, Words):
            bit = 1 << i
            for w in before.words.split():
                held[w] = held.get(w, 0) | bit
            before = before.pattern()
        made.append((before, _Test(breaks, re.compile(after).match, bit, re.compile(before).search, _tail(before), _looks_back_to(before)), _first(after)))
    tests = {c: [(test, first) for before, test, first in made if _may_end(before, c)] for c in _ENDS}
    dotted = {w: bits for w, bits in held.items() if "." in w}
    return Table(tests, {}, {w: bits for w, bits in held.items() if w not in dotted}, dotted, sorted({len(w) for w in held if w not in dotted}))


_FIRST, _LAST = _compile(FIRST), _compile(LAST)
_TABLES = {langs: _compile(r for lang in langs for r in BY_LANGUAGE[lang]) for langs in (LATIN, CYRILLIC, GREEK, INDIC, ARABIC)}
_NO_TABLE = _compile([])
_GREEK = re.compile("[Ͱ-Ͽἀ-\u1fff]")
_SIGN = re.compile(_MARKS + "|[;;]")
_STOP_BLANK = re.compile(r"\.\s")


def _reach(text: str, low: int, at: int, far: re.Pattern) -> int:
    """A place before ``at``, ``low`` or earlier, after which there is a ``far`` before the last character, and a word before that."""
    stop = at - 1
    while low > 0 and not far.search(text, low, stop):
        low, stop = max(0, low - _BACK), low + 1
    return max(0, low - _BACK)


#: Characters read at a time on the way back to what a pattern looks for.
_BACK = 60


def _rules_of(text: str, at: int, table: Table) -> int:
    """The bits of the word rules that hold for the word before the full stop at ``at - 1``."""
    stop, bits = at - 1, 0
    for size in table.sizes:
        i = stop - size
        if i < 0:
            break
        found = table.held.get(text[i:stop])
        if found and not (i and text[i - 1].isalnum()):
            bits |= found
    if table.dotted and "." in (tail := text[max(0, stop - _NEAR) : stop]):
        tail = _STOP_BLANK.sub(".", tail)
        for word, found in table.dotted.items():
            if tail.endswith(word) and not (len(tail) > len(word) and tail[-len(word) - 1].isalnum()):
                bits |= found
    return bits


def _script_table(text: str, start: int, at: int) -> Table:
    """The table of the script of the last letter before the mark."""
    i = at - 1
    while i >= start and not text[i].isalpha():
        i -= 1
    if i < start:
        return _TABLES[LATIN]
    c = text[i]
    if "Ѐ" <= c <= "ԯ":
        return _TABLES[CYRILLIC]
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "\u1fff":
        return _TABLES[GREEK]
    if "ऀ" <= c <= "\u0dff":
        return _TABLES[INDIC]
    if "\u0600" <= c <= "ۿ":
        return _TABLES[ARABIC]
    return _TABLES[LATIN] if c < "\u0300" or "Ḁ" <= c <= "ỿ" else _NO_TABLE


def _decide(text: str, start: int, mark: int, at: int, end: int) -> bool:
    """Whether a sentence ends at ``at``: the first rule of the three tables whose patterns match says so, without any it does.

    ``start`` and ``end`` bound the block, the marks begin at ``mark``.
    """
    low = max(0, mark - _NEAR)
    last, i = text[at - 1], at
    while i < end and text[i].isspace():
        i += 1
    blank, sign = i > at, text[i] if i < end else ""
    for table in (_FIRST, _script_table(text, start, at), _LAST):
        bits = -1
        for breaks, after, bit, before, tail, far in table.given(last, blank, sign):
            if bit:
                if bits < 0:
                    bits = _rules_of(text, at, table)
                if bits & bit and after(text, at, end):
                    return breaks
            elif (tail is None or tail(text, at - 2)) and after(text, at, end) and before(text, _reach(text, low, at, far) if far else low, at):
                return breaks
    return True


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, first place of a mark, end) of the stretches between empty lines and bullets."""
    start = first = -1
    end = at = 0
    size = len(text)
    while at <= size:
        m = _LINE.search(text, at)
        stop, after = (m.start(), m.end()) if m else (size, size + 1)
        line = text[at:stop]
        if not line.strip():
            if start >= 0:
                yield start, first, end
            start = -1
        else:
            bullet = _BULLET.match(text, at, min(size, stop + 1))
            if bullet and bullet.end() <= stop and start >= 0:
                yield start, first, end
                start = -1
            if start < 0:
                start, first = at, bullet.end() if bullet else at
            end = stop
        if m and m.group() == "\u2029" and start >= 0:
            yield start, first, end
            start = -1
        at = after
    if start >= 0:
        yield start, first, end


def _closes(text: str, start: int, m: re.Match) -> int:
    """The end of the candidate: quotes that open something new are left out."""
    end = m.end()
    if text[m.start()] == ";" and not _GREEK.match(text, max(0, m.start() - 1)):
        return start
    sign = m.start()
    for i in range(m.start(), m.end()):
        c = text[i]
        if _SIGN.match(c) and (c != ";" or _GREEK.match(text, max(0, i - 1))):
            sign = i
        elif c == "“" and text.count("„", start, i) <= text.count("“", start, i):
            return i
        elif c == "»" and text.count("«", start, i) <= text.count("»", start, i):
            return sign + 1
        elif c == '"' and text.count('"', start, i) % 2 == 0:
            return i
        elif c == "'" and i + 1 < len(text) and text[i + 1].isalnum():
            return i
    return end


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text``, without the blanks around it; null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    thai = not text.isascii() and _THAI.search(text)
    for start, first, end in _blocks(text):
        cuts = []
        for m in _CANDIDATE.finditer(text, first, end):
            at = m.end()
            if at - m.start() > 1:
                at = _closes(text, start, m)
            elif text[at - 1] == ";" and not _GREEK.match(text, max(0, at - 2)):
                continue
            if start < at < end and _decide(text, start, m.start(), at, end):
                cuts.append(at)
        if thai:
            cuts += [m.start() for m in _THAI_BLANK.finditer(text, first, end)]
            cuts = sorted(set(cuts))
        last = start
        for cut in cuts:
            add(last, cut)
            last = cut
        add(last, end)
    return out


SCHEMA = "doc_id bigint, start_pos int, end_pos int"


def split_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos): one row per sentence of ``documents`` (doc_id, text).

    Positions count Unicode characters.  The documents are only mapped, never
    shuffled.  Null, empty and blank texts have no sentences; repeated rows
    give their sentences each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for a, b in sentence_spans(text):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "start_pos": pd.Series(starts, dtype="int32"), "end_pos": pd.Series(ends, dtype="int32")})

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInPandas(run, SCHEMA)
