"""Problem 7: held-out passages inside documents.

One Aho-Corasick automaton holds the normalised items, cut into pieces of
half the words (for items in scripts without blanks: characters) that make a
leak.  Any shared run that is long enough holds a whole piece, so each
document is normalised and scanned once; where a piece is found the run is
followed to both sides, and its place is mapped back to the original text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepmill.llm.charforms import _NEAR, _PROTO, FORMS, HOLES, INVISIBLES, LATIN_VARIANTS, _ranges, extend, look_alikes
from stepmill.session import fits, spread, table_folder

_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[㐀-鿿豈-﫿\U00020000-\U0003ffff]")

#: Characters as they are compared: invisible ones gone, width forms plain,
#: look-alikes as the Latin letter they resemble.
_FOLD: dict[int, str] = {}
#: Finds out fast whether the table is needed; all astral characters go to it.
_FOLDS = re.compile("")


def refold(more: dict[str, str]) -> None:
    """Make the tables of this process from those of problem 1 with ``more`` look-alikes."""
    global _FOLDS
    if not extend(more) and _FOLD:
        return
    _FOLD.update({ord(c): "" for c in INVISIBLES} | FORMS)
    _FOLD.update({ord(a): b for a, b in [*_PROTO.items(), *_NEAR.items(), *LATIN_VARIANTS.items(), *HOLES.items()] if b[0] != "\x00"})
    _FOLDS = re.compile("[" + "".join(_ranges(chr(c) for c in _FOLD if c < 0x10000)) + "\U00010000-\U0010ffff]")


refold({})


def fold(text: str) -> str:
    """``text`` without what problem 1 and letter case distinguish.

    Capitals are compared by their own look before case goes (a Greek capital
    nu is an N, a small one a v); the table is used only where it is needed.
    """
    if text.isascii():
        return text.lower()
    if _FOLDS.search(text):
        text = text.translate(_FOLD)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.casefold()
    if not text.isascii() and _FOLDS.search(text):
        text = text.translate(_FOLD)
    return text


def words(text: str) -> list[str]:
    """The runs of letters or digits of the folded text."""
    return _WORD.findall(fold(text))


def without_blanks(text: str) -> bool:
    """Whether most letters of the text are Chinese characters."""
    letters = [c for c in text if c.isalpha()]
    return len(letters) > 0 and len(_HAN.findall(text)) * 2 > len(letters)


class Passages:
    """The items made ready to be looked for: their words or characters, and the automaton of their pieces.

    The pieces do not overlap, so the automaton grows with the items' text and
    not with the number of runs in it.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], min_words: int, min_chars: int) -> None:
        import ahocorasick

        self.items: list[tuple[int, list[str] | str]] = []
        self.least = {True: min_words, False: min_chars}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            found = words(text) if text else []
            by_words = not without_blanks(text or "")
            units = found if by_words else "".join(found)
            size = (self.least[by_words] + 1) // 2
            if len(units) < self.least[by_words]:
                continue
            for k in range(0, len(units) - size + 1, size):
                piece = f" {' '.join(units[k : k + size])} " if by_words else units[k : k + size]
                pieces.setdefault(piece, []).append((len(self.items), k))
            self.items.append((item, units))
        self.by_words = any(isinstance(units, list) for _, units in self.items)
        self.by_chars = any(isinstance(units, str) for _, units in self.items)
        self.automaton = ahocorasick.Automaton()
        for piece, held in pieces.items():
            self.automaton.add_word(piece, (len(piece), held))
        self.automaton.make_automaton()

    def shared(self, found: list[str], by_words: bool) -> dict[int, list[tuple[int, int]]]:
        """By item, the stretches [start, end) of ``found`` (words, or their characters) that it shares, in order and apart."""
        line = f" {' '.join(found)} " if by_words else "".join(found)
        hits = list(self.automaton.iter(line)) if self.items else []
        if not hits:
            return {}
        place = range(len(line))
        if by_words:
            starts = [0, *accumulate(len(w) + 1 for w in found)]
            place = {at: i for i, at in enumerate(starts)}
        whole = found if by_words else line
        seen: dict[tuple[int, int], int] = {}
        out: dict[int, list[tuple[int, int]]] = {}
        for end, (size, held) in hits:
            at = end + 1 - size
            if by_words and at not in place:
                continue  # a piece of characters that happens to lie inside the line
            at = place[at]
            for n, k in held:
                item, units = self.items[n]
                if isinstance(units, list) != by_words or at < seen.get((n, at - k), 0):
                    continue
                low, shift = k, at - k
                while low > 0 and low + shift > 0 and units[low - 1] == whole[low + shift - 1]:
                    low -= 1
                high = k
                while high < len(units) and high + shift < len(whole) and units[high] == whole[high + shift]:
                    high += 1
                seen[n, shift] = max(high + shift, at + 1)
                if high - low >= self.least[by_words]:
                    out.setdefault(item, []).append((low + shift, high + shift))
        return {item: _merged(spans) for item, spans in out.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joins(ch: str) -> bool:
    """Whether a character (as it is compared) may change the one before it: a mark, a vowel or end of a Korean syllable, or nothing."""
    new = _FOLD.get(ord(ch), ch)
    return not new or unicodedata.category(new[0])[0] == "M" or "\u1160" <= new[0] <= "\u11ff"


def folded_places(text: str) -> tuple[str, list[int], list[int]]:
    """``fold(text)`` with, for each of its characters, the start and end of what it stands for in ``text``.

    The text is folded in pieces that do not touch each other: a character
    with the marks and invisible characters after it.  Invisible characters at
    the end of a piece belong to none.
    """
    out, starts, ends = [], [], []
    at, size = 0, len(text)
    while at < size:
        end = at + 1
        while end < size and not text[end].isascii() and _joins(text[end]):
            end += 1
        new = fold(text[at:end])
        last = end
        while last > at + 1 and not _FOLD.get(ord(text[last - 1]), "x"):
            last -= 1
        out.append(new)
        starts += [at] * len(new)
        ends += [last] * len(new)
        at = end
    return "".join(out), starts, ends


def leaks_in(passages: Passages, text: str) -> list[tuple[int, int, int]]:
    """(item, start, end) of every shared stretch of ``text``, in its own positions."""
    found = words(text)
    if not found:
        return []
    by_words = passages.shared(found, True) if passages.by_words else {}
    by_chars = passages.shared(found, False) if passages.by_chars and _HAN.search(text) else {}
    if not by_words and not by_chars:
        return []
    folded, starts, ends = folded_places(text)
    spans = [m.span() for m in _WORD.finditer(folded)]
    out = [(item, starts[spans[a][0]], ends[spans[b - 1][1] - 1]) for item, stretches in by_words.items() for a, b in stretches]
    if by_chars:
        letters = [i for a, b in spans for i in range(a, b)]
        out += [(item, starts[letters[a]], ends[letters[b - 1]]) for item, stretches in by_chars.items() for a, b in stretches]
    return out


SCHEMA = "doc_id bigint, item_id bigint, start_pos int, end_pos int"


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, min_chars: int = 20, most_items: int = 20_000, most_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start_pos, end_pos): every stretch of ``documents`` (doc_id, text) taken from ``items`` (item_id, text).

    The items are held-out material; one automaton holds up to ``most_items``
    of them with up to ``most_chars`` characters (checked before they are sent
    to the executors), larger sets are scanned in blocks of that size.  Every
    document is scanned whole, where it lies: nothing is shuffled.  Null and
    blank texts have no leaks.
    """
    wanted = items.select("item_id", "text").where("text is not null and item_id is not null")
    if not fits(wanted, most_items, most_chars):
        return find_leaks_in_blocks(documents, wanted, min_words, min_chars, most_items, most_chars)
    held = [(r.item_id, r.text) for r in wanted.orderBy("item_id").collect()]
    return _scan(documents, held, min_words, min_chars)


def find_leaks_in_blocks(documents: DataFrame, items: DataFrame, min_words: int, min_chars: int, most_items: int, most_chars: int) -> DataFrame:
    """``find_leaks`` for more items than one automaton should hold: one scan for each block of items.

    The driver holds one block at a time; what it finds is written to the
    shared folder before the next one comes.
    """
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(-(-size.n // most_items), -(-(size.chars or 0) // most_chars)) * 2
    folder = table_folder(items.sparkSession, "leaks")
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        _scan(documents, [(r.item_id, r.text) for r in part.collect()], min_words, min_chars).write.parquet(f"{folder}/block={k}")
    return items.sparkSession.read.schema(SCHEMA).parquet(*[f"{folder}/block={k}" for k in range(blocks)])


def _scan(documents: DataFrame, held: list[tuple[int, str]], min_words: int, min_chars: int) -> DataFrame:
    more = look_alikes(documents.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refold(more)
        passages = Passages(held, min_words, min_chars)
        for batch in batches:
            rows = []
            if passages.items:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    rows += [(doc, *x) for x in leaks_in(passages, text)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_pos", "end_pos"]).astype({"doc_id": "Int64", "item_id": "int64", "start_pos": "int32", "end_pos": "int32"})

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInPandas(run, SCHEMA)
