"""Tokens, renderings and field clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepmill.functions.schema import ATTRS

# The three wordings of the element question.
PHRASINGS = {
    "a": "Given the goal and previous actions, which candidate element should be acted on next?",
    "b": "Which one of the listed elements is the right next target for this goal?",
    "c": "Pick the element to interact with next to make progress on the task.",
}
# The instructions of a training record.
ELEMENT_INSTRUCTIONS = "Which element should be acted on?"
OPERATION_INSTRUCTIONS = "What operation should be performed on the target element?"

_EDGES = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in lower case; null gives the empty array."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def _attr(cand: Column, key: str) -> Column:
    return cand.getField("attrs").getField(key)


def attr_values(cand: Column) -> Column:
    """The attribute values of a candidate, in order, joined by blanks."""
    return F.concat_ws(" ", *[_attr(cand, k) for k in ATTRS])


def candidate_tokens(cand: Column) -> Column:
    """Tokens of text, tag, role and of the keys and values of the attributes that are there."""
    named = [F.when(_attr(cand, k).isNotNull(), F.concat_ws(" ", F.lit(k), _attr(cand, k))) for k in ATTRS]
    return tokens(F.concat_ws(" ", cand.getField("text"), cand.getField("tag"), cand.getField("role"), *named))


def overlap(a: Column, b: Column) -> Column:
    """How many tokens two token arrays share."""
    return F.size(F.array_intersect(a, b))


def query_tokens(goal: Column, previous: Column) -> Column:
    """Tokens of the goal and of the last previous action."""
    last = F.when(F.size(previous) > 0, F.element_at(previous, -1))
    return F.array_union(tokens(goal), tokens(last))


def value_overlap(goal: Column, cand: Column) -> Column:
    """Shared tokens of goal and text with attribute values only (no tag, role or keys)."""
    return overlap(tokens(goal), tokens(F.concat_ws(" ", cand.getField("text"), attr_values(cand))))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three then being dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def python_repr(text: Column) -> Column:
    """A string as Python's repr writes it; null is None.

    Printable characters stay; others become escapes by code point, worked out
    character by character only where one occurs.
    """
    odd = r"[\p{C}\p{Z}&&[^ ]]"
    esc = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(F.replace(F.replace(esc, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        digits = F.lower(F.hex(code))
        return F.when(~ch.rlike(odd), ch).when(code < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))).when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))

    esc = F.when(esc.rlike(odd), F.array_join(F.transform(F.split(esc, ""), one), "")).otherwise(esc)
    double = text.contains("'") & ~text.contains('"')
    quoted = F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(quoted, F.lit("None"))


def attrs_repr(cand: Column) -> Column:
    """The attributes that are there as Python writes a dict."""
    parts = [F.when(_attr(cand, k).isNotNull(), F.concat(F.lit(f"'{k}': "), python_repr(_attr(cand, k)))) for k in ATTRS]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _shown(cand: Column, limit: int) -> Column:
    return shorten(F.replace(strip(F.coalesce(cand.getField("text"), F.lit(""))), F.lit("\n"), F.lit(" ")), limit)


def render_candidate(cand: Column, compact: bool = False) -> Column:
    """One line of the candidate table: 80 characters of text with attributes, or 60 without."""
    head = [F.lit("["), cand.getField("idx").cast("string"), F.lit("] <"), F.coalesce(cand.getField("tag"), F.lit("")), F.lit("> role="), F.coalesce(cand.getField("role"), F.lit("None"))]
    line = F.concat(*head, F.lit(' "'), _shown(cand, 60 if compact else 80), F.lit('"'))
    return line if compact else F.concat(line, F.lit(" attrs="), attrs_repr(cand))


def option_label(cand: Column) -> Column:
    """Short name of a candidate, unique by its position."""
    return F.concat(F.lit("["), cand.getField("idx").cast("string"), F.lit("] <"), F.coalesce(cand.getField("tag"), F.lit("")), F.lit('> "'), _shown(cand, 60), F.lit('"'))


def _history_lines(previous: Column, last: int | None) -> Column:
    kept = previous if last is None else F.slice(previous, F.greatest(F.size(previous) - last + 1, F.lit(1)), last)
    none = F.array().cast("array<string>")
    return F.when(F.size(previous) > 0, F.concat(F.array(F.lit("Previous actions:")), F.transform(kept, lambda a: F.concat(F.lit("- "), a)))).otherwise(none)


def render_state(goal: Column, website: Column, domain: Column, previous: Column, cands: Column, compact: bool = False) -> Column:
    """The whole question: goal, site, previous actions (compact: the last two), candidate table."""
    head = F.array(F.concat(F.lit("Goal: "), F.coalesce(goal, F.lit("None"))), F.concat(F.lit("Website: "), F.coalesce(website, F.lit("None")), F.lit(" ("), F.coalesce(domain, F.lit("None")), F.lit(")")))
    table = F.concat(F.array(F.lit("Candidate elements:")), F.transform(cands, lambda c: render_candidate(c, compact)))
    return F.array_join(F.concat(head, _history_lines(previous, 2 if compact else None), table), "\n")


def training_state(goal: Column, previous: Column, cands: Column) -> Column:
    """The compact question without the site line."""
    head = F.array(F.concat(F.lit("Goal: "), F.coalesce(goal, F.lit("None"))))
    table = F.concat(F.array(F.lit("Candidate elements:")), F.transform(cands, lambda c: render_candidate(c, True)))
    return F.array_join(F.concat(head, _history_lines(previous, 2), table), "\n")


def phrasing(variant: str = "a") -> Column:
    """The wording of the element question; an unknown variant is an error."""
    return F.lit(PHRASINGS[variant])


def class_words(classes: Column) -> Column:
    """The first four words of a class attribute that are longer than 2 and no numbers."""
    parts = F.split(strip(F.regexp_replace(classes, "[-_]+", " ")), r"(?U)\s+")
    return F.array_join(F.slice(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$")), 1, 4), " ")


def netloc(href: Column) -> Column:
    """User, host and port of a URL; null where there is none."""
    return F.nullif(F.regexp_extract(href, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))


def compact_attr(value: Column) -> Column:
    """An attribute stripped and cut at 80; null where it is absent or empty (a blank one becomes empty)."""
    return F.when(value != "", F.substring(strip(value), 1, 80))


def ascii_json(value: Column) -> Column:
    """JSON with all other characters escaped and nulls kept."""
    return F.to_json(value, {"writeNonAsciiCharacterAsCodePoint": "true", "ignoreNullFields": "false"})


def clean_value(text: Column) -> Column:
    """Null for empty and 'no input text', else stripped."""
    return F.when((text != "") & (text != "no input text"), strip(text))


def site_of(primary: Column, host: Column) -> Column:
    """The first non-empty of two hosts without one leading ``www.``; empty where there is none."""
    return F.regexp_replace(F.coalesce(F.nullif(primary, F.lit("")), F.nullif(host, F.lit("")), F.lit("")), r"^www\.", "")
