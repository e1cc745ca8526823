"""Problem 2: the same or nearly the same request in training and evaluation.

Requests are brought to a canonical form (characters of problem 1, case,
punctuation, blanks), slips of spelling are put right from the shares and the
neighbours of words in the corpus, polite and filler words are dropped, and
the remaining words are hashed without regard to their order.  Evaluation
hashes are joined with training hashes; a last check keeps numbers and names
with their clauses.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepmill.llm.charforms import canonicalise, extend, look_alikes
from stepmill.llm.groups import site_key
from stepmill.session import broadcast_if_small, cut, fits

#: Ranks of a public tokenizer: a longer word that is one token of it is a real word of some language.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
EVALUATION = ("val", "cross_website", "cross_domain")
TRAINING = "train"

# Polite and filler phrases at the beginning of a request.
LEADS = [
    "please", "pls", "kindly", "hi", "hello", "hey", "now", "just", "ok", "okay", "so", "well",
    "could you", "can you", "would you", "will you", "could you please", "help me", "help me to",
    "i want to", "i want you to", "i need to", "i need you to", "i wish to", "i would like to", "i d like to", "i d like you to",
    "let s", "let me", "lets", "try to", "go ahead and", "for me",
    "bitte", "bitte mal", "könntest du", "kannst du", "ich möchte", "por favor", "puedes", "podrías", "quiero",
    "s il te plaît", "s il vous plaît", "peux tu", "pouvez vous", "je veux", "je voudrais", "пожалуйста", "прошу", "помоги", "помогите", "хочу",
]
# Polite and filler phrases at its end.
TAILS = [
    "please", "pls", "thanks", "thank you", "thanks a lot", "many thanks", "thx", "for me", "now", "right now", "asap", "if possible", "if you can", "today please",
    "bitte", "danke", "por favor", "gracias", "s il te plaît", "s il vous plaît", "merci", "пожалуйста", "спасибо", "お願いします", "をお願いします", "ください", "してください",
]
# Words that say nothing wherever they stand.
ANYWHERE = frozenset("please pls kindly thanks thank".split())

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ก-๛]|\d+(?:[.,]\d+)*|[^\W\d_぀-ヿ㐀-鿿豈-﫿ก-๛]+")
_GROUPED = re.compile(r"(?<=\d)[,.](?=\d{3}(?:\D|$))")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿ก-๛]")


def tokens(goal: str) -> tuple[list[str], list[int]]:
    """Words of the canonical goal in lower case, and of each whether it is written as a name.

    1: capital inside a goal written in ordinary case; 0: small letter there;
    -1: not to be told (first word, goal in capitals or in title case, digits).
    East Asian characters count one by one.
    """
    text = canonicalise(goal)[0]
    found = _TOKEN.findall(_GROUPED.sub("", text))
    cased = [w for w in found if w[0].isupper() or w[0].islower()]
    plain = len(cased) > 1 and sum(w[0].islower() for w in cased) * 2 >= len(cased)
    flags = [-1 if i == 0 or not plain or not (w[0].isupper() or w[0].islower()) else int(w[0].isupper()) for i, w in enumerate(found)]
    return [w.casefold() for w in found], flags


_TOKENS = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("flags", T.ArrayType(T.IntegerType()))])


def _tokens(goal, more: dict[str, str]):
    """``tokens`` of a column, with ``more`` look-alikes."""

    @F.pandas_udf(_TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        extend(more)
        for goals in batches:
            yield pd.DataFrame([tokens(g) for g in goals], columns=["words", "flags"])

    return run(goal)


def slip(a: str, b: str) -> bool:
    """Whether one letter dropped, doubled, changed or swapped with its neighbour makes ``a`` of ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    return ra[1:] == rb or ra == rb[1:] or ra[1:] == rb[1:] or (len(ra) > 1 and len(rb) > 1 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:])


def _phrases(phrases: list[str]) -> list[list[str]]:
    return sorted((p.split() for p in phrases), key=len, reverse=True)


_LEADS, _TAILS = _phrases(LEADS), _phrases([*TAILS])


def _same(words: list[str], phrase: list[str]) -> bool:
    return len(words) == len(phrase) and all(w == p or (len(p) > 4 and slip(w, p)) for w, p in zip(words, phrase, strict=True))


def content(words: list[str]) -> list[str]:
    """``words`` without the polite and filler ones (a slip in a longer one does not hide it)."""
    words = list(words)
    again = True
    while again:
        again = False
        for p in _LEADS:
            if len(words) > len(p) and _same(words[: len(p)], p):
                words, again = words[len(p) :], True
        for p in _TAILS:
            if _CJK.match(p[0]):
                p = list(p[0])
            if len(words) > len(p) and _same(words[-len(p) :], p):
                words, again = words[: -len(p)], True
    kept = [w for w in words if not any(_same([w], [f]) for f in ANYWHERE)]
    return kept or words


def _deletes(word: str) -> list[str]:
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _delete_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(_deletes)


@F.pandas_udf(T.BooleanType())
def _is_slip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([slip(x, y) for x, y in zip(a, b, strict=True)])


def real_words(path: str | None = VOCABULARY, least: int = 4) -> frozenset[str]:
    """The words of at least ``least`` letters that are one token after a blank; shorter ones are mostly parts of words. None gives no words."""
    found = set()
    if path:
        with open(path, "rb") as lines:
            for line in lines:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                if word[:1] == " " and len(word) > least and word[1:].isalpha():
                    found.add(word[1:].casefold())
    return frozenset(found)


def word_counts(seqs: DataFrame) -> DataFrame:
    """(word, df, caps, smalls) over distinct word sequences (words, flags), before any correction."""
    each = seqs.select(F.posexplode("words").alias("at", "word"), "flags").select("word", F.get("flags", F.col("at")).alias("flag"))
    return each.groupBy("word").agg(F.count("*").alias("df"), F.count_if(F.col("flag") == 1).alias("caps"), F.count_if(F.col("flag") == 0).alias("smalls"))


#: How many times as frequent as a slip the right word is at least, by what the slip is: no known word, one of
#: up to three letters, a real word.
SHARES = (8, 100, 500)


def slip_candidates(counts: DataFrame, vocabulary: str | None = VOCABULARY, least: int = 3) -> DataFrame:
    """(word, right, right_df, real): words that are one slip away from an ordinary word frequent enough beside them.

    How frequent depends on shares alone (``SHARES``), so a corpus ten times
    as large gives the same answer.  Ordinary words are mostly written small
    where case tells.  A word written only with a capital is a name and never
    a slip; numbers are not either; one of two letters only of one of three.
    Words meet only where they share a deletion of one letter, never all with
    all.
    """
    known = real_words(vocabulary)

    @F.pandas_udf(T.BooleanType())
    def is_real(words: pd.Series) -> pd.Series:
        return words.isin(known)

    letters = counts.where((F.length("word") > 1) & ~F.col("word").rlike(r"\d"))
    ordinary = letters.where((F.length("word") > 2) & (F.col("df") >= least) & (F.col("smalls") >= F.col("caps")))
    odd = letters.where((F.col("smalls") > 0) | (F.col("caps") == 0))
    a = odd.select(F.col("word"), "df", F.explode(_delete_keys("word")).alias("key"))
    b = ordinary.select(F.col("word").alias("right"), F.col("df").alias("right_df"), F.explode(_delete_keys("word")).alias("key"))
    near = a.join(b, "key").where((F.col("df") * SHARES[0] <= F.col("right_df")) & (F.col("word") != F.col("right")))
    near = near.select("word", "right", "df", "right_df").distinct().where(_is_slip("word", "right") & ((F.length("word") > 2) | (F.length("right") == 3)))
    need = F.when(F.col("real"), SHARES[2]).when(F.length("word") < 4, SHARES[1]).otherwise(SHARES[0])
    return near.withColumn("real", is_real("word")).where(F.col("df") * need <= F.col("right_df")).drop("df")


def neighbours(seqs: DataFrame) -> DataFrame:
    """(word, before, after) of every place in the sequences (words), all numbers alike."""
    plain = F.transform("words", lambda w: F.when(w.rlike(r"^\d"), "#").otherwise(w))
    triples = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get("w", i - 1)).otherwise("").alias("before"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))
    return seqs.select(plain.alias("w")).select(F.explode(triples).alias("t")).select("t.*")


def corrections(counts: DataFrame, seqs: DataFrame | None = None, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(word, right): the slips of ``slip_candidates`` that stand where the right word stands too.

    With ``seqs`` (words) the neighbours decide: of a word that is not known,
    half the places must have a neighbour that the right word has on that side;
    of a real word all places must have it on both.
    """
    near = slip_candidates(counts, vocabulary)
    if seqs is not None:
        near = cut(near)
        asked = near.select("word").unionAll(near.select(F.col("right").alias("word"))).distinct()
        around = cut(neighbours(seqs).join(broadcast_if_small(asked), "word").distinct())
        places = near.join(around, "word")
        left = around.select(F.col("word").alias("right"), "before", F.lit(True).alias("b")).distinct()
        right = around.select(F.col("word").alias("right"), "after", F.lit(True).alias("a")).distinct()
        met = places.join(left, ["right", "before"], "left").join(right, ["right", "after"], "left")
        same, one = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
        per = met.groupBy("word", "right", "right_df", "real").agg(F.count("*").alias("n"), same.alias("both"), one.alias("one"))
        near = per.where(F.when(F.col("real"), F.col("both") == F.col("n")).otherwise(F.col("one") * 2 >= F.col("n")))
    return near.groupBy("word").agg(F.max_by("right", F.struct("right_df", "right")).alias("right"))


_KEY = T.StructType([T.StructField("bag", T.StringType()), T.StructField("seq", T.ArrayType(T.StringType()))])


def _key(words, fixes: dict[str, str] | None = None):
    """(bag, seq) of a column of words: content words in order, and sorted; ``fixes`` puts slips right first."""

    @F.pandas_udf(_KEY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        right = fixes or {}
        for rows in batches:
            seqs = [content([right.get(w, w) for w in words]) for words in rows]
            yield pd.DataFrame({"bag": [" ".join(sorted(s)) for s in seqs], "seq": seqs})

    return run(words)


def digest(text) -> object:
    """128 bits of a text column, to join by."""
    return F.unhex(F.md5(text))


def bound_alike(a: list[str], b: list[str]) -> bool:
    """Whether every number keeps a neighbour, so that moved clauses took their numbers along.

    Both lists hold the same words.  Words that occur once in either are
    compared by their neighbours; a word is at home if the word before or the
    word after it is the same.
    """
    if a == b:
        return True

    def homes(s: list[str]) -> dict[str, tuple[set[str], set[str]]]:
        out: dict[str, tuple[set[str], set[str]]] = {}
        for i, w in enumerate(s):
            before, after = out.setdefault(w, (set(), set()))
            before.add(s[i - 1] if i else "^")
            after.add(s[i + 1] if i + 1 < len(s) else "$")
        return out

    x, y = homes(a), homes(b)
    for w in x:
        if w[0].isdigit() and not (x[w][0] & y[w][0] - {"^"} or x[w][1] & y[w][1] - {"$"}):
            return False
    # more words than clause ends must keep a neighbour: a few clauses moved, nothing was shuffled
    loose = sum(not (x[w][0] & y[w][0] or x[w][1] & y[w][1]) for w in x)
    return loose * 4 <= len(x)


@F.pandas_udf(T.BooleanType())
def _bound(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bound_alike(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def task_goals(rows: DataFrame) -> DataFrame:
    """(task, side, split, website, goal) of the rows that take part; rows without task, goal or one of the four splits are left out."""
    side = F.when(F.col("split") == TRAINING, "train").when(F.col("split").isin(*EVALUATION), "eval")
    base = rows.select(F.col("_annotation_id").alias("task"), side.alias("side"), "split", "website", "goal")
    return base.where("task is not null and side is not null and trim(goal) <> ''")


def request_keys(goals: DataFrame, vocabulary: str | None = VOCABULARY, most: int = 200_000) -> DataFrame:
    """(g, bag, h, raw, seq) for every distinct goal, by its digest ``g``.

    ``bag`` is the digest of the words without order, ``h`` the hash of ``seq``,
    the words in order; ``raw`` that of the words as they are written, but for
    case, punctuation and blanks.  Only distinct goals go through Python, so
    copies of one goal, however many, cost one row.  Corrections are sent to
    the goals where they are at most ``most`` (and few characters), else
    joined word by word.
    """
    forms = goals.groupBy(digest(F.col("goal")).alias("g")).agg(F.first("goal").alias("goal"))
    forms = forms.withColumn("t", _tokens("goal", look_alikes(goals.sparkSession))).select("g", F.col("t.words").alias("words"), F.col("t.flags").alias("flags"))
    forms = cut(forms.withColumn("raw", F.xxhash64("words")))
    seqs = cut(forms.groupBy("raw").agg(F.first("words").alias("words"), F.max("flags").alias("flags")))
    fixes = cut(corrections(cut(word_counts(seqs)), seqs, vocabulary))
    if fits(fixes, most):
        done = forms.withColumn("k", _key("words", {r.word: r.right for r in fixes.collect()}))
    else:
        each = forms.select("g", F.posexplode("words").alias("at", "word")).join(fixes, "word", "left").select("g", "at", F.coalesce("right", "word").alias("word"))
        fixed = each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).withColumn("k", _key(F.transform("w", lambda x: x.word)))
        done = forms.select("g", "raw").join(fixed, "g")
    return done.select("g", digest(F.col("k.bag")).alias("bag"), F.xxhash64("k.seq").alias("h"), "raw", "k.seq")


def asked(rows: DataFrame, vocabulary: str | None = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(who, keys): the distinct (task, side, split, bag, h, raw), and the keys of the goals as from ``request_keys``; both written."""
    goals = task_goals(rows)
    keys = cut(request_keys(goals, vocabulary))
    each = goals.select("task", "side", "split", digest(F.col("goal")).alias("g")).distinct()
    return cut(each.join(keys.drop("seq"), "g").drop("g").distinct()), keys


def alike_sequences(who: DataFrame, keys: DataFrame) -> DataFrame:
    """(bag, eh, th): the word sequences of evaluation and training that are the same request, by their hashes.

    Equal hashes need no look at the words; different sequences of one bag
    fetch theirs and pass ``bound_alike``.
    """
    sides = cut(who.select("side", "bag", "h").distinct())
    met = sides.where("side = 'eval'").select("bag", F.col("h").alias("eh")).join(sides.where("side = 'train'").select("bag", F.col("h").alias("th")), "bag")
    other = met.where("eh <> th")
    words = keys.join(other.select("bag").distinct(), "bag", "left_semi").groupBy("bag", "h").agg(F.first("seq").alias("seq"))
    both = other.join(words.select("bag", F.col("h").alias("eh"), F.col("seq").alias("es")), ["bag", "eh"]).join(words.select("bag", F.col("h").alias("th"), F.col("seq").alias("ts")), ["bag", "th"])
    return met.where("eh = th").unionByName(both.where(_bound("es", "ts")).select("bag", "eh", "th"))


def request_overlaps(rows: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(eval_task, split, train_task, exact): every pair of an evaluation and a training task with the same request.

    ``exact`` is true where the goals agree as they are written, but for case,
    punctuation, blanks and character forms: before slips are put right and
    fillers dropped.  Requests are compared once per distinct goal and key; the
    pairs of tasks that the result asks for are made only in the last join.
    Null and blank goals, goals without a word, null tasks and other splits
    have no overlaps; a task is never its own partner.
    """
    who, keys = asked(rows, vocabulary)
    alike = alike_sequences(who, keys)
    left = who.where("side = 'eval'").select("bag", F.col("h").alias("eh"), F.col("task").alias("eval_task"), "split", F.col("raw").alias("er"))
    right = who.where("side = 'train'").select("bag", F.col("h").alias("th"), F.col("task").alias("train_task"), F.col("raw").alias("tr"))
    found = alike.join(left, ["bag", "eh"]).join(right, ["bag", "th"]).where(F.col("eval_task") != F.col("train_task"))
    return found.groupBy("eval_task", "split", "train_task").agg(F.max(F.col("er") == F.col("tr")).alias("exact"))


def exact_partners(who: DataFrame) -> DataFrame:
    """(task, split, exact): for every evaluation task the training tasks with a goal of the same words, counted from class sizes."""
    sides = who.select("task", "side", "split", "raw").distinct()
    sizes = sides.where("side = 'train'").select("raw", "task").distinct().groupBy("raw").agg(F.count("*").alias("n"))
    selves = sides.where("side = 'train'").select("raw", "task", F.lit(1).alias("self")).distinct()
    mine = sides.where("side = 'eval'").join(sizes, "raw").join(selves, ["raw", "task"], "left")
    return mine.groupBy("task", "split").agg(F.sum(F.col("n") - F.coalesce("self", F.lit(0))).alias("exact"))


def overlap_counts(rows: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(split, website, tasks, tasks_found, pairs, exact_pairs) per evaluation split and site (as problem 3 tells sites apart, '' for none).

    Pairs are counted from the sizes of request classes and never made: a pair
    of tasks that shares two requests counts for each.  Tasks with rows on
    several sites count on each.
    """
    who, keys = asked(rows, vocabulary)
    tasks = rows.where(F.col("split").isin(*EVALUATION) & F.col("_annotation_id").isNotNull())
    tasks = tasks.select("split", F.coalesce(site_key(F.col("website")), F.lit("")).alias("website"), F.col("_annotation_id").alias("task")).distinct()
    found = partners_of(who, keys).where(F.col("split") != TRAINING).groupBy("task", "split").agg(F.sum("partners").alias("pairs"))
    both = tasks.join(found, ["task", "split"], "left").join(exact_partners(who), ["task", "split"], "left")
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_pairs" if c == "exact" else c)
    return both.groupBy("split", "website").agg(F.count("*").alias("tasks"), F.count("pairs").alias("tasks_found"), some("pairs"), some("exact"))


def classes(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The class of every sequence in ``pairs``: the least one that it is tied to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


_CLASSES = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("class", T.LongType())]))


@F.pandas_udf(_CLASSES)
def _classes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for bags in batches:
        yield bags.map(lambda pairs: [{"h": h, "class": c} for h, c in classes([(p["eh"], p["th"]) for p in pairs]).items()])


def leaked_tasks(rows: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(task, split, request, partners): one row per task of either side with its request class and the number of its partners."""
    return partners_of(*asked(rows, vocabulary))


def partners_of(who: DataFrame, keys: DataFrame) -> DataFrame:
    """``leaked_tasks`` of what ``asked`` gives.

    The form without pairs of tasks: a class holds the word sequences of one
    bag that are tied by the check of ``request_overlaps``; partners are the
    other tasks of the other side that it finds.  Tasks with the same
    sequences in a class are counted together, so only the distinct sets of
    sequences meet; a task with goals on both sides is not its own partner.
    """
    alike = cut(alike_sequences(who, keys))
    tied = alike.groupBy("bag").agg(F.collect_list(F.struct("eh", "th")).alias("pairs")).select("bag", F.explode(_classes("pairs")).alias("c")).select("bag", "c.h", "c.class")
    placed = cut(who.drop("raw").distinct().join(tied, ["bag", "h"]))

    def sets(*by: str) -> DataFrame:
        return placed.groupBy("bag", "class", "side", "task", *by).agg(F.array_sort(F.collect_set("h")).alias("hs"))

    own, whole = cut(sets("split")), cut(sets())
    # the distinct sets of sequences of one side, with the tasks that have them
    sizes = whole.groupBy("bag", "class", "side", "hs").agg(F.count("*").alias("n"))
    near = alike.select(F.lit("eval").alias("side"), "bag", F.col("eh").alias("h"), F.col("th").alias("to")).unionAll(alike.select(F.lit("train"), "bag", "th", "eh"))
    wanted = own.select("bag", "class", "side", "hs").distinct().withColumn("h", F.explode("hs")).join(near, ["side", "bag", "h"])
    held = sizes.select("bag", "class", "side", F.col("hs").alias("other"), "n", F.explode("hs").alias("to")).withColumn("side", F.when(F.col("side") == "eval", "train").otherwise("eval"))
    met = cut(wanted.join(held, ["bag", "class", "side", "to"]).select("bag", "class", "side", "hs", "other", "n").distinct())
    per = met.groupBy("bag", "class", "side", "hs").agg(F.sum("n").alias("n"))
    # a task on both sides whose own sets meet
    twice = whole.select("bag", "class", "task", F.when(F.col("side") == "eval", "train").otherwise("eval").alias("side"), F.col("hs").alias("other"))
    selves = own.join(twice, ["bag", "class", "task", "side"]).join(met.drop("n"), ["bag", "class", "side", "hs", "other"], "left_semi").select("bag", "class", "side", "task", "split", F.lit(1).alias("self"))
    found = own.join(per, ["bag", "class", "side", "hs"]).join(selves, ["bag", "class", "side", "task", "split"], "left")
    found = found.withColumn("partners", F.col("n") - F.coalesce("self", F.lit(0))).where("partners > 0")
    return found.select("task", "split", F.md5(F.concat_ws(":", F.hex("bag"), "class")).alias("request"), "partners")
