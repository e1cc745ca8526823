from stepmill.llm import overlap as o

SCHEMA = "_annotation_id string, split string, goal string, website string, task string"
WORDS = ["Find a hotel near {} Square in Talgaro from May {} for {} adults", "Buy tickets for the {} quartet in Sennick, row {}, no more than ${} each"]


def _rows(spark, extra=()):
    filler = [(f"f{i}", "train", WORDS[i % 2].format(f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}ix", i % 28 + 1, i + 40), "s", "x") for i in range(60)]
    return spark.createDataFrame([*filler, *extra], SCHEMA)


BASE = "Buy tickets for the Lotapex quartet in Mistrel, row 11, no more than $263 each"


def _pairs(spark, goals):
    rows = _rows(spark, [("t0", "train", BASE, "a", None), *[(f"e{i}", "val", g, "b", None) for i, g in enumerate(goals)]])
    return {(r.eval_task, r.train_task): r.exact for r in o.request_overlaps(rows).collect()}


def test_same_requests_are_found(spark):
    same = [
        BASE, BASE.upper() + "!", BASE.replace(",", " -"), BASE.replace("tickets", "tikcets"), "Please buy" + BASE[3:], "Could you buy" + BASE[3:] + ", thanks", "I want to buy" + BASE[3:] + " please",
        "Buy tickets for the Lotapex quartet in Mistrel no more than $263 each row 11", BASE.replace("Lotapex", "Ｌоtapex").replace(" ", "\u00a0"), "Could you buy" + BASE[3:] + ", tahnks",
    ]
    got = _pairs(spark, same)
    assert set(got) == {(f"e{i}", "t0") for i in range(len(same))}
    assert got["e0", "t0"] and got["e1", "t0"] and not got["e7", "t0"]


def test_other_requests_are_not(spark):
    other = [
        BASE.replace("263", "264"), BASE.replace("11", "12"), BASE.replace("Lotapex", "Lotapix"), BASE.replace("Mistrel", "Sennick"), BASE.replace("11", "263").replace("$263 each", "$11 each"),
        None, "", "  ", "!!!", BASE + " on May 4",
    ]
    assert _pairs(spark, other) == {}


def test_rows_without_split_or_task_are_left_out(spark):
    rows = _rows(spark, [("t0", "train", BASE, "a", None), ("e0", None, BASE, "a", None), ("e1", "", BASE, "a", None), ("e2", "overall", BASE, "a", None), (None, "val", BASE, "a", None), ("t0", "val", BASE, "a", None), ("e3", "cross_domain", BASE, None, None), ("e3", "cross_domain", BASE, None, None)])
    pairs = o.request_overlaps(rows)
    assert {(r.eval_task, r.split, r.train_task) for r in pairs.collect()} == {("e3", "cross_domain", "t0")}
    counts = {(r.split, r.website): (r.tasks, r.tasks_found, r.pairs, r.exact_pairs) for r in o.overlap_counts(rows).collect()}
    assert counts["cross_domain", ""] == (1, 1, 1, 1) and counts["val", "a"] == (1, 0, 0, 0)
    assert {(r.task, r.partners) for r in o.leaked_tasks(rows).collect()} >= {("e3", 1)}
    assert o.request_overlaps(rows.limit(0)).count() == 0


def test_slips():
    for a, b in [("tickts", "tickets"), ("tikcets", "tickets"), ("ticckets", "tickets"), ("tackets", "tickets"), ("ickets", "tickets")]:
        assert o.slip(a, b) and o.slip(b, a)
    for a, b in [("tickets", "tickets"), ("tkets", "tickets"), ("row", "bow-tie"), ("stekcit", "tickets")]:
        assert not o.slip(a, b)


def test_filler_words_and_long_goals():
    assert o.content("i would like to find me a room thanks a lot".split()) == "find me a room".split()
    assert o.content(["please"]) == ["please"]
    assert len(o.tokens("word " * 50_000)[0]) == 50_000


def test_partners_without_pairs_are_those_of_the_pairs(spark):
    party = "Reserve a cabin near Orvik lake for {} adults and {} children with breakfast"
    a, b = party.format(2, 3), party.format(3, 2)
    rows = _rows(spark, [
        ("t1", "train", a, "s", None), ("t2", "train", a, "s", None), ("t3", "train", b, "s", None), ("e1", "val", a, "s", None), ("e2", "val", b, "s", None),
        ("e3", "cross_domain", "Please " + b, "s", None), ("e3", "val", a, "s", None), ("both", "train", BASE, "s", None), ("both", "val", BASE, "s", None), ("t4", "train", BASE, "s", None),
        ("lone", "train", "Read the news of Vennet harbour", "s", None), ("lone", "val", "Read the news of Vennet harbour", "s", None), ("e1", "val", b, "s", None),
        ("m", "train", BASE, "s", None), ("m", "train", "Buy tickets for the Lotapex quartet in Mistrel no more than $263 each row 11", "s", None),
    ])
    pairs = {(r.eval_task, r.split, r.train_task) for r in o.request_overlaps(rows).collect()}
    want = {}
    for e, split, t in pairs:
        want.setdefault((e, split), set()).add(t)
        want.setdefault((t, "train"), set()).add(e)
    got = {}
    for r in o.leaked_tasks(rows).collect():
        got.setdefault((r.task, r.split), []).append((r.request, r.partners))
    assert {k: sum(n for _, n in v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert got["t1", "train"] == got["t2", "train"] and got["t1", "train"][0][0] != got["t3", "train"][0][0]
    assert ("lone", "val") not in got and got["both", "val"][0][1] == 2


def test_slips_are_told_by_shares_at_any_count(spark):
    def right(*counts):
        table = spark.createDataFrame([(w, n, 0, n) for w, n in counts], "word string, df long, caps long, smalls long")
        return {(r.word, r.right) for r in o.corrections(table).collect()}

    for times in (1, 10, 100):
        counts = [("tickts", 2), ("tickets", 160), ("adress", 1), ("address", 20), ("cart", 1), ("card", 20), ("cabin", 1), ("cabins", 10), ("patents", 1), ("patients", 600), ("fr", 40), ("for", 400), ("of", 2), ("or", 200)]
        # a real word is none, unless next to never
        assert right(*((w, n * times) for w, n in counts)) == {("tickts", "tickets"), ("adress", "address"), ("patents", "patients")}
    assert right(("fr", 2), ("for", 200)) == {("fr", "for")}
    assert right(("tickts", 1), ("tickets", 8)) == right(("tickts", 50), ("tickets", 5000)) == {("tickts", "tickets")}
    assert right(("cabin", 200), ("cabins", 1600)) == right(("cabin", 2), ("cabins", 15)) == right(("f", 1), ("fr", 200), ("for", 9)) == set()


def test_neighbours_tell_slips(spark):
    def right(odd):
        seqs = [["buy", "a", "vulmet", "for", f"n{i}"] for i in range(20)] + odd
        table = spark.createDataFrame([(s,) for s in seqs], "words array<string>")
        counts = table.select(o.F.explode("words").alias("word")).groupBy("word").agg(o.F.count("*").alias("df"), o.F.lit(0).alias("caps"), o.F.count("*").alias("smalls"))
        return {(r.word, r.right) for r in o.corrections(counts, table).collect()}

    assert right([["buy", "a", "vulmt", "for", "us"]]) == right([["buy", "the", "vulmt", "for", "us"]]) == {("vulmt", "vulmet")}
    assert right([["read", "no", "vulmt", "today"]]) == set()


def test_real_words_are_not_overwritten(spark):
    card = [(f"t{i}", "train", f"Order a gift card with the sign {chr(97 + i)}{chr(98 + i)}o on it", "s", None) for i in range(20)]
    rows = _rows(spark, [*card, ("a", "train", "buy a red card for the garden", "s", None), ("b", "val", "buy a red cart for the garden", "s", None)])
    assert not {r.eval_task for r in o.request_overlaps(rows).collect()} & {"b"}


def test_exact_is_as_written(spark):
    got = _pairs(spark, [BASE, BASE.upper() + " !", "Please " + BASE, BASE.replace("tickets", "tikcets")])
    assert got == {("e0", "t0"): True, ("e1", "t0"): True, ("e2", "t0"): False, ("e3", "t0"): False}


def test_many_corrections_are_joined(spark):
    goals = o.task_goals(_rows(spark, [("t0", "train", BASE, "a", None), ("e0", "val", BASE.replace("tickets", "tikcets"), "b", None)]))
    few, many = ({(bytes(r.g), bytes(r.bag), r.h, r.raw) for r in o.request_keys(goals, most=most).collect()} for most in (100, 0))
    assert few == many and len(few) == 62
