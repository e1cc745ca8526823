import random

from stepmill.llm import leaks as m

ITEMS = [
    (1, "The elder gardener needs to reroute half a dozen beehives outside the ropeworks in Mistrel although the quarter closes on August 25."),
    (2, "住在河边的木匠打算修理半车干薰衣草，地点在老城墙南侧的第12号院子。手续费恰好435个银币须用硬币支付。"),
    (3, "too short to leak"),
    (4, None),
    (5, ""),
]
PART = "elder gardener needs to reroute half a dozen beehives outside the ropeworks"


def _found(spark, docs, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint, start_pos int")
    i = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return m.find_leaks(d, i, **more)


def test_passages_are_found_with_their_places(spark):
    docs = [
        (10, f"Before. {PART} after", 1, 1), (11, f"x {PART.upper()}! y", 1, 1), (12, PART.replace(" ", "\r\n"), 1, 1), (13, PART.replace("gardener", "gаrdener").replace(" ", "\u00a0"), 1, 1),
        (14, PART.replace("half a", "half the"), 1, 1), (15, PART.rsplit(" ", 1)[0], 1, 1), (16, "前言。河边的木匠打算修理半车干，薰衣草 地点在老城\n墙南侧了", 1, 1), (17, "河边的木匠打算修理半车干薰衣草地点在老", 1, 1),
        (18, None, 1, 1), (19, "", 1, 1), (20, " \n", 1, 1), (21, "filler " * 50_000 + PART, 1, 1), (10, f"Before. {PART} after", 1, 1), (22, "x" + PART, 1, 1), (23, "หน้าเว็บ " + PART, 1, 1),
    ]
    text = {d[0]: d[1] for d in docs}
    got = [tuple(r) for r in _found(spark, docs).collect()]
    assert {(d, i) for d, i, *_ in got} == {(10, 1), (11, 1), (12, 1), (13, 1), (16, 2), (21, 1), (23, 1)}
    for d, i, a, b in got:
        assert m.words(text[d][a:b]) == m.words(PART) or i == 2
    assert {text[d][a:b] for d, i, a, b in got if i == 2} == {"河边的木匠打算修理半车干，薰衣草 地点在老城\n墙南侧"}


def test_blocks_of_items_give_the_same(spark):
    docs = [(1, f"a {PART} b", 0, 0), (2, ITEMS[1][1], 0, 0)]
    one = {tuple(r) for r in _found(spark, docs).collect()}
    assert one == {tuple(r) for r in _found(spark, docs, most_items=1).collect()} == {tuple(r) for r in _found(spark, docs, most_chars=40).collect()} and len(one) == 2


def test_places_are_exact_whatever_stands_around():
    passage = "住在河边的木匠打算修理半车干薰衣草，地点在老城墙"
    passages = m.Passages(ITEMS, 12, 20)
    for odd in ("İ", "ΐ", "e\u0301\u0301", "\u200b", "ﬃ", "ｶﾞ", "ﾡￂ", "각", "İ\u200bﬁ", "\u0301", "ß", "한국"):
        for text, part in ((f"{odd} x{odd}y {PART} {odd} z{odd}", PART), (f"{odd}前{odd} {passage}{odd}", passage)):
            (one,) = m.leaks_in(passages, text)
            assert text[one[1] : one[2]].rstrip("\u0301") == part, odd  # marks belong to their character


def test_pieces_fold_as_the_whole_text():
    rnd = random.Random(4)
    signs = [chr(c) for c in (*range(0x20, 0x180), *range(0x300, 0x340), *range(0x370, 0x400), *range(0x1100, 0x1120), *range(0x1160, 0x1180), *range(0x11A8, 0x11B0), 0x200B, 0x200D, 0xFEFF, *range(0xFF01, 0xFFDD), 0xAC00, 0x1D400, 0x9C7, 0x9BE, 0x130, 0x1E9E)]
    for _ in range(4000):
        text = "".join(rnd.choices(signs, k=rnd.randint(1, 12)))
        folded, starts, ends = m.folded_places(text)
        assert folded == m.fold(text), [hex(ord(c)) for c in text]
        assert len(starts) == len(ends) == len(folded) and all(0 <= a < b <= len(text) for a, b in zip(starts, ends, strict=True))


def test_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=20))) for i in range(5)]
    docs = [(i, ", ".join(rnd.choices(vocabulary, k=60))) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in m.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), min_words=4).collect()}
    want = set()
    for d, t in docs:
        w = m.words(t)
        for i, x in items:
            y = m.words(x)
            if {tuple(w[k : k + 4]) for k in range(len(w) - 3)} & {tuple(y[k : k + 4]) for k in range(len(y) - 3)}:
                want.add((d, i))
    assert got == want and want


def test_stretches_are_those_of_all_runs():
    rnd = random.Random(8)
    for least in (1, 2, 3, 4, 5, 7, 12):
        for _ in range(60):
            units = [rnd.choices(["ab", "c", "ddd"], weights=[5, 1, 1], k=rnd.randint(0, 25)) for _ in range(3)]
            text = ", ".join(x for u in rnd.choices(units, k=3) for x in u[rnd.randint(0, 5) :]) + " c"
            found = m.words(text)
            want = {}
            for i, u in enumerate(units):
                runs = {tuple(u[k : k + least]) for k in range(len(u) - least + 1)}
                inside = [(k, k + least) for k in range(len(found) - least + 1) if tuple(found[k : k + least]) in runs]
                if inside:
                    want[i] = m._merged(inside)
            assert m.Passages([(i, " ".join(u)) for i, u in enumerate(units)], least, 20).shared(found, True) == want
            chars = ["".join(rnd.choices("河边木", k=rnd.randint(0, 30))) for _ in range(3)]
            line = "".join(rnd.choices(chars, k=2)) + "木"
            want = {}
            for i, u in enumerate(chars):
                inside = [(k, k + least) for k in range(len(line) - least + 1) if line[k : k + least] in {u[j : j + least] for j in range(len(u) - least + 1)}]
                if inside:
                    want[i] = m._merged(inside)
            assert m.Passages(enumerate(chars), 12, least).shared([line], False) == want


def test_empty_tables(spark):
    assert _found(spark, []).count() == 0
    d = spark.createDataFrame([(1, PART)], "doc_id bigint, text string")
    assert m.find_leaks(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
