import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepmill.llm import charforms as c

CASES = {
    "Ca\u00adfé": "Café",
    "Café": "Café",
    "by\u00a0August": "by August",
    "Ｆｉｎｄ ２": "Find 2",
    "Find rеviеws": "Find reviews",
    "сор\u200by": "copy",
    "Βook а visit": "Book a visit",
    "Рlау аll": "Play all",
    "Покaзaть бoльшe": "Показать больше",
    "в город Ζοrrique": "в город Zorrique",
    "Ⅿatte ⅽlass": "Matte class",
    "ﬁlm": "film",
    "Gерӓck": "Gepäck",
    "Mаíz": "Maíz",
    "Kelvin": "Kelvin",
    "エラ力ー": "エラカー",
}
SAME = [
    "½ price, 25 m², № 7, Brandmark™, 10 × 15, 27″ — ok", "نمی\u200cخواهم", "👩\u200d👧 Family", "❤️", "two  blanks\tand\nlines", "Найти в городе Umbrafield", "Αναζήτηση προϊόντων",
    "ホテルの空室，検索！", "Théâtre à côté", "検索", "", "5 µm", "Хор", "ค้นหา",
]


def test_cases_get_their_ordinary_form():
    for text, plain in CASES.items():
        got, kinds = c.canonicalise(text)
        assert got == plain and kinds, (text, got)
        assert c.canonicalise(got) == (got, 0)


def test_ordinary_texts_stay():
    for text in SAME:
        assert c.canonicalise(text) == (text, 0), text
    assert c.canonicalise(None) == (None, 0)


def test_needless_joiners_go():
    assert c.canonicalise("نمی\u200c\u200cخواهم")[0] == "نمیخواهم" or c.canonicalise("نمی\u200c\u200cخواهم")[1] == c.INVISIBLE
    assert c.canonicalise("ab\u200dc") == ("abc", c.INVISIBLE)


@given(st.text(max_size=60))
def test_canonical_form_is_final(text):
    once, _ = c.canonicalise(text)
    assert c.canonicalise(once)[0] == once


def test_random_spoofs_come_back():
    rnd = random.Random(5)
    back = {}
    for rows in c.LOOKALIKES.values():
        for own, latin in rows:
            for a, b in zip(own, latin, strict=True):
                back.setdefault(b, []).append(a)
    for word in ["Dunwick", "Reviews", "checkout", "parking", "Belmarsh", "quartet"]:
        for _ in range(200):
            spoof = "".join(rnd.choice(back[x]) if x in back and rnd.random() < 0.4 else x for x in word)
            assert c.canonicalise(f"the {spoof} number")[0] == f"the {word} number"


def test_long_text():
    assert c.canonicalise("Fіnd it " * 30_000)[0] == "Find it " * 30_000


def test_state_lines_keep_their_own_words():
    state = 'Goal: Хор\nCandidate elements:\n[0] <a> role=link "Сор"\n[1] <a> role=None "Play аll"'
    got, kinds = c.canonicalise_state(state)
    assert got == state.replace("аll", "all") and kinds == c.SCRIPT


def _rows(spark, data):
    return spark.createDataFrame(data, "id string, goal string, candidates array<struct<idx int, text string, id string>>, field string, text string, idx int")


def test_unusual_texts_in_a_table(spark):
    rows = _rows(spark, [("a", "Fіnd", [(3, "ok", "x"), (1, "b\u200bad", "y"), (None, None, None)], "clash", "clash", 9), ("a", "Fіnd", [(1, "b\u200bad", "y")], None, None, None), (None, None, None, None, None, None), ("e", "", [], None, None, None)])
    records = spark.createDataFrame([("Goal: plain", ("a",), 1), ("Goal: Ａ", ("b",), 2), (None, (None,), 3)], "state string, _meta struct<id string>, idx int")
    got = {(r.id, r.field, r.idx, r.canonical) for r in c.unusual(c.texts_of(rows, records)).collect()}
    assert got == {("a", "goal", -1, "Find"), ("a", "candidate", 1, "bad"), ("b", "state", -1, "Goal: A")}
    every = c.unify(c.texts_of(rows, records))
    assert every.count() == 4 + 4 + 3
    assert every.where(F.col("kinds") > 0).select("canonical").distinct().count() == 3
    empty = c.unusual(c.texts_of(rows.limit(0), records.limit(0)))
    assert empty.count() == 0


def test_filter_lets_every_case_through(spark):
    texts = [*CASES, *SAME]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.suspect(F.col("t")).alias("s"))
    passed = {r.t for r in df.where("s").collect()}
    assert set(CASES) <= passed


def test_query_gives_the_form_of_every_text(spark, tmp_path):
    from stepmill.llm.queries import QUERIES

    cands = [(0, "Find"), (1, "Ｆind"), (2, None)]
    rows = spark.createDataFrame([("a", "plain goal", cands), ("a", "plain goal", cands), ("b", "caf\u00a0e", []), (None, None, None)], "id string, goal string, candidates array<struct<idx:int,text:string>>")
    rows.write.parquet(f"{tmp_path}/eval_rows.parquet")
    spark.createDataFrame([((("r",)), "Goal: x\n[1] <a> role=b \"c\"")], "_meta struct<id:string>, state string").write.parquet(f"{tmp_path}/train_records.parquet")
    got = sorted(map(tuple, QUERIES["p1_canonical"](spark, str(tmp_path)).collect()), key=repr)
    want = [
        ("a", "goal", -1, "plain goal", 0), ("a", "candidate", 0, "Find", 0), ("a", "candidate", 1, "Find", c.WIDTH), ("a", "candidate", 2, None, 0), ("b", "goal", -1, "caf e", c.BLANK),
        (None, "goal", -1, None, 0), ("r", "state", -1, "Goal: x\n[1] <a> role=b \"c\"", 0),
    ]
    assert got == sorted(want, key=repr)
    cases = {tuple(r) for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()}
    assert cases == {r[:3] for r in got if r[4]}


def test_look_alikes_of_all_scripts(spark):
    more = c.look_alikes(spark)
    c.extend(more)
    assert len(more) > 250 and all(len(a) == len(b) == 1 for a, b in more.items())
    for odd, plain in {"ⲟpen": "open", "ⲣage": "page", "סpen": "open", "ᖇent": "Rent", "ҽmail": "email", "ɩogin": "iogin", "Ɩogin": "Iogin", "ꞵook": "ßook", "ℎotel": "hotel", "ꭺpple": "Apple", "l०gin": "login", "ⲟⲣen now": "open now"}.items():
        assert c.canonicalise(odd) == (plain, c.WIDTH if "ℎ" in odd else c.SCRIPT), odd
    for plain in ("שלום עולם", "ⲁⲛⲟⲕ ⲡⲉ", "ქართული ენა", "ህሎ ዐለም", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "[ɡoʊ]", "ǀXam", "500 mℓ", "ıssız", "בGoogle", "ଠ ଓଡ଼ିଆ", "१० घंटे", "Привет", "Ελλάδα", "ℝ and ℕ", "Հայաստան", "ሰላም ዐ"):
        assert c.canonicalise(plain) == (plain, 0), plain
    rows = spark.createDataFrame([("Ɩogin",), ("ℎotel",), ("plain ö",), ("ɩogin",), (None,)], "t string")
    assert [r.s for r in rows.select(c.suspect(c.F.col("t")).alias("s")).collect()] == [True, True, False, True, None]


def test_words_are_read_by_the_intersection_of_their_scripts():
    assert c.canonicalise("Mobile арр") == ("Mobile app", c.SCRIPT) and c.canonicalise("мир арр") == ("мир арр", 0)
