import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepmill.functions import html, scores, text
from stepmill.functions.schema import ATTRS, EVAL_ROW

NONE = dict.fromkeys(ATTRS)


def _cand(spark, **k):
    attrs = NONE | k.pop("attrs", {})
    row = {"idx": 3, "tag": "a", "role": None, "text": "x"} | k
    data = [("id", None, None, None, None, None, [(row["idx"], row["tag"], row["role"], row["text"], tuple(attrs[a] for a in ATTRS))], None, None, None)]
    return spark.createDataFrame(data, EVAL_ROW).select(F.get("candidates", F.lit(0)).alias("c"))


def _twin(c, limit):
    t = (c["text"] or "").strip().replace("\n", " ")
    return t[: limit - 3] + "..." if len(t) > limit else t


def test_render_matches_a_twin(spark):
    for body in ["short", "a" * 60, "a" * 61, "a" * 80, "a" * 81, "  line\nbreak ", "😀" * 79, None, ""]:
        for limit, compact in ((80, False), (60, True)):
            df = _cand(spark, text=body).select(text.render_candidate(F.col("c"), compact).alias("r"))
            want = f'[3] <a> role=None "{_twin({"text": body}, limit)}"' + ("" if compact else " attrs={}")
            assert df.first().r == want


def test_attrs_are_written_as_python_writes_them(spark):
    for v in ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\there", "é—", "z​w", " ", "\x07", "\U000e0041", ""]:
        df = _cand(spark, attrs={"aria-label": v, "href": "h"}).select(text.attrs_repr(F.col("c")).alias("r"))
        assert df.first().r == repr({"aria-label": v, "href": "h"})


def test_state(spark):
    df = spark.createDataFrame([("g", "w", "d", ["1", "2", "3"], [(0, "a", "link", "t", None)]), ("g", None, None, [], [])], "goal string, website string, domain string, p array<string>, c array<struct<idx int, tag string, role string, text string, attrs struct<id string, `aria-label` string, placeholder string, name string, type string, href string>>>")
    full = [r.s for r in df.select(text.render_state(F.col("goal"), F.col("website"), F.col("domain"), F.col("p"), F.col("c")).alias("s")).collect()]
    assert full[0] == 'Goal: g\nWebsite: w (d)\nPrevious actions:\n- 1\n- 2\n- 3\nCandidate elements:\n[0] <a> role=link "t" attrs={}'
    assert full[1] == "Goal: g\nWebsite: None (None)\nCandidate elements:"
    short = df.select(text.training_state(F.col("goal"), F.col("p"), F.col("c")).alias("s")).first().s
    assert short == 'Goal: g\nPrevious actions:\n- 2\n- 3\nCandidate elements:\n[0] <a> role=link "t"'


def test_tokens_and_fields(spark):
    df = spark.createDataFrame([("A b-2 B é", "search-icon-btn x 12 abcd_ef more", "https://u@x.com:8/a b")], "t string, c string, h string")
    r = df.select(text.tokens(F.col("t")).alias("t"), text.class_words(F.col("c")).alias("c"), text.netloc(F.col("h")).alias("h"), text.netloc(F.lit("/rel")).alias("n"), text.netloc(F.lit("//p.q/z")).alias("p"), text.compact_attr(F.lit("  ")).alias("b"), text.compact_attr(F.lit("")).alias("e"), text.clean_value(F.lit("no input text")).alias("v"), text.site_of(F.lit(""), F.lit("www.www.a")).alias("s")).first()
    assert r.t == ["a", "b", "2"] and r.c == "search icon btn abcd" and r.h == "u@x.com:8" and r.n is None and r.p == "p.q"
    assert r.b == "" and r.e is None and r.v is None and r.s == "www.a"


def test_scores_on_edges(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([0.0, 0.0],), ([],), ([-1000.0, -1000.0],)], "p array<double>")
    assert spark.createDataFrame([([float("nan"), 0.5],)], "p array<double>").select(scores.first_argmax(F.col("p")).alias("a")).first().a is None
    rows = df.select(scores.first_argmax(F.col("p")).alias("a"), scores.softmax(F.col("p")).alias("s"), scores.renormalise(F.col("p")).alias("n"), scores.brier(F.col("p"), F.lit(1)).alias("b")).collect()
    assert [r.a for r in rows] == [1, 0, None, 0]
    assert rows[3].s == [0.5, 0.5] and rows[2].s == [] and rows[1].n == [0.0, 0.0] and rows[1].b == 1.0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=10, max_size=10), st.integers(0, 9))
def test_brier_in_range(spark, raw, gold):
    df = spark.createDataFrame([(raw, gold)], "p array<double>, g int").select(scores.softmax(F.col("p")).alias("s"), "g")
    r = df.select("s", scores.brier(F.col("s"), F.col("g")).alias("b")).first()
    assert abs(sum(r.s) - 1) < 1e-9 and 0 <= r.b <= 2


PAGE = """<html><!-- c --><body class=main><script>no()</script><div aria-label="Menu"><p>One<p>Two <b>bold</b>
<a href="https://u:p@x.com:80/q" id=" go " backend_node_id="7">  Cars &amp; vans </a></p>
<span><button class="search-icon-btn 12"></button></span></div>
<input placeholder="Type" name="q" type="text"><select role="listbox"><option>1<option>2</select><i><u><em class="x-long_word9"></em></u></i></body>"""


def test_page_nodes(spark):
    df = spark.createDataFrame([(PAGE, "a[id^=' go']"), (None, "a"), ("", None), ("<a", "a")], "h string, s string")
    nodes = df.select(F.explode(html.page_nodes(F.col("h"), F.col("s"))).alias("n")).select("n.*").collect()
    by = {n.tag: n for n in nodes}
    assert by["a"].text == "Cars & vans" and by["a"].attrs.href == "u:p@x.com:80" and by["a"].attrs.id == "go" and by["a"].backend_node_id == "7"
    assert by["button"].text == "Menu" and by["input"].text == "Type" and by["select"].text == "12" or by["select"].text == "1 2"
    assert by["em"].text == "long word9" and by["script"].text == "" and len([n for n in nodes if n.tag == "p"]) == 2
    assert by["a"].matches == [0, 1] and by["select"].matches == [1] and by["select"].role == "listbox" and by["i"].matches == []


def _hits(page, s):
    return [n[0] for n in html.parse(page, (s,)) if 0 in n[7]]


def test_selectors():
    page = '<div id=a class="x y"><p><a href=q>1</a></p><a>2</a></div>'
    for s, want in [("a", [2, 3]), ("div > a", [3]), ("#a p a", [2]), (".x.y", [0]), ("a[href]", [2]), ("a:nth-child(2)", [3]), ("p, [href=q]", [1, 2]), ("a:::b", []), ("DIV>p>a", [2]), ("*", [0, 1, 2, 3])]:
        assert _hits(page, s) == want, s


def test_selectors_among_siblings():
    page = "<ul><li id=b:1 class=k>1</li><b>x</b><li>2</li><li class='k m'>3</li><i data-n='a b'>y</i></ul><ul><li>4</li></ul>"
    for s, want in [
        ("li:nth-of-type(2)", [3]), ("li:nth-child(2)", []), ("ul > :nth-child(2)", [2]), ("li:first-of-type", [1, 7]), ("b + li", [3]), ("b ~ li", [3, 4]), ("li ~ i", [5]), ("li:not(.k)", [3, 7]), ("li:not(.k.m)", [1, 3, 7]), ("ul+ul>li", [7]),
        ("li:nth-child(odd):not(:first-child)", [3]), (r"#b\:1", [1]), ("[data-n~=b]", [5]), ('i[data-n="a b"]', [5]), ("li:not(::x)", []), ("li >", []), ("", []), ("b,,i", []),
    ]:
        assert _hits(page, s) == want, s
    assert not html.readable("li:not(::x)") and not html.readable("a:hover") and html.readable(None) and html.readable("a , b > c")


def test_pages_are_decoded_as_they_say(spark):
    pages = ["<p>é</p>".encode(), b'<meta charset="iso-8859-1"><p>\xe9</p>', b"<p>\xe9\xff</p>", "<p>é</p>".encode("utf-16"), b"<meta charset=none-such><p>e</p>", b"", None, b"<meta http-equiv=x content='text/html; charset=windows-1251'><p>\xe6</p>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h binary").select("i", F.explode(html.page_nodes(F.col("h"))).alias("n")).where("n.tag = 'p'")
    assert {r.i: r.n.text for r in df.collect()} == {0: "é", 1: "é", 2: "\ufffd\ufffd", 3: "é", 4: "e", 7: "ж"}


def test_places_among_siblings_take_no_second_look():
    import time

    page = "<ul>" + "<li>x</li><b>y</b>" * 20_000 + "</ul>"
    began = time.process_time()
    assert len(_hits(page, "li:nth-of-type(3)")) == len(_hits(page, "li:nth-child(3)")) == 1
    assert time.process_time() - began < 20


def test_long_page():
    rnd = random.Random(1)
    page = "<ul>" + "".join(f"<li>{rnd.random()}" for _ in range(20_000))
    assert len(html.parse(page)) == 20_001
