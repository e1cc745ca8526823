import random
import re

from stepmill.llm import sentences as s

# sentences are separated by ¦ here; what stands between two of them in the text is a blank, unless \0 says none
GOLD = [
    "Dr. Pemmer came.¦Mr. X left!¦Is the total $3.50?!¦Yes.",
    "Use a query, e.g. Taskell or Sennick, and press Enter.¦See Fig. 12 and the notes of Prof. Ort on p. 13.¦It was shown twice, i.e. once per tab.",
    "The shop sells lamps, etc.¦Guests see it.¦Filters (size, colour, etc.) stay open.¦(The link opens.)¦Use it.",
    "The queue closed at 9 a.m.¦The page works.¦Send it before 3 p.m. on May 4.¦Sent in U.S. units and rounded to .5 steps.",
    "Order No. 364 was shown.¦The answer was no.¦142 results were listed.",
    "Ask J. R. Brunvik for it.¦The banner said “Sold out!” and turned grey.¦“Where is it?” asked the tester.¦He wrote, “It is blank.”¦Next one.",
    "Which is right: “Pay now?” or “Pay later?”¦He wrote.¦Wait … then press.¦It kept loading...¦The end.",
    "Open report_v23.11.csv in shop.x.example now.¦Version 2.5 of it loads.",
    "Sorted by price or distance.\0¦The search box is there.\0¦Dr. Ort came!\0¦Again",
    "The answer was no.\0¦Does it stay?\0¦142 were listed.¦She has a Ph.D. in law.¦The U.S. Army came.¦It left the U.S.¦It is big.",
    "Der Preis liegt z. B. bei 236,18 Euro.¦Am 3. Mai wurde um 14.30 Uhr geprüft.¦„Aus!“ stand über dem Knopf.¦Laut Nr. 17 ist sie ungültig.¦Sie kommt ca. 5 Tage später.",
    "La Sra. Orrdin eligió 3.¦¿Dónde está?¦El aviso decía «¡Agotado!» y no abría.¦El código n.º 39 vale.¦Muestra tallas, etc. en una tabla.",
    "« Rupture de stock ! » affichait la bannière.¦La carte ne s'affiche plus !¦Vers 18 h 30, p. ex. au guichet n° 3.¦M. Umbrek a choisi.",
    "Форму подписал А. Б. Ровадин.¦Пришёл на ул. Велманская, д. 24.¦Цвет и т. д. перед оплатой.¦В 2021 г. страница.¦«Всё!» — написано.¦Цена 5 руб. за билет.¦Размер и т. д.¦Конец.",
    "Ο κ. Τασκέλης άνοιξε.¦Πού είναι το καλάθι;¦Χρώμα κ.λπ. πριν.¦Έδειχνε «Εξαντλήθηκε!» και έσβησε.",
    "价格是30.80元。\0¦购物车在哪里？\0¦测试员说：“请重新加载页面。”\0¦页面提示“已售罄！”，变成灰色。\0¦第3步完成！",
    "注文No.102は表示。\0¦「売り切れです。」と表示。\0¦「完了！」が出ます。\0¦どこですか？",
    "डॉ. वेलमार आए।¦पन्ने पर “सब बिक गया!” लिखा था।¦कीमत 40.98 रुपये है।¦क्या खाली है?",
    "أرسل د. فلمار النموذج.¦أين السلة؟¦ظهرت «نفدت!» فوق الزر.¦يجب الرمز؛ ثم اضغط.¦السعر 36.65 دولار.",
    "กรุณาเลือกสี¦ราคาคือ 16.64 บาทต่อชิ้น¦หน้าเว็บ lipupand ต้องใช้รหัส",
]


def _text(gold):
    return gold.replace("\0¦", "").replace("¦", " ")


def test_gold_sentences():
    for gold in GOLD:
        text = _text(gold)
        got = [text[a:b] for a, b in s.sentence_spans(text)]
        assert got == gold.replace("\0", "").split("¦"), got


def test_hard_wraps_are_blanks():
    for gold in GOLD[:14]:
        text = _text(gold).replace(" ", "\n", 3) if not gold.startswith("Ask") else _text(gold)
        got = [" ".join(text[a:b].split()) for a, b in s.sentence_spans(text)]
        assert got == gold.replace("\0", "").split("¦"), got


def test_lines_and_bullets():
    for eol in ("\n", "\r\n", "\r", "\u2028"):
        text = f"A heading{eol}{eol}  One line{eol}goes on.  Two{eol}- a bullet{eol}• bee. Then sea{eol}12. number{eol}  {eol}* last"
        got = [" ".join(text[a:b].split()) for a, b in s.sentence_spans(text)]
        assert got == ["A heading", "One line goes on.", "Two", "- a bullet", "• bee.", "Then sea", "12. number", "* last"], (eol, got)


def test_no_sentences_and_long_texts():
    assert s.sentence_spans(None) == s.sentence_spans("") == s.sentence_spans(" \n\t\n") == []
    assert s.sentence_spans("...") == [(0, 3)]
    assert len(s.sentence_spans("One two three. " * 20_000)) == 20_000
    assert len(s.sentence_spans("ก" * 100_000)) == 1


def test_table(spark):
    docs = spark.createDataFrame([(1, "Ab be. Ce do.", 5), (2, None, 5), (3, "", 5), (None, "x 😀 yes.", 5), (1, "Ab be. Ce do.", 5)], "doc_id bigint, text string, start_pos int")
    got = sorted(((r.doc_id or 0), r.start_pos, r.end_pos) for r in s.split_sentences(docs).collect())
    assert got == [(0, 0, 8), (1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13)]
    assert s.split_sentences(docs.limit(0)).count() == 0


def test_rules_see_quotations_tokens_and_blanks_of_any_length():
    long = "请在页面上重新选择一个颜色并再次提交您的订单然后等待确认" * 5
    for quote in ("已售罄", long):
        for text in (f"页面提示“{quote}！”变成灰色。", f"“{quote}！”测试员说。", f"提示「{quote}……」变成灰色。"):
            assert [text[a:b] for a, b in s.sentence_spans(text)] == [text]
        text = f"测试员说：“{quote}！”页面变成灰色。"
        assert len(s.sentence_spans(text)) == 2
    for word in ("Ende", "Ab" * 50, "Ab-" * 40 + "ab"):
        assert len(s.sentence_spans(f"Das {word}.Dann weiter.")) == 2
        assert len(s.sentence_spans(f"Das a/{word}.Dann weiter.")) == 1
    for blanks in (" ", " " * 90):
        assert len(s.sentence_spans(f"The answer was{blanks}no. 142 were listed.")) == 2
        assert len(s.sentence_spans(f"It was “Sold out!”{blanks}, she wrote.")) == 1
    assert len(s.sentence_spans("It was sold out!" + "”" * 90 + " and grey.")) == 1


def test_long_texts_without_quotes_or_blanks_are_read_once():
    import time

    began = time.process_time()
    for piece in ("很长的文字！”", "很长的文字.", "字" * 2000 + "”。", "a" * 3000 + ").B ", ".)" * 20):
        s.sentence_spans(piece * (60_000 // len(piece)))
    assert time.process_time() - began < 20


def test_signs_that_begin_no_sentence_after_a_whole_word_and_a_blank():
    for sign in ",;:)]}،）":
        for text in (f"See the page. {sign} and the next", f"See the page.\n {sign}"):
            assert [text[a:b] for a, b in s.sentence_spans(text)] == [text]
    assert len(s.sentence_spans("See the page. (And the next)")) == 2


def test_no_mark_is_decided_beside_the_tables():
    whole = ["(See the list. ) Then go.", "He saw lamps. , and left.", "店员喊“" + "快" * 70 + "！”然后走了。", "We use it etc. and my-site stays."]
    for text in whole[1:]:
        assert len(s.sentence_spans(text)) == 1, text
    assert [whole[0][a:b] for a, b in s.sentence_spans(whole[0])] == ["(See the list. ) Then go."]


def _by_all_patterns(text, start, at, end):
    """The decision of the rule tables read as they are written, every pattern over the whole text."""
    c = next((c for c in reversed(text[start:at]) if c.isalpha()), "a")
    langs = next((k for k, v in s._TABLES.items() if v is s._script_table(c + ".", 0, 2)), ())
    for breaks, before, after in [*s.FIRST, *(r for lang in langs for r in s.BY_LANGUAGE[lang]), *s.LAST]:
        before = before.pattern() if isinstance(before, s.Words) else before
        if re.compile(after).match(text, at, end) and re.compile(before).search(text, 0, at):
            return breaks
    return True


def test_decisions_are_those_of_all_patterns_in_order():
    rnd = random.Random(11)
    words = [w for table in (*s.NEVER.values(), *s.MAYBE.values()) for w in table.split()] + ["no", "No", "was", "is", "am", "3", "12", "4.5", "A", "J.R", "z. B", "p. m", "May", "The", "the", "He", "asked", "Hotel", "lamp", "页面", "说", "ด", "का", "مرحبا", "Дом", "дом", "Ένα", "x/y", "a_b", "«", "“", "„", "(", "「", "x" * 40]
    signs = [".", "!", "?", "…", "。", "！", "।", "؟", ";", ".”", "!”", ".)", "!»", " »", "？」", "..", "?!", ".\"", "！”"]
    gaps = [" ", " ", " ", "", "\n", "  ", " " * 30, ", ", " — ", " ) "]
    seen = 0
    for _ in range(3000):
        text = "".join(rnd.choice(words) + (rnd.choice(signs) if rnd.random() < 0.6 else "") + rnd.choice(gaps) for _ in range(rnd.randint(1, 9)))
        for m in s._CANDIDATE.finditer(text):
            at = m.end()
            if 0 < at < len(text):
                seen += 1
                assert s._decide(text, 0, m.start(), at, len(text)) == _by_all_patterns(text, 0, at, len(text)), (text, at)
    assert seen > 8000
