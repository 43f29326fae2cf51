import random

from tallyline.llm import spam as M

PROSE = "The goods arrived on Monday and were booked in by the warehouse. We have not yet received payment for the last bill, which was due in March."
GERMAN = "Die Ware wurde am Montag geliefert und im Lager geprüft. Für Rückfragen stehen wir Ihnen gern zur Verfügung, bitte melden Sie sich."
ITEMS = "Acme Ltd\nStatement of account\n" + "\n".join(f"2024-03-{i:02d}  INV-{i:05d}  EUR {i}50.00  open" for i in range(1, 29))
ORDER = PROSE + "\n" + "\n".join(f"- toner black, {i}\nlab gloves, box ({i})\n{i} x steel brackets M8" for i in range(1, 9))
REMITTANCE = "Payment advice\n" + "\n".join(f"{i:06d}/FAC/03/2024" for i in range(40))
KEYWORDS = "tax refund  cheap toner  " * 40
TAGS = "\n".join(f"{random.Random(i).choice(['toner', 'drum', 'ink', 'paper'])} bulk premium {random.Random(-i - 1).choice(['deal', 'kit', 'box'])} SKU:{70000 + i}" for i in range(30))
HASHTAGS = " ".join(f"#{a}{b}" for a in ("toner", "drum", "ink", "paper", "label") for b in ("deal", "kit", "box", "bulk"))
LINKS = "\n".join(f"http://toner{i}.example.com/cheap/{i} (ink)" for i in range(15))
HTML = " |\n".join(f'<a href="https://ink{i}.example.org/x">cheap ink</a>' for i in range(15))
BUY = "Buy toner! Cheap toner? TONER best. Order toner now! " * 12
DOORWAY = " | ".join(f"papier A4 promo à Ville{chr(97 + i)}" for i in range(20))
GREEK = "Η απόδειξη εκδόθηκε σήμερα. 我们核对了两份扫描件,税号相同。 Оплата пока не поступила."


CASES = [
    (PROSE, False), (GERMAN, False), (ITEMS, False), (ORDER, False), (REMITTANCE, False), (GREEK, False), (None, False), ("", False), (" \n", False), ("ok", False),
    (PROSE + "\nsee: http://a.example.com/b", False), (KEYWORDS, True), (TAGS, True), (HASHTAGS, True), (LINKS, True), (HTML, True), (BUY, True), (DOORWAY, True),
    ("We changed our bank last spring, as agreed on the phone.\n" + KEYWORDS, True), ("We changed our bank last spring, as agreed on the phone.\n" + LINKS, True), (KEYWORDS * 200, True), (PROSE * 500, False),
]


def test_pages(spark):
    corpus = [(i, (PROSE if i % 2 else ITEMS), "en") for i in range(60)] + [(1000 + i, text, "en") for i, (text, _) in enumerate(CASES)]
    found = {r.doc_id for r in M.stuffed_pages(spark.createDataFrame(corpus, "doc_id bigint, text string, lang string")).collect()}
    assert found == {1000 + i for i, (_, expected) in enumerate(CASES) if expected}


def test_long_texts_take_one_pass():
    import time

    began = time.perf_counter()
    for text in ("<a " + "http://x.y/z " * 20_000, "<" * 100_000, PROSE + " " * 200_000 + KEYWORDS, "a, " * 100_000, "the of " + "x |  " * 50_000):
        M.features(text)
    assert time.perf_counter() - began < 20


def test_languages_and_clashing_columns(spark):
    rows = [(i, PROSE, lang, 1.0, "x") for i, lang in enumerate(["en", " EN-us ", "De", None, "", "??"] * 60)] + [(1000 + i, KEYWORDS, lang, 1.0, "x") for i, lang in enumerate(["en", None, "xx"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, spam_share double, dense string")
    assert {r.doc_id for r in M.stuffed_pages(df).collect()} == {1000, 1001, 1002}
    limits = {r.lang: r for r in M.thresholds(M.page_features(df)).collect()}
    assert set(limits) == {"en", "de", "", M.OTHER_LANGUAGE} and limits["en"].n_docs == 120
    empty = M.thresholds(M.page_features(df.limit(0))).collect()
    assert [(r.lang, r.n_docs) for r in empty] == [(M.OTHER_LANGUAGE, 0)] and all(empty[0][n] == x for n, x in M.PRIOR.items())
    assert M.stuffed_pages(df.limit(0)).isEmpty()


TONER = {
    "Cyrillic": "тонер бумага картридж принтер краска лента плёнка папка ручка степлер скрепка конверт".split(), "Greek": "τόνερ χαρτί μελάνι εκτυπωτής φάκελος στυλό ταινία κουτί ετικέτα κόλλα".split(),
    "Arabic": "حبر ورق طابعة خرطوشة قلم ملف ظرف شريط ملصق صندوق".split(), "CJK": "打印机 墨盒 硒鼓 纸张 标签 文件夹 信封 胶带 订书机 回形针".split(),
}
FOREIGN = [
    "Здравствуйте, коллеги!\nСчёт за март получен, но сумма не совпадает с заказом, поэтому просим прислать исправленный.\nС уважением,\nИван Петров", GREEK * 5,
    "وصلت البضاعة يوم الاثنين وتم تسجيلها في المستودع. لم نستلم الدفعة عن الفاتورة الأخيرة بعد.", "我们核对了两份扫描件，税号相同，但是金额不一致。请在本周内确认付款日期，并把更正后的发票发给我们。",
    "Товар поступил на склад в понедельник и был принят без замечаний, но оплата за прошлый месяц до сих пор\nне поступила, хотя срок истёк ещё в марте, поэтому просим сообщить дату платежа как можно скорее",
]


def test_tags_in_any_script(spark):
    pages = [sep.join(f"{a} {b}" if two else a for i, a in enumerate(words) for b in words[:2]) for words in TONER.values() for two in (False, True) for sep in (" | ", ", ", "\n")]
    pages += [" ".join(f"#{w}" for w in words) for words in TONER.values()]
    rows = [(i, text, "xx") for i, text in enumerate(pages)] + [(1000 + i, text, "xx") for i, text in enumerate(FOREIGN)] + [(2000 + i, PROSE, "en") for i in range(60)]
    found = {r.doc_id for r in M.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found == set(range(len(pages)))


def test_sentences_among_keywords_and_frames(spark):
    """Keywords that run into sentences, one frame filled in again and again, long attributes of links."""
    rng = random.Random(3)
    words = {"en": ["printer ink sale", "cheap toner", "tax refund", "invoice app", "late fee calculator"], "fr": ["encre pas cher", "devis en ligne", "papier A4 promo", "crédit pro", "relance impayé"]}
    sentences = {"en": "We hold the payment until the lab department has answered.", "fr": "Si vous avez déjà payé, merci de ne pas tenir compte de cette relance."}
    pages = []
    for lang in words:
        keywords = lambda n: "".join(rng.choice(words[lang]) + rng.choice([", ", " / ", " "]) for _ in range(n))  # noqa: B023, E731
        pages += [(f"{sentences[lang]} {keywords(40)}{sentences[lang]} {keywords(40)}", lang), (f"{sentences[lang]} {keywords(60)}{sentences[lang]}", lang)]
    towns = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(40)]
    pages += [("\n".join(f"invoice template free in {t}" for t in towns), "en"), (" | ".join(f"debt collector in {t}" for t in towns), "en"), ("\n".join(f"tinta murah di {t}" for t in towns), "id")]
    pages += [("\n".join(f'<a class="{"x" * 900}" href="https://ink{i}.example.org/x" title="{"y" * 900}">cheap ink</a>' for i in range(15)), "en")]
    pages += [("Keywords: " + ",".join(f"{rng.choice('ink pen drum desk label'.split())} {rng.choice('kit box sale bulk pro'.split())}" for _ in range(60)), "en")]
    ordinary = [(PROSE if i % 2 else ITEMS, lang) for i in range(60) for lang in ("en", "fr", "id")]
    rows = [(i, *x) for i, x in enumerate(pages)] + [(1000 + i, *x) for i, x in enumerate(ordinary)]
    found = {r.doc_id for r in M.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found == set(range(len(pages)))


LINK = "http://toner{0}.example.com/{0} cheap"
HALF = [
    # (text, expected): half to six tenths of the characters
    ("\n".join(LINK.format(i) for i in range(4)) + "\nNobody in fleet remembers approving a second shipment. Late fees start after the second reminder.", True),
    ("toner | drum | ink | paper | label | folder | binder | staple | stamp | pens\nNobody in fleet remembers approving a second shipment.", True),
    ("Good morning,\n\nNobody in the fleet remembers approving a second shipment. Approval is still open because the cost centre was missing.\n\nLate fees start after the second reminder.\n"
     "portal: https://ledgersale334.example.com/premium/bulk\nsee: https://www.tonerkit658.example/premium/cheap\nsee: http://facture-recycled866.test/holder/mini/refurb\n\nThanks,\nMutoli Vapuk Engineering B.V.", False),
]


def test_half_is_most(spark):
    shares = [dict(zip(M.FEATURES, M.features(text)))["spam_share"] for text, _ in HALF]
    assert all(0.5 < s < 0.6 for s in shares), shares
    rows = [(i, PROSE, "en") for i in range(60)] + [(1000 + i, text, "en") for i, (text, _) in enumerate(HALF)]
    found = {r.doc_id for r in M.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert found == {1000 + i for i, (_, expected) in enumerate(HALF) if expected}
