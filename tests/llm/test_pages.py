"""Restoration by page and language: what is found, and what is restored wrongly."""

import pytest

from weftgram.llm import encoding_repair as er

#: Invented sentences in the language of each key.
SENTENCES = {
    "greek": ["η γλώσσα έχει πολλές λέξεις", "ο κατάλογος περιέχει όλα τα παραδείγματα", "σήμερα μεταφράζουμε ένα μικρό κείμενο", "αυτή η πρόταση είναι σωστή", "το λεξικό μεγαλώνει κάθε χρόνο", "κανείς δεν γνωρίζει την απάντηση"],
    "hebrew": ["המילון מכיל מילים רבות", "היום אנחנו מתרגמים טקסט קצר", "השפה משתנה כל הזמן", "כל משפט נכתב פעם אחת", "הדוגמה הזאת אינה ארוכה", "אין תשובה לשאלה הזאת"],
    "arabic": ["يحتوي القاموس على كلمات كثيرة", "نترجم اليوم نصا قصيرا", "تتغير اللغة مع الوقت", "هذه الجملة صحيحة تماما", "لا يوجد جواب لهذا السؤال", "المثال الثاني اطول من الاول"],
    "turkish": ["sözlükte çok sayıda kelime vardır", "bugün kısa bir metin çeviriyoruz", "dağın ardında küçük bir ışık göründü", "bu cümle doğru yazılmış", "hiç kimse cevabı bilmiyor", "şimdi ikinci örneği açıklıyoruz"],
    "russian": ["словарь содержит много примеров", "сегодня мы переводим короткий текст", "язык постоянно меняется", "это предложение написано верно", "никто не знает ответа", "второй пример длиннее первого"],
    "polish": ["słownik zawiera wiele przykładów", "dziś tłumaczymy krótki tekst", "język ciągle się zmienia", "to zdanie jest właściwie napisane", "nikt nie zna właściwej odpowiedzi", "źródło wciąż łączy części"],
    "czech": ["slovník obsahuje mnoho příkladů", "dnes překládáme krátký text", "jazyk se stále mění", "tato věta je napsána správně", "nikdo nezná odpověď", "žluťoučký kůň skáče přes plot"],
    "german": ["das Wörterbuch enthält viele Beispiele", "heute übersetzen wir einen kürzeren Satz", "die Größe der Lücke überrascht", "niemand weiß die Lösung", "fünf Wörter gehören dazu", "schöne Grüße aus München"],
    "french": ["le lexique répète déjà l’idée", "nous traduisons un été très froid", "la fréquence a été vérifiée", "le système préfère la même règle", "où êtes-vous passés hier", "une thèse très éloignée"],
    "japanese": ["この辞書には多くの言葉があります", "今日は短い文章を翻訳します", "言葉はいつも変わっていく", "この文は正しく書かれています", "だれも答えを知らない", "二番目の例はもっと長い"],
    "chinese": ["这本词典包含很多词语", "今天我们翻译一段短文", "语言总是在不断变化", "这个句子写得完全正确", "没有人知道问题的答案", "第二个例子比第一个长"],
    "korean": ["이 사전에는 많은 단어가 있습니다", "오늘은 짧은 글을 번역합니다", "언어는 언제나 변한다", "이 문장은 바르게 쓰였습니다", "아무도 대답을 모릅니다", "둘째 예문은 더 길다"],
}
#: Page written in, page read as, languages.
MISREAD = [
    ("utf-8", "cp1252", list(SENTENCES)), ("utf-8", "latin-1", list(SENTENCES)), ("cp1253", "cp1252", ["greek"]), ("iso8859-7", "latin-1", ["greek"]), ("cp1255", "cp1252", ["hebrew"]), ("iso8859-8", "latin-1", ["hebrew"]),
    ("cp1256", "cp1252", ["arabic"]), ("iso8859-6", "latin-1", ["arabic"]), ("cp1254", "cp1252", ["turkish"]), ("iso8859-9", "latin-1", ["turkish"]), ("cp1251", "cp1252", ["russian"]), ("koi8-r", "latin-1", ["russian"]), ("koi8-r", "cp1251", ["russian"]),
    ("cp1250", "cp1252", ["polish", "czech"]), ("iso8859-2", "latin-1", ["polish", "czech"]), ("cp1252", "cp850", ["german", "french"]), ("cp1252", "mac_roman", ["german", "french"]),
    ("gb18030", "latin-1", ["chinese"]), ("big5", "latin-1", []), ("euc_jp", "latin-1", ["japanese"]), ("euc_kr", "latin-1", ["korean"]),
]


def misread(text: str, written_in: str, read_as: str) -> str:
    decode = er._PAGES[read_as][1] if read_as in er._PAGES else {}
    return "".join(chr(b) if b < 0x80 else decode.get(b, bytes([b]).decode("latin-1")) for b in text.encode(written_in, "replace"))


def outcomes():
    """(written in, read as, language): documents, found, restored exactly, changed into something else."""
    table = {}
    for written_in, read_as, languages in MISREAD:
        for language in languages:
            n = found = right = wrong = 0
            for sentence in [*SENTENCES[language], "\n".join(SENTENCES[language])]:
                garbled = misread(sentence, written_in, read_as)
                if garbled.isascii():
                    continue
                got, case = er.Repairer().text(garbled)
                n, found, right = n + 1, found + case, right + (got == sentence)
                # a word is restored wrongly if it is neither as it should be nor as it came
                wrong += any(g not in (s, c) for g, s, c in zip(got.split(), sentence.split(), garbled.split(), strict=False)) if len(got.split()) == len(sentence.split()) == len(garbled.split()) else got not in (sentence, garbled)
            table[written_in, read_as, language] = n, found, right, wrong
    return table


@pytest.fixture(scope="module")
def table():
    return outcomes()


def test_recall_by_page_and_language(table):
    n, found = sum(r[0] for r in table.values()), sum(r[1] for r in table.values())
    assert found >= 0.9 * n, {k: r for k, r in table.items() if r[1] < 0.9 * r[0]}


def test_few_wrong_restorations(table):
    n, wrong = sum(r[0] for r in table.values()), sum(r[3] for r in table.values())
    assert wrong <= 0.01 * n, {k: r for k, r in table.items() if r[3]}


def test_sentences_of_every_language_stay():
    for sentences in SENTENCES.values():
        for text in [*sentences, "\n".join(sentences)]:
            assert er.Repairer().text(text) == (text, False)


def test_repeatedly_misread():
    text = "die Größe überdeckt fünf Lücken"
    garbled = text
    for _ in range(6):
        garbled = misread(garbled, "utf-8", "cp1252")
    assert er.Repairer().text(garbled) == (text, True)


def test_references_and_stray_blanks():
    r = er.Repairer()
    assert r.text("un caf&Atilde;&copy; noir") == ("un café noir", True)
    assert r.text("caf&eacute; &amp; th&eacute;") == ("caf&eacute; &amp; th&eacute;", False)
    assert r.text("10Â 000 mots") == ("10 000 mots", True)
    assert r.text("Ã©" * 3000)[0] == "é" * 3000
