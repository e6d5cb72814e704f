import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import garble as G

GOOD = [
    "l’écriture, NÃO usa o botão; AÇÃO: revê «já»",
    "Исправить журнал ошибок перед выпуском",
    "修正: 読み込み処理 リリース前",
    "│   └── src\n├── a\n┌─┬┐ ├┤ └┘",
    "“quoted” – it’s … 5 € § √ ≤ π ✓ 🚧 ¡por señor! ÀÉÎÕÜ",
    "Zażółć gęślą jaźń; Příliš žluťoučký kůň; Öğe şablonu ığdır",
    "Ёлка РЁБРА рёв",
    "«ЦЕНТР» и “ГОСТ”",
    "Πρόγραμμα «ΔΟΞΑ» ΟΛΑ ΚΕΦΑΛΑΙΑ",
    "متن فارسی تک خط کمک",
    "中文文本应该保持不变的测试内容 日本語のテキスト処理 한국어 문장",
    "ŽLUŤOUČKÝ KŮŇ Čēpti Āžu",
    "naïve café Ünïcödé Äpfel Überprüfe größe",
    "",
    "plain ascii",
]


@pytest.mark.parametrize("text", GOOD)
def test_correct_text_is_left_alone(text):
    assert G.restore(text) == (text, "")


TEXTS = ["the naïve café – it’s “done”", "Исправить журнал ошибок", "Změň výchozí řešení kvůli chybě", "修正: 読み込み", "größe übernehmen Straße", "revisão da configuração", "ok 🚧 here"]


def misread(text: str, page: str) -> str:
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", TEXTS)
def test_misread_text_is_restored(text, page):
    bad = misread(text, page)
    assert G.restore(f"before {bad} after")[0] == f"before {text} after"
    assert G.restore(bad)[1]


@pytest.mark.parametrize("text", TEXTS)
def test_twice_misread(text):
    fixed, kind = G.restore(misread(misread(text, "cp1252"), "cp1252"))
    assert fixed == text and kind


RARE = ["the naïve café is größer", "Исправить журнал ошибок", "revisão da configuração", "修正: 読み込み", "Đây là tiếng Việt"]


@pytest.mark.parametrize("page", ["koi8_r", "cp1253", "cp1255", "cp1256", "cp1258", "cp852", "cp862", "mac_greek", "mac_cyrillic", "iso8859-2", "iso8859-4", "iso8859-9", "iso8859-15"])
def test_rarer_pages(page):
    whole = sum(G.restore(misread(t, page))[0] == t for t in RARE)
    assert whole >= 4 and all(G.restore(misread(t, page))[1] for t in RARE)


def test_however_often_misread():
    t = "größe café"
    for _ in range(7):
        t = misread(t, "cp1252")
    assert G.restore(t)[0] == "größe café"


@pytest.mark.parametrize("page", ["gbk", "cp932", "cp949"])
def test_double_byte_pages(page):
    """The whole runs of East Asian text that a double-byte page can show."""
    shown = 0
    for t in ["解决", "文件", "保存问题", "読込処理", "修正内容", "確認画面", "문장", "입니다요", "처리결과", "設定変更"]:
        try:
            bad = t.encode().decode(page)
        except UnicodeDecodeError:
            continue
        shown += 1
        assert G.restore(f"a {bad} b")[0] == f"a {t} b"
    assert shown


OTHER = ["مرحبا بالعالم", "שלום עולם", "สวัสดีชาวโลก", "हिन्दी पाठ", "გამარჯობა"]


@pytest.mark.parametrize("page", ["cp1252", "latin-1"])
@pytest.mark.parametrize("text", OTHER)
def test_other_scripts_are_restored(text, page):
    assert G.restore(text) == (text, "")
    assert G.restore(f"before {misread(text, page)} after")[0] == f"before {text} after"


def test_one_sign_of_another_script_may_be_correct_text():
    assert G.restore("á…” – É‘")[1] == ""


def test_places_only():
    mixed = f"NÃO usa o botão. {misread('é', 'cp1252')} Журнал\n"
    assert G.restore(mixed)[0] == "NÃO usa o botão. é Журнал\n"


def test_cyrillic_in_western_letters():
    line = "Исправить разбор строки перед выпуском для"
    bad = line.encode("cp1251").decode("latin-1")
    assert G.restore(f"x = 1 # naïve\n# {bad}\n") == (f"x = 1 # naïve\n# {line}\n", "cyrillic")


def test_lost_text():
    assert G.restore("Gr\ufffd\ufffde")[1] == "lost"


def test_long_texts():
    bad = misread("größe ", "cp1252") * 20_000
    assert G.restore(bad)[0] == "größe " * 20_000


def test_column(spark):
    df = spark.createDataFrame([(1, misread("é", "cp1252"), "c"), (2, "é", "c"), (3, None, "c"), (4, "", "c"), (5, "\ufffd", "c")], "doc_id long, text string, found string")
    got = {r.k: (r.found, r.restored) for r in G.restore_column(df, F.col("doc_id"), F.col("text")).collect()}
    assert got == {1: ("cp1252", "é"), 5: ("lost", "\ufffd")}
    everything = G.restore_column(df, F.col("doc_id"), F.col("text"), found_only=False)
    assert everything.count() == 5
    assert G.restore_column(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
