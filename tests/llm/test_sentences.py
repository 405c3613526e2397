import pytest

from spanwise.llm.sentences import sentence_units, unit_starts

SCHEMA = "doc_id long, text string, sentence string"


def units(spark, text):
    df = spark.createDataFrame([(1, text, "clash")], SCHEMA)
    got = [(r["sent_start"], r["sentence"]) for r in sentence_units(df).orderBy("sent_start").collect()]
    assert sorted(r["sent_start"] for r in unit_starts(df).collect()) == [s for s, _ in got]
    return got


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("Dr. M. Ali geldi. Sonra 3,5 mg aldı! Bitti mi?", ["Dr. M. Ali geldi.", "Sonra 3,5 mg aldı!", "Bitti mi?"]),
        ("Bkz. www.ornek.invalid/5.html adresi. Son.", ["Bkz. www.ornek.invalid/5.html adresi.", "Son."]),
        ("Hekim, “Önce bekle. Sonra gel.” diye yazdı. Gitti.", ["Hekim, “Önce bekle. Sonra gel.” diye yazdı.", "Gitti."]),
        ("„Zuerst Ruhe. Danach sehen wir“, schrieb sie. Der 87. Bericht kam.", ["„Zuerst Ruhe. Danach sehen wir“, schrieb sie.", "Der 87. Bericht kam."]),
        ("护士写道：“先休息。再看结果。”软膏往往不够。什么时候？", ["护士写道：“先休息。再看结果。”", "软膏往往不够。", "什么时候？"]),
        ("看護師は「まず安静です。それから。」と書きました。吐き気です。", ["看護師は「まず安静です。それから。」と書きました。", "吐き気です。"]),
        ("थकान है। खाँसी है। डॉ. वेलकर आए।", ["थकान है।", "खाँसी है।", "डॉ. वेलकर आए।"]),
        ("متى تصبح الحكة خطرة؟ لا تكفي المراهم إلخ. في علاج الأرق.", ["متى تصبح الحكة خطرة؟", "لا تكفي المراهم إلخ. في علاج الأرق."]),
        ("รายงานฉบับที่55มี59ราย แพทย์แนะนำการพักผ่อน", ["รายงานฉบับที่55มี59ราย", "แพทย์แนะนำการพักผ่อน"]),
        ("== Tanı ==\nBir cümle.\n* madde bir.\n- madde iki.", ["== Tanı ==", "Bir cümle.", "* madde bir.", "- madde iki."]),
        ("Doz sporcularda\nyarıya indirilir. Son.", ["Doz sporcularda\nyarıya indirilir.", "Son."]),
        ("No: 178496975120862977823\nGünlük doz budur.", ["No: 178496975120862977823", "Günlük doz budur."]),
        ("Bir işlem … ve durduruldu.Peki sonra?", ["Bir işlem … ve durduruldu.", "Peki sonra?"]),
    ],
)
def test_units(spark, text, sentences):
    got = units(spark, text)
    assert [s for _, s in got] == sentences
    assert all(text[i : i + len(s)] == s for i, s in got)


def test_offsets_are_code_points(spark):
    text = "👩‍⚕️ geldi. \r\n\r\n Sonra 😀 gitti."
    got = units(spark, text)
    assert len(got) == 2 and all(text[i : i + len(s)] == s for i, s in got)


def test_defined_results(spark):
    for text in (None, "", "   ", "--- 12 ---"):
        assert units(spark, text) == []
    assert units(spark, "a b.") == [(0, "a b.")]
    assert sentence_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    text = "Bir cümle daha. " * 5000
    got = units(spark, text)
    assert len(got) == 5000 and got[-1][0] == 16 * 4999


@pytest.mark.parametrize(("opens", "closes", "stop"), [("“", "”", "."), ("„", "“", "!"), ("«", "»", "?"), ("「", "」", "。")])
def test_quotation_of_any_length(spark, opens, closes, stop):
    quoted = f"Bir cümle daha{stop} " * 300
    text = f"Hekim, {opens}{quoted}{closes} diye yazdı. Gitti."
    assert [s for _, s in units(spark, text)] == [text[: -len(" Gitti.")], "Gitti."]


def test_quotation_mark_left_open(spark):
    text = "„Bir cümle. İkinci cümle.\n\nÜçüncü cümle. Dördüncü, “alıntı” ile. Son."
    assert [s for _, s in units(spark, text)] == ["„Bir cümle.", "İkinci cümle.", "Üçüncü cümle.", "Dördüncü, “alıntı” ile.", "Son."]


def test_list_line_of_any_length(spark):
    first, second = ("* " + "Bir cümle daha. " * 300 + "Bitti.", "- " + "Kısa söz. " * 300 + "Son.")
    assert [s for _, s in units(spark, f"{first}\n{second}\nBaşka satır. Son.")] == [first, second, "Başka satır.", "Son."]


def test_address_of_any_length(spark):
    address = "https://www.ornek.invalid/" + "a.b/" * 400 + "son.html"
    assert [s for _, s in units(spark, f"Bkz. {address} adresi. Son.")] == [f"Bkz. {address} adresi.", "Son."]


@pytest.mark.parametrize("brk", ["\n", "\r\n", "\r"])
def test_list_lines_hold_several_sentences(spark, brk):
    lines = ["Giriş cümlesi.", "* Madde bir var. İkinci cümle burada.", "- Madde iki. Bitti.", "== Başlık ==", "Son cümle. En son."]
    assert [s for _, s in units(spark, brk.join(lines))] == [*lines[:4], "Son cümle.", "En son."]


def test_placeholders_in_the_text(spark):
    text = "Bir \ue000 iki \ue00f üç. Dört \ue00d beş."
    assert [s for _, s in units(spark, text)] == ["Bir \ue000 iki \ue00f üç.", "Dört \ue00d beş."]
