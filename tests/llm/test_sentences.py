import pytest
from pyspark.sql import functions as F

from threadloom.llm import sentences as S

CASES = [
    ["Dr. Zuidhoek cut the dose to 44.5 mg, i.e. half of what she took in August.", "It is 8.82% according to Marchetto et al. and 11% on page 8 of vol. 4.", "The call came at 8 a.m.", "The trainer, Mr. A. W. Ostrand Jr., left."],
    ["The reading was .53 on Apr. 3 and 1.3e-5 over the holidays.", "Version 36.9.29 of the app from badger.example/help.html lost my notes.txt!", "No. 5 on the list was tea, nos. 6 and 7 did nothing."],
    ["St. Arrowen Hospital (dept. of sleep, bldg. 15) never called.", "We tried tea (see fig. 2, it is awful! really) after lunch.", "Is it from the U.S. or the U.K. version, e.g. the one we saw?", "Really?!", "Wow..."],
    ["“Has anybody noticed? I doubt it.” asked my dad.", "'Stop! It hurts.' was all that he said.", "She wrote, \"To be fair, it worked. Nobody cared!\"", "No. 4 was it."],
    ["I lost weight... and the swelling went down…", "So it goes — but slowly… The end"][:1] + ["So it goes — but slowly…", "The end"],
    ["„Tut das weh? Ganz bestimmt.“, sagte Lundeby.", "Dr. med. Ostrand lobt z. B. den Termin, d. h. ab dem 6. Mai 6,2 mg.", "Am 26. 7. um 26 Uhr kam er usw.", "Das kostet ca. 5.350,50 Euro inkl. Versand, meint Arrowen."],
    ["El Dr. Ostrand vive en EE. UU. y evita la dieta, etc.", "¡El n.º 19 vale 9.151,50 euros!", "¿Por qué?", "La Sra. Arrowen busca, p. ej., la receta, aprox. 4,8 mg."],
    ["Le Dr Lundeby et Mme. Iverdale compare la tisane...", "M. Ostrand cherche p. ex. la crème (cf. p. 10. quel ennui !) en hiver.", "Pourquoi ?", "« Ça fait mal ? Sûrement. » demande Ostrand."],
    ["А. Б. Zuidhoek ищет чай и т. д.", "Проф. Arrowen сравнивает, т. е. назначает, мазь.", "Это стоило 15 тыс. руб. в 2022 г. на ул. Tamsworth!", "«Больно? Конечно.» — спросил Bexwick зимой."],
    ["Ποιος σημειώνει το τσάι;", "Μια φίλη ξεχνά την αλοιφή· κανείς δεν απαντά.", "Ο κ. Bexwick δοκιμάζει π.χ. τις σταγόνες 16,6 mg.", "Η γιαγιά ξεχνά τη συνταγή κ.λπ.", "«Πονάει; Σίγουρα.» ρώτησε Arrowen."],
    ['डॉ. Varnholt ने 12.8 मि.ग्रा. पुराना नुस्खा लिखी।', '"क्या दर्द है? पता नहीं।" दादी ने कहा।', "पृ. 21 पर लिखा है ।", "नर्स ढूँढता है…"],
    ["د. Lundeby ينصح بـ المرهم بمقدار 13.9 ملغ.", "«هل يؤلم؟ نعم.» قال أخي ص. 16 كل ليلة.", "لماذا؟", "المختبر يقارن المشي..."],
]
TIGHT = [
    ["版本8.5（真糟糕！）把睡眠日记删掉了。", "“疼吗？当然疼。”邻居这样问。", "医生忘了处方……", "每天21.7毫克；我同事换掉处方。", "为什么？"],
    ["「痛いですか？もちろんです。」と祖母は言いました。", "（信じられない！）同僚は買いました。", "Bexwick先生によると一日22.8mgです。", "姉は忘れました…"],
]
THAI = ["คุณยายจดบันทึกยาทา 28 ครั้งตั้งแต่เมื่อวานค่ะ", "คุณหมอ Bexwick ให้ยาทา 14.6 มก. เป็นครั้งที่สองนะคะ", '"เจ็บไหม ไม่รู้สิ" พี่สาวถามจริงๆ', "ดร. Marchetto ซื้อสมุดการนอนครับ", "ยาทาดีมากแล้ว"]


def ends_of(parts, joint):
    text = joint.join(parts)
    out, at = [], 0
    for p in parts:
        out.append(at + len(p))
        at += len(p) + len(joint)
    return text, out


@pytest.mark.parametrize("parts,joint", [(c, j) for c in CASES for j in (" ", "\xa0", "\n\n")] + [(c, j) for c in TIGHT for j in ("", "\n\n")] + [(THAI, " ")])
def test_languages(parts, joint):
    text, want = ends_of(parts, joint)
    got = S.Segmenter().ends(text)
    assert got == want, [text[a:b] for a, b in zip([0, *got], got)]


def test_layout():
    text = "  My routine:\n- tea\n- cold showers, approx. 2.8 mg after\nlunch\n\nNot again! 😀\n \nIt ends :)  \n"
    got = [text[:k].rsplit("\n", 1)[-1] if "\n" in text[:k] else text[:k] for k in S.Segmenter().ends(text)]
    assert got == ["  My routine:", "- tea", "lunch", "Not again! 😀", "It ends :)"]
    numbered = "Questions for Dr. Lundeby:\n1. tea\n2. soup\n3. rest"
    assert S.Segmenter().ends(numbered) == [26, 33, 41, 49]
    assert len(S.Segmenter().ends("It is on page 8 of vol.\n4. The whole thread left.")) == 2


def test_missing_blanks_and_lower_case():
    assert len(S.Segmenter().ends("We left after lunch.Wow. Really?Her dog! Fine")) == 5
    low = "my dad gave up tea last winter. the reading was .41 on jan. 25 and low. mr. h. t. arrowen jr., thanks! is it from the u.s. or the u.k. version? so it goes"
    assert len(S.Segmenter().ends(low)) == 5


def test_edges():
    ends = S.Segmenter().ends
    assert ends(None) == [] and ends("") == [] and ends(" \n\t ") == []
    assert ends("[deleted]") == [9] and ends(" [Removed] \n") == [10]
    assert ends("word") == [4] and ends("...") == [3] and ends("a (b. c") == [7] and ends("A (bed. Cup") == [7, 11]
    long = "It works. " * 20000
    assert len(ends(long)) == 20000


def test_document_then_corpus_decides():
    text = "The blk. A was closed and blk. b as well. Blk. 7 too."
    assert len(S.Segmenter({"blk": "abbreviation"}).ends("We saw blk. seven. It was shut.")) == 2
    assert len(S.Segmenter().ends("We saw block. seven")) == 2
    assert S.Segmenter().ends(text)[-1] == len(text)


def test_corpus_decisions(spark):
    docs = [(k, f"We met in bldx. {k} and bldx. two, and then Arrowen said no. The plan was fine.") for k in range(6)] + [(9, "On the whole we met Arrowen and the dog.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.token: r.kind for r in S.corpus_decisions(df).collect()}
    assert got["bldx"] == "abbreviation" and got["arrowen"] == "name" and "said" not in {k for k, v in got.items() if v == "abbreviation"}


def test_sentence_ends(spark):
    docs = [(1, "One. Two!"), (2, None), (3, ""), (4, "[deleted]"), (5, "One. Two!"), (6, "x" * 100000), (7, "We met in bldx. two and bldx. three.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("end_offset", F.lit(1)).withColumn("doc", F.lit("clash"))
    want = [(1, 4), (1, 9), (4, 9), (5, 4), (5, 9), (6, 100000), (7, 36)]
    assert sorted((r.doc_id, r.end_offset) for r in S.sentence_ends(df).collect()) == want
    assert sorted((r.doc_id, r.end_offset) for r in S.sentence_ends(df, broadcast_rows=0).collect()) == want
    assert S.sentence_ends(df.limit(0)).count() == 0
