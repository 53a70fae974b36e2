import pytest
from hypothesis import given, settings, strategies as st

from quernel.llm.sentences import sentence_ends, sentence_spans, sentence_units, word_lattice

CASES = [
    ["The job ended at 6 p.m.", "The lint rule drops entries.", "At 9:30 a.m. the run stopped."],
    ["Prof. Orsay and J. K. Vask wrote No. 12, p. 8, e.g. this.", "Ver. 1.2 of index.json was late.", "sturdy-quarry depends on it."],
    ['"The rule is fine." said Orlin Vask.', 'The note says "Stop. Check it. Go." and nothing more.', 'He replied: "Rebuild it first."', "Oddly enough, nobody did."],
    ["(The details are in run.sh, p. 8.)", "It ran on and on... and then stopped.", "After that it just waited...", "What?!", "Yes."],
    ["Am 11. März kam Dr. Quill, z. B. mit 3 %, d. h. unter dem Limit.", "Pläne usw.", "Vgl. S. 13 im Bericht."],
    ["Selka a répondu : « Relancez d'abord. »", "Le dossier contient des plans, etc.", "Où ?"],
    ["¿Por qué se duplicó?", "¡No cambies nada!", "La Dra. Quill midió 3,5.", "«Todo está listo.» dice el registro."],
    ["Пропускает 10 статей, т. е. почти все.", "Старые планы и т. д.", "«Всё работает.» — так записано.", "В 2026 г. список проф. Vask вырос."],
    ["Είναι έτοιμο ή περιμένουμε το v1.2;", "Ο κ. Wexel έγραψε, π.χ. αυτό.", "Παλιά σχέδια κ.λπ."],
    ["كتب د. Wexel أن الذاكرة فارغة.", "هل أصبح جاهزًا؟", "جاء في السجل «كل شيء سليم.» لكن الملف توقف."],
    ['लॉग में लिखा है "सब ठीक है।" पर सूची रुकी है।', "डॉ. Brisk ने लिखा।", "क्यों बढ़ा?"],
    ['기록에는 "모두 정상이다."라고 적혀 있다.', "v1.11.4 버전에서는 고쳐졌다.", "왜 늘었을까?"],
]
JOINED = [
    ["记录里写着“一切正常。”，但链接图已经停了。", "负责人回答：“请先检查run.sh。”", "如果慢了，就重建……然后再检查。", "谁来维护呢？！", "没有句号"],
    ["「すべて正常です。」と記録に書かれている。", "担当者は答えた。", "「まずrun.shを確認してください。」", "もし遅れたなら……止まる。"],
]
THAI = ["การซิงก์ตอนกลางคืนข้ามบทความ 9 รายการ", "ผู้ดูแลตอบว่าให้ตรวจ brisk-lattice ก่อน", "ห้ามแก้ไฟล์ run.sh ด้วยมือ", "รุ่น v3.8.2 ของ keen-tannery แก้ปัญหาข้อ 21 แล้ว", "ดัชนีหัวข้อโตขึ้นสัปดาห์ละ 0.56 MB", "ถ้าแคชว่างเปล่าระบบจะหยุดทำงาน"]


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("want", CASES, ids=lambda w: w[0][:20])
def test_spaced_scripts(want):
    assert units(" ".join(want)) == want
    wrapped = " ".join(want).replace(" and ", "\nand ")
    assert [u.replace("\n", " ") for u in units(wrapped)] == want


@pytest.mark.parametrize("want", JOINED, ids=lambda w: w[0][:8])
def test_joined_scripts(want):
    assert units("".join(want)) == want


def test_thai():
    assert units(" ".join(THAI)) == THAI
    assert word_lattice("ผู้ดูแลตอบว่า")[0] == "ผู้ดูแล" and word_lattice("") == []


def test_blocks():
    text = "---\ntitle: A. B.\n---\n# Head. One unit\r\n\r\nPara one. Two\nwrapped here\n\n- item a\n- item b. And c\n> quoted\n> again. More\n\nuser: hello there\n[10:40] Stamped line\n1. First thing.\n```\ncode. Not units.\n```\n| a | b |\n|---|---|\nEnd."
    assert units(text) == ["Head. One unit", "Para one.", "Two\nwrapped here", "item a", "item b.", "And c", "quoted", "again.", "More", "hello there", "Stamped line", "First thing.", "| a | b |", "End."]


def test_glued():
    assert units("Do not edit run.sh by hand.If it stops, wait.T. Tond wrote it.") == ["Do not edit run.sh by hand.", "If it stops, wait.", "T. Tond wrote it."]


@given(st.text(alphabet="aB. ?!\n\"“”«»()#->`|ก。字;1é…:", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_text_has_ordered_ends(text):
    spans = sentence_spans(text)
    assert all(0 <= a < b <= len(text) and text[a:b].strip() == text[a:b] for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_frame(spark):
    long = "One sentence here. " * 20_000
    rows = [(1, "A b. C d.", "x"), (1, "A b. C d.", "x"), (2, None, None), (3, "", "x"), (4, " \n ", "x"), (5, long, "x"), (None, "Null id.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string")
    got = sentence_units(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 4, 5: 20_000, None: 1}
    assert [r.text for r in sentence_units(df.filter("doc_id = 1"), with_text=True).collect()] == ["A b.", "C d."] * 2
    assert sentence_units(df.limit(0)).count() == 0
    assert sentence_ends("x") == [1]


@pytest.mark.parametrize(
    "units",
    [
        # scripts and languages beyond those of the test tables
        ["แม่ไปตลาดเมื่อเช้า", "พ่ออยู่บ้านดูโทรทัศน์", "น้องไปโรงเรียน"],
        ["ฝนตกหนักมาก", "รถติดทั้งเมือง", "ผู้คนกลับบ้านช้า"],
        ["یہ کتاب میری ہے۔", "وہ گھر گیا۔"],
        ["Այսօր լավ օր է։", "Մենք տուն ենք գնում։"],
        ["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។"],
        ["ကျွန်တော် ဈေးသွားတယ်။", "သူ အိမ်မှာ ရှိတယ်။"],
        ["ሰላም ነው።", "እንዴት ነህ።"],
        ["བཀྲ་ཤིས་བདེ་ལེགས།", "ང་བོད་པ་ཡིན།"],
        ["今日は晴れです．", "明日は雨です．"],
        ["我昨天去了", "他今天来了"],
        ["今日は暑いですね", "水を飲みました"],
        ["ຂ້ອຍໄປຕະຫຼາດ", "ລາວຢູ່ເຮືອນ"],
        ["Il dott. Rossi è partito.", "Torna lunedì."],
        ["Jan pojechał do Warszawy, np. Warszawa jest duża.", "Wrócił w piątek."],
        ["A Exma. Senhora chegou.", "Ela saiu cedo."],
        ["Dhr. Jansen woont hier.", "Hij werkt o.a. in Delft."],
        ["The value is 3.14 today.", "e-mail works again.", "iPhone users complain."],
        ["See p. 12 and vol. 3 for more.", "Nothing else."],
    ],
)
def test_other_scripts_and_languages(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentence_spans(text)] == units


def test_runs_of_any_length_are_segmented_whole():
    run = "แม่ไป" * 3000 + "ครับ"
    assert word_lattice(run)[-1] == "ครับ" and "".join(word_lattice(run)) == run
    text = run + " Next one here."
    assert [text[a:b] for a, b in sentence_spans(text)] == [run, "Next one here."]


def test_openers_are_learned_from_all_blocks(spark):
    """A noun that opens blocks opens sentences after numbers too; with a word list of one's own for the lattice."""
    texts = ["ดาวเทียมโคจรรอบโลก"] * 4 + ["ค่าคือ 14 MB ดาวเทียมโคจรรอบโลก"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, unit_no string")
    ends = lambda **k: [r.end_char for r in sentence_units(df, **k).filter("doc_id = 4").orderBy("end_char").collect()]
    assert ends(dictionary=frozenset(["ดาวเทียม"])) == [12, 31]
    assert ends(dictionary=frozenset(["ดาวเทียม"]), learn=False) == [31]
