"""Sentence units of documents in many languages and scripts.

``sentence_units`` gives one row per unit. A text is first cut into blocks (headings, list items, quoted
lines, speakers' lines, table rows, paragraphs); front matter and fenced code hold no units. In each block the possible ends
are found and kept or dropped:

* Spaced scripts: the terminators of a block (every mark that Unicode calls a sentence terminal, ellipses, Greek question
  marks) form a lattice of possible ends; a full stop is kept or dropped by the token before it
  (abbreviation, initial, ordinal, number), by the opening of what follows, and by the quotes and brackets around it.
* Scripts without spaces that have terminators (Han, kana, Khmer, Burmese, Tibetan) use the same lattice with their marks; where Han or kana
  sentences are set apart by blanks only, a gap ends one after a final word of the lattice of the run before.
* Thai and Lao have neither: each run of letters is segmented by a lattice of dictionary words (fewest unknown
  characters, then fewest words), and each gap is kept or dropped by the final word before and the opening word after. Between two runs
  a gap ends a sentence unless a word on either side binds it; beside a number or a word in another script, where a gap is usual, only
  before an opening word or after a final one. Words that open blocks of the corpus count as opening words too (``opening_words``).

The built-in words are particles, conjunctions, pronouns and other closed classes; a dictionary file of open classes is a parameter.

Defined results: a null or blank text gives no rows; a text is processed whole, however long; repeated rows give their
units again; columns other than the two named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# Tokens that end in a full stop and never end a sentence (lower case, without the last stop).
NEVER = frozenset(
    """mr mrs ms dr prof sr st ver eds vs cf e.g i.e viz approx resp messrs
    z.b d.h u.a nr vgl s bzw ggf evtl hr hrn bsp zzgl inkl ca o.g u.u i.d.r sog str
    m mme mlle mm env p.ex av éd
    sra dra srta ud uds pág págs p.ej aprox núm lic ing
    dott dott.ssa sig sigg sig.ra sig.na prof.ssa avv geom rag arch on p.es pag pagg
    exmo exma ilmo ilma v.exa sto sta prof.a eng
    dhr mevr drs mw bijv bv o.a d.w.z m.b.v t.a.v nl
    np tj tzn m.in ul al mgr inż hab św ks płk godz pt por zob
    např tzv tj mudr judr ing bc rndr
    t.ex bl.a d.v.s s.k f.d f.n jfr
    örn bkz yrd doç av müh
    kb pl ún dr ifj özv
    стр см проф акад г-н г-жа т.е т.к т.н ул рис гл напр доц тыс ок
    κ κα π.χ σελ βλ δηλ αρ κος
    د أ م ص ج
    डॉ श्री प्रो सं पृ""".split()
)
# Tokens that end in a full stop and end a sentence only if a new one opens after them.
MAYBE = frozenset(
    """etc a.m p.m inc ltd co corp bros al jr est pts dept jan feb mar apr jun jul aug sep sept oct nov dec
    usw u.s.w mio mrd std gmbh uhr jh
    min janv févr juil
    т.д т.п др г гг в вв руб млн млрд им
    κ.λπ κ.ά κτλ""".split()
)
# Tokens that go on only before a number, and titles that go on only if written with a capital.
NUMBERED = frozenset("no nos fig figs sec secs p pp vol eq ch art par tab abb kap cap n°".split())
TITLES = frozenset("gen col sgt capt lt rev hon gov sen rep pres mt ft fr".split())
# Month names after which a German ordinal goes on.
MONTHS_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
# Words before an English letter that isn't an initial.
LABELS = frozenset("plan option appendix type class grade team vitamin section part figure table exhibit group step phase".split())
# What goes on after a closing quote in Japanese and Chinese.
JA_GOES_ON = tuple("と って という なんて など の を が".split())
CJK_GOES_ON = "，、；：,;:—–-的」』）)】》〉・"

# Closed classes of Thai and Lao. Openers begin a sentence: conjunctions, question and prohibition words, pronouns, prefixes that make nouns, words of time.
OPENERS = frozenset(
    """ถ้า หาก แม้ เพราะ เนื่องจาก เมื่อ ขณะ ระหว่าง ทำไม ใคร อะไร อย่างไร เหตุใด ห้าม อย่า โปรด กรุณา การ ความ ผู้ ชาว เรา เขา เธอ ท่าน คุณ พวก ฉัน ผม
    ดิฉัน หนู มัน นี่ นั่น แต่ ดังนั้น อย่างไรก็ตาม นอกจาก ต่อมา จากนั้น สุดท้าย ตอนนี้ ปัจจุบัน วันนี้ เมื่อวาน พรุ่งนี้ ทุก บาง ไม่มี มี สำหรับ หลังจาก ก่อนหน้านี้
    ຖ້າ ຫາກ ເພາະ ເນື່ອງຈາກ ເມື່ອ ເປັນຫຍັງ ໃຜ ຢ່າ ກະລຸນາ ການ ຄວາມ ຜູ້ ພວກ ເຮົາ ເຂົາ ຂ້ອຍ ຂ້າພະເຈົ້າ ມັນ ແຕ່ ດັ່ງນັ້ນ ມື້ນີ້ ມື້ວານ ມື້ອື່ນ""".split()
)
# Finals end one: particles and adverbs that stand last.
FINALS = frozenset("แล้ว ครับ ค่ะ คะ นะ จ้ะ จ้า ไหม หรือไม่ หรือยัง หรือเปล่า เลย ด้วย อีก เอง ก่อน เท่า ทั้งหมด ทั้งสิ้น เสมอ มาก จริง แล้ว ແລ້ວ ເດີ ບໍ ດ້ວຍ ເລີຍ ອີກ ກ່ອນ".split())
# Joiners bind what stands on either side: before a gap they need what follows, after it they go on with what was said.
BINDING = frozenset(
    """ของ ว่า ที่ ซึ่ง อัน และ หรือ กับ ให้ ใน บน จาก ละ ข้อ ถึง โดย เพื่อ เป็น คือ ได้แก่ เช่น ประมาณ ราว หน้า เลขที่ รวมทั้ง ตลอดจน พร้อม ต่อ ตาม แก่ แด่ ณ
    ຂອງ ວ່າ ທີ່ ຊຶ່ງ ແລະ ຫຼື ກັບ ໃຫ້ ໃນ ຈາກ ໂດຍ ເພື່ອ ເປັນ ຄື""".split()
)
GOES_ON = frozenset("และ หรือ ที่ ซึ่ง อัน ของ กับ จึง ก็ ว่า คือ เช่น โดย เพื่อ ฯลฯ ๆ แล้ว ด้วย ก่อน ครับ ค่ะ คะ นะ ແລະ ຫຼື ທີ່ ຊຶ່ງ ຂອງ ຈຶ່ງ ກໍ".split())
# Other common words, so that runs come apart at the right places: verbs, adverbs, measures.
PLAIN = frozenset(
    """ไป มา อยู่ ได้ ต้อง ไม่ ควร จะ เคย ยัง ถูก กำลัง จึง ก็ ทำ ทำงาน หยุด เริ่ม จบ เปิด ปิด ใช้ เขียน อ่าน ดู เห็น พบ รู้ คิด บอก ตอบ ถาม พูด กิน นอน เดิน วิ่ง ซื้อ ขาย ให้ รับ ส่ง สร้าง แก้ ลบ ย้าย
    เปลี่ยน เพิ่ม ลด ตรวจ ข้าม รอ โต ใหญ่ เล็ก ใหม่ เก่า ดี ช้า เร็ว น้อย กว่า ขึ้น ลง เข้า ออก นาที วินาที ชั่วโมง วัน สัปดาห์ เดือน ปี ครั้ง คน ตัว อัน เล่ม หน้า บาท เท่า รายการ
    หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า สิบ ร้อย พัน หมื่น แสน ล้าน บ้าน เมือง งาน ปัญหา เรื่อง ชื่อ หัว ข้อ ผู้ดูแล สมุด หนังสือ ไฟล์ ระบบ รายงาน ข้อมูล ผล แผน ตาราง รุ่น ภาพ เสียง น้ำ ไฟ รถ ฝน แม่ พ่อ พี่ น้อง
    เด็ก ครู โรงเรียน ตลาด เพื่อน ประเทศ โลก ค่า เงิน มือ ตา ใจ ทาง ที่ดิน อาหาร ยา หมอ""".split()
)
DICTIONARY = OPENERS | FINALS | BINDING | GOES_ON | PLAIN
# Chinese and Japanese words that end a sentence.
HAN_FINALS = frozenset("了 吧 吗 嗎 呢 啊 呀 啦 嘛 です ます でした ました ません ない なかった だった である だ た ね よ か ください ましょう だろう でしょう".split())

THAI = "\u0e00-\u0eff"  # Thai and Lao
HAN = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
CLOSERS = "\"'”’»›」』）)\\]}】》〉“"
GLUED = "A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆ-Ώ¿¡«„(\"“"  # what may follow a full stop without a space
#: Marks that end a sentence whatever follows: Unicode's sentence terminals but for the ambiguous and the wide ones, and Tibetan shads.
STOPS = "".join(regex.findall("(?![.!?\u061f\u104a\u203c\u203d\u2047-\u2049\u3002\uff01\uff0e\uff1f\uff61])\\p{Sentence_Terminal}", "".join(map(chr, range(0x80, 0x20000))))) + "\u0f0d\u0f0e\u0f11"
ENDING = re.compile(
    "(?P<m>[.!?\u061f\u203c\u203d\u2047-\u2049]+|…+|;)(?P<c>[ \u00a0\u202f]?[»›](?:[)\\]]*)|[" + CLOSERS + "]*)(?=\\s|$|[" + HAN + "]|[—–](?:\\s|$)|[" + GLUED + "])"
    "|(?P<w>[。！？｡]+|[!?](?=[" + HAN + "「『“])|(?<![0-9０-９])．|．(?![0-9０-９])|[" + STOPS + "]+)(?P<d>[" + CLOSERS + "]*)"
)
PAIRS = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "‹": "›", "‚": "‘"}
QUOTING = re.compile('["«„“「『(（\\[《‹‚”»」』)）\\]》›]')
THAI_GAP = re.compile("(?<=\\S)[ \t\u00a0]+(?:\r?\n[ \t]*)?(?=\\S)|(?<=\\S)\r?\n[ \t]*(?=\\S)")
THAI_RUN = re.compile("[" + THAI + "]+")
HAN_LETTER = re.compile("[" + HAN + "]")
HAN_GAP = re.compile("(?<=[" + HAN + "])[ \u3000]+(?=[" + HAN + "])")
GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
VOWEL = re.compile("[aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüаеёиоуыэюяіїєαεηιουωάέήίόύώ]")
NOT_BLANK = re.compile("\\S")
WORD_BEFORE = re.compile("[^\\s(\\[{\"«“„「『（]+$")
STOPPED = re.compile("(?:^|\\s)((?:\\w{1,3}\\.[ \u00a0\u202f]?){1,4})$")

LINE = re.compile("[^\n]*\n?")
FENCE = re.compile(" {0,3}(`{3,}|~{3,})")
HEADING = re.compile("\\s{0,3}#{1,6}(?:[ \t]+|(?=\r?$))")
ITEM = re.compile("\\s*(?:[-*+•–]|\\d{1,4}[.)])(?:[ \t]+\\[[ xX]\\])?(?:[ \t]+|(?=\r?$))")
QUOTED = re.compile("\\s{0,3}(?:>[ \t]?)+")
SPEAKER = re.compile(
    "\\s*(?:(?:\\[?\\(?\\d{1,2}:\\d{2}(?::\\d{2})?(?:\\s?[AaPp][Mm])?\\)?\\]?)\\s+(?:-\\s+)?)?(?:\\*{0,2}"
    "(?:user|assistant|system|tool|human|ai|bot|agent|developer|speaker|host|guest|interviewer|moderator|q|a)(?:\\s?\\d{1,2})?\\*{0,2}[ \t]?[:：]\\*{0,2})(?:[ \t]+|(?=\r?$))",
    re.I,
)
STAMP = re.compile("\\s*(?:\\[\\d{1,2}:\\d{2}(?::\\d{2})?\\]|\\(\\d{1,2}:\\d{2}(?::\\d{2})?\\)|\\d{1,2}:\\d{2}:\\d{2})(?:[ \t]+(?:<?[A-Z][\\w.]*(?: [A-Z][\\w.]*)?>?:[ \t]+)?|(?=\r?$))")
RULE = re.compile("\\s*(?:(?:[-*_=][ \t]*){3,}|\\|?(?:[ \t]*:?-{2,}:?[ \t]*\\|)+[ \t:|-]*)\r?\n?$")
TABLE = re.compile("\\s*\\|.*\\|\\s*$")


def word_lattice(run: str, words: frozenset[str] = DICTIONARY, longest: int = 16) -> list[str]:
    """The best path through the lattice of dictionary words over a run without spaces.

    Least unknown characters first, then fewest words; unknown characters in a row form one word. Linear in the run, however long.
    """
    n = len(run)
    best: list[tuple[int, int, int, bool]] = [(0, 0, -1, True)] + [(1 << 60, 0, -1, True)] * n
    for i in range(n):
        unknown, count, _, known = best[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            if run[i:j] in words and (unknown, count + 1) < best[j][:2]:
                best[j] = (unknown, count + 1, i, True)
        step = (unknown + 1, count + known)
        if step < best[i + 1][:2]:
            best[i + 1] = (*step, i, False)
    out, j = [], n
    while j > 0:
        i, known = best[j][2], best[j][3]
        while not known and i > 0 and not best[i][3]:
            i = best[i][2]
        out.append(run[i:j])
        j = i
    return out[::-1]


class Lexicon:
    """Dictionary, opening words and the words at both ends of runs seen before; a run's lattice is built once a task."""

    def __init__(self, words: frozenset[str] = frozenset(), openers: frozenset[str] = frozenset()) -> None:
        self.words, self.openers = DICTIONARY | words, OPENERS | openers
        self.longest = max(map(len, self.words))
        self.seen: dict[str, tuple[str, str]] = {}

    def ends(self, run: str) -> tuple[str, str]:
        """The first and the last word of a run."""
        if run not in self.seen:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            path = word_lattice(run, self.words, self.longest)
            self.seen[run] = path[0], path[-1]
        return self.seen[run]


PLAIN_LEXICON = Lexicon()


def _gap_ends(block: str, spans: _Spans, lexicon: Lexicon) -> list[int]:
    """Ends at the gaps of a block that holds Thai or Lao."""
    out = []
    runs = [m.span() for m in THAI_RUN.finditer(block)]
    begins, ends = [a for a, _ in runs], [b for _, b in runs]
    for gap in THAI_GAP.finditer(block):
        a, b = gap.span()
        if spans.around(a) >= 0:
            continue
        k, n = bisect_left(ends, a), bisect_left(begins, b)
        last = lexicon.ends(block[runs[k][0] : a])[1] if k < len(ends) and ends[k] == a else None
        first = lexicon.ends(block[b : runs[n][1]])[0] if n < len(begins) and begins[n] == b else None
        if first is not None and last is not None:
            if last not in BINDING and first not in GOES_ON:
                out.append(a)
        elif first is not None:
            if k > 0 and first in lexicon.openers:  # else no such run stands before, and terminators decide
                out.append(a)
        elif last is not None and last in FINALS:
            if block[b].isupper() or block[b] in "¿¡«„“「『" or (block[b].isalpha() and not block[b].isascii()):
                out.append(a)
    return out


def _blank_ends(block: str, spans: _Spans) -> list[int]:
    """Ends at blanks between Han or kana runs after a final word."""
    out = []
    for m in HAN_GAP.finditer(block):
        a = m.start()
        i = a
        while i > 0 and HAN_LETTER.match(block[i - 1]):
            i -= 1
        if spans.around(a) < 0 and word_lattice(block[i:a], HAN_FINALS, 5)[-1] in HAN_FINALS:
            out.append(a)
    return out


class _Spans:
    """Quotes and brackets that both open and close in a block, nested or apart."""

    def __init__(self, block: str) -> None:
        self.by_end: dict[int, tuple[int, bool]] = {}  # place of the closing mark: that of the opening one, whether a bracket
        self.outer: list[tuple[int, int]] = []  # those within no other, in order
        if not QUOTING.search(block):
            return
        stack: list[tuple[str, int]] = []
        wanted: Counter[str] = Counter()  # closing marks that something open waits for

        def close(ch: str, at: int) -> None:
            while True:
                mark, start = stack.pop()
                wanted.subtract(PAIRS.get(mark, mark))
                if ch in PAIRS.get(mark, mark):
                    self.by_end[at] = (start, mark in "(（[")
                    return

        for m in QUOTING.finditer(block):
            ch, at = m.group(), m.start()
            if wanted[ch] > 0:
                close(ch, at)
            elif ch in PAIRS or (ch == '"' and block.find('"', at + 1) >= 0):
                stack.append((ch, at))
                wanted.update(PAIRS.get(ch, ch))
        for end, (start, _) in sorted(self.by_end.items(), key=lambda x: x[1][0]):
            if not self.outer or start > self.outer[-1][1]:
                self.outer.append((start, end))

    def around(self, at: int) -> int:
        """Where the outermost span around a place ends, or -1."""
        k = bisect_left(self.outer, (at, -1)) - 1
        return self.outer[k][1] if k >= 0 and self.outer[k][0] < at < self.outer[k][1] else -1


def _opens(rest: str) -> int:
    """What a new sentence could open with here: 2 surely, 3 a script without case, 1 a lower-case letter, 0 not."""
    ch = rest[0]
    if ch.isupper() or ch.istitle() or ch in "¿¡«„“「『\"([（‘'#" or ord(ch) > 0x2FFF or ord(ch) in range(0x1F000, 0x20000):
        return 2
    if ch.isdigit():
        return 2
    if ch.islower():
        return 1
    if ch.isalpha():
        return 3  # a script without case
    return 2 if ch in "*_`~@$€£§" else 0


def _glued(block: str, at: int, end: int, unit: int, closed: bool) -> bool:
    """Whether a sentence ends at a mark with no space after it: a whole word before, a word with a capital after."""
    ch = block[end]
    if ch in "\"“«„(¿¡":
        if ch == '"' and (block[at] != "." or closed):
            return False
        following = block[end + 1 : end + 3]
    else:
        following = block[end : end + 2]
    if len(following) < 2 or not following[0].isalnum() or not (following[1].islower() or following[1] in " ." or not following[0].isascii()):
        return False
    word = WORD_BEFORE.search(block, max(unit, at - 60), at)
    token = word.group() if word else ""
    if "/" in token or "@" in token or token.lower() in NEVER or (token.isalpha() and len(token) < 2) or (following[1] == "." and len(token.rsplit(".", 1)[-1]) < 2):
        return False
    return closed or len(token) > 1 or token.isdigit()


def _keeps(block: str, m: re.Match, unit: int, spans: _Spans, greek: list[int]) -> int | None:
    """The end that a possible end stands for, or None."""
    mark, closing = (m["m"], m["c"]) if m["m"] is not None else (m["w"], m["d"])
    at = m.start()
    if mark == ";" and bisect_left(greek, unit) == bisect_left(greek, at):
        return None  # no Greek letter between the unit's start and here
    end = m.start() + len(mark)
    quote = bracket = False
    whole = colon = False
    for ch in closing:  # only marks that close something opened before
        if ch in " \u00a0\u202f":
            end += 1
            continue
        span = spans.by_end.get(end)
        if span is None:
            if ch in "“" or (ch in "\"'" and end + 1 < len(block) and not block[end + 1].isspace()):
                break
            end += 1
            continue
        end += 1
        quote, bracket = quote or not span[1], bracket or span[1]
        lead = block[max(unit, span[0] - 12) : span[0]].rstrip(" \t\r\n*_")
        whole, colon = not lead and span[0] - unit <= 12, lead[-1:] in (":", "：")
    if end < m.end() and m["m"] is not None and block[end : end + 1] and not block[end].isspace():
        return None
    if spans.around(at) >= end:
        return None
    follow = NOT_BLANK.search(block, end)
    if not follow:
        return end
    rest = block[follow.start() : follow.start() + 80]
    spaced = block[end].isspace()
    if m["w"] is None and not spaced and rest[0] not in "—–" and not re.match("[" + HAN + "]", rest):
        return end if _glued(block, at, end, unit, quote or bracket) else None
    if m["w"] is not None and not spaced:
        if quote:
            if rest[0] in CJK_GOES_ON or (rest.startswith(JA_GOES_ON) and not colon):
                return None
        return end
    if rest[0] in "—–" and quote:
        return None
    opens = _opens(rest)
    small, opens = opens == 1, 0 if opens == 1 else opens
    if small and mark != "." and block[at - 1].isalpha() and not (block[at - 1].islower() or block[at - 1].isupper()):
        opens = 2  # a script without case before: a name in another script may open what follows
    if mark in ("...", "…", "……") or set(mark) <= {".", "…"} and len(mark) > 1:
        if not spaced:
            return None
        return end if opens in (2, 3) else None
    if mark[0] in "\u0964\u0965" or m["w"] is not None:
        if quote and opens == 3 and not colon:
            return None
        return end
    if quote:
        if opens == 3:
            return end if colon else None
        return end if opens == 2 else None
    if bracket:
        return end if opens or (small and whole) else None
    if mark != ".":
        return end if opens or small or mark == ";" else None
    word = WORD_BEFORE.search(block, max(unit, at - 40), at)
    token = word.group() if word else ""
    low = token.lower()
    if low not in NEVER and re.search("['’]", low) and re.split("['’]", low)[-1] in NEVER and len(re.split("['’]", low)[-1]) > 1:
        low = re.split("['’]", low)[-1]
    if len(token) <= 3:  # abbreviations written with spaces, as "z. B."
        joined = STOPPED.search(block[max(unit, at - 16) : at + 1])
        if joined and joined.group(1).count(".") > 1:
            whole = re.sub("[ \u00a0\u202f]", "", joined.group(1)).rstrip(".").lower()
            low = whole if whole in NEVER or whole in MAYBE else low
    if low in MAYBE:
        if opens == 3 or not opens:
            return end if opens == 3 else None
        if rest[0].isdigit() or (low == "al" and rest[0] == "("):
            return None
        return end
    if low in NEVER:
        return None
    if low in NUMBERED and rest[0].isdigit() or low in TITLES and token[:1].isupper() and rest[0].isupper():
        return None
    if len(token) == 1 and token.isalpha() and re.match("\\w{1,3}\\.", rest):
        return None  # an abbreviation written with spaces goes on
    if len(token) == 1 and token.isupper():
        before = re.search("(\\w+)\\s+$", block[unit : at - 1])
        if not (before and before.group(1).lower() in LABELS):
            return None
    if token.isdigit() and len(token) <= 2:
        following = re.match("\\w+", rest)
        if following and following.group().lower() in MONTHS_DE:
            return None
    if not opens and len(token) > 1 and token[-1].isalpha() and not (token[-1].islower() or token[-1].isupper()):
        return end
    listed = low in NUMBERED or low in TITLES
    parts = [x for x in token.split(".") if x]
    word_like = len(token) > 3 or token.isdigit() or (len(token) > 1 and VOWEL.search(low)) if len(parts) < 2 else min(map(len, parts)) > 1  # else a file's name or a number
    if small and not listed and word_like:
        return end  # no abbreviation: a sentence may open in lower case, with a name or for want of care
    return end if opens else None


def _block_units(block: str, offset: int, out: list[tuple[int, int]], lexicon: Lexicon) -> None:
    """Appends start and end of each unit of a block that begins at offset."""
    stop = len(block.rstrip())
    if not stop:
        return
    block = block[:stop]
    unit = 0
    ends: list[int] = []
    spans = None
    greek: list[int] = []
    for m in ENDING.finditer(block):
        if spans is None:
            spans = _Spans(block)
            greek = [g.start() for g in GREEK.finditer(block)] if ";" in block else []
        end = _keeps(block, m, unit, spans, greek)
        if end is not None and end > unit:
            ends.append(end)
            unit = end
    if THAI_RUN.search(block):
        ends = sorted({*ends, *_gap_ends(block, spans or _Spans(block), lexicon)})
    if HAN_GAP.search(block):
        ends = sorted({*ends, *_blank_ends(block, spans or _Spans(block))})
    if not ends or ends[-1] != stop:
        ends.append(stop)
    at = 0
    for end in ends:
        while block[at].isspace():
            at += 1
        out.append((offset + at, offset + end))
        at = end


def sentence_ends(text: str | None, lexicon: Lexicon = PLAIN_LEXICON) -> list[int]:
    """For each unit, in order, the number of characters of text up to and with its last one."""
    return [end for _, end in sentence_spans(text, lexicon)]


def sentence_spans(text: str | None, lexicon: Lexicon = PLAIN_LEXICON) -> list[tuple[int, int]]:
    """Start and end, in characters, of each unit in order."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    at, size = 0, len(text)
    if text.startswith("\ufeff"):
        at = 1
    if text.startswith(("---\n", "---\r\n"), at):
        close = re.compile("^(?:---|\\.\\.\\.)[ \t]*\r?(?:\n|\\Z)", re.M).search(text, text.index("\n", at) + 1)
        if close:
            at = close.end()
    begin, fence = -1, ""

    def flush(end: int) -> None:
        nonlocal begin
        if begin >= 0:
            _block_units(text[begin:end], begin, out, lexicon)
            begin = -1

    while at < size:
        stop = text.find("\n", at)
        stop = size if stop < 0 else stop + 1
        line = text[at:stop]
        if fence:
            m = FENCE.match(line)
            if m and m.group(1).startswith(fence) and not line[m.end() :].strip():
                fence = ""
            at = stop
            continue
        bare = line.strip()
        if not bare:
            flush(at)
        elif (ch := bare[0]) in "`~" and (m := FENCE.match(line)):
            flush(at)
            fence = m.group(1)
        elif ch == "#" and (m := HEADING.match(line)):
            flush(at)
            end = len(line.rstrip())
            if end > m.end():
                out.append((at + m.end(), at + end))
        elif ch == ">" and (m := QUOTED.match(line)):
            flush(at)
            inner = line[m.end() :]
            mark = ITEM.match(inner) or SPEAKER.match(inner) or HEADING.match(inner)
            begin = at + m.end() + (mark.end() if mark else 0)
            flush(stop)
        elif ch in "-*_=|:" and RULE.match(line):
            flush(at)
        elif ch == "|" and TABLE.match(line):
            flush(at)
            begin = at
            flush(stop)
        elif (m := SPEAKER.match(line)) or (m := STAMP.match(line)):
            flush(at)
            begin = at + m.end()
        elif (ch in "-*+•–" or ch.isdigit()) and (m := ITEM.match(line)):
            flush(at)
            begin = at + m.end()
        elif begin < 0:
            begin = at + len(line) - len(line.lstrip())
        at = stop
    flush(size)
    return out


def opening_words(texts: Iterable[str | None], lexicon: Lexicon = PLAIN_LEXICON) -> Counter[tuple[str, bool]]:
    """How often dictionary words open a block of Thai or Lao (True) or stand after a gap beside a number or another script (False)."""
    counts: Counter[tuple[str, bool]] = Counter()
    for text in texts:
        if not text or not THAI_RUN.search(text):
            continue
        for line in text.split("\n"):
            mark = HEADING.match(line) or QUOTED.match(line) or ITEM.match(line) or SPEAKER.match(line) or STAMP.match(line)
            at = mark.end() if mark else len(line) - len(line.lstrip())
            for m in THAI_RUN.finditer(line):
                if m.start() == at or (m.start() > 1 and line[m.start() - 1] in " \t" and not THAI_RUN.match(line[m.start() - 2])):
                    word = lexicon.ends(m.group())[0]
                    if word in lexicon.words:
                        counts[word, m.start() == at] += 1
    return counts


def learned_openers(counts: Iterable[tuple[str, bool, int]]) -> frozenset[str]:
    """Words that open blocks, and at least once for each ten times they stand after such a gap; particles and joiners never."""
    starts, after = Counter(), Counter()
    for word, opens, n in counts:
        (starts if opens else after)[word] += n
    return frozenset(w for w, n in starts.items() if n >= 3 and 10 * n >= after[w] and w not in GOES_ON and w not in BINDING and w not in FINALS)


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, dictionary: frozenset[str] = frozenset(), learn: bool = True) -> DataFrame:
    """One row per sentence unit: id, unit_no from 1, end_char and, if asked for, the unit's text.

    Documents are independent, so nothing is shuffled; only the two columns named are read. dictionary: more words for the lattices of
    Thai and Lao. With learn, documents that hold such letters are read once before, and what comes back is two counts for each dictionary
    word that opens something: no more rows than twice the dictionary, whatever the corpus.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    openers: frozenset[str] = frozenset()
    if learn:

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Lexicon(dictionary)
            for batch in batches:
                yield pd.DataFrame([(w, o, n) for (w, o), n in opening_words(batch["t"], own).items()], columns=["word", "opens", "n"])

        counted = rows.select("t").filter(F.col("t").rlike("[\u0e00-\u0eff]")).mapInPandas(count, "word string, opens boolean, n bigint").groupBy("word", "opens").agg(F.sum("n").alias("n"))
        openers = learned_openers((r.word, r.opens, r.n) for r in counted.collect())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(dictionary, openers)
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "ends": [sentence_ends(t, own) for t in batch["t"]]})

    if not with_text:
        ends = rows.mapInPandas(cut, f"k {kind}, ends array<int>")
        return ends.select("k", F.posexplode("ends").alias("n", "end_char")).select(F.col("k").alias(id_col), (F.col("n") + 1).alias("unit_no"), "end_char")

    def cut_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(dictionary, openers)
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"], strict=True):
                spans = sentence_spans(t, own)
                yield pd.DataFrame({"k": [k] * len(spans), "unit_no": range(1, len(spans) + 1), "end_char": [b for _, b in spans], "text": [t[a:b] for a, b in spans]})

    return rows.mapInPandas(cut_text, f"k {kind}, unit_no int, end_char int, text string").withColumnRenamed("k", id_col)
