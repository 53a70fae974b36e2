"""Finds fetched pages that hold no page: unfilled templates, filler text, error pages and notices that scripts are needed.

Bodies are cut into messages (lines and sentences), numbers, addresses, dates and ids in them are masked, and equal ones are
grouped by digest over all pages. Each different message is classified once, by phrase rules and by whether all its words are such as
messages to a visitor are made of; those that recur on several hosts are then judged by where they recur, and the classes go back to the
pages. A page in which nothing of its own is left is residue. Placeholders are looked for in titles and bodies without code and
quotations. No rule knows names or turns of the corpus at hand.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quernel.functions.times import tidy
from quernel.session import checkpointed, own_folder

# Words of filler text, by kind.
LATIN_FILLER = """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia
deserunt mollit anim id est laborum
aenean lacinia bibendum vestibulum mauris donec vivamus pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas
curabitur integer posuere erat ante venenatis dapibus cras justo odio facilisis egestas fusce condimentum nibh fermentum massa
praesent cursus vel scelerisque nisl maecenas faucibus interdum etiam porta sem nullam id dictum ultricies vehicula sapien
phasellus suscipit lectus quam luctus viverra sagittis tellus augue hendrerit pharetra lobortis eget vitae ligula porttitor rhoncus
tincidunt eros elementum feugiat pretium mattis metus vulputate euismod sodales proin varius blandit accumsan gravida""".split()
LAYOUT_FILLER = "solupta nonse latur faccus quamet menda isti sarin moditi antique corpore omnis velorum doluptas viti berum ratio pedita erro tandus".split()
KEYBOARD_FILLER = "foo bar baz qux quux blah asdf asdfgh qwer qwerty jkl xxx yyy zzz abc test testing hjkl zxcv sdf".split()
FILLER_WORDS = frozenset(LATIN_FILLER + LAYOUT_FILLER + KEYBOARD_FILLER)
#: Of these, the ones that are words of other languages too; a message needs another one beside them.
ORDINARY = frozenset("in ex do ad et sit ut id est non test testing abc sed qui sunt aliqua ea culpa bar erro ratio".split())

# Forms of placeholders, as regular expressions that Java and Python read alike.
# The look-ahead rejects most places of a text by their first character.
PLACEHOLDER = r"(?=[\[{(<$#%@_XTF])(?:" + "|".join(
    [
        r"\{\{\{?\s*\w[\w.|\s-]{0,60}?\s*\}?\}\}", r"\$\{\s*[\w.]+\s*\}", r"#\{\s*[\w.]+\s*\}", r"%\([\w.]+\)[sdif]", r"<%[=-]?\s*[\w.]+\s*%>", r"<\?=\s*\$?[\w.>-]+;?\s*\?>", r"\{%-?\s*[\w.]+\s*-?%\}",
        r"\[\[%[\w.]+%\]\]", r"\[%\s*[\w.]+\s*%\]", r"(?<![\w_])__[A-Z][A-Z0-9_.]*[A-Z0-9]__(?![\w_])", r"@@[\w.]+@@", r"(?<![\w%])%[A-Z][A-Z0-9_.]+%(?!\w)", r"(?<![\w$])\$[A-Z][A-Z0-9_.]+\$(?!\w)",
        r"\bXX_[A-Z0-9_.]+_XX\b", r"\[(?i:insert|your|enter|add|my) [\w.' -]{1,40}\]", r"\[(?i:title|name|first name|company|date|author|city|product) here\]", r"\b(?:TODO|FIXME|TBD):? (?:add|insert|fill in|write|put|set) [\w.]+", r"\[object Object\]",
        r"<[A-Z][A-Z0-9]*(?:[_.][A-Z0-9]+)+>", r"<(?:TITLE|COMPANY|NAME|AUTHOR|DATE|CITY|PRODUCT|COUNT|YEAR|PLAN|HEADING|BODY|USER|EMAIL|USERNAME|ID|PRICE|ADDRESS)>", r"\((?:[\w.]+(?: [\w.]+){0,2}) goes here\)", r"(?<![\w$#%\\{}])\{[A-Za-z][\w]*(?:\.\w+)+\}(?!\})", r"(?<![\w$#%\\{}])\{[A-Za-z][\w]{2,}\}(?!\})",
    ]
) + ")"
CODE = r"(?s)(?:^|\n)[ ]{0,3}(```|~~~).*?(?:\n[ ]{0,3}\1[^\n]*|\z)|<(pre|code)>.*?</\2>|`[^`\n]+`"
QUOTED = r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|「[^」\n]{1,300}」|‘[^’\n]{1,300}’"
FENCED = r"(?s)(?:^|\n)[ ]{0,3}(```|~~~).*?(?:\n[ ]{0,3}\1[^\n]*|\z)"
LINES = r"\s*\n\s*"
SENTENCES = r"\s(?<=[.!?…؟।][\"'”’»」』)\]]{0,2}\s)\s*|(?<=[。！？])[”’」』]?"

_THING = r"(?:page|post|view|file|resource|document|article|address|content|link|site|website|token|session|visit|connection|upstream|host|database|servers?|requests?|record|item|service|url|path|account|backend|proxy|key|certificate|image|video|story|entry|section|portal|application)"
_ERRORS = [
    rf"\b(?:this|that|the|your|our|requested) (?:\w+ )?{_THING}(?: (?:that )?(?:you|we) [\w' ]{{3,40}}?| hosts?| side| here| at this \w+)? (?:does ?n[o']t exist|does not exist|(?:could|can|can)(?:not| not|n't) be|not be found|not found|failed to|fails to|(?:is|are|was|were) (?:not|no longer|currently|temporarily|closed|down|overloaded|busy|taking a break|being repaired|unavailable|blocked|reset|moved|removed|deleted|offline|restricted|gone|out of)|(?:has|have) (?:been|expired|ended|run out|timed out|moved|gone)|may have (?:been|moved)|did(?:n't| not) (?:reply|respond|answer)|took too long|timed out|gave (?:no|an)|sent (?:no|an)|no longer|not (?:available|offered|valid|allowed)|arriving too)",
    r"\b(?:we|i)(?:'re| are)? (?:could ?n[o']t|could not|can'?t|cannot|can not|were unable|unable|have lost|lost|don'?t know|do not know|did not find|found nothing)\b.*\b(?:find|open|load|tell|that|show|reach|verify|process|locate|display|serve|page|document|file)\b",
    r"\bunable to (?:open|load|find|show|reach|connect|process|display)\b|\bfailed to load\b",
    r"\byou (?:do not|don't|are not|aren't|may not|must be|have been|need to be|need permission|lack)\b.*\b(?:permission|allowed|signed in|logged in|authori[sz]ed|blocked|access|rights?)\b|\bnot allowed to (?:see|view|open|access)\b",
    r"\b(?:access denied|forbidden|page not found|not found|internal (?:server )?error|server error|service unavailable|bad gateway|bad request|gateway time-?out|session (?:has )?expired|too many requests|temporarily (?:offline|unavailable|down)|something (?:went wrong|broke)|be right back|connection refused|link has expired|unexpected (?:condition|error)|nothing to see|out of order|down for (?:planned|scheduled|maintenance)|under maintenance|unauthori[sz]ed|error (?:\d+|#|4xx|5xx)|http (?:\d+|#)|rate limit (?:reached|exceeded)|unusual traffic|suspicious activity|(?:are you|not) (?:a|human|robot)\b|a robot|you are (?:a )?(?:human|person|not a robot)|solve the puzzle|captcha|(?:blocked|offered) (?:by a rule|in your)|your (?:area|country|region|network)|maintenance (?:mode|work)|we(?:'ll| will) be back|one more step|lost that page|your (?:requests?|session|visit|token|connection)\b)",
]
_SCRIPT = r"(?:javascript|\bjs\b|\bscripts?\b|\bscripting\b|active content|client-side|content blocker|\bcookies\b|run the code|noscript)"
_SCRIPT_CUE = r"\b(?:please|you|your|this|enable|allow|activate|unblock|turn on|switch(?:ed)? (?:on|off)|needs?|requires?|required|relies|rely|depends?|without|disabled|blocked|missing|detected|must|off|sorry|supported?|cannot|to (?:continue|see|read|use|view|get)|full version)\b"
_COMPANIONS = [
    r"^(?:please,? |then |or |and |so |sorry,? |now |you (?:can|may|could|might) (?:also )?)?(?:try|come|check|wait|reload|refresh|go|use|tell|contact|sign|log|tick|solve|confirm|press|return|learn|see|ask|search|visit)\b.*\b(?:again|back|later|minutes?|moments?|address|spelling|owner|site owner|start page|home ?page|page|retry|in|search|puzzle|person|human|reload|help(?: pages?| desk)?|instead|support|administrator|next request|browser)\b",
    r"\bwe(?:'ve| have| are|'re|'ll| will)?\b.*\b(?:logged|notified|look(?:ing)? into|working on|fix(?:ing)?|investigat\w+|aware of|apologi[sz]e)\b|\b(?:our|the) (?:team|engineers|staff|support team)\b.*\b(?:notified|informed|working|know)\b|\b(?:thank you|thanks) for your (?:patience|understanding)\b|\bsorry for (?:the|any)\b|\bif you (?:believe|think) this\b|\berror (?:code|id|reference)\b",
    r"\bif (?:this|the problem) (?:keeps|happens|persists|continues)\b|\bsupported browsers?\b|\bcookies must\b|\bslow down\b|\bjust a moment\b|\bloading\b|\boops\b|\bsorry\b|\bplease wait\b|\bhold on\b|\bredirecting\b|\bchecking your browser\b|\bstays? empty\b",
]
_FILLERS = [
    r"\b(?:goes|go) (?:right )?(?:here|in this (?:spot|box|space|place))\b|\bto follow\W*$|\bcoming soon\b.*\btext\b",
    r"^(?:just|this is|here is)(?: only| just)?(?: an?| one| some| the)? (?:dummy|sample|mock|demo|placeholder|filler|example)\b",
    r"\b(?:dummy|sample|placeholder|filler|mock|demo|example)\b (?:text|copy|caption|paragraph|title|headline|tagline|quote|intro|description)\b.*\b(?:only|ignore|nothing|layout|replace)\b|\bnothing to see yet\b|\bplease ignore\b",
    r"^(?:replace|insert|paste|type|enter|put|add|write|click|edit|fill|change)\b.*\b(?:here|box|own words|description|this text|save|yourself|text|your (?:page|title|text|headline|tagline|caption|content))\b",
    r"\byour (?:\w+ ){0,2}here\W*$|\bonly here to show\b|\bclick (?:here )?to edit\b|\bclick edit\b|\blorem ipsum\b",
]
# The same in other languages; parts of words, as these have endings.
_FOREIGN = {
    "error": """nicht gefunden|nicht erreichbar|zugriff verweigert|keine berechtigung|existiert nicht|wurde verschoben|nicht verfügbar|serverfehler|etwas schief|abgelaufen|nicht gestattet|zu viele anfragen|wartungsarbeiten|überlastet|gewünschte seite
    |introuvable|accès refusé|indisponible|n'existe plus|n'existe pas|pas le droit|n'avez pas|erreur (?:interne|du serveur|#)|trop de temps|expiré|trop de requêtes|page demandée|mal passé|surchargé
    |no encontrad|acceso denegado|no disponible|ya no está|no tiene permiso|no existe|algo salió mal|error (?:interno|del servidor)|ha caducado|demasiadas solicitudes|fuera de servicio|servidor .*(?:tarda|ocupado)
    |не найден|доступ (?:запрещ|закрыт)|недоступ|удален[аоы]? или|удалена|нет прав|не существует|ошибка (?:сервера|#|\\d)|что-то пошло не так|истек|слишком много запросов|запрошенн|сервер .*не отвеча|перемещена
    |不存在|拒绝访问|没有权限|已被删除|无法访问|服务暂停|服务器|暂停服务|访问的页面|请求过多|已过期|出错了|找不到|暂时无法
    |見つかりません|アクセスできません|移動または削除|権限がありません|表示できません|サーバー|有効期限|利用できません|エラーが発生|メンテナンス
    |찾을 수 없|접근이 거부|권한이 없|서비스를 이용할 수 없|오류가 발생|만료되|서버 오류|삭제되었
    |غير موجود|تم رفض|ليس لديك إذن|غير متاح|خطأ في الخادم|انتهت|الصفحة
    |नहीं मिला|अनुमति नहीं|उपलब्ध नहीं|सर्वर त्रुटि|पृष्ठ .*नहीं
    |δεν βρέθηκε|δεν υπάρχει|απαγορεύεται|μη διαθέσιμ|δεν έχετε|σφάλμα (?:διακομιστή|#)|έληξε
    |ไม่พบหน้า|ไม่มีสิทธิ์|ปฏิเสธการเข้าถึง|ไม่พร้อมใช้งาน|เซิร์ฟเวอร์|หมดอายุ
    |non (?:è stat[ao] )?trovat|accesso negato|non (?:è )?(?:più )?disponibile|non esiste|non autorizzat|errore (?:interno|del server|#)|scadut|troppe richieste|fuori servizio
    |niet gevonden|bestaat niet|toegang geweigerd|geen toegang|niet beschikbaar|serverfout|er is iets misgegaan|verlopen|te veel verzoeken
    |nie istnieje|nie znalezion|nie została znaleziona|brak dostępu|dostęp zabroniony|odmowa dostępu|niedostępn|błąd (?:serwera|#)|wygasł|zbyt wiele żądań
    |bulunamadı|mevcut değil|erişim (?:reddedildi|engellendi)|izniniz yok|kullanılamıyor|sunucu hatası|süresi doldu|çok fazla istek
    |não (?:foi )?encontrad|acesso negado|não (?:está )?disponível|não existe|sem permissão|erro (?:interno|do servidor|#)|expirou|muitas solicitações|fora do ar""",
    "script": """javascript|javascrip|skripte|exécution de scripts|los scripts|de scripts|скрипт|脚本|スクリプト|스크립트|जावास्क्रिप्ट|सक्रिप्ट|جافا ?سكريبت|σενάρι|สคริปต์|จาวาสคริปต์""",
    "weak": """versuchen sie es|später noch einmal|réessayer|réessayez|inténtelo|más tarde|попробуйте|зайти позже|请稍后|再试|もう一度お試し|しばらくして|다시 시도|잠시 후|حاول مرة|बाद में|δοκιμάστε|ลองใหม่|ลองอีกครั้ง""",
    "filler": """blindtext|platzhalter|ersetzen sie diesen|hier (?:steht|kommt|folgt|entsteht) (?:später|bald|noch|in kürze|ihr|der|die|das)\\b|folgt (?:noch|in kürze)|mustertext|beispieltext|ihr (?:text|titel) hier|geben sie hier
    |texte (?:d'exemple|de (?:remplissage|démonstration|test)|provisoire|factice)|remplacez ce|à venir\\b|faux texte|votre (?:texte|titre|contenu) ici|saisissez (?:ici|votre)|ici (?:viendra|ira|votre)
    |texto de (?:ejemplo|relleno|muestra|prueba|demostración)|(?:reemplace|sustituya|cambie) este|aquí (?:va|irá|iría|su)\\b|su (?:texto|título|contenido) aquí|título pendiente|(?:escriba|introduzca|ponga) (?:aquí|su)
    |заглушка|замените эт|здесь (?:будет|появится)|ваш (?:текст|заголовок)|текст-рыба|заголовок появится|пример текста|образец текста|введите (?:здесь|текст|заголовок)
    |示例(?:文字|文本|段落|内容)|(?:请在此|在此处|此处|请)(?:输入|填写)|(?:标题|内容|正文)待定|占位|测试文[字本]|您的(?:文字|内容|标题)
    |(?:ダミー|サンプル|仮の?)(?:テキスト|文章|文)|(?:本文|見出し|タイトル)が入ります|(?:本文|見出し|テキスト|タイトル|文章)を入力してください|ここに.*(?:入ります|入力)
    |(?:예시|더미|샘플|견본) (?:텍스트|문장|글)|여기에 .*(?:입력|들어)|들어갑니다
    |نص (?:تجريبي|بديل|مؤقت)|استبدل هذا|اكتب هنا|नमूना (?:पाठ|शीर्षक)|यहा[ँं] .*(?:लिखें|आएगा)|इस अनुच्छेद|κείμενο (?:δείγμα|δοκιμής)|δείγμα κειμένου|αντικαταστήστε|γράψτε εδώ|εδώ θα|ข้อความ(?:ตัวอย่าง|ทดสอบ|จำลอง)|แทนที่ข้อความ|ใส่(?:ข้อความ|หัวข้อ)|พิมพ์ที่นี่""",
}
FOREIGN = {k: re.compile(re.sub(r"\s*\n\s*", "", v)) for k, v in _FOREIGN.items()}
ERRORS, FILLERS = (re.compile("|".join(f"(?:{p})" for p in ps)) for ps in (_ERRORS, _FILLERS))
ADVICE, SURELY_WEAK = re.compile(_COMPANIONS[0]), re.compile("|".join(_COMPANIONS[1:]))
SCRIPT, SCRIPT_CUE = re.compile(_SCRIPT), re.compile(_SCRIPT_CUE)
ENGLISH = frozenset("the this your you is are for and please we of that with was it to not in on".split())
# Words that any English sentence may hold.
COMMON = frozenset(
    """a an the this that these those it its is are was were be been being am do does did done have has had having can could may might must
    shall should will would not no nor t don doesn isn aren couldn wasn weren hasn haven didn won shouldn wouldn cannot re ve ll s d m and or but if then
    else so as at by for from in into of off on onto out over to under until up upon with without within about after again all also any because
    before both down each either enough ever every few how i me my more most much many neither next none now once one only other our ours
    own please same some soon such than their them there they too very we what when where which while who why you your yours yourself
    us here just yet let get got go goes gone going back like want make made way whether through between little nothing something anything
    everything instead seems seem soon quite rather away around later today ago sure okay ok welcome dear hello hi""".split()
)
# English words that messages of servers, browsers and site owners to a visitor are made of: things, states and acts.
THINGS = frozenset(
    """page pages post view file files resource document article address content link links site website web token session visit connection
    upstream host hosts hosting database server servers request requests record item service services url path account backend proxy key certificate gateway image video
    story entry section portal application app system network internet browser browsers cookies cookie javascript js script scripts scripting code client
    side plugin extension ad blocker noscript domain owner administrator admin webmaster team engineers staff support help desk search home homepage start
    screen device window version feature option settings permission permissions rights access password user guest guests member members visitor subscription login region
    country area law reasons rule rules traffic activity rate limit robot bot human person puzzle captcha box security error errors failure problem
    problems issue trouble condition status reference incident ray id http https moment minute minutes seconds while time day hours date spelling text step steps""".split()
)
STATES = frozenset(
    """active enabled disabled blocked allowed supported unsupported required needed missing unavailable available unable denied forbidden unauthorized unauthorised authorized
    authorised restricted internal bad lost moved removed deleted renamed expired ended closed offline online busy overloaded temporarily temporary currently permanently unexpected
    unexpectedly found timed timeout out long late slow quickly broken wrong invalid incorrect old outdated latest modern current new full reset refused rejected aborted interrupted
    exceeded reached unusual seen suspicious met detected parked suspended banned construction maintenance planned scheduled empty signed logged notified informed aware sorry
    oops whoops legal secure private safe down longer different main first last quick short still usual later together right below listed""".split()
)
ACTS = frozenset(
    """enable disable turn switch switched allow activate unblock block support require requires need needs rely relies depend depends work works working run runs
    running load loads loaded loading fail fails failed find exist exists open opened show shown display displayed reach see read view continue use using visit visiting
    return come came keep keeps check checking wait try trying tried retry reload refresh press click tick sign log register contact tell ask report send sent answer answered
    respond reply replied took take gave give looking look went happened happens happening broke know fix fixing fixed investigate investigating apologize
    apologise believe think thank thanks verify verifying confirm solve prove learn update upgrade install redirecting hold persists happen requested asked moved repaired
    taking break serve served process tell cause caused slow change end match arriving offered valid complete finish going understanding patience inconvenience stay stays follow followed comment comments""".split()
)
# English words that filler of unfinished pages is made of.
STUFFING = frozenset(
    """title headline tagline caption captions copy description paragraph quote intro introduction body heading subtitle name company author text dummy sample mock demo
    placeholder filler example layout spot box space place ignore nothing replace replaced insert paste type enter put add write click edit fill change save
    words lorem ipsum follow follows coming show sentence line content page section block short long small brief see press button image
    photo picture logo link item list number date price word heading style font colour color template theme design website site""".split()
)
NOTICE_WORDS, FILLER_PHRASE_WORDS = COMMON | THINGS | STATES | ACTS, COMMON | STUFFING
#: A sentence that demands scripts and names no more than the thing that needs them.
DEMAND = re.compile(r"^(?:sorry,? |please,? )?(?:this|the|our|your|that) [\w-]+ (?:needs?|requires?|relies on|depends on|(?:does(?: not|n't)|can(?:not| ?not|'t)|will not|won't) (?:be )?(?:work|run|load|open|loaded|shown|opened)(?: properly| correctly)? without|(?:only )?(?:works|runs|loads) (?:only )?with) (?:active |enabled |an? )?(?:javascript|js|scripts?|scripting|active content|client-side (?:code|scripts?)|cookies)(?: (?:enabled|to (?:be )?\w+|turned on|switched on))?\W*$")
#: A message that is made of such words and says one of these is a notice, whatever its form.
STRONG = re.compile(
    r"\berrors?\b|\bnot (?:found|supported|available|valid)\b|\b(?:denied|forbidden|unavailable|unauthori[sz]ed|expired|timed out|time-?out|offline|overloaded|maintenance|parked|out of date|outdated|unsupported"
    r"|under construction|refused|no longer|does ?n[o']t exist|does not exist|can ?not be|could not be|unable to|went wrong|broke|happened|unexpected|unusual traffic)\b|\b(?:is|are|was|were|been|got) (?:moved|removed|deleted|blocked|invalid|refused|lost)\b|\bfailed\W*$"
)
FURNITURE = re.compile(r"^(?:#{1,6} .*|[-*] ?\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\([^)]*\)(?:\s*[·|•/-]\s*\[[^\]]*\]\([^)]*\))*|(?:time|date|request id|ray(?: id)?|incident|reference|ref|trace|error code|id|code)\b:? ?[\w#:-]*|err_[\w#]+|\w+/[#.\d]+|[a-z]+/#[\w.]*|back to [\w ]+|return to [\w ]+|all rights reserved\W*|questions\?|\W*|© .*|!\[[^\]]*\]\([^)]*\)|[-*_=]{3,}|home|menu|search|contact|about|help|login|sign in|\(#\))$")


#: A message is common from so many hosts on.
RECURS = 3


def _outside(words: list[str], known: frozenset[str]) -> int:
    """How many words are none of the known ones, nor plurals of them."""
    return sum(w not in known and not (w[-1:] == "s" and w[:-1] in known) for w in words)


def message_class(text: str | None) -> str:
    """own, notice (error, refusal, outage, scripts), weak (what goes with notices), filler, furniture or maybe.

    text is a masked message. A phrase rule must match, and the words around it must be such as messages to a visitor are made of: a sentence
    that names anything else is own, one that does so in an eighth of its words at most is a maybe, as is a phrase in a language
    without such a list; how it recurs decides then.
    """
    low = re.sub(QUOTED, " ", (text or "").strip()).lower()
    low = low.replace("’", "'")
    words = re.findall(r"[^\W\d_]+", low)
    if FURNITURE.match(low):
        body = re.sub(r"^[#\s]+", "", low)
        return "filler" if FILLERS.search(body) else "furniture"
    if sum(w in FILLER_WORDS for w in words) >= max(1, 0.6 * len(words)) and not ORDINARY.issuperset(w for w in words if w in FILLER_WORDS):
        return "filler"
    english = not ENGLISH.isdisjoint(words)
    scripted = bool(SCRIPT.search(low))
    if FILLERS.search(low) and (beyond := _outside(words, FILLER_PHRASE_WORDS)) <= len(words) / 8:
        return "maybe" if beyond else "filler"
    if DEMAND.search(low):
        return "notice"
    outside = _outside(words, NOTICE_WORDS)
    if words and outside <= len(words) / 8:
        says = (scripted and SCRIPT_CUE.search(low) and "comment" not in low) or ERRORS.search(low) or (not outside and STRONG.search(low))
        if says:
            return "maybe" if outside else "notice"
        if not outside and (SURELY_WEAK.search(low) or ADVICE.search(low) or scripted):
            return "weak"
    if scripted and "comment" in low and outside <= 1:
        return "weak"
    if not english:
        for kind, name in (("filler", "filler"), ("script", "notice"), ("error", "notice"), ("weak", "weak")):
            if FOREIGN[kind].search(low):
                return "weak" if name == "weak" else "maybe"
    return "own"


@F.pandas_udf(T.StringType())
def _class(text: pd.Series) -> pd.Series:
    return text.map(message_class)


def masked(c: Column) -> Column:
    """A message with addresses, e-mail addresses, dates, ids and numbers as ``#`` and white space as single blanks."""
    # most messages hold neither addresses nor digits, so the dearer patterns are tried on the others only
    web = F.regexp_replace(F.regexp_replace(c, "https?://\\S+|www\\.\\S+", "#"), "[\\w.+-]+@[\\w-]+\\.[\\w.]+", "#")
    c = F.when(c.contains("://") | c.contains("www.") | c.contains("@"), web).otherwise(c)
    bare = F.regexp_replace(F.regexp_replace(c, "\\b(?=[a-z]*\\d)(?=\\d*[a-z])[a-z0-9]{6,}\\b", "#"), "\\d+(?:[.,:/-]\\d+)*", "#")
    c = F.when(c.rlike("\\d"), bare).otherwise(c)
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def holds_placeholder(c: Column) -> Column:
    """Whether a text without its code and quotations holds an unfilled placeholder."""
    bare = F.regexp_replace(F.regexp_replace(c, CODE, " "), QUOTED, " ")
    return F.coalesce(bare.rlike(PLACEHOLDER) | tidy(F.lower(c)).isin("undefined", "null", "nan", "[object object]"), F.lit(False))


def page_body(*fields: str) -> Column:
    """The first field that isn't blank."""
    return F.coalesce(*[F.when(tidy(F.col(f).cast("string")) != "", F.col(f).cast("string")) for f in fields])


def _units(bodies: DataFrame, host_col: str) -> DataFrame:
    """id, host, message and its digest for each message of each body, masked once."""
    body = F.regexp_replace("body", FENCED, "\n")
    whole = lambda line: line.rlike("^\\s*#{1,6}\\s")  # noqa: E731  a heading is one message
    cut = F.flatten(F.transform(F.split(body, LINES), lambda line: F.when(whole(line), F.array(line)).otherwise(F.split(line, SENTENCES))))
    units = bodies.select("id", F.col(host_col).alias("host"), F.explode(cut).alias("unit"))
    units = units.select("id", "host", masked(F.col("unit")).alias("message"))
    return units.withColumn("hash", F.substring(F.unhex(F.sha2("message", 256)), 1, 16))


def _recurrence(units: DataFrame) -> DataFrame:
    """Each different message once, with how often and on how many hosts it occurs, and its class."""
    by_host = units.groupBy("hash", "host").agg(F.count("*").alias("n"), F.first("message").alias("message"))
    known = by_host.groupBy("hash").agg(F.first("message").alias("message"), F.sum("n").alias("times"), F.count("*").alias("hosts"))
    return known.withColumn("class", _class("message"))


def classify_messages(bodies: DataFrame, host_col: str = "host") -> DataFrame:
    """Different messages of bodies (id, host, body) with how often and on how many hosts they occur, and their class."""
    return _recurrence(_units(bodies, host_col).filter("message <> ''"))


def residue(fetches: DataFrame, id_col: str = "fetch_id", url_col: str = "url", title_col: str = "title", body_cols: tuple[str, ...] = ("content", "markdown", "text")) -> DataFrame:
    """id, why (placeholder, filler, notice) of the fetches that are no real page.

    Recurrence decides on messages that stand on three hosts or more: one that no rule knows goes with notices or filler if it stands beside
    such in half of its pages and beside anything of a page's own in a tenth at most; one that a rule holds for a notice or filler counts as a
    page's own if it stands beside what only that page says in nine tenths of its pages (a maybe: in more than half). A page is residue if
    nothing of its own is left in it.

    Defined results: a fetch whose body is blank is none of them, whatever its title, as
    there is nothing to judge; a null title counts as empty; rows that share an id are judged together; a null id is judged as one more id; empty tables
    give no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^\\s*(?:\\w+:)?//([^/?#]*)", 1))
    rows = fetches.select(F.col(id_col).alias("id"), host.alias("host"), F.col(title_col).cast("string").alias("title"), page_body(*body_cols).alias("body")).filter("body is not null")
    # one pass over the bodies: whether they hold a placeholder, and their masked messages
    flagged = rows.withColumn("template", holds_placeholder(F.col("title")) | holds_placeholder(F.col("body"))).select("id", "host", "template", "body")
    path = own_folder(fetches.sparkSession, "messages")
    _units(flagged.withColumn("host", F.struct("host", "template")), "host").select("id", "host.*", "hash", "message").filter("message <> '' or template").write.parquet(path)
    units = fetches.sparkSession.read.parquet(path)  # columns of their own, so each later look reads only those it needs
    classes = checkpointed(_recurrence(units.select("hash", "host", "message")).select("hash", "class", (F.col("hosts") >= RECURS).alias("common")))
    judged = checkpointed(units.select("id", "hash", "template").distinct().join(classes, "hash"))
    n = lambda c: F.count(F.when(c, 1))
    kind = lambda *c: F.col("class").isin(*c)
    pages = judged.groupBy("id").agg(n(kind("own") & ~F.col("common")).alias("alone"), n(kind("notice", "filler", "maybe")).alias("bad"))
    recurring = judged.filter(kind("own", "notice", "filler", "maybe") & F.col("common")).select("id", "hash", "class")
    met = recurring.join(pages.select(F.col("id").alias("of"), (F.col("bad") > 0).alias("bad"), (F.col("alone") > 0).alias("good")), F.col("id").eqNullSafe(F.col("of")))
    company = met.groupBy("hash", "class").agg(F.count("*").alias("pages"), n(F.col("bad")).alias("bad"), n(F.col("good")).alias("good"))
    goes_along = kind("own") & (F.col("pages") >= RECURS) & (2 * F.col("bad") >= F.col("pages")) & (10 * F.col("good") <= F.col("pages"))
    told = (kind("maybe") & (2 * F.col("good") > F.col("pages"))) | (kind("notice", "filler") & (10 * F.col("good") > 9 * F.col("pages")))
    moved = company.filter(goes_along | told).select("hash", F.when(kind("own"), "weak").otherwise("own").alias("becomes"))
    final = judged.join(moved, "hash", "left").withColumn("class", F.coalesce("becomes", "class"))
    kinds = final.groupBy("id").agg(F.max("template").alias("template"), n(kind("own")).alias("own"), n(kind("filler")).alias("filler"), n(kind("notice", "weak", "maybe")).alias("notice"))
    empty = (F.col("own") == 0) & (F.col("filler") + F.col("notice") > 0)
    why = F.when(F.col("template"), "placeholder").when(empty, F.when(F.col("filler") > F.col("notice"), "filler").otherwise("notice"))
    return kinds.select(F.col("id").alias(id_col), why.alias("why")).filter("why is not null")
