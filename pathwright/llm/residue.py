"""Template residue and error-page text.

Method: count normalised lines by host, once per distinct body, subtract recurrent boilerplate, and
exclude records whose residual contains error, placeholder, filler or
script-required evidence with next to nothing real beside it.

Evidence is what a sentence does, not a list of sentences: a served thing that cannot be had, a demand on the
reader's browser, a status or trace of a machine, an unfilled slot, filler. Each family has cues, one of which every
match holds; one automaton looks for all cues, and only sentences with a cue meet the expressions of their families.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pathwright.session import written

#: A line is boilerplate of its host from this share of the host's distinct bodies on, and from so many of them.
BOILERPLATE_SHARE, BOILERPLATE_DOCS = 0.002, 5
#: A line that is evidence is boilerplate of its host (a notice at the foot of every page) from this share of the bodies with content on.
EVIDENCE_SHARE = 0.05
#: Residue may stand beside a title or a sentence: so many pieces between full stops or question marks, of so many words in all.
REAL_SENTENCES, REAL_WORDS = 2, 34
#: A sentence of more words is evidence only if it addresses its reader: running text of that length may mention anything.
LONG_WORDS = 22

# What a server serves, in the languages of the patterns, and what happens to it.
_OBJ = (
    r"(?:web ?)?(?:page|site|record|document|file|article|paper|manuscript|supplement|link|url|address|resource|item|entry|content|server|host|service|archive|repository|viewer|reader|reading room|view|request|preview|pdf|"
    r"full text|figure|download|session|system|application|connection|publication|chapter|issue|volume)s?"
)
_LOST = (
    r"(?:(?:could|can|was|were|is|are|does|do|did|has|have)(?: ?not|n't)(?: \w+){0,2}? (?:be )?(?:found|located|loaded|displayed|opened|shown|retrieved|rendered|reached|available|processed|converted|accessed|exist|answer|respond|valid)"
    r"|no longer (?:\w+ )?(?:available|exists?|hosted|valid|here|online)|(?:is|are|was|were|has been|have been) (?:unavailable|withdrawn|removed|deleted|moved|disabled|blocked|locked|suspended|denied|down)"
    r"|unavailable|failed to (?:load|open|render)|returned (?:nothing|no content)|timed out|never existed)"
)
#: What is lost: a negation beside its verb, or a verb of loss. A match also holds a served thing, which is left to the expression.
_LOST_CUES = "|".join(
    [f"{n}+{v}" for n in ("not", "n't") for v in "found located loaded displayed opened shown retrieved rendered reached available processed converted accessed exist answer respond valid locate load open display retrieve reach render".split() + ["find"]]
    + ["no longer", "unavailable", "withdrawn", "unable to", "failed to", "returned nothing", "returned no content", "timed out", "never existed"]
    + [f"{b} {v}" for b in ("is", "are", "was", "were", "been") for v in "removed deleted moved disabled blocked locked suspended denied down".split()]
    + [f"{b}+{v}" for b in (" has been ", " have been ") for v in "removed deleted moved disabled blocked locked suspended denied down".split()]
)
_DE, _FR, _ES = (
    r"(?:seite|dokument|artikel|dienst|server|datei|link|ansicht|inhalt|volltext|adresse|eintrag|beitrag)\w*",
    r"(?:page|document|article|ressource|fichier|site|service|lien|adresse|serveur|contenu|notice)s?",
    r"(?:página|documento|artículo|recurso|archivo|servidor|contenido|servicio|enlace|sitio|registro)s?",
)
_SCRIPTS = r"(?:java ?script\b|\bjs\b|\b(?:s[ck]ripts?|skripte|scripting)\b|\bcookies\b|script blocker)"
_REASONS = (
    r"(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|not allowed|not acceptable|authentication required|(?:request|gateway)? ?time-?out|conflict|gone|length required|"
    r"precondition failed|too large|too long|unsupported media|not satisfiable|expectation failed|too many requests|legal reasons|not implemented|bad gateway|gateway|(?:service )?unavailable|not supported|denied)"
)
#: Kind, cues (of which every match holds one; # is any digit; + joins two that a match holds both), expression over a sentence in
#: lower case. Expressions without cues are for whole sentences of WHOLE characters at most.
WHOLE = 60
_FAMILIES: tuple[tuple[str, str, str], ...] = (
    ("error", "4##|5##", rf"\b[45]\d\d\b\W{{0,4}}(?:error\b(?=\W*$|\s*[^\w\s])|(?:\w+\W+){{0,2}}{_REASONS})"),
    ("error", "http", r"\bhttp(?:/\d(?:\.\d)?)?(?: status| error)?(?: code)?\W{0,3}[45]\d\d\b"),
    ("error", "error #|error: #|error:#|error-#|fehler #|fehler: #|fehler-#|erreur #|erreur: #|erreur : #|errore #|errore: #|erro #|erro: #|błąd #|błąd: #|ошибка #|ошибка: #|エラー#|エラー #|エラー: #", r"^\W*(?:error|fehler|erreur|errore|erro|błąd|ошибка|エラー)(?: ?: ?| |-)?\d{3}\b"),
    ("error", "oops|uh-oh|uhoh", r"^\W*(?:oops|whoops|uh-?oh)\b"),
    ("error", "sorry|désolé|sentimos|leid", rf"^\W*(?:we(?:'re| are) )?(?:(?:very|so|terribly) )?sorry\b.{{0,160}}?\b(?:{_OBJ}|wrong|unable|problem|find|load)\b|désolée?s?\b.{{0,120}}?\b(?:{_FR}|erreur)\b|lo sentimos\b|tut uns leid\b"),
    ("error", "apolog|excus|entschuld", r"apologi[sz]e for (?:the|any|this) inconvenience|(?:veuillez nous excuser|entschuldigen sie) "),
    ("error", "traceback|recent call|raise |file \"|error:|error :|failure:|failure :|exception:|exception :|:#", r"^traceback\b|most recent call last|^file \"[^\"]*\", line \d+|^raise \w+\(|^(?:\w+\.)*\w*(?:error|failure|exception) ?:|^at [\w.$]+\([\w.]+:\d+\)"),
    ("error", "fatal|parse error|syntax error|runtime error|internal error|system error|database error|sql error|warning|notice|on line", r"^(?:php )?(?:fatal|parse|syntax|runtime|internal|system|database|sql) (?:error|warning)\b|^(?:php )?(?:warning|notice)\b.*\bon line \d+|\bon line \d+\W*$"),
    ("error", "latex failure|latex error|latex warning|pages of output|conversion stopped|conversion failed|conversion aborted|undefined environment|core dumped|segmentation fault|stack trace|stacktrace", r"latex (?:failure|error|warning)|no pages of output|conversion (?:stopped|failed|aborted)|undefined environment|core dumped|segmentation fault|stack ?trace"),
    ("error", _LOST_CUES, rf"\b{_OBJ}\b[^.,;]{{0,60}}?\b{_LOST}|\b(?:could(?: not|n't)|cannot|unable to|failed to) (?:find|locate|load|open|display|retrieve|reach|render) (?:the|that|this|your) (?:\w+ ){{0,2}}{_OBJ}"),
    ("error", "maintenance|temporarily unav|service unav|service is|server error|bad gateway|gateway time|longer hosted", r"\b(?:down for|under) (?:\w+ )?maintenance\b|temporarily unavailable|service (?:is )?unavailable|(?:internal|upstream) server error|bad gateway|gateway time-?out|no longer hosted"),
    ("error", "unexpected|unknown|internal|occurred|went wrong|gone wrong", rf"(?:hit|encountered|ran into|experienced) an? (?:unexpected|unknown|internal) \w+|\ban? (?:\w+ )?error (?:has )?occurred|something (?:went|has gone) wrong|unexpected condition"),
    ("error", "request was|request blocked|request denied|request rejected|reference number|incident|trace id|trace code|ray id|ray code|error id|error code", r"\brequest (?:was )?(?:blocked|denied|rejected)|\breference number\W*\d|your request was logged|^incident\b\W*\d|^(?:trace|ray|error) (?:id|code)\b"),
    ("error", "check the|try again|back to the|return to the|contact the", r"^(?:please )?check the (?:address|url|link)\b|\btry again\b(?: later| in\b| soon|\W*$)|\bgo back to the (?:start|home)|return to the (?:home|start) ?page|contact the (?:administrator|webmaster|support)"),
    ("error", "too many req|rate limit|wait |access denied|access is denied|access was denied|permission|authori", r"too many requests|rate limit(?:ed|ing)?\b(?: has)? ?(?:exceeded|reached|been exceeded)|\bwait \d+ (?:seconds|minutes)|access (?:is |was )?denied|do(?:es)? not have permission|permission denied|(?:you are|are) not authori[sz]ed"),
    ("error", "session|sign in|log in|verify|are you|captcha|unusual traffic|restricted to|subscription|purchase", r"session (?:has )?(?:expired|timed out)|\b(?:sign|log) in (?:again )?(?:to|and)\b|until you (?:sign|log) in|verify (?:that )?you are|are you (?:a )?(?:human|robot)|(?:solve|complete|enter) (?:the|this|a) (?:re)?captcha|(?:re)?captcha (?:below|required|verification)|unusual traffic|restricted to (?:subscribers|members)|subscription (?:is )?required|purchase (?:access|this)"),
    ("error", "full text|no abstract|no text|no content|no preview|no full|has no|not provided|preview", r"full text (?:is )?(?:not|un) ?(?:yet )?available|\bno (?:abstract|text|content|preview|full text)\b(?: is| was)? (?:available|provided|found)|\b(?:record|page|document|item|entry|article|paper|this|it) has no (?:text|abstract|content)\b|(?:abstract|text|content)\b[^.]{0,20} not provided|not provided by (?:the )?publisher|preview (?:is )?(?:un|not )available"),
    ("error", "error\"|errors\"|detail\"|message\"|status\"|code\"|error'|detail'|message'|status'|code'|status:|status :|code:|code :|trace:|trace :|message:|message :|<error|<code|<message|<requestid|nosuchkey|accessdenied", r"^[\[{]\W*(?:error|errors|detail|message|status|code)[\"'] ?:|^\W*(?:status|code|trace|message) ?:|<(?:error|code|message|requestid)>|accessdenied|nosuchkey"),
    # other languages
    ("error", "nicht|zugriff|anfragen|sitzung|erneut|berechtigung|serverfehler|wartung|melden|fehler", rf"\b{_DE}[^.]{{0,60}}?\b(?:nicht (?:mehr )?(?:gefunden|verfügbar|erreichbar|geladen|angezeigt|geöffnet)|existiert nicht)|nicht (?:gefunden|erreichbar)\W*$|erneut versuchen|später erneut|versuchen sie es|zugriff verweigert|zu viele anfragen|sitzung (?:ist )?abgelaufen|keine berechtigung|interner serverfehler|fehler (?:ist )?aufgetreten|wartungsarbeiten|melden sie sich"),
    ("error", "introuvable|n'existe|n'est|indisponible|accès|requêtes|expiré|ssayez|ssayer|erreur|en maintenance|connectez|connecter", rf"introuvable|\b{_FR}[^.]{{0,60}}?(?:n'existe|n'est) (?:pas|plus)|indisponible|accès (?:refusé|interdit)|trop de requêtes|session (?:a )?expiré|veuillez réessayer|réessayez|erreur (?:interne|du serveur|est survenue|s'est produite)|en maintenance|connectez-vous|vous connecter"),
    ("error", "no se|no está|no existe|no fue|no ha sido|no disponible|no encontrad|acceso|solicitudes|sesión|intente|inténtelo|error interno|error del|mantenimiento", rf"no se (?:ha )?(?:encontr|pudo)\w*[^.]{{0,40}}?\b{_ES}|\b{_ES}[^.]{{0,60}}?\bno (?:se |está |existe|fue |ha sido |disponible|encontrad)|acceso (?:denegado|restringido)|demasiadas solicitudes|sesión (?:ha )?(?:caducad|expirad)|inténtelo|intente(?:lo)? (?:de nuevo|más tarde)|error (?:interno|del servidor)|(?:por|en) mantenimiento|inicie sesión"),
    ("error", "不存在|未找到|无法|不可用|拒绝|稍后|过期|登录|请求|错误|维护|权限|找不到", r"页面(?:不存在|未找到|无法)|不存在。?$|暂时不可用|无法(?:访问|加载|显示|打开|找到)|找不到(?:页面|文件|网页)|访问被拒绝|拒绝访问|请稍后|会话已过期|请(?:先|重新)?登录|请求(?:过多|过于频繁)|服务器(?:内部)?错误|维护中|没有权限"),
    ("error", "trovat|disponibile|errore interno|un errore|riprova|negato|manutenzione|scaduta|inesistente", r"pagina (?:non (?:è stata )?trovata|inesistente)|(?:pagina|servizio|documento|risorsa|contenuto)[^.]{0,50} non (?:è )?(?:disponibile|trovat[oa])|si è verificato un errore|errore interno del |riprova(?:re)? più tardi|accesso negato|in manutenzione|sessione scaduta"),
    ("error", "encontrad|disponível|um erro|novamente|acesso negado|manutenção|sessão expir", r"(?:página|documento|recurso|arquivo|serviço|conteúdo)[^.]{0,50} não (?:foi |está )?(?:encontrad[oa]|disponível)|não encontrad[oa]\W*$|ocorreu um erro|tente novamente|acesso negado|em manutenção|sessão expir"),
    ("error", "znaleziono|istnieje|niedostępn|błąd|ponownie|dostęp", r"nie znaleziono|nie istnieje|(?:strona|usługa|serwer)[^.]{0,40} niedostępn|wystąpił błąd|spróbuj ponownie|odmowa dostępu|dostęp zabroniony"),
    ("error", "найден|существует|недоступ|ошибка|попробуйте|доступ", r"(?:страниц\w+|документ|файл|ресурс|запис\w+|стать\w+)[^.]{0,50} не (?:найден|существует)|не найден[ао]?\W*$|(?:сервис|сервер|страница)[^.]{0,40} недоступ|произошла ошибка|ошибка сервера|попробуйте (?:ещё|еще|снова|позже)|доступ (?:запрещ|закрыт)"),
    ("error", "見つかりません|存在しません|できません|エラー|メンテナンス|お試し|拒否", r"見つかりません|存在しません|(?:アクセス|利用|表示)できません|エラーが発生|メンテナンス中|もう一度お試し|アクセスが拒否"),
    ("error", "gevonden|beschikbaar|opnieuw|geweigerd|fout", r"(?:pagina|document|bestand|artikel)[^.]{0,40} niet (?:gevonden|beschikbaar)|probeer het (?:later )?opnieuw|toegang geweigerd|fout opgetreden"),
    # demands on the reader's browser
    ("script", "javascript|java script| script|scripts|scripting|cookies|skript| js", rf"(?:enable|activat\w*|turn(?:ed)? (?:it |them )?(?:on|off)|switch(?:ed)? (?:it |them )?(?:on|off)|disabl\w*|must (?:run|support|execute)|executes?|stops)[^.]{{0,40}}?{_SCRIPTS}|\b(?:allow|permit)(?:s|ing)? (?:your )?{_SCRIPTS}|(?:without|requir(?:es?|ing)|\bneeds?) (?:\w+ ){{0,2}}{_SCRIPTS}"),
    ("script", "javascript|java script| script|scripts|scripting|cookies|skript| js", rf"{_SCRIPTS}[^.]{{0,60}}?(?:\benabled?\b|disabled|blocked|is necessary|\brequired|\bneeded|turned o|switched o|\ballow|permitted|not supported|deactivated|before you can continue)"),
    ("script", "switched off|turned off", r"\bbrowser has (?:it|them|these|scripts?) (?:switched|turned) off"),
    ("script", "javascript|java script| script|scripts|cookies|skript", rf"(?:aktivier|erlaub|ohne\b|benötig|erforder|activ(?:er|ez|e|a|ar)\b|habilit|autoris|nécessit|requiert|necesita|permit(?:a|e|ir|en|ez)\b|ejecut|exécut|\bative|attiv|abilit|włącz|включ|inschakel)\w*[^.]{{0,40}}?{_SCRIPTS}|{_SCRIPTS}\W{{0,3}}(?:を有効|が無効)"),
    ("script", "脚本|javascript", r"(?:启用|禁用|允许|需要|开启)[^。]{0,20}(?:java ?script|脚本)|(?:java ?script|脚本)[^。]{0,20}(?:禁用|启用|允许|无法|开启)"),
    # unfilled slots
    ("placeholder", "{{|${|@@|%%|<<|[[|\\var{|__|#|<%|{%", r"\{\{\s*[\w.\- |]+\s*\}\}|\$\{[\w.\-]+\}|@@[\w\-]+@@|%%[\w\-]+%%|<<\s*[\w.\- ]+\s*>>|\[\[\s*[\w.\- ]+\s*\]\]|\\var\{|(?<!\w)__\w+__(?!\w)|(?<![\w&#])#\w+#|<%=?[^%]*%>|\{%[^%]*%\}"),
    ("placeholder", "", r"^\W*(?:[\w ]{0,24}[:=]\s*)?[<{\[]\s*[a-z]+(?:[_ ][a-z]+)*\s*[>}\]]\W*$"),
    ("placeholder", "insert | here|here]|click to|type your|enter your", r"\[insert\b[^\]]{0,60}\]|\[[^\]]{0,40}\bhere\]|\byour [\w ]{1,20} here\b|\binsert [\w ]{1,20} here\b|goes here|click to (?:edit|add)|type your|enter your"),
    # filler
    ("filler", "", r"^\W*(?:todo|tbd|tba|xxx+|fixme|null|undefined|nan|n/?a|none|nil|lorem ipsum|placeholder|untitled|empty|asdf|test|foo|bar)(?:\W+(?:null|undefined|nan|todo|tbd|tba|xxx+|n/?a))*\W*$"),
    ("filler", "", r"^\W*(?:abstract|body|title|keywords?|authors?|venue|references?|evidence|contribution|text|content|summary)\s*[:=]\s*(?:n/?a|null|none|undefined|tbd|todo|xxx|-+|\?+|\.+)?\W*$"),
    ("filler", "[object|body missing|body is missing|(null)", r"\[object object\]|body (?:is )?missing|\(null\)"),
    ("filler", "to be added|to be written|to be completed|to be determined|to be announced|to be supplied|to be filled|write me|coming soon|construction|sample text|sample content|sample abstract|dummy text|lorem ipsum|empty template|not index|content removed|text removed|left blank", r"\bto be (?:added|written|completed|determined|announced|supplied|filled)(?: in| here| later| soon)?\W*$|\bwrite me\b|\bcoming soon\b(?!\s+\w)|^\W*(?:\w+\W+){0,4}under construction\W*$|\bsample (?:content|text|abstract)\b|\bdummy text\b|\blorem ipsum\b|empty template|do not index|\b(?:content|text) removed\b|this page (?:is )?intentionally left blank"),
    ("filler", "____", r"^_{4,}$|(?:^|\W)_{5,}(?:\W|$)"),
    ("filler", "à venir|compléter|folgt in|ergänz|blindtext|platzhalter|texte ici|texte de rem|hier steht|hier text|completar|pendiente|próximamente|texto aquí|texto de rel|待|敬请|此处|示例|占位", r"à venir\W*$|à compléter|folgt in kürze|noch (?:zu )?ergänz|wird (?:noch )?ergänzt|blindtext|platzhalter|texte (?:ici|de remplissage)|hier (?:steht|text)|por completar|pendiente de (?:completar|redac)|próximamente\W*$|texto (?:aquí|de relleno)|待补充|待定|敬请期待|此处(?:填写|插入|为)|示例(?:文本|内容)|占位"),
)
_KINDS = ("error", "script", "placeholder", "filler")
_SEARCHES = [(_KINDS.index(kind), re.compile(expression)) for kind, _, expression in _FAMILIES]
_PATTERNS = [re.compile("|".join(f"(?:{x})" for kind, _, x in _FAMILIES if kind == k)) for k in _KINDS]
_WHOLES = [i for i, (_, cues, _) in enumerate(_FAMILIES) if not cues]


def _automaton() -> tuple[ahocorasick.Automaton, list[tuple[int, int]]]:
    """An automaton of all cues, each with a bit of its own or, for those that stand alone, the bits of their families above these; and the joined
    pairs as (bits of both, bit of the family)."""
    alone: dict[str, int] = {}
    joined: list[tuple[str, str, int]] = []
    for i, (_, cues, _) in enumerate(_FAMILIES):
        for cue in filter(None, cues.split("|")):
            if "+" in cue:
                a, b = cue.split("+")
                joined.append((a, b, i))
            else:
                for tail in itertools.product(*(string.digits if c == "#" and len(cue) > 1 else c for c in cue)):
                    word = "".join(tail)
                    alone[word] = alone.get(word, 0) | 1 << i
    parts = {w: len(_FAMILIES) + k for k, w in enumerate(dict.fromkeys(w for a, b, _ in joined for w in (a, b)))}
    a = ahocorasick.Automaton()
    for word in {*alone, *parts}:
        a.add_word(word, alone.get(word, 0) | (1 << parts[word] if word in parts else 0))
    a.make_automaton()
    return a, [(1 << parts[x] | 1 << parts[y], 1 << i) for x, y, i in joined]


_CUES: list = []


def _cued(low: str) -> int:
    """Bits of the families of which a cue stands in a text in lower case."""
    if not _CUES:
        _CUES.extend(_automaton())
    found = 0
    for _, b in _CUES[0].iter(" " + low):
        found |= b
    own = found & (1 << len(_FAMILIES)) - 1
    if found != own:
        for both, family in _CUES[1]:
            if found & both == both:
                own |= family
    return own


#: The beginnings of the words of the usual filler paragraph.
LOREM = frozenset(
    "lore ipsu dolo sit sita amet cons adip elit sed eius temp inci labo magn aliq enim mini veni quis nost exer ulla nisi "
    "comm duis aute irur repr volu veli cill fugi null pari exce sint occa cupi non proi sunt culp qui offi dese moll anim est".split()
)
#: What a sentence says that speaks about such strings instead of being one.
MENTION = re.compile(
    r"\b(?:said|says|saw|reads|asked (?:the )?(?:readers?|users?|visitors?)|(?:is|are|was|were) (?:called|named|dropped|replaced|pretrained|excluded|filtered|discarded|flagged|labell?ed|annotated|treated)|"
    r"treats?|maps?|contain(?:s|ed|ing)|follows? the pattern|markers|such as|e\.g\.)(?!\w)"
)
#: How a text addresses its reader.
ADDRESS = re.compile(r"\b(?:you|your|please|sorry|apologi[sz]e|veuillez|votre|désolés?|bitte|ihre?n?|por favor|lo sentimos|su (?:navegador|solicitud|sesión)|per favore|proszę|пожалуйста)\b|请|您|ください")

_SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。!?;])\s*| / ")
_QUOTED = re.compile(r"``.{1,80}?''|“[^”]{1,80}”|(?<!\w)'[^']{1,80}'(?!\w)")
_STRUCTURE = re.compile(r"\\(?:section|subsection|paragraph|chapter|title|begin|end|label|maketitle|item)\b\*?(?:\{[^{}]*\})*|^\s*(?:#{1,6}\s.*|%.*|\\%.*|[=*_\-]{3,}|powered by .*|(?:©|\(c\)|copyright ).*|request id: .*)$")
_WIDE, _WORDS = re.compile(r"[㐀-鿿]"), re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_DIGITS = re.compile(r"\d+")


def line_key(line: str) -> str:
    """A line without case, runs of white space and the values of its numbers."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def _tokens(text: str) -> list[str]:
    if text.isascii():
        return _WORDS.findall(text)
    wide = len(_WIDE.findall(text))
    return _WORDS.findall(_WIDE.sub(" ", text)) + [""] * ((wide + 1) // 2)


def evidence(low: str, tokens: list[str] | None = None) -> int:
    """Bits of the kinds of evidence that a sentence in lower case is, of whatever length."""
    cued = _cued(low)
    searches = [i for i in range(len(_FAMILIES)) if cued >> i & 1] if cued else []
    if len(low) <= WHOLE:
        searches += _WHOLES
    if not searches:
        return 0
    bare = _QUOTED.sub(" ", low) if "'" in low or "`" in low or "“" in low else low
    kinds = 0
    for i in searches:
        k, search = _SEARCHES[i]
        if not kinds >> k & 1 and search.search(bare):
            kinds |= 1 << k
    if not kinds or MENTION.search(low):
        return 0
    if not kinds & 4 and len(_tokens(low) if tokens is None else tokens) > LONG_WORDS and not ADDRESS.search(low):
        return 0
    return kinds


def filler_words(tokens: list[str]) -> bool:
    """Whether at least three in five of four or more words are those of the usual filler paragraph."""
    return len(tokens) > 3 and sum(w[:4] in LOREM for w in tokens) >= 0.6 * len(tokens)


def analysed(line: str) -> tuple[int, int, int]:
    """(kinds, sentences, words) of a line: bits of the kinds of evidence its sentences are, the number of its other
    sentences of four words or more, and the words of all the others."""
    kinds = sentences = real = 0
    for sentence in _SENTENCE.split(line):
        low = " ".join(sentence.split()).lower()
        if not low:
            continue
        tokens = _tokens(low)
        hit = evidence(low, tokens)
        if not hit and filler_words(tokens):
            hit = 8
        if hit:
            kinds |= hit
            continue
        n = len(_tokens(_STRUCTURE.sub(" ", low))) if "\\" in low or low[0] in "#%=*_-pc©(r" else len(tokens)
        real += n
        sentences += n > 3
    return kinds, sentences, real


def has_evidence(line: str) -> bool:
    """Whether a sentence of a line is evidence, as analysed() has it. Sentences without a cue that are too long to be evidence as a whole, in lines
    without words of the usual filler, are done with at once."""
    low = line.lower()
    cued = _cued(low)
    filler = len(LOREM.intersection([w[:4] for w in low.split()])) > 2
    for x in _SENTENCE.split(low):
        if (cued or len(x) <= 2 * WHOLE) and evidence(" ".join(x.split())) or filler and filler_words(_tokens(x)):
            return True
    return False


def line_features(documents: DataFrame) -> DataFrame:
    """(doc_id, host, body, content, key, kinds, sentences, real, times): one row per document and distinct normalised line.

    body is the same for documents whose evidence-free lines of four words or more are the same, case and white space aside:
    copies of one text, whatever notes each has. A document without such lines has its whole text as body. content: whether these lines have more
    than REAL_WORDS words. Sentences and words are counted in documents with evidence only; the others, which no evidence can exclude, have NULL
    for doc_id, sentences and real. Lines are kept as keys of 64 bits and counts, so that shuffles do not carry texts."""
    rows = documents.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.col("text").alias("_text"))
    rows = rows.where("_text is not null and _text rlike '(?U)\\\\S'")
    name = rows.schema["_id"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    types = (kind, pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "host", "body", "content", "key", "kinds", "sentences", "real", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, bool, int]] = {}
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for doc, host, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                every: list[tuple[str, int, bool]] = []
                running: list[str] = []
                words = 0
                for line in text.splitlines():
                    found = known.get(line)
                    if found is None:
                        key = line_key(line)
                        found = xxhash.xxh64_intdigest(key, seed=42), has_evidence(line), len(key.split())
                        if len(line) < 80:
                            if len(known) > 50_000:
                                known.clear()
                            known[line] = found
                    if not found[2]:
                        continue
                    every.append((line, found[0], found[1]))
                    if found[2] > 3 and not found[1]:
                        running.append(line)
                        words += found[2]
                body = xxhash.xxh3_64_intdigest(" ".join(" ".join(running or [text]).split()).lower()) - (1 << 63)
                some = any(e for _, _, e in every)
                lines: dict[int, list] = {}
                for line, key, _ in every:
                    kinds, sentences, real = analysed(line) if some else (0, None, None)
                    if key in lines:
                        x = lines[key]
                        x[3] += 1
                        if some:
                            x[0], x[1], x[2] = x[0] | kinds, x[1] + sentences, x[2] + real
                    else:
                        lines[key] = [kinds, sentences, real, 1]
                for key, x in lines.items():
                    for column, value in zip(out, (doc if some else None, host, body, words > REAL_WORDS, key - (1 << 64) if key >> 63 else key, *x)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=list(names))

    return rows.mapInArrow(run, f"doc_id {name}, host string, body bigint, content boolean, key bigint, kinds int, sentences bigint, real bigint, times bigint")


def host_boilerplate(features: DataFrame) -> DataFrame:
    """(host, key, n_bodies): the recurrent lines of hosts, in BOILERPLATE_DOCS distinct bodies at least. Copies of one text count once, so that its own
    lines are not taken for the host's.

    A line without evidence is boilerplate from BOILERPLATE_SHARE of the host's bodies on. A line that is evidence counts where it stands beside
    content, and is boilerplate from EVIDENCE_SHARE of the bodies with content on: a notice on every page says nothing of any of them, while the
    error of pages that hold nothing else stays evidence however often the host serves it."""
    # a body has one value of content
    hosts = features.select("host", "body", "content").distinct().groupBy("host").agg(F.count("*").alias("_bodies"), F.count_if("content").alias("_full"))
    once = features.groupBy("host", "key", "body").agg(F.max(F.col("kinds") > 0).alias("_e"), F.max("content").alias("_c"))
    counts = once.groupBy("host", "key").agg(F.count("*").alias("_all"), F.count_if(F.col("_c")).alias("_beside"), F.max("_e").alias("_e"))
    counts = counts.withColumn("n_bodies", F.when(F.col("_e"), F.col("_beside")).otherwise(F.col("_all"))).where(F.col("n_bodies") >= BOILERPLATE_DOCS)
    least = F.when(F.col("_e"), F.col("_full") * EVIDENCE_SHARE).otherwise(F.col("_bodies") * BOILERPLATE_SHARE)
    return counts.join(hosts, "host").where(F.col("n_bodies") >= least).select("host", "key", "n_bodies")


def residual(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, real_sentences, real_words, boilerplate_lines) of each document with evidence: what is left of it once
    the boilerplate of its host is subtracted. kinds is a bit mask: 1 error, 2 script, 4 placeholder, 8 filler; 0 if all evidence was boilerplate.

    A NULL host is the host ''; NULL, empty and blank texts and texts without evidence give no row; doc_id is the key, repeated rows of it count
    together."""
    f = written(line_features(documents))
    b = host_boilerplate(f).select("host", "key", F.lit(True).alias("_b"))
    f = f.where("doc_id is not null").join(b, ["host", "key"], "left")
    left = lambda c: F.when(F.col("_b").isNull(), F.col(c)).otherwise(0)
    return f.groupBy("doc_id").agg(
        F.bit_or(left("kinds")).alias("kinds"), F.sum(left("sentences")).alias("real_sentences"), F.sum(left("real")).alias("real_words"), F.sum(F.when(F.col("_b"), F.col("times")).otherwise(0)).alias("boilerplate_lines")
    )


def _is_residue() -> Column:
    return (F.col("kinds") > 0) & (F.col("real_sentences") <= REAL_SENTENCES) & (F.col("real_words") <= REAL_WORDS)


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of each document in which residue stands in place of the content: its residual has evidence and
    at most REAL_SENTENCES real sentences of REAL_WORDS words. Documents without text, and real text that only mentions such strings, give no row."""
    return residual(documents).where(_is_residue()).select("doc_id")


def residue_report(documents: DataFrame) -> DataFrame:
    """Documents with residue per host and kind of evidence; a document counts under each of its kinds."""
    r = residual(documents).where(_is_residue())
    d = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")).dropDuplicates(["doc_id"])
    kinds = F.array(*(F.when(F.col("kinds").bitwiseAND(1 << k) > 0, F.lit(name)) for k, name in enumerate(_KINDS)))
    return r.join(d, "doc_id").select("host", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind")).groupBy("host", "kind").agg(F.count("*").alias("n_docs"))
