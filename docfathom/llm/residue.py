"""Template residue, filler, error pages and notices instead of content (problem 2)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from docfathom.session import spread

# --- What does not count: code and formulas ------------------------------------------------------------------------

CODE = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)"
    r"|<(pre|code|script|style|syntaxhighlight|source|nowiki|kbd|samp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|\\begin\{(verbatim|lstlisting|minted)\*?\}.*?(?:\\end\{\2\*?\}|\Z)"
    r"|\\verb\*?([^\w\s]).*?\3|(?<!`)`[^`\n]+`(?!`)|(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+",
    re.S | re.I,
)
FORMULA = re.compile(
    r"\\begin\{(equation|align|gather|math|displaymath|eqnarray)\*?\}.*?\\end\{\1\*?\}|\\\[.*?\\\]|\\\(.*?\\\)"
    r"|\$\$(?=[^$]*[\\^_=+\s])[^$]+\$\$|(?<![\\$\w])\$(?=[^$\n]*[\\^_=])[^$\n{][^$\n]*\$(?!\w)",
    re.S,
)

# --- Spots where a value belongs, by delimiter ---------------------------------------------------------------------

#: Names between double underscores and per cent signs that are no spot.
MAGIC_WORDS = "TOC|NOTOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|INDEX|NOINDEX|HIDDENCAT|NOGALLERY|DISAMBIG|STATICREDIRECT|NOTITLECONVERT|NOCONTENTCONVERT|FILE|LINE|FUNCTION|DATE|TIME|COUNTER"
ENVIRONMENT = "PATH|HOME|USER|TEMP|TMP|APPDATA|LOCALAPPDATA|USERPROFILE|PROGRAMFILES|SYSTEMROOT|WINDIR|COMSPEC|USERNAME|HOMEPATH|PWD|SHELL|LANG"
SPOTS = {
    "mustache": r"\{\{\{?-?\s*[#/^>&]?\s*[^\W\d][\w.\-]*(?: [\w.\-]+){0,3}(?:\[[\w'\"]+\])?\s*-?\}?\}\}",
    "block": r"\{%-?\s*\w[^%{}\n]*-?%\}",
    "tag": r"<%[=#\-@]?\s*[^%\n]+%>",
    "dollar": rf"(?<!\\)\$\{{(?!(?:{ENVIRONMENT})\}})[^{{}}\n]{{1,80}}\}}",
    "call": r"\$t\(\s*['\"][^'\"\n]*['\"]\s*\)",
    "hash": r"(?<![A-Za-z0-9_&\\])#\{[^{}\n]{1,80}\}",
    "percent": rf"(?<![A-Za-z0-9_%])%(?!(?:{ENVIRONMENT})%)(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*|[一-鿿]{{1,12}})%(?![A-Za-z0-9_%])",
    "dunder": rf"(?<![A-Za-z0-9_])__(?!(?:{MAGIC_WORDS})__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![A-Za-z0-9_])",
    "at": r"@@[A-Za-z0-9_]+@@",
    "dollars": r"\$\$[^\W\d]\w+\$\$",
    "brace": r"(?<![\\$#{%A-Za-z0-9_^}\])*/=:&~-])\{(?:\d{1,2}|[a-z][a-zA-Z0-9]*(?:[_.][a-zA-Z0-9]+)*)\}(?![{}\[(])",
    "angle": r"<<[A-Z][A-Z0-9_ ]*>>",
    "todo": r"\[\[?\s*(?:TODO|TBD|FIXME|TK)\b[^\]\n]*\]\]?(?![(\[])",
    "ask": r"(?i:\[(?:insert|enter|fill in|add|put|type|your|placeholder)\b[^\]\n]{0,60}\](?![(\[:]))",
    "name": r"(?i:\[(?:product|company|board|model|device|version|page|section|project|customer|author|guide|manual)[ _](?:name|title|number|version|text|date|id)\](?![(\[:]))",
    "corner": r"[【［（(〔][^】］）)〕\n]{0,8}?(?:待补充|待填写|待完善|待更新|待定|待续|填写|输入|请填写|请输入|占位文字|占位符|占位|示例文字)[^】］）)〕\n]{0,12}[】］）)〕]",
    "shout": r"(?<![A-Za-z0-9_])[A-Z_]*(?:FILL_ME|FILL_IN|REPLACE_ME|CHANGE_ME|INSERT_HERE)[A-Z_]*(?![A-Za-z0-9_])",
    "tk": r"(?<![A-Za-z0-9_])TK(?: TK)+(?![A-Za-z0-9_])",
    "untranslated": r"(?i:(?<![A-Za-z0-9_])(?:missing translation|translation missing|untranslated key)\s*:\s*[A-Za-z0-9_.\-]+)",
    "object": r"\[object [A-Z]\w*\]",
}
SPOT = re.compile("|".join(f"(?P<{k}>{x})" for k, x in SPOTS.items()))
#: A text without any of these has no spot.
SPOT_SIGN = re.compile(r"\{|\$[{t$]|<%|%[A-Z一-鿿]|__[A-Z]|@@|<<[A-Z]|\[\s*\[?\s*[A-Za-z]|[【［（〔]|\([^)\x00-\x7f]|_ME|_IN|_HERE|TK TK|ranslat|RANSLAT")
#: Words of sentences that explain template signs.
TUTORIAL = re.compile(
    r"(?i)\b(?:templates?|placeholders?|syntax|interpolat\w+|substitut(?:e[sd]?|ion)|literal(?:ly)?|variable names?|curly|brac(?:es?|kets?)|escap(?:e[sd]?|ing)|delimiters?|expressions?|Vorlagen?|Platzhalter|gabarits?)\b|模板|占位符|语法|花括号|шаблон|заполнител"
)
QUOTES = "\"'“”„«»‘’「」『』`"
WIKI = re.compile(r"(?m)^={2,6}[^=\n]+={2,6}\s*$|'''|\[\[[^\[\]]+\]\]|^\{\||\{\{[^{}]*\|")
SENTENCE = re.compile(r"(?<=[!?。！？…])\s*|(?<=\.)\s+|\n+")


def unfilled_spots(text: str) -> list[str]:
    """Kinds of the template spots left unfilled in a text.

    Code and formulas are put aside first. A spot is explained in quotes, in a sentence that explains template signs,
    or right after a line of that kind that ends in a colon. A text is a tutorial as a whole, and its other spots no
    case either, if more of its spots are explained than not, and they stand denser there than in the rest by length.
    """
    if not SPOT_SIGN.search(text) or not SPOT.search(text):
        return []
    plain = FORMULA.sub(" ", CODE.sub(" \x00 ", text))
    found, explained, sentences = [], 0, {}
    wiki = None
    for m in SPOT.finditer(plain):
        kind, spot = m.lastgroup, m.group()
        if kind == "mustache" and not re.search(r"[\s._]", spot.strip("{}")):
            wiki = bool(WIKI.search(plain)) if wiki is None else wiki
            if wiki:
                continue  # a wiki template without values
        lo = max((plain.rfind(x, 0, m.start()) for x in (". ", "。", "\n", "! ", "? ", "！", "？")), default=-1)
        ends = [k for x in (". ", "。", "\n", "! ", "? ", "！", "？") if (k := plain.find(x, m.end())) >= 0]
        end = min(ends, default=len(plain))
        around = plain[lo + 1 : m.start()] + " " + plain[m.end() : end]
        quoted = m.start() and m.end() < len(plain) and plain[m.start() - 1] in QUOTES and plain[m.end()] in QUOTES
        if quoted or TUTORIAL.search(around) or _led_in(plain, lo + 1):
            explained += 1
            sentences[lo + 1] = max(end, sentences.get(lo + 1, 0))
        else:
            found.append(kind)
    if found and explained > len(found):
        own = sum(end - start for start, end in sentences.items())
        if explained * max(0, len(plain) - own) > len(found) * own:
            return []
    return found


def _led_in(text: str, start: int) -> bool:
    """Whether the line at ``start`` follows one that explains template signs and ends in a colon."""
    before = text[max(0, start - 300) : start].rstrip()
    return before.endswith((":", "：")) and "\n" in text[max(0, start - 300) + len(before) : start] and bool(TUTORIAL.search(before.rsplit("\n", 1)[-1]))


# --- Fields that are a notice, an error page or filler as a whole ---------------------------------------------------

#: Reason phrases of HTTP statuses.
REASONS = "Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Request Time-?out|Conflict|Gone|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service (?:Temporarily )?Unavailable|Gateway Time-?out|HTTP Version Not Supported"
SCRIPTS = r"(?:java ?scripts?|scripts?)"
#: Fixed patterns of sentences that are themselves a notice; each must fit a whole sentence.
NOTICES = {
    "error": [
        rf"(?:HTTP(?:/[\d.]+)? )?(?:error |status |fehler |erreur )?[45]\d\d(?: ?[:.–-]? ?(?:{REASONS}))?(?: ?\|.*)?",
        rf"(?:error:? )?(?:{REASONS})",
        r"(?:error|fehler|erreur|ошибка|oops|whoops|uh-?oh|sorry)",
        r"(?:(?:sorry|oops), ?)?(?:the|this|that|your) (?:requested |web ?)?(?:page|file|document|resource|url|site|address)(?: you (?:are|were) looking for| you requested| requested)? (?:(?:could|can) ?not be found|was not found|is not found|does not exist|no longer exists|doesn't exist|has been (?:removed|deleted|moved))[^.]*",
        r"(?:sorry, )?we (?:could ?n[o']t|can ?n[o']?t|could not|cannot|can't) find (?:the|that|this) (?:page|file|document)[^.]*",
        r"(?:page|file|document|site) (?:not found|does not exist|unavailable|missing)",
        r"nothing lives at this address",
        r"(?:the )?(?:page|site|service|server|website|system) is (?:temporarily )?(?:down|unavailable|offline|under maintenance|overloaded)[^.]*",
        r"this (?:page|site|service) is (?:temporarily |currently )?(?:down|unavailable|offline|closed)[^.]*",
        r"something went wrong[^.]*",
        r"an? (?:unexpected|unknown|internal|fatal|application) error (?:has )?occurred[^.]*",
        r"upstream (?:connect|request) (?:error|timeout)\b.*",
        r"traceback: .*",
        r"traceback \(most recent call last\).*",
        r"(?:fatal|uncaught|unhandled)\b.{0,40}\b(?:error|exception)\b.*",
        r"die (?:angeforderte|gesuchte|gewünschte) (?:seite|datei) (?:wurde nicht gefunden|existiert nicht|ist nicht verfügbar)",
        r"seite nicht (?:gefunden|verfügbar)",
        r"(?:cette|la) page (?:demandée )?(?:est|reste|n'a pas été|n'existe)[^.]{0,20}(?:introuvable|trouvée?|pas|indisponible)",
        r"page (?:introuvable|non trouvée)",
        r"(?:запрошенная )?страница не (?:найдена|существует)",
        r"服务器(?:开小差|错误|繁忙|内部错误|暂时不可用|无响应).*",
        r"(?:您?(?:访问|请求|查找)的)?(?:页面|网页|文件|内容)(?:不存在|未找到|找不到|无法找到|走丢了|已被删除|已删除|已失效|不见了)(?:或已被?(?:删除|移动))?(?:[，, ].*)?",
        r"(?:抱歉|对不起)[，,].{0,24}(?:不存在|未找到|出错|错误).*",
        r"系统(?:错误|繁忙|维护中).*",
    ],
    "access": [
        r"(?:access|permission) (?:to this (?:page|resource) )?(?:was |has been |is )?denied",
        r"you (?:do not|don't) have (?:permission|access|the rights?)[^.]*",
        r"(?:please )?(?:sign|log) ?in (?:again )?to (?:continue|view|access|see)[^.]*",
        r"your session (?:has )?(?:expired|timed out|ended)[^.]*",
        r"(?:zugriff|zugang) verweigert",
        r"accès (?:refusé|interdit)",
        r"доступ (?:запрещ[её]н|закрыт|ограничен)",
        r"(?:您|你)?(?:没有|无)权限?(?:访问|查看).*",
        r"(?:请|需要)(?:先)?登录(?:后)?.{0,12}",
        r"(?:访问|登录)(?:受限|被拒绝|已过期|超时).*",
        r"you (?:have been|are) (?:blocked|rate limited)[^.]*",
    ],
    "waiting": [
        r"just a moment.*",
        r"(?:please )?(?:wait|stand by|hold on)(?: while| a moment| until|, )[^.]*",
        r"one moment(?:,| please).*",
        r"checking (?:your browser|if the site connection is secure|that you are human)[^.]*",
        r"verify(?:ing)? (?:that )?you are (?:a )?human.*",
        r"(?:please )?(?:complete|solve) the (?:captcha|security check|challenge)[^.]*",
        r"(?:loading|redirecting)(?: page| content)?(?:, please wait)?",
        r"访问(?:过于|太)频繁.*",
        r"(?:正在)?(?:验证|检查)(?:您|你)(?:是否|的浏览器).*",
        r"请?(?:稍候|稍等|完成验证).*",
        r"(?:seite|inhalt) wird geladen.*",
    ],
    "scripts": [
        rf"(?:(?:please|you (?:need|have|must)(?: to)?|kindly) )?(?:enable|activate|allow|turn on|switch on) {SCRIPTS}(?: (?:in|to|and|for)\b[^.,]*)?",
        rf"(?:this|the|our) (?:site|page|app|application|website|viewer|content)\b[^.]{{0,40}} (?:works|runs|loads|requires?|needs?)\b[^.]{{0,20}}\b{SCRIPTS}\b[^.]*",
        rf"{SCRIPTS} (?:is|are|must be) (?:required|disabled|turned off|switched off|not enabled|enabled|needed)[^.]*",
        rf"{SCRIPTS} (?:required|disabled)",
        rf"your browser (?:does not|doesn't|did not|cannot) (?:run|support|execute)[^.]*",
        rf"update it and allow {SCRIPTS}",
        rf"if nothing happens, (?:turn on|enable|allow) {SCRIPTS}[^.]*",
        r"bitte (?:aktivieren|schalten) sie (?:javascript|skripte)[^.]*",
        r"(?:veuillez )?activer? (?:le )?javascript[^.]*",
        r"(?:пожалуйста, ?)?включите javascript.*",
        r"请(?:先)?(?:启用|开启|打开) ?(?:javascript|脚本).*",
        r"(?:您|你)的浏览器(?:已|未|不).{0,8}(?:脚本|javascript).*",
    ],
    "filler": [
        r"placeholder (?:copy|text|content|image)\b.*",
        r"(?:your|sample|dummy|example|body|page|title) ?(?:text|content|title|copy|paragraph) (?:goes|comes|will be) here.*",
        r"(?:sample|dummy|example|test) (?:text|paragraph|heading|title|content|page|sentence|copy)",
        r"(?:replace|edit|change|delete) this (?:paragraph|text|sentence|section|block)\b.*",
        r"type (?:something|here|your text)\b.*",
        r"(?:click|tap) (?:here )?to (?:edit|add)(?: (?:text|title|content))?.*",
        r"(?:content|text|description|page) (?:coming soon|to follow|to come|tbd|pending)",
        r"coming soon|tbd|to be (?:done|defined|written|added)|n/?a|xxx+|asdf\w*|qwerty\w*|foo(?: bar)?(?: baz)?",
        r"hier (?:steht|folgt|kommt)(?: später| bald| noch)? (?:der|ein|das|die)?\b.{0,24}\b(?:text|inhalt)",
        r"(?:blindtext|fülltext|mustertext|platzhaltertext)\b.*",
        r"texte? (?:d'exemple|à venir|provisoire|de remplissage)",
        r"(?:здесь будет|пример) текста?.*",
        r"(?:这里|此处|这)是?(?:示例|占位|测试|样例|填充)(?:文字|文本|内容|段落).*",
        r"(?:(?:示例|占位|测试|样例|填充)(?:文字|文本|内容|段落|标题)|(?:稍后|请)?(?:替换|填写|修改|补充)|[，,、 ])+",
        r"(?:稍后|请)(?:替换|填写|补充).{0,10}",
        r"(?:内容|正文|文字)?(?:待补充|待填写|敬请期待|建设中)",
    ],
    "untitled": [
        r"(?:untitled|unnamed)(?: (?:document|page|article|\d+|\(\d+\)))?",
        r"new (?:page|document|article)(?: ?\(?\d+\)?)?",
        r"(?:page |document )?title(?: goes here)?",
        r"(?:undefined|null|nan|none|\[object object\])(?: ?[|–·:-].*)?",
        r"(?:无标题|未命名)(?:文档|页面|网页)?(?: ?\(?（?\d+\)?）?)?",
        r"(?:ohne titel|unbenannt(?:es dokument|e seite)?|sans titre|nouvelle page|neue seite|без названия|новая страница)(?: ?\(?\d+\)?)?",
        r"(?:新建|新)(?:页面|文档)(?: ?\(?（?\d+\)?）?)?",
        r"(?:标题|页面标题|此处标题)",
    ],
}
#: Fixed patterns of sentences that come along with a notice and are none by themselves.
COMPANIONS = [
    r"(?:it|the page) may have (?:been )?(?:moved|removed|deleted)[^.]*",
    r"(?:return|go back|back) to (?:the )?(?:start|home|main|front|previous)(?: ?page)?[^.]*",
    r"(?:home|homepage|start|back|index)",
    r"(?:please )?(?:check back|try again|come back|retry|reload)(?: later| soon| in a (?:few )?(?:moment|minute)s?)?[^.]*",
    r"retour à l'accueil|zurück zur startseite|zur startseite|на главную|返回首页|返回上一页",
    r"(?:edge-proxy|nginx|apache|openresty|cloudflare|varnish|envoy|caddy)[/\d. ]*(?:\(.*\))?",
    r"(?:ray|request|reference|incident|trace) ?(?:id|#)?:? ?[\w-]+",
    r"(?:please )?contact (?:the )?(?:administrator|support|webmaster)[^.]*",
    r"稍后(?:再试|重试)|请稍后(?:再试|重试).*|请(?:返回|刷新).{0,10}",
    r"final wording to follow|update it",
    r"this (?:may |might |will )?takes? (?:a few|several|up to) \w+(?: \w+)?",
    r"(?=[\w-]*\d)[\w-]{2,40}",
    r"[\d\W_]+",
]
NOTICE = re.compile("|".join(f"(?P<{k}>{'|'.join(f'(?:{x})' for x in xs)})" for k, xs in NOTICES.items()), re.I)
COMPANION = re.compile("|".join(f"(?:{x})" for x in COMPANIONS), re.I)

#: Words of Latin filler.
LATIN_FILLER = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
    enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
    voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt
    mollit anim id est laborum vita vitae ornare porta velo fugit cursus quaedam nostri tarum pulvin pulvinar mauris donec vestibulum
    pellentesque vivamus nunc ac at vel massa orci risus turpis egestas integer faucibus""".split()
)
#: Pieces that made-up Latin filler words are built of.
LATIN_PIECES = re.compile(r"^(?:ium|dis|por|lis|al|ise|ment|orn|equi|ibus|sec|qua|dia|set|lib|ora|tur|cur|fac|ent|umn?|con|vin|ero|rad|ad|et|us|is|a|um|por|at|it|en|qui)+$")
_WORD = re.compile(r"[a-zà-ÿ]+", re.I)
_REPEATED = re.compile(r"(.{1,24}?)\1{2,}", re.S)


def _filler(text: str) -> bool:
    words = [x.lower() for x in _WORD.findall(text)]
    if len(words) >= 2:
        latin = sum(x in LATIN_FILLER for x in words)
        if latin / len(words) >= 0.5 and ("ipsum" in words or "lorem" in words or len(words) >= 6):
            return len(words) <= 3 or latin >= 3
        if len(set(words)) == 1 and len(words[0]) <= 8 and len("".join(words)) >= 0.8 * len(re.sub(r"[\W\d_]+", "", text)):
            return True  # one short word again and again
    bare = re.sub(r"[\W_]+", "", text)
    if len(bare) >= 6 and (m := _REPEATED.fullmatch(bare)):
        return not m.group(1).isdigit() and len(set(m.group(1))) > 1
    # A unit repeated and cut off within its last repetition, as CJK filler often is.
    if len(bare) >= 8 and not bare.isascii() and (m := _REPEATED.match(bare)) and len(set(m.group(1))) > 1:
        return m.group(1).startswith(bare[m.end() :]) and m.end() >= 0.75 * len(bare)
    return False


def _sentences(text: str) -> Iterator[str]:
    """The parts of ``SENTENCE.split``, one at a time: a long text is mostly given up at its first."""
    at = 0
    for m in SENTENCE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def _bare_sentences(text: str) -> Iterator[str]:
    plain = re.sub(r"<[^<>]*>", "\n", text) if "<" in text else text
    plain = html.unescape(plain) if "&" in plain else plain
    for x in _sentences(plain):
        x = " ".join(x.split()).strip(" .!?。！？…·*_#>-=")
        if x:
            yield x.replace("’", "'")


def whole_notice(text: str) -> str | None:
    """The kind of notice, error page or filler that a field consists of, or None if it holds anything else."""
    kind, n = None, 0
    for n, x in enumerate(_bare_sentences(text), 1):
        if m := NOTICE.fullmatch(x):
            kind = kind or m.lastgroup
        elif not COMPANION.fullmatch(x):
            break
    else:
        if kind and (kind != "untitled" or n == 1):
            return kind
    return "filler" if n and _filler(re.sub(r"<[^<>]*>", " ", text)) else None


def residue_of(text: str | None) -> list[str]:
    """Why a field is no content: kinds of unfilled spots and of a whole notice; empty for content, null and empty texts."""
    if not text:
        return []
    whole = whole_notice(text)
    return ([f"whole:{whole}"] if whole else []) + sorted({f"spot:{k}" for k in unfilled_spots(text)})


def _find(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        row_ids, names, reasons = [], [], []
        for field, column in zip(fields, batch.columns[1:]):
            seen: dict[str, list[str]] = {}
            for row_id, text in zip(ids, column.to_pylist()):
                if text:
                    if (why := seen.get(text)) is None:
                        why = seen[text] = residue_of(text)
                    if why:
                        row_ids.append(row_id)
                        names.append(field)
                        reasons.append(why)
        yield pa.RecordBatch.from_arrays([pa.array(row_ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(reasons, pa.list_(pa.string()))], names=["id", "field_name", "reasons"])


def residue(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """(id, field_name, reasons) of the fields that hold residue instead of content.

    A null or empty field is no case, a repeated row one case each time. Whole texts are read; no shuffle.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column], *(df[c] for c in columns))
    return spread(rows).mapInArrow(partial(_find, fields=list(columns)), f"id {kind}, field_name string, reasons array<string>").withColumnRenamed("id", id_column)


def _drop(batches: Iterator[pa.RecordBatch], places: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = batch.columns
        for k in places:
            columns[k] = pa.array([None if residue_of(x) else x for x in columns[k].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def without_residue(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the fields that hold residue set to null; every row and all other columns stay."""
    return df.mapInArrow(partial(_drop, places=[df.columns.index(c) for c in columns]), df.schema)
