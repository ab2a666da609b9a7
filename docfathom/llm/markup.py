"""HTML, Markdown, wiki and LaTeX markup turned into clean text (problem 5).

Markup is found by grammars of its delimiters and stripped; headings, lists, code blocks, formulas and tables keep a
plain form: ``# heading``, ``- item``, a fenced code block, ``$formula$``, cells parted by `` | ``. The line-block
distribution of the stripped lines then finds where text surges up and dives down, and the lines between stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from docfathom.session import spread

from .residue import SPOT

# --- Fixed values ---------------------------------------------------------------------------------------------------

#: HTML elements; other names in angle brackets stand for a value.
TAGS = """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col
colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head
header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav nobr noframes noscript object ol optgroup option
output p param picture pre progress q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td
template textarea tfoot th thead time title tr track tt u ul var video wbr ref nowiki gallery syntaxhighlight math references poem""".split()
#: Elements whose content is no text, and elements that hold the frame of a page.
DROPPED = "script|style|template|svg|head|iframe|object"
FRAME = "nav|footer|aside|header|menu|button|form"
BLOCKS = "p|div|section|article|main|blockquote|figure|figcaption|table|tbody|thead|tfoot|ul|ol|dl|dt|dd|address|fieldset|body|html|center|details|summary|nav|footer|aside|header|menu|form|hr|caption"
#: LaTeX commands with an argument that is text, headings among them by level, and commands without any text.
LATEX_HEADINGS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5, "title": 1}
LATEX_TEXT = "textbf|textit|texttt|textsc|textsf|textrm|textsl|textup|textmd|emph|underline|uline|mbox|fbox|text|enquote|footnote|caption|url|href|hbox|centerline|uppercase|lowercase|textsuperscript|textsubscript"
LATEX_SILENT = "label|ref|eqref|pageref|autoref|cref|Cref|cite|citep|citet|nocite|includegraphics|input|include|usepackage|documentclass|bibliography|bibliographystyle|vspace|hspace|pagestyle|thispagestyle|index|newcommand|renewcommand"
LATEX_BARE = "noindent|centering|newline|newpage|clearpage|pagebreak|linebreak|maketitle|tableofcontents|hfill|vfill|hline|toprule|midrule|bottomrule|small|large|Large|footnotesize|bigskip|medskip|smallskip|par|indent|item|ldots|dots|LaTeX|TeX|quad|qquad"

_tags = "|".join(sorted(TAGS, key=len, reverse=True))
TAG = re.compile(rf"</?(?:{_tags})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!doctype\b[^<>]*>|<!\[CDATA\[.*?\]\]>|<\?xml\b.*?\?>", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

MATH = re.compile(
    r"\\begin\{(?P<env>equation|align|gather|multline|eqnarray|math|displaymath|array|matrix|cases)(?P<star>\*?)\}(?P<body>.*?)\\end\{(?P=env)\*?\}"
    r"|\\\[(?P<display>.+?)\\\]|\\\((?P<inline>.+?)\\\)"
    r"|(?<!\\)\$\$(?P<dollars>[^$]*?[\\^_=+*/<>\s-][^$]*?)\$\$"
    r"|(?<![\\$\w])\$(?P<dollar>(?=\S)(?=[^$\n]*(?:\\[A-Za-z]|[\^]|[A-Za-z]_[{\w]|[=<>]))[^$\n{][^$\n]*?(?<=\S))\$(?![\w$])",
    re.S,
)
CODE_BLOCK = re.compile(
    r"^[ \t]*(?P<fence>```+|~~~+)[ \t]*(?P<info>[^\n`]*)\n(?P<body>.*?)(?:\n[ \t]*(?P=fence)[ \t]*(?=\n|\Z)|\Z)"
    r"|<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<pre>.*?)(?:</code\s*>\s*)?(?:</pre\s*>|\Z)"
    r"|<(?P<tag>syntaxhighlight|source)\b[^>]*>(?P<wiki>.*?)(?:</(?P=tag)\s*>|\Z)"
    r"|\\begin\{(?P<env>verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(?P<tex>.*?)\\end\{(?P=env)\*?\}",
    re.S | re.I | re.M,
)

LATEX = re.compile(
    rf"\\(?:begin|end)\{{[A-Za-z]+\*?\}}|\\(?:{'|'.join(LATEX_HEADINGS)})\*?(?:\[[^\]\n]*\])?\{{"
    rf"|\\(?:{LATEX_TEXT}|{LATEX_SILENT})\*?(?:\[[^\]\n]*\])?\{{|(?<![A-Za-z0-9:\\])\\(?:{LATEX_BARE})(?![A-Za-z\\])|\\(?:frac|sqrt|mathrm|mathbf)\{{"
)
MARKDOWN = {
    "heading": r"^ {0,3}#{1,6}[ \t]+\S",
    "underlined": r"^[^\s|>#*+=-][^\n|]*\n {0,3}(?:={3,}|-{3,})[ \t]*$",
    "item": r"^[ \t]*[*+-][ \t]+\S",
    "quote": r"^ {0,3}>[ \t]?\S",
    "fence": r"^[ \t]*(?:```|~~~)",
    "table": r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$",
    "rule": r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$",
    "reference": r"^ {0,3}\[[^\]\n]{1,80}\]:[ \t]+\S+",
    "image": r"!\[[^\]\n]*\]\([^)\n]*\)",
    "link": r"(?<!!)\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))*(?:[ \t]+\"[^\"\n]*\")?\)",
    "link_to": r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]",
    "auto": r"<(?:https?://|mailto:)[^<>\s]+>",
    "strong": r"(?<![*\\\w])\*\*(?=[^\s*])(?:[^*\n]|\n(?!\n)|\*(?!\*))+?(?<=[^\s*])\*\*(?![*])|(?<![\w\\\u00ad\u200b-\u200d\u2060\ufeff])__(?=[^\s_])(?![A-Z0-9_]+__)[^_\n]+?(?<=[^\s_])__(?!\w)",
    "emphasis": r"(?<![*\\\w])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![*\w])|(?<![\w\\\u00ad\u200b-\u200d\u2060\ufeff])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w\u00ad\u200b-\u200d\u2060\ufeff])",
    "struck": r"~~(?=[^\s~])[^~]+?(?<=[^\s~])~~",
    "code": r"(?<![`\\])`+(?=[^`\n])[^\n`]+`+(?!`)",
}
WIKI = {
    "heading": r"^(={1,6})[ \t]*[^=\n](?:[^\n]*[^=\n])?[ \t]*\1[ \t]*$",
    "link": r"\[\[(?!\s*(?:TODO|TBD|FIXME|TK)\b)[^\[\]\n]+\]\]",
    "external": r"\[(?:https?|ftp)://[^\s\]]+[^\]\n]*\]",
    "template": r"\{\{[A-Za-z#][^{}|]*\|[^{}]*\}\}",
    "table": r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[ \t-]*$|^!.*!!",
    "strong": r"'''(?=\S)(?:[^'\n]|'(?!''))+'''|(?<!')''(?=[^'\s])[^'\n]+''(?!')",
    "magic": r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX)__",
}
_ANY_MARKDOWN = re.compile("|".join(f"(?P<{k}>{x})" for k, x in MARKDOWN.items()), re.M)
_ANY_WIKI = re.compile("|".join(f"(?P<{k}>{re.sub(r'\\1', r'={1,6}', x) if k == 'heading' else x})" for k, x in WIKI.items()), re.M)
_WIKI_ITEM = re.compile(r"^\*{2,6}[ \t]+(?=\S)|^[:;][ \t]+(?=\S)", re.M)
_WIKI_PAGE = re.compile("|".join(f"(?:{x})" for x in (WIKI["magic"], r"^(?:={2,6})[ \t]*[^=\n][^\n]*[^=\n]={2,6}[ \t]*$", WIKI["table"], WIKI["template"])), re.M)
#: A text without any of these signs has no markup.
_SIGN = re.compile(r"[<>&*_#`\\$~|\[{=]|''|^[ \t]*[+-][ \t]|^ {0,3}-{3,}|^[:;]", re.M)


def _hide_spots(text: str) -> str:
    """Template spots and values to put in are no markup; their signs are put out of the grammars' sight."""
    return SPOT.sub(lambda m: "\x01" * len(m.group()), text) if any(x in text for x in ("{", "$", "%", "__", "@@", "<<", "[", "【")) else text


def markup_kinds(text: str | None) -> list[str]:
    """The markups found in a text, of 'html', 'markdown', 'wiki' and 'latex'; none for null and empty texts."""
    if not text or not _SIGN.search(text):
        return []
    kinds = set()
    if "<" in text and (TAG.search(text) or COMMENT.search(text)) or "&" in text and any(html.unescape(x) != x for x in ENTITY.findall(text)):
        kinds.add("html")
    if "\\" in text and LATEX.search(text):
        kinds.add("latex")
    plain = text
    if "\\" in text or "$" in text:
        if (m := MATH.search(text)) and (m.group("env") or m.group("display") or m.group("inline") or not (m.group("dollars") or m.group("dollar") or "").isalnum()):
            kinds.add("latex")
            plain = MATH.sub(" ", text)
    plain = _hide_spots(plain)
    if "html" in kinds:
        plain = TAG.sub(" ", COMMENT.sub(" ", plain))
    if _ANY_WIKI.search(plain) or _WIKI_ITEM.search(plain):
        kinds.add("wiki")
    if _ANY_MARKDOWN.search(plain):
        kinds.add("markdown")
    return sorted(kinds)


# --- Stripping ------------------------------------------------------------------------------------------------------


def _math_text(m: re.Match) -> str:
    body = next(x for x in (m.group("body"), m.group("display"), m.group("inline"), m.group("dollars"), m.group("dollar")) if x is not None)
    body = re.sub(r"\\(?:label|tag|nonumber)(?:\{[^}]*\})?", "", body).strip()
    one_line = re.sub(r"\s*\n\s*", " ", body)
    return f"\n$${one_line}$$\n" if m.group("body") is not None or m.group("display") is not None or m.group("dollars") is not None else f"${one_line}$"


def _cells(row: str) -> str:
    return re.sub(r"(?:\s*\|\s*)+$", "", re.sub(r"^\s*\|\s*", "", re.sub(r"[ \t]*\|[ \t]*", " | ", row)))


def _from_html(text: str) -> str:
    text = COMMENT.sub("", text)
    text = re.sub(rf"<({DROPPED})\b[^>]*>.*?</\1\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"<noscript\b[^>]*>|</noscript\s*>", "\n", text, flags=re.I)
    # The frame of a page stays as lines of no own text, for the distribution to judge.
    text = re.sub(rf"<({FRAME})\b[^>]*>(.*?)</\1\s*>", lambda m: "\n\x02" + re.sub(r"\s*\n\s*", "\n\x02", m.group(2).strip()) + "\n", text, flags=re.S | re.I)
    text = re.sub(r"<a\b[^>]*(?:class=[\"']?[^\"'>]*\b(?:hash-link|headerlink|anchor)\b|aria-hidden)[^>]*>.*?</a\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"<a\b[^>]*\bhref\b[^>]*>([^\n]*?)</a\s*>", "\x05\\1\x06", text, flags=re.I)
    text = re.sub(r"<img\b[^>]*?\balt=(?:\"([^\"]*)\"|'([^']*)')[^>]*>", lambda m: m.group(1) or m.group(2) or "", text, flags=re.I)
    text = re.sub(r"<h([1-6])\b[^>]*>\s*(.*?)\s*(?:</h\1\s*>|$)", lambda m: f"\n\n{'#' * int(m.group(1))} {' '.join(m.group(2).split())}\n", text, flags=re.S | re.I)
    text = re.sub(r"<code\b[^>]*>(.*?)</code\s*>", lambda m: f"`{m.group(1)}`" if "\n" not in m.group(1) else m.group(1), text, flags=re.S | re.I)
    text = re.sub(r"\s*<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"\s*<tr\b[^>]*>\s*", "\n", text, flags=re.I)
    text = re.sub(r"\s*</t[dh]\s*>\s*<t[dh]\b[^>]*>\s*", " | ", text, flags=re.I)
    text = re.sub(r"<br\b[^>]*>", "\n", text, flags=re.I)
    text = re.sub(rf"</?(?:{BLOCKS})\b[^>]*>", "\n", text, flags=re.I)
    text = TAG.sub("", text)
    return html.unescape(text).replace("\xa0", " ")


def _from_latex(text: str) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*\n(?=\s*\\)", "\n", text)
    for name, level in LATEX_HEADINGS.items():
        text = re.sub(rf"\\{name}\*?(?:\[[^\]\n]*\])?\{{([^{{}}]*)\}}", lambda m, n=level: f"\n{'#' * n} {m.group(1).strip()}\n", text)
    text = re.sub(r"\\begin\{(?:tabular|table)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?", "\n", text)
    text = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?", "\n", text)
    text = re.sub(r"[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "- " + (f"{m.group(1)} " if m.group(1) else ""), text)
    text = re.sub(rf"~?\\(?:{LATEX_SILENT})\*?(?:\[[^\]\n]*\])*(?:\{{[^{{}}]*\}})+", "", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    for _ in range(4):
        new = re.sub(rf"\\(?:{LATEX_TEXT})\*?\{{([^{{}}]*)\}}", r"\1", text)
        if new == text:
            break
        text = new
    text = re.sub(r"\\(?:ldots|dots)\b(?:\{\})?", "...", text)
    text = re.sub(rf"\\(?:{LATEX_BARE})(?![A-Za-z])(?:\{{\}})?[ \t]?", "", text)
    return re.sub(r"\\([%&_#{}$])", r"\1", text).replace("\\\\\n", "\n")


def _from_wiki(text: str) -> str:
    if _WIKI_PAGE.search(text):  # there a number sign begins an item, elsewhere a heading
        text = re.sub(r"^#{1,6}(?=[ \t]+\S)", lambda m: "  " * (len(m.group()) - 1) + "-", text, flags=re.M)
    text = re.sub(r"^(\*{2,6})[ \t]+", lambda m: "  " * (len(m.group(1)) - 1) + "- ", text, flags=re.M)
    text = re.sub(WIKI["magic"] + r"\n?", "", text)
    text = re.sub(r"<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"^(={1,6})[ \t]*([^=\n](?:[^\n]*[^=\n])?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * len(m.group(1))} {m.group(2).strip()}", text, flags=re.M)
    text = re.sub(r"\[\[(?:File|Image|Datei|Fichier|文件|图像):[^\[\]|]*(?:\|[^\[\]|]*)*?(?:\|([^\[\]|]*))?\]\]", lambda m: m.group(1) or "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]*([^\]\n]*)\]", r"\1", text)
    text = re.sub(r"\{\{[A-Za-z#][^{}|]*\|([^{}]*)\}\}", lambda m: re.sub(r"^\w+=", "", m.group(1).split("|")[-1] if "=" in m.group(1).split("|")[0] and "|" in m.group(1) else m.group(1)).strip(), text, flags=re.S)
    text = re.sub(r"^\{\|[^\n]*$|^\|\}[ \t]*$|^\|-[^\n]*$|^\|\+[ \t]*", "", text, flags=re.M)
    text = re.sub(r"^[|!][ \t]*([^\n|]*(?:(?:\|\||!!)[^\n]*)?)$", lambda m: re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", m.group(1)), text, flags=re.M)
    text = re.sub(r"'''(?=\S)((?:[^'\n]|'(?!''))+)'''", r"\1", text)
    return re.sub(r"(?<!')''(?=[^'\s])([^'\n]+)''(?!')", r"\1", text)


def _from_markdown(text: str) -> str:
    text = re.sub(r"^([^\s|>#*+=-][^\n|]*)\n {0,3}(={3,}|-{3,})[ \t]*$", lambda m: f"{'#' if m.group(2)[0] == '=' else '##'} {m.group(1).strip()}", text, flags=re.M)
    text = re.sub(r"^ {0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", r"\1 \2", text, flags=re.M)
    text = re.sub(MARKDOWN["table"] + r"\n?", "", text, flags=re.M)
    text = re.sub(MARKDOWN["rule"], "", text, flags=re.M)
    text = re.sub(r"^([ \t]*)[*+-][ \t]+(?:\[[ xX]\][ \t]+)?", r"\1- ", text, flags=re.M)
    text = re.sub(r"^ {0,3}(?:>[ \t]?)+", "", text, flags=re.M)
    text = re.sub(MARKDOWN["reference"] + r"[^\n]*$\n?", "", text, flags=re.M)
    text = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = re.sub(r"(?<!!)\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", text)
    text = re.sub(r"<((?:https?://|mailto:)[^<>\s]+)>", r"\1", text)
    for kind, n in (("strong", 2), ("emphasis", 1), ("struck", 2)):
        text = re.sub(MARKDOWN[kind], lambda m, n=n: m.group()[n:-n], text, flags=re.M)
    text = re.sub(r"^[ \t]*\|.*\|[ \t]*$", lambda m: _cells(m.group()), text, flags=re.M)
    return text


#: The share of the mean block from which on a block holds text, and the most characters that are asked of one.
SURGE_SHARE, SURGE_MOST = 0.1, 30
#: What begins a line whose structure is kept whatever its length: headings, list items, cells, code blocks and formulas.
_STRUCTURE = re.compile(r"#{1,6} |[ \t]*(?:[-*+]|\d+[.)])[ \t]+\S|\x03|.* \| ")


def surge_limit(weights: list[int], block: int = 3) -> int:
    """From how many characters on a block holds text, by the text's own blocks: a tenth of the mean of those with any, 1 to 30."""
    sums = [x for i in range(len(weights)) if (x := sum(weights[i : i + block]))]
    return max(1, min(SURGE_MOST, int(SURGE_SHARE * sum(sums) / len(sums)))) if sums else 1


def surges(weights: list[int], block: int = 3, least: int | None = None) -> list[tuple[int, int]]:
    """Stretches [from, to) of lines that hold text, by their line-block distribution.

    A block is the sum of the weights of ``block`` lines. Text surges at a line of own text whose block reaches
    ``least`` (by default ``surge_limit``) and dives where a whole block falls below it.
    """
    least = surge_limit(weights, block) if least is None else least
    final = max(0, len(weights) - block)  # the last lines are judged by the last whole block
    blocks = [sum(weights[min(i, final) : min(i, final) + block]) for i in range(len(weights))]
    last = max((i for i, x in enumerate(weights) if x), default=-1)
    out, start = [], None
    for i, x in enumerate(blocks):
        if start is None and weights[i] and x >= least:
            start = i
        elif start is not None and x < least:
            out.append((start, i))
            start = None
    return out + ([(start, max(start, last) + 1)] if start is not None else [])


def _own_weight(line: str, least: int) -> int:
    """The characters of a line that are its own text: none in the frame of a page, none inside links; structure counts as enough."""
    if line.startswith("\x02"):
        return 0
    own = len(_LINKED.sub("", line).strip(_AROUND))
    return max(own, least) if own and _STRUCTURE.match(line) else own


_LINKED = re.compile("\x05[^\x06]*\x06")
_AROUND = " \t-*+|>\u00b7\u2022/,;:\x02"


def clean_text(text: str, kinds: list[str], block: int = 3) -> str:
    """The text without its markup; a text without markup comes back letter by letter."""
    if not kinds:
        return text
    kept: list[str] = []

    def keep(x: str) -> str:
        kept.append(x)
        return f"\x03{len(kept) - 1}\x04"

    def code(m: re.Match) -> str:
        body = next((x for x in (m.group("body"), m.group("pre"), m.group("wiki"), m.group("tex")) if x is not None), "")
        if m.group("pre") is not None:
            body = html.unescape(TAG.sub("", body))
        return "\n" + keep("```" + (m.group("info") or "").strip() + "\n" + body.strip("\n") + "\n```") + "\n"

    plain = CODE_BLOCK.sub(code, re.sub("[\x02-\x06]", "", text))
    plain = re.sub(MARKDOWN["code"], lambda m: keep(m.group()), plain)
    if "latex" in kinds:
        plain = MATH.sub(lambda m: keep(_math_text(m).strip()) if m.group("inline") or m.group("dollar") else "\n" + keep(_math_text(m).strip()) + "\n", plain)
        plain = re.sub(r"(\x04\n)[ \t]+", r"\1", plain)
    plain = SPOT.sub(lambda m: keep(m.group()), plain)
    if "html" in kinds:
        plain = re.sub(r"<code\b[^>]*>([^<\n]*)</code\s*>", lambda m: keep(f"`{html.unescape(m.group(1))}`"), plain, flags=re.I)
    if "wiki" in kinds:
        plain = _from_wiki(plain)
    if "latex" in kinds:
        plain = _from_latex(plain)
    if "html" in kinds:
        plain = _from_html(plain)
    if "markdown" in kinds:
        plain = _from_markdown(plain)
    lines = [re.sub(r"[ \t]+$", "", x) for x in plain.split("\n")]
    # Blank lines part blocks and are no dive: only lines with text count in the distribution.
    full = [i for i, x in enumerate(lines) if x.strip("\x02\x05\x06 \t")]
    # Short lines tell the frame of a page from its text in HTML only; elsewhere a line of any own text counts.
    least = surge_limit([_own_weight(lines[i], 0) for i in full], block) if "html" in kinds else 1
    stretches = surges([_own_weight(lines[i], least) for i in full], block, least)
    out: list[str] = []
    for lo, hi in stretches:
        for k in range(lo, hi):
            i = full[k]
            if out and i and not lines[i - 1].strip("\x02\x05\x06 \t"):
                out.append("")
            out.append(lines[i].lstrip("\x02"))
    if not stretches:  # nothing but the frame of a page: its text stays
        out = [lines[i].lstrip("\x02") for i in full]
    clean = "\n".join(out).replace("\x05", "").replace("\x06", "")
    while "\x03" in clean:
        new = re.sub(r"\x03(\d+)\x04", lambda m: kept[int(m.group(1))], clean)
        if new == clean:
            break
        clean = new
    return clean


def _clean(batches: Iterator[pa.RecordBatch], fields: list[str], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        row_ids, names, cleaned, found = [], [], [], []
        for field, column in zip(fields, batch.columns[1:]):
            for row_id, text in zip(ids, column.to_pylist()):
                if text is not None:
                    kinds = markup_kinds(text)
                    row_ids.append(row_id)
                    names.append(field)
                    cleaned.append(clean_text(text, kinds, block))
                    found.append(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(cleaned, pa.string()), pa.array(found, pa.list_(pa.string()))],
            names=["id", "field_name", "clean", "markups"],
        )


def without_markup(df: DataFrame, id_column: str, *columns: str, block: int = 3) -> DataFrame:
    """(id, field_name, clean, markups) of every field that is not null.

    Texts without markup come back unchanged with an empty ``markups``; empty texts stay empty. Fields are read whole,
    row by row and without shuffle; repeated rows come out repeatedly.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column], *(df[c] for c in columns))
    return spread(rows).mapInArrow(partial(_clean, fields=list(columns), block=block), f"id {kind}, field_name string, clean string, markups array<string>").withColumnRenamed("id", id_column)
