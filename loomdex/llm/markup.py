"""Markup residue: which markup a text still holds, and the text without it.

detect() counts the tags that the parser's events give and the marks that line readers of Markdown, wiki and LaTeX take,
and leaves those that plain prose uses in their ordinary sense.  to_text() streams the text through the standard library's HTML parser and line-wise
readers of the other markups into lines with a kind (heading, list, code, formula, table, text); for HTML,
lines far from the page's content are dropped by the smoothed text-to-tag ratio.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, narrow
from .junk import is_junk

# Element names of HTML, tags that wiki text uses as its own, LaTeX commands that stand without braces.
HTML_TAGS = "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
WIKI_TAGS = "ref references math nowiki syntaxhighlight gallery noinclude includeonly onlyinclude poem pre code source blockquote".split()
LATEX_BARE = "item noindent maketitle tableofcontents centering newpage clearpage par medskip bigskip smallskip hline toprule midrule bottomrule ldots dots cdots today LaTeX TeX bf it em tt sc rm sf sl footnotesize small large Large huge appendix quad qquad linebreak pagebreak newline dag ddag copyright pounds raggedright indent".split()

_TAG = "|".join(HTML_TAGS)
_WIKI_ONLY = "ref|references|math|nowiki|syntaxhighlight|gallery|noinclude|includeonly|onlyinclude|poem"
_WIKI_NAMES = frozenset(_WIKI_ONLY.split("|"))
_LEGACY = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))

#: A tag of HTML: opened, closed, with attributes (over lines, unquoted too), with stray blanks.
_ATTR = r"\s+[a-z-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+)"
HTML_TAG = re.compile(rf"<(?:{_TAG})(?:{_ATTR})*\s*/?\s*>|<\s(?:{'|'.join(t for t in HTML_TAGS if len(t) > 1)})(?:{_ATTR})*\s*/?\s*>|<\s?/\s?(?:{_TAG})\s*>", re.I)
_DECLARED = re.compile(r"<!--|<!doctype|<\?xml|<!\[CDATA\[", re.I)
HTML_REST = re.compile(r"-->|\b(?:href|src|style|class|align|colspan|rowspan)\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*')\s*/?>", re.I)
ENTITY = re.compile(rf"&#\d{{1,7}};|&#[xX][0-9a-fA-F]{{1,6}};|&[A-Za-z][A-Za-z0-9]{{1,30}};|&(?:{_LEGACY})(?![\w;=])")
WIKI_TAG = re.compile(rf"<\s?/?\s?(?:{_WIKI_ONLY})(?:\s[^<>]*)?/?\s*>", re.I)
WIKI = [
    ("heading", re.compile(r"^[ \t]*(={2,6})[ \t]*[^=\s][^=\n]*?[ \t]*\1[ \t]*$", re.M)),
    ("link", re.compile(r"\[\[(?![\d\s\[])[^\[\]\n]*|(?<=[^\W\d_])\]\](?!\))")),
    ("template", re.compile(r"\{\{[^{}\n]+\}\}|^\{\{[A-Za-z][^{}\n]*$|(?<=\w)\|\}\}|\}\}$", re.M)),
    ("quotes", re.compile(r"(?<![\w'`])'{2,5}(?=[^\W\d_])(?:(?!'')[^\n`])*?(?<=\w)'{2,5}(?!\w)")),
    ("file", re.compile(r"\b(?:thumb|frame|left|right)\|(?:\d+px\|)?|\b\d+px\|")),
    ("table", re.compile(r"^\{\|.*$|^\|-+[^|\n]*$|^\|\}[ \t]*$|^!.*!!", re.M)),
    ("signature", re.compile(r"(?<!~)~{3,5}(?!~)(?=[ \t]+[^\W\d_]|[ \t]*$)(?<!^~~~)", re.M)),
    ("switch", re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX)__")),
    ("redirect", re.compile(r"^#REDIRECT\b", re.M | re.I)),
    ("list", re.compile(r"^[:*#;]*:[*#:]+ \S", re.M)),
    ("extern", re.compile(r"(?<!\w)\[https?://\S+ [^\]\n]+\](?!\()")),
]
MARKDOWN = [
    ("heading", re.compile(r"(?<!\n# )(?<![^\n]\n)^ {0,3}#{1,6} +[^\W\d_][^\n]*$(?!\n#)|^ {0,3}#{2,6} +[^\W\d_][^\n]*$", re.M)),
    ("setext", re.compile(r"^[^\n=|*#>-][^\n|]*[^\n\s]\n={3,}[ \t]*$|^(?=[^\n]*\w)[^\n=|*#>-][^\n|.]{2,60}\n-{3,}[ \t]*$", re.M)),
    ("fence", re.compile(r"^ {0,3}(?:```|~~~)[ \t]*[\w+-]*[ \t]*$", re.M)),
    ("link", re.compile(r"!?(?<![\w\]])\[[^\[\]\n]*\]\([^()\s]*(?: \"[^\"\n]*\")?\)|(?<![\w\]])!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]")),
    ("definition", re.compile(r"^ {0,3}\[\^?[^\[\]\n]+\]: ?\S+", re.M)),
    ("footnote", re.compile(r"\[\^[\w-]+\]")),
    ("bold", re.compile(r"(?<![*\w\\])\*\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*\*(?![*\w])|(?<![_\w])__(?=[^\s_])(?!NOTOC|TOC|FORCETOC)[^_\n]*?(?<=[^\s_])__(?![_\w])")),
    ("emphasis", re.compile(r"(?<![*\w\\])\*(?=[^\W\d_])[^*\n]{1,80}?(?<=[^\W\d_])\*(?![*\w])|(?<![_\w\\])_(?=[^\W\d_])[^_\n]{1,80}?(?<=[^\W\d_])_(?![_\w])")),
    ("escape", re.compile(r"\\[*_`#\[\]](?=[^\W\d_])|(?<=[^\W\d_])\\[*_`]")),
    ("strike", re.compile(r"(?<![~\w])~~(?=[^\W\d_])[^~\n]*?(?<=\w)~~(?![~\w])")),
    ("code", re.compile(r"(?<![`\\])`(?=[^\s`])[^`\n]*?(?<=[^\s`])`(?![`'])")),
    ("table", re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$", re.M)),
    ("task", re.compile(r"^[ \t]*[-*+] \[[ xX]\] ", re.M)),
    ("quote", re.compile(r"^> ?\S", re.M)),
]
_BARE = "|".join(LATEX_BARE)
LATEX = [
    ("command", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{")),
    ("environment", re.compile(r"\\(?:begin|end)\{")),
    ("bare", re.compile(rf"(?<![\w\\:])\\(?:{_BARE})(?![A-Za-z\\])")),
    ("group", re.compile(r"\{\\[A-Za-z]+[ \\]")),
    ("math", re.compile(r"\\\(|\\\[|(?<![\w$\\])\$(?=[^\s$\d])[^$\n]*[\\_^{][^$\n]*\$(?![\w$])|(?<![\w$\\])\$\d[^$\n]*[\\^{][^$\n]*\$(?![\w$])|(?<![\w$\\])\$[A-Za-z]\$(?![\w$])")),
    ("display", re.compile(r"\$\$[^$]+\$\$")),
    ("quotes", re.compile(r"(?<!`)``(?!`)[^`'\n]+?''")),
    ("escape", re.compile(r"(?<=\w)\\[%&#$_](?!\w)|(?<!\w)\\[%&#$_](?=\s)|\\[&%$#](?=\d)")),
    ("accent", re.compile(r"\\['\"^~`](?:\{[A-Za-z]\}|[A-Za-z])")),
    ("break", re.compile(r"(?<![\\\w])\\\\(?=\s|$|\[)|(?<=\s)\\\\(?=\s|$)", re.M)),
    ("tie", re.compile(r"(?<=\w)~\\[a-z]+")),
]
#: Signs without which a text holds no markup, and what must be in a text for a pattern to be tried.
ANY = re.compile(r"[<>\[\]{}|*_#\\`$~&=]|''")
NEEDS = {
    "wiki": {"heading": ("==",), "link": ("[[", "]]"), "template": ("{{", "}}"), "quotes": ("''",), "file": ("|",), "table": ("|", "!!"), "signature": ("~~~",), "switch": ("__",), "redirect": ("#",), "list": (":*", ":#", "*:", "#:", "::"), "extern": ("[http",)},
    "markdown": {"heading": ("# ",), "setext": ("===", "---"), "fence": ("```", "~~~"), "link": ("](", "]["), "definition": ("]:",), "footnote": ("[^",), "bold": ("**", "__"), "emphasis": ("*", "_"), "escape": ("\\",), "strike": ("~~",), "code": ("`",), "table": ("---",), "task": ("] ",), "quote": (">",)},
    "latex": {"command": ("\\",), "environment": ("\\",), "bare": ("\\",), "group": ("{\\",), "math": ("$", "\\(", "\\["), "display": ("$$",), "quotes": ("``",), "escape": ("\\",), "accent": ("\\",), "break": ("\\\\",), "tie": ("~\\",)},
}


#: Regions whose inside says nothing of the markup around: (markup, pattern).
CODE = [
    ("markdown", re.compile(r"^ {0,3}(```|~~~)[^\n]*\n.*?^ {0,3}\1[ \t]*$", re.M | re.S)),
    ("html", re.compile(r"<pre\b[^>]*>.*?</pre\s*>|<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)),
    ("wiki", re.compile(r"<(syntaxhighlight|nowiki|source)\b[^>]*>.*?</\1\s*>", re.I | re.S)),
    ("latex", re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}.*?\\end\{\1\*?\}", re.S)),
]


def _blank(m: re.Match) -> str:
    return "\n" * m.group().count("\n") or " "


_LOOSE = re.compile(r"<(\s?)(/?)(\s?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>")


def _tightened(m: re.Match) -> str:
    """A tag of known name with stray blanks as the parser reads it; one letter after a blank is a sign of comparison."""
    if m[4].lower() not in _KNOWN or (m[1] and not m[2] and len(m[4]) == 1):
        return m[0]
    return f"<{m[2]}{m[4]}{re.sub(r'/ +$', '/', m[5].rstrip())}>"


class _Tags(HTMLParser):
    """Counts the tags of wiki text and of HTML that the parser's events give, and what is left of cut ones.  An event is
    a tag if its text is well formed: `<b and c>` in a sentence is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.wiki = self.html = self.rest = 0
        self.text: list[str] = []

    def read(self, text: str) -> None:
        if "<" in text:
            self.rest = len(_DECLARED.findall(text))
            self.feed(_LOOSE.sub(_tightened, text))
            self.close()
            text = "".join(self.text)
        self.rest += len(HTML_REST.findall(text))

    def _tag(self, tag: str, raw: str) -> None:
        if tag in _WIKI_NAMES and WIKI_TAG.fullmatch(raw):
            self.wiki += 1
        elif HTML_TAG.fullmatch(raw):
            self.html += 1
        else:
            self.text.append(raw)
            return
        self.text.append(" ")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tag(tag, self.get_starttag_text() or "")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        self._tag(tag, f"</{tag}>")

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def set_cdata_mode(self, *_: object, **__: object) -> None:
        """Whole scripts are regions of code and gone before; after the start of a cut one, text goes on."""


def signs(text: str) -> dict[str, dict[str, int]]:
    """Counts of each kind of sign, by markup; signs within code regions and formulas count for the region only."""
    out: dict[str, dict[str, int]] = {"html": {}, "markdown": {}, "wiki": {}, "latex": {}}

    def add(kind: str, sign: str, n: int) -> None:
        if n:
            out[kind][sign] = out[kind].get(sign, 0) + n

    if not ANY.search(text):
        return out
    for kind, pattern in CODE:
        if (kind == "markdown" and "```" not in text and "~~~" not in text) or (kind in ("html", "wiki") and "</" not in text) or (kind == "latex" and "\\begin" not in text):
            continue
        hits = len(pattern.findall(text))
        if hits:
            add(kind, "code", hits)
            text = pattern.sub(_blank, text)
    if "<" in text:
        n = len(re.findall(r"<math\b", text, re.I))
        if n:
            add("wiki", "math", n)
            text = re.sub(r"<math\b[^>]*>.*?</math\s*>", _blank, text, flags=re.I | re.S)
    if "$$" in text:
        n = len(LATEX[5][1].findall(text))
        add("latex", "display", n)
        text = LATEX[5][1].sub(_blank, text)
    if "<" in text or ">" in text or "=" in text:
        seen = _Tags()
        seen.read(text)
        add("wiki", "tag", seen.wiki)
        add("html", "tag", seen.html)
        add("html", "rest", seen.rest)
    if "&" in text:
        add("html", "entity", sum(m[1:] in html.entities.html5 or m[1] == "#" or m[1:] + ";" in html.entities.html5 for m in ENTITY.findall(text)))
    if "\\" in text or "$" in text or "``" in text:
        for sign, pattern in LATEX:
            if any(x in text for x in NEEDS["latex"][sign]):
                add("latex", sign, len(pattern.findall(text)))
        text = LATEX[6][1].sub(" ", text)
    for kind, patterns in (("wiki", WIKI), ("markdown", MARKDOWN)):
        for sign, pattern in patterns:
            if any(x in text for x in NEEDS[kind][sign]):
                add(kind, sign, len(pattern.findall(text)))
    return out


def detect(text: str | None) -> list[str]:
    """The markups that the text still holds, in alphabetical order; none for null, blank and junk texts."""
    if not text:
        return []
    s = signs(text)
    if not any(s.values()) or not text.strip() or is_junk(text):
        return []
    page = {k: sum(v.values()) for k, v in s.items()}
    h, m, w, x = s["html"], s["markdown"], s["wiki"], s["latex"]
    # what belongs to another markup's page counts there
    if "math" in w and len(w) == 1 and h.get("tag", 0):
        w.clear()
    if set(w) <= {"code"} and h.get("tag", 0):
        w.clear()
    if "display" in x and len(x) == 1 and m:
        x.clear()
    if set(h) == {"entity"} and page["wiki"] > 2:
        h.clear()
    return [k for k in ("html", "latex", "markdown", "wiki") if s[k]]


def _inline(line: str, kinds: set[str]) -> str:
    """Takes the inline marks of wiki, Markdown and LaTeX out of one line or paragraph."""
    if "latex" in kinds:
        line = re.sub(r"(?<!\\)%.*$", "", line, flags=re.M)
        line = re.sub(r"\\(?:cite[a-z]*|ref|eqref|pageref|label|vspace\*?|hspace\*?|includegraphics|footnotemark|footnotetext|bibliography(?:style)?|input|usepackage|documentclass|pagestyle)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "", line)
        while True:
            line, n = re.subn(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", line)
            line, m = re.subn(r"\{\\[A-Za-z]+[ \\]([^{}]*)\}", r"\1", line)
            if not n + m:
                break
        line = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{", "", line)
        line = re.sub(r"``([^`'\n]+?)''", r'"\1"', line)
        line = re.sub(r"\\['\"^~`](?:\{([A-Za-z])\}|([A-Za-z]))", lambda m: m.group(1) or m.group(2), line)
        line = re.sub(rf"(?<![\w\\:])\\(?:{_BARE})(?![A-Za-z\\])", "", line)
        line = re.sub(r"(?<![\\\w])\\\\(?=\s|$|\[)|(?<=\s)\\\\(?=\s|$)", " ", line)
        line = re.sub(r"\\([%&#$_])", r"\1", line)
        line = re.sub(r"\\[()\[\]]", "", line)
        line = re.sub(r"(?<![\w$\\])\$([^\s$][^$\n]*|\S)\$(?![\w$])", lambda m: re.sub(r"\\([A-Za-z]+)", r"\1", m.group(1)).replace("{", "").replace("}", ""), line)
        line = re.sub(r"\{\\[A-Za-z]+[ \\]", "", line)
        line = re.sub(r"(?<=\w)~(?=\w)", " ", line)
    if "wiki" in kinds:
        line = re.sub(r"\{\{(?:lang|nowrap|small|big)\|(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", line, flags=re.I)  # templates that only dress their text
        while True:
            line, n = re.subn(r"\{\{[^{}]*\}\}", "", line)
            if not n:
                break
        line = re.sub(r"\[\[(?:File|Image|Category):[^\[\]\n]*\]\]", "", line, flags=re.I)
        line = re.sub(r"\[\[(?![\d\s\[])(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", r"\1", line)
        line = re.sub(r"\[\[(?![\d\s\[])(?:(?:File|Image|Category):)?|(?<=[^\W\d_])\]\](?!\))", "", line)
        line = re.sub(r"(?<![\w'`])'{2,5}(?=[^\W\d_])((?:(?!'')[^\n`])*?)(?<=\w)'{2,5}(?!\w)", r"\1", line)
        line = re.sub(r"\b(?:thumb|frame|left|right)\|(?:\d+px\|)?|\b\d+px\|", "", line)
        line = re.sub(r"__[A-Z]{3,}__", "", line)
        line = re.sub(r"(?<!~)~{3,5}(?!~)", "", line)
        line = re.sub(r"(?<!\w)\[https?://\S+ ([^\]\n]+)\](?!\()", r"\1", line)
        line = re.sub(r"(?<=\w)\|\}\}|^\{\{|\}\}$", "", line)
    if "markdown" in kinds:
        line = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]*(?: \"[^\"\n]*\")?\)", r"\1", line)
        line = re.sub(r"(?<![\w\]])\[([^\[\]\n]*)\]\([^()\s]*(?: \"[^\"\n]*\")?\)", r"\1", line)
        line = re.sub(r"(?<![\w\]])!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", line)
        line = re.sub(r"\[\^[\w-]+\]", "", line)
        line = re.sub(r"(?<![`\\])`(?=[^\s`])([^`\n]*?)(?<=[^\s`])`(?![`'])", r"\1", line)
        line = re.sub(r"(?<![*\w\\])\*\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*\*(?![*\w])|(?<![_\w])__(?=[^\s_])([^_\n]*?)(?<=[^\s_])__(?![_\w])", lambda m: m.group(1) or m.group(2), line)
        line = re.sub(r"(?<![*\w\\])\*(?=[^\W\d_])([^*\n]{1,80}?)(?<=[^\W\d_])\*(?![*\w])|(?<![_\w\\])_(?=[^\W\d_])([^_\n]{1,80}?)(?<=[^\W\d_])_(?![_\w])", lambda m: m.group(1) or m.group(2), line)
        line = re.sub(r"(?<![~\w])~~(?=[^\W\d_])([^~\n]*?)(?<=\w)~~(?![~\w])", r"\1", line)
        line = re.sub(r"\\([*_`#\[\]])", r"\1", line)
    return line


_ENV = {"equation": "formula", "align": "formula", "displaymath": "formula", "math": "formula", "gather": "formula", "verbatim": "code", "lstlisting": "code", "minted": "code"}
_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "title": 1}


class _Events(HTMLParser):
    """Streams HTML and wiki tags into lines of (kind, text, tags passed, characters within links).  Tags that are no
    known element (`map<int>`, `<word at Place>`) stay as they were written."""

    BLOCK = frozenset("p div br hr ul ol table tr section article header footer nav aside main form body html head title blockquote pre dl dt dd figure figcaption caption address fieldset".split())
    HIDDEN = frozenset(("script", "style", "ref"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, int, int]] = []
        self.kind, self.buffer, self.tags, self.linked = "text", [], 0, 0
        self.hidden, self.held, self.link = "", [], 0

    def finish(self) -> None:
        """Ends the text; what an element hides that was never closed comes out."""
        if self.cdata_elem:  # a script without end: the parser would keep the rest
            rest, self.rawdata = self.rawdata, ""
            self.clear_cdata_mode()
            self.handle_data(rest)
        self.close()
        self.show()
        self.end_line()

    def show(self) -> None:
        held, self.hidden, self.held = self.held, "", []
        for data in held:
            self.handle_data(data)

    def end_line(self) -> None:
        text = "".join(self.buffer)
        if text.strip() or self.kind == "code":
            self.lines.append((self.kind, text, self.tags, self.linked))
        elif self.kind == "text":
            self.lines.append(("text", "", 0, 0))
        self.buffer, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _KNOWN:
            self.handle_data(self.get_starttag_text() or "")
            return
        self.tags += 1
        if self.hidden and (tag in self.BLOCK or tag in self.HIDDEN):
            self.show()  # the element was not closed before the next block
        if tag in self.HIDDEN:
            if not (self.get_starttag_text() or "").rstrip().endswith("/>"):
                self.hidden = tag
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.end_line()
            self.kind = "heading"
        elif tag in ("li", "dt", "dd"):
            self.end_line()
            self.kind = "list"
        elif tag in ("pre", "syntaxhighlight", "source"):
            self.end_line()
            self.kind = "code"
        elif tag == "math":
            self.end_line()
            self.kind = "formula"
        elif tag in ("td", "th"):
            if "".join(self.buffer).strip():
                self.buffer.append(" | ")
            self.kind = "table"
        elif tag == "a":
            self.link += 1
        elif tag in self.BLOCK:
            self.end_line()
            if self.kind != "code":
                self.kind = "text"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "ref":
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _KNOWN:
            return
        self.tags += 1
        if tag == self.hidden:
            self.hidden, self.held = "", []
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "syntaxhighlight", "source", "math", "ul", "ol", "table", "tr") or tag in self.BLOCK:
            self.end_line()
            self.kind = "text"

    def handle_data(self, data: str) -> None:
        if self.hidden:
            self.held.append(data)
            return
        parts = data.split("\n")
        for j, part in enumerate(parts):
            if j:
                self.end_line()
            self.buffer.append(part)
            if self.link:
                self.linked += len(part)


_KNOWN = frozenset(HTML_TAGS) | frozenset(WIKI_TAGS)


def content_lines(lines: list[tuple[str, str, int, int]], sigma: float = 2.0, apart: float = 2.0) -> list[bool]:
    """Which lines belong to the content, by their text-to-tag ratio: the ratios are smoothed with a Gaussian and
    clustered in two by a threshold that is moved between the means of both sides until it rests.  If the means are less
    than `apart` times each other there is one region only.  Lines of the low region go if they consist of links (menus,
    footers); headings, lists, code and short lines stay."""
    if not lines:
        return []
    ratio = np.array([len(text.strip()) / max(1, tags) for _, text, tags, _ in lines])
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
    cut = smooth.mean()
    for _ in range(50):
        low, high = smooth[smooth <= cut], smooth[smooth > cut]
        if not len(low) or not len(high):
            break
        moved = (low.mean() + high.mean()) / 2
        if abs(moved - cut) < 1e-6:
            break
        cut = moved
    low, high = smooth[smooth <= cut], smooth[smooth > cut]
    if not len(low) or not len(high) or high.mean() < apart * low.mean():
        return [True] * len(lines)
    return [bool(smooth[j] > cut or linked < 0.6 * max(1, len(text.strip())) or not text.strip()) for j, (_, text, _, linked) in enumerate(lines)]


def blocks_of(text: str | None, kinds: list[str] | None = None) -> list[tuple[str, str]]:
    """The text as (kind, line) pairs without markup; kind is heading, list, code, formula, table or text."""
    if not text:
        return []
    found = set(detect(text) if kinds is None else kinds)
    if not found:
        return [("text", x) for x in text.split("\n")]
    if "html" in found or "wiki" in found:
        fence = "markdown" in found and re.search(r"^ {0,3}(```|~~~)", text, re.M)
        text = re.sub(r"<\s+(/?)\s*(?=[A-Za-z])([A-Za-z0-9]+)((?:\s+[a-z-]+\s*=\s*\S+)*)\s*(/?)\s*>", lambda m: f"<{m[1]}{m[2]}{m[3]}{m[4]}>" if m[2].lower() in _KNOWN and len(m[2]) > 1 else m[0], text)
        text = re.sub(r"<(/?)\s*([A-Za-z0-9]+)\s+>", r"<\1\2>", text)
        text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: html.escape(m[1]), text, flags=re.S)
        if fence:
            text = re.sub(r"^ {0,3}(```|~~~)([^\n]*)\n(.*?)^ {0,3}\1[ \t]*$", lambda m: f"<pre>{html.escape(m[3])}</pre>", text, flags=re.M | re.S)
        events = _Events()
        events.feed(text)
        events.finish()
        keep = content_lines(events.lines) if "html" in found else [True] * len(events.lines)
        rows = [(k, x) for (k, x, _, _), ok in zip(events.lines, keep) if ok]
        if "html" in found:  # what the parser gives out as text may hold doubly escaped entities and scraps of tags
            rows = [(k, x if k == "code" else HTML_REST.sub("", HTML_TAG.sub("", html.unescape(x) if ENTITY.search(x) else x))) for k, x in rows]
    else:
        rows = [("text", x) for x in text.split("\n")]
    return list(_lines(rows, found))


def _lines(rows: list[tuple[str, str]], found: set[str]) -> Iterator[tuple[str, str]]:
    """Reads lines of wiki, Markdown and LaTeX; lines that came with another kind than text pass."""
    rest = found & {"wiki", "markdown", "latex"}
    mode, fence = "", ""
    closed = max((j for j, (_, x) in enumerate(rows) if "}}" in x), default=-1)
    for j, (kind, line) in enumerate(rows):
        if kind == "code" or not rest:
            yield kind, line
            continue
        bare = line.strip()
        if mode:
            if (fence and bare.startswith(fence)) or (not fence and re.match(r"\\end\{|\\\]|\$\$$", bare)):
                mode = fence = ""
            else:
                yield mode, re.sub(r"\\label\{[^{}]*\}", "", line) if mode == "formula" else line
            continue
        if "markdown" in rest and (m := re.match(r"(```|~~~)(?!~)", bare)) and bare.count(m[1]) == 1:
            mode, fence = "code", m[1]
            continue
        if m := re.fullmatch(r"\$\$(.+)\$\$", bare):
            yield "formula", m[1]
            continue
        if bare == "$$" or ("latex" in rest and bare == "\\["):
            mode = "formula"
            continue
        if "latex" in rest:
            if m := re.match(r"\\begin\{([a-z]+)(\*?)\}(?:\[[^\]]*\])?", bare):
                inside, after = bare[m.end() :], ""
                if m[1] in _ENV:
                    mode = _ENV[m[1]]
                    if (end := inside.find(f"\\end{{{m[1]}{m[2]}}}")) >= 0:
                        after = inside[end + len(m[1]) + len(m[2]) + 6 :]
                        inside = inside[:end]
                    if inside.strip():
                        yield mode, inside.strip()
                    mode = "" if end >= 0 else mode
                    inside = after
                if inside.strip() and not mode and not re.fullmatch(r"(?:\{[^{}]*\})+", inside.strip()):
                    yield "text", _inline(inside.strip(), rest)
                continue
            if m := re.match(r"\\end\{[^{}]*\}", bare):
                if bare[m.end() :].strip():
                    yield "text", _inline(bare[m.end() :].strip(), rest)
                continue
            if re.fullmatch(r"\\(?:maketitle|tableofcontents|centering|hline|documentclass.*|usepackage.*)", bare):
                continue
            if (m := re.fullmatch(r"\\([a-z]+)\*?\{(.*)\}", bare)) and m[1] in _HEADS:
                yield "heading", _inline(m[2], rest)
                continue
            if re.match(r"\\item\b", bare):
                yield "list", _inline(bare[5:], rest).strip()
                continue
        if "wiki" in rest:
            if m := re.fullmatch(r"(={2,6})[ \t]*(.+?)[ \t]*\1", bare):
                yield "heading", _inline(m[2], rest)
                continue
            if bare.startswith(("{|", "|}", "|-")) and not bare.endswith("}}") or bare == "}}":
                continue
            if bare.startswith("{{") and "}}" not in bare and j < closed:
                continue  # a template over several lines
            if kind == "text" and re.match(r"[|!](?!\|)", bare) and "markdown" not in rest:
                yield "table", _inline(" | ".join(x.strip() for x in re.split(r"\|\||!!", bare[1:])), rest)
                continue
            if m := re.match(r"[*#:;]+ ", line):
                yield "list", _inline(line[m.end():], rest)
                continue
            line = line.replace("||", " ") if "||" in line and not re.search(r"[=<>]", line) else line
        if "markdown" in rest:
            if m := re.match(r" {0,3}#{1,6} +(.*?)#*$", line):
                yield "heading", _inline(m[1], rest)
                continue
            if re.fullmatch(r"={3,}|-{3,}|(?:\*\s*){3,}", bare):
                continue
            if re.match(r"[^\n]+$", line) and j + 1 < len(rows) and re.fullmatch(r"={3,}|-{3,}", rows[j + 1][1].strip()) and bare:
                yield "heading", _inline(bare, rest)
                continue
            if m := re.match(r"\[\^[^\[\]\n]+\]: ?(?=\S)", bare):
                yield "text", _inline(bare[m.end() :], rest)
                continue
            if re.match(r"\[[^\[\]\n]+\]: ?\S+", bare):
                continue
            if re.fullmatch(r"\|?[ \t]*:?-{3,}:?[ \t]*(\|[ \t]*:?-{3,}:?[ \t]*)*\|?", bare):
                continue
            if bare.startswith("|") and bare.endswith("|") and len(bare) > 1:
                yield "table", _inline(" | ".join(x.strip() for x in bare.strip("|").split("|")), rest)
                continue
            if m := re.match(r"[ \t]*(?:[-*+]|\d+[.)]) (?:\[[ xX]\] )?", line):
                yield "list", _inline(line[m.end():], rest)
                continue
            line = re.sub(r"^> ?", "", line)
        yield kind, _inline(line, rest)


def to_text(text: str | None, kinds: list[str] | None = None) -> str | None:
    """The text without markup, line by line; a text without markup comes back as it is."""
    if text is None:
        return None
    return "\n".join(x for _, x in blocks_of(text, kinds))


def _read(docs: DataFrame, id_col: str, text_col: str, id_type: str) -> DataFrame:
    return narrow(docs, doc_id=F.col(f"`{id_col}`").cast(id_type), text=F.col(f"`{text_col}`").cast("string"))


def markup_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """One row (doc_id, markup) for each row of docs and each markup its text still holds: html, latex, markdown or wiki.
    Null, blank and junk texts hold none.  Whole texts are read, one row at a time; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            hits = [(i, k) for i, t in enumerate(batch.column(1).to_pylist()) for k in detect(t)]
            if hits:
                at, kinds = zip(*hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kinds)], names=["doc_id", "markup"])

    return _read(docs, id_col, text_col, id_type).mapInArrow(run, f"doc_id {id_type}, markup string")


def clean_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """Every row of docs as (doc_id, text, kinds, markups): text without markup (null stays null), the kind of each of its
    lines (heading, list, code, formula, table or text, as structure() gives them; null for null texts), and the markups
    it held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            texts, lines, marks = [], [], []
            for t in batch.column(1).to_pylist():
                found = detect(t)
                blocks = blocks_of(t, found) if found else None
                texts.append(t if blocks is None else "\n".join(x for _, x in blocks))
                lines.append(None if t is None else ["text"] * (t.count("\n") + 1) if blocks is None else [k for k, x in blocks for _ in range(x.count("\n") + 1)])
                marks.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.string()))], names=["doc_id", "text", "kinds", "markups"])

    return _read(docs, id_col, text_col, id_type).mapInArrow(run, f"doc_id {id_type}, text string, kinds array<string>, markups array<string>")


def structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """The lines of every text without markup: (doc_id, line, kind, text); kind is heading, list, code, formula, table or
    text.  Texts that are null have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1, rows=512):
            rows = [(i, j, *b) for i, t in enumerate(batch.column(1).to_pylist()) for j, b in enumerate(blocks_of(t))]
            if rows:
                at, line, kind, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(line, pa.int32()), pa.array(kind), pa.array(text)], names=["doc_id", "line", "kind", "text"])

    return _read(docs, id_col, text_col, id_type).mapInArrow(run, f"doc_id {id_type}, line int, kind string, text string")
