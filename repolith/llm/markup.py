"""HTML, Markdown, wiki and LaTeX left in a text: a tree of blocks, and clean text.

``parse`` reads one text into a tree: containers, quotes, lists, items and tables
hold further blocks to any depth; paragraphs, headings, code, formulas and cells
are leaves.  It never fails: what is not closed or not known stays as it is, and
what only looks like markup (comparisons, type parameters, prices, paths,
identifiers) is left alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

# Element names of HTML and wiki markup, by what they make of a text.
LIST_TAGS = {"ul", "ol", "li", "dl", "dt", "dd"}
CODE_TAGS = {"pre", "code", "tt", "kbd", "samp", "source", "syntaxhighlight"}
HEADING_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINER_TAGS = {
    "address", "article", "aside", "blockquote", "body", "center", "details", "div", "figure", "footer", "form", "header", "html", "main", "nav", "section",
}
OTHER_TAGS = CONTAINER_TAGS | {
    "a", "abbr", "b", "big", "br", "caption", "cite", "col", "colgroup", "del", "dfn", "em", "figcaption", "font", "head", "hr", "i", "iframe", "img", "input",
    "ins", "label", "link", "mark", "meta", "nowiki", "object", "p", "q", "ref", "references", "s", "script", "small", "span", "strike", "strong", "style", "sub",
    "summary", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "u", "var", "video", "wbr",
}
FORMULA_TAGS = {"math"}
# LaTeX commands and environments.
LATEX_HEADING = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph"
LATEX_CODE = "verbatim|lstlisting|minted|alltt"
LATEX_MATH = "equation|align|gather|displaymath|math|eqnarray|multline|alignat|flalign"
LATEX_LIST = "itemize|enumerate|description"
LATEX_TEXT = "textbf|textit|emph|underline|textsc|textrm|textsf|textsl|textup|textmd|textnormal|mbox|uline|title|author|caption"
LATEX_DROP = "cite|citep|citet|ref|eqref|pageref|label|index|bibliography|includegraphics|input|usepackage|documentclass|vspace|hspace"
LATEX_SIZE = "tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge|bf|it|em|sc|tt|sf|rm|bfseries|itshape|ttfamily|scshape"

I = re.I | re.S
#: Regions whose content is not read for other markup: (name, pattern, group of the content, block?).
REGIONS = [
    ("fence", r"(?m:^)[ ]{0,3}(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<fence>.*?)(?:(?:(?<=\n)|\n)[ ]{0,3}(?P=f)[`~]*[ \t]*(?=\n|\Z)|\Z)", "code", True),
    ("pre", r"<(?P<p>pre|source|syntaxhighlight)\b[^<>]*>(?P<pre>.*?)</(?P=p)\s*>", "code", True),
    ("braces", r"\{\{\{(?P<braces>.*?)\}\}\}", "code", True),
    ("verbatim", rf"\\begin\{{(?P<v>{LATEX_CODE})\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(?P<verbatim>.*?)\\end\{{(?P=v)\}}", "code", True),
    ("verb", r"\\verb\*?(?P<d>[^\sA-Za-z0-9*\\])(?P<verb>[^\n]*?)(?P=d)", "code", False),
    ("tag", r"<(?P<c>code|tt|kbd|samp)\b[^<>]*>(?P<tag>.*?)</(?P=c)\s*>", "code", False),
    ("comment", r"<!--(?P<comment>.*?)-->", "other", False),
    ("nowiki", r"<nowiki>(?P<nowiki>.*?)</nowiki>", "other", False),
    ("ticks", r"(?<!`)(?P<t>`+)(?!`)(?P<ticks>[^\n]+?)(?<!`)(?P=t)(?!`)", "code", False),
    ("mathml", r"<math\b[^<>]*>(?P<mathml>.*?)</math\s*>", "formula", False),
    ("env", rf"\\begin\{{(?P<m>(?:{LATEX_MATH})\*?)\}}(?P<env>.*?)\\end\{{(?P=m)\}}", "formula", True),
    ("dollars", r"(?<!\\)\$\$(?P<dollars>(?:[^$]|\\\$)+?)\$\$", "formula", True),
    ("square", r"(?<!\\)\\\[(?P<square>.+?)\\\]", "formula", True),
    ("round", r"(?<!\\)\\\((?P<round>.+?)\\\)", "formula", False),
    ("dollar", r"(?<![\\$\w])\$(?=[^\s$])(?P<dollar>[^$\n]*?[^\s$\\])\$(?![\w$])", "formula", False),
]
SCAN = re.compile("|".join(f"(?P<r_{n}>{p})" for n, p, _, _ in REGIONS), I)
KIND = {n: (k, b) for n, _, k, b in REGIONS}
#: Between dollars only what has an operator, a command or is one letter is a formula.
MATH = re.compile(r"[\\^_={}+*/<>|]|^[A-Za-z]$|[A-Za-z]\(|[0-9][A-Za-z]")

BRACED = r"((?:[^{}]|\{[^{}]*\})*)"
#: What opens and closes blocks that hold blocks.
NEST = re.compile(
    rf"</?({'|'.join(sorted(CONTAINER_TAGS | {'ul', 'ol', 'dl', 'table'}))})(?=[\s/>])[^<>]*>|\\(?:begin|end)\{{({LATEX_LIST})\}}(?:\[[^\]\n]*\])?", I
)
START = re.compile(r"\bstart\s*=\s*[\"']?([0-9]{1,9})", I)
HTML_ITEM = re.compile(r"<(?:li|dt|dd)\b[^<>]*>(.*?)(?=</?(?:li|dt|dd)\b|\Z)", I)
HTML_ITEM_END = re.compile(r"</(?:li|dt|dd)\s*>", I)
HTML_HEAD = re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", I)
HTML_ROW = re.compile(r"</?tr\b[^<>]*>", I)
HTML_CELL = re.compile(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", I)
LATEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?")
LATEX_HEAD = re.compile(rf"\\({LATEX_HEADING})\*?\{{{BRACED}\}}")
WIKI_TABLE = re.compile(r"(?m:^)\{\|.*?(?m:^)\|\}", re.S)

ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
WIKI_HEAD = re.compile(r"(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(={2,}|-{3,})[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"([ \t]*)([-+*]|([0-9]{1,9})[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
WIKI_ITEM = re.compile(r"(\*{2,}|\*+#+|#+\*+)[ \t]+(\S.*)$")
QUOTE = re.compile(r"(?: {0,3}>[ \t]?)+(.*)$")
SEPARATOR = re.compile(r"[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[[^\]\n]+\]:[ \t]+\S+.*$")
MARK = re.compile("\x00([0-9]+)\x00")
BLOCK_MARK = re.compile("[ \t]*\x00([0-9]+)\x00[ \t]*$")


@dataclass
class Block:
    """A block: its own text where it is a leaf, else the blocks in it; and the kinds of markup in it at any depth."""

    tag: str
    text: str = ""
    children: list[Block] = field(default_factory=list)
    kinds: set[str] = field(default_factory=set)
    mark: str = ""  # of an item

    def counted(self) -> Block:
        """Itself, with the kinds of its children taken over."""
        self.kinds.update(*(c.kinds for c in self.children))
        return self


def _is_tag(m: re.Match, text: str) -> bool:
    """Not a type parameter: ``List<Table>`` has a capitalised name right after a word."""
    name = m.group(1)
    if name.lower() not in OTHER_TAGS | LIST_TAGS | CODE_TAGS | HEADING_TAGS | FORMULA_TAGS:
        return False
    before = text[m.start() - 1] if m.start() else " "
    glued = before.isascii() and (before.isalnum() or before == "_")
    return not (glued and not m.group(0).startswith("</") and name != name.upper() and name != name.lower())


TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Inline markup in the order in which it is read: (a text without which there is none, pattern, what stays).
INLINE = [
    ("![", re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"), r"\1"),
    ("](", re.compile(r"(?<![\w\]])\[([^\[\]\n]+)\]\([^()\s]*(?:\([^()\s]*\))?(?:[ \t]+\"[^\"\n]*\")?\)"), r"\1"),
    ("][", re.compile(r"(?<![\w\]])\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    ("[^", re.compile(r"\[\^[^\]\s]+\]"), ""),
    ("<", re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+|[\w.+-]+@[\w-]+\.[\w.]+)>"), r"\1"),
    ("[[", re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]"), r"\1"),
    ("://", re.compile(r"(?<!\w)\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"),
    ("{{", re.compile(r"\{\{(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}"), r"\1"),
    ("<", re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>(.*?)</ref\s*>", I), ""),
    ("\\footnote", re.compile(rf"\\footnote\{{{BRACED}\}}"), r" (\1)"),
    ("\\href", re.compile(rf"\\href\{{[^{{}}]*\}}\{{{BRACED}\}}"), r"\1"),
    ("\\url", re.compile(rf"\\url\{{{BRACED}\}}"), r"\1"),
    ("\\", re.compile(rf"~?\\(?:{LATEX_DROP})(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}}"), ""),
    ("\\", re.compile(rf"\\(?:{LATEX_TEXT})\{{{BRACED}\}}"), r"\1"),
    ("{\\", re.compile(rf"\{{\\(?:{LATEX_SIZE})\s+{BRACED}\}}"), r"\1"),
    ("\\", re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?"), ""),
    ("**", re.compile(r"(?<![\w*])\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?!\w)"), r"\1"),
    ("__", re.compile(r"(?<!\w)__(?=[^\s_])(.+?)(?<=[^\s_])__(?!\w)"), r"\1"),
    ("~~", re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~"), r"\1"),
    ("'''''", re.compile(r"(?<!')'{5}(?=[^'\s])(.+?)(?<=[^'\s])'{5}(?!')"), r"\1"),
    ("'''", re.compile(r"(?<!')'{3}(?=[^'\s])(.+?)(?<=[^'\s])'{3}(?!')"), r"\1"),
    ("''", re.compile(r"(?<!['\w])''(?=[^'\s])([^'\n]+?)(?<=[^'\s])''(?!['\w])"), r"\1"),
    ("*", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    ("_", re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)"), r"\1"),
]
TEXTTT = re.compile(rf"\\(?:texttt|lstinline)\{{{BRACED}\}}")


#: A text without any of these has no markup but lists, quotes, rules and code by their place in a line.
SIGNS = re.compile(r"[#*_=~`$\\<>{}\[\]|&]|''")
LINE_SIGNS = re.compile(r"(?m)^[ \t]*(?:[-+>]|[0-9]{1,9}[.)])|^(?: {4}|\t)")
#: Characters without one of which no region is looked for.
REGION_SIGNS = re.compile(r"[`~<{\\$]")


@dataclass
class _Open:
    """A block that is not closed yet: its name, the tag that opened it, and the parts of its text."""

    name: str
    tag: str
    parts: list[str] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str):
        self.kept: list[tuple[str, str, bool, str]] = []  # (kind, tag, block, content)
        self.made: dict[int, Block] = {}
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "�")
        self.text = SCAN.sub(self.region, text) if REGION_SIGNS.search(text) else text

    def keep(self, kind: str, tag: str, block: bool, content: str) -> str:
        self.kept.append((kind, tag, block, content))
        mark = f"\x00{len(self.kept) - 1}\x00"
        return f"\n{mark}\n" if block else mark

    def keep_block(self, block: Block) -> str:
        mark = self.keep("", block.tag, True, "")
        self.made[len(self.kept) - 1] = block
        return mark

    def region(self, m: re.Match) -> str:
        name = m.lastgroup if m.lastgroup in KIND else next(n for n in KIND if m.group(f"r_{n}") is not None)
        kind, block = KIND[name]
        content = m.group(name)
        if name == "dollar" and not MATH.search(content):
            return m.group(0)
        if name in ("pre", "tag"):
            content = html.unescape(re.sub(r"(?i)^\s*<code\b[^<>]*>|</code\s*>\s*$", "", content))
        if name == "mathml":
            content = re.sub(r"<[^<>]*>", " ", content) if "<" in content and "</" in content else content
        return self.keep(kind, name, block, content)

    def inline(self, text: str, kinds: set[str], within: bool = True) -> str:
        """Text without inline markup; adds the kinds found.

        Blocks taken out of the text before are put in as they read, or stay marks without ``within``.
        """
        if SIGNS.search(text):
            text = TEXTTT.sub(lambda m: self.keep("code", "texttt", False, m.group(1)), text) if "\\" in text else text
            for sign, pattern, stays in INLINE:
                if sign in text and (new := pattern.sub(stays, text)) != text:
                    kinds.add("other")
                    text = new
            text = TAG.sub(lambda m: self.tag(m, kinds), text) if "<" in text else text
            text = ENTITY.sub(lambda m: self.entity(m, kinds), text) if "&" in text else text
        if "\x00" in text:
            text = MARK.sub(lambda m: self.back(m, kinds, within), text)
        return "\n".join(x for x in (" ".join(line.replace("\t", " ").split(" ")).strip() if "  " not in line else re.sub(r"[ \t]+", " ", line).strip() for line in text.split("\n")) if x)

    def tag(self, m: re.Match, kinds: set[str]) -> str:
        if not _is_tag(m, m.string):
            return m.group(0)
        name = m.group(1).lower()
        kinds.add(
            "list" if name in LIST_TAGS else "code" if name in CODE_TAGS else "heading" if name in HEADING_TAGS else "formula" if name in FORMULA_TAGS else "other"
        )
        return "\n" if name in ("br", "p", "div", "tr", "li") else " " if name in ("td", "th") else ""

    def entity(self, m: re.Match, kinds: set[str]) -> str:
        if m.group(0)[1] != "#" and m.group(0)[1:] not in html5:
            return m.group(0)
        kinds.add("other")
        return html.unescape(m.group(0)).replace("\xa0", " ").replace("\x00", "")

    def back(self, m: re.Match, kinds: set[str], within: bool) -> str:
        if block := self.made.get(int(m.group(1))):
            if not within:
                return m.group(0)
            kinds.update(block.kinds)
            return "\n" + "\n".join(t for _, t in leaves(block)) + "\n"
        kind, name, _, content = self.kept[int(m.group(1))]
        kinds.add(kind)
        if kind == "code":
            return f"`{self.raw(content).strip()}`"
        if kind == "formula":
            return f"${content.strip()}$"
        return "" if name == "comment" else content

    def heading(self, level: int, text: str) -> Block:
        b = Block(f"h{level}", kinds={"heading"})
        b.text = self.inline(text, b.kinds).replace("\n", " ")
        return b

    def item(self, mark: str, text: str) -> Block:
        """An item: a leaf, or its text and the blocks within it in their order."""
        b = Block("li", mark=mark)
        own, *rest = MARK.split(self.inline(text, b.kinds, within=False).replace("\n", " "))
        if not rest:
            b.text = own.strip()
            return b
        for i, part in enumerate([own, *rest]):
            if i % 2:
                b.children.append(self.made[int(part)])
            elif part.strip():
                b.children.append(Block("text", part.strip()))
        return b.counted()

    def listing(self, tag: str, items: list[str], start: int = 1) -> Block:
        return Block(tag, children=[self.item(f"{start + i}. " if tag == "ol" else "- ", t) for i, t in enumerate(items)], kinds={"list"}).counted()

    def table(self, rows: list[list[str]]) -> Block:
        b = Block("table", kinds={"other"})
        for cells in rows:
            row = Block("tr")
            for c in cells:
                cell = Block("td")
                cell.text = self.inline(c, cell.kinds).replace("\n", " ")
                row.children.append(cell)
            if any(c.text or c.kinds for c in row.children):
                b.children.append(row.counted())
        return b.counted()

    def html_items(self, content: str) -> list[str]:
        """Items with what stands behind them; what stands before the first is an item if it has text."""
        parts, at = [""], 0
        for m in HTML_ITEM.finditer(content):
            parts[-1] += HTML_ITEM_END.sub("", content[at : m.start()])
            parts.append(m.group(1))
            at = m.end()
        parts[-1] += HTML_ITEM_END.sub("", content[at:])
        if self.inline(parts[0], set(), within=False):
            return parts
        return [parts[0] + parts[1], *parts[2:]] if len(parts) > 1 else []

    def closed(self, opened: _Open, text: str) -> Block:
        """The block of a pair of tags or of a LaTeX environment around a text whose inner blocks are marks."""
        name = opened.name
        if name in ("itemize", "enumerate", "description"):
            return self.listing("ol" if name == "enumerate" else "ul", [p for p in LATEX_ITEM.split(text) if p.strip()])
        if name in ("ul", "ol", "dl"):
            start = START.search(opened.tag)
            return self.listing(name, self.html_items(text), int(start[1]) if start else 1)
        if name == "table":
            return self.table([HTML_CELL.split(r) for r in HTML_ROW.split(HTML_HEAD.sub(self.html_head, text))])
        return Block(name, children=self.blocks_of(text), kinds={"other"}).counted()

    def nested(self, text: str) -> str:
        """Text with its blocks taken out, inner ones first; what is not closed stays as it is."""
        level, names, at = [_Open("", "")], Counter(), 0
        for m in NEST.finditer(text):
            if m.group(1) and (m.group(0).endswith("/>") or not _is_tag(m, text)):
                continue
            level[-1].parts.append(text[at : m.start()])
            at = m.end()
            name = (m.group(1) or m.group(2)).lower()
            if not m.group(0).startswith(("</", "\\end")):
                level.append(_Open(name, m.group(0)))
                names[name] += 1
            elif not names[name]:
                level[-1].parts.append(m.group(0))
            else:
                loose: list[_Open] = []
                while level[-1].name != name:
                    loose.append(level.pop())
                    names[loose[-1].name] -= 1
                level[-1].parts += [x for o in reversed(loose) for x in (o.tag, *o.parts)]
                done = level.pop()
                names[name] -= 1
                level[-1].parts.append(self.keep_block(self.closed(done, "".join(done.parts))))
        level[-1].parts.append(text[at:])
        return "".join(x for o in level for x in (o.tag, *o.parts))

    def html_head(self, m: re.Match) -> str:
        return self.keep_block(self.heading(int(m.group(1)), m.group(2)))

    def latex_head(self, m: re.Match) -> str:
        return self.keep_block(self.heading(1 + LATEX_HEADING.split("|").index(m.group(1)) % 6, m.group(2)))

    def wiki_table(self, m: re.Match) -> str:
        rows = [line.lstrip("|!").strip() for line in m.group(0).split("\n")[1:-1] if not line.startswith(("|-", "|+"))]
        return self.keep_block(self.table([re.split(r"\|\||!!", r) for r in rows]))

    def read(self) -> list[Block]:
        return self.blocks_of(self.nested(self.text) if "<" in self.text or "\\" in self.text else self.text)

    def blocks_of(self, text: str) -> list[Block]:
        """The blocks of a text whose tagged blocks are marks already."""
        if "<" in text:
            text = HTML_HEAD.sub(self.html_head, text)
        if "\\" in text:
            text = LATEX_HEAD.sub(self.latex_head, text)
        if "{|" in text:
            text = WIKI_TABLE.sub(self.wiki_table, text)
        return _Lines(self, text.split("\n")).read()

    def raw(self, text: str) -> str:
        """Text of code in which something had been taken for a region."""

        def one(m: re.Match) -> str:
            block = self.made.get(int(m.group(1)))
            return "\n".join(t for _, t in leaves(block)) if block else self.raw(self.kept[int(m.group(1))][3])

        return MARK.sub(one, text)

    def marked(self, i: int) -> Block:
        if i in self.made:
            return self.made[i]
        kind, _, _, content = self.kept[i]
        return Block("code" if kind == "code" else "math", content.strip("\n") if kind == "code" else content.strip(), kinds={kind})


class _Lines:
    """Reads lines into blocks: paragraphs, headings, lists by indent, quotes, tables, code."""

    def __init__(self, reader: _Reader, lines: list[str]):
        self.reader, self.lines = reader, lines
        self.blocks: list[Block] = []
        self.para: list[str] = []
        self.items: list[list] = []  # [indent, tag, number, text] of an open list

    def end_paragraph(self) -> None:
        if self.para and "".join(self.para).strip():
            b = Block("p")
            b.text = self.reader.inline("\n".join(self.para), b.kinds)
            self.blocks.append(b)
        self.para.clear()

    def end_list(self) -> None:
        """Items become lists; those indented further are lists within the item before."""
        level: list[tuple[int, Block, list[Block], int]] = []  # (indent, list, where it stands, number of its first item)
        before = len(self.blocks)
        for indent, tag, number, text in self.items:
            while len(level) > 1 and indent < level[-1][0] and indent <= level[-2][0] + 1:
                level.pop()
            top = level[-1] if level else None
            if top and indent <= top[0] + 1 and top[1].tag != tag:  # a list of another kind beside it
                level.pop()
                home = top[2]
            elif top and indent > top[0] + 1:
                last = top[1].children[-1]
                if not last.children and last.text:
                    last.children.append(Block("text", last.text))
                    last.text = ""
                home = last.children
            else:
                home = None if top else self.blocks
            if home is not None:
                level.append((indent, Block(tag, kinds={"list"}), home, number))
                home.append(level[-1][1])
            made, first = level[-1][1], level[-1][3]
            made.children.append(self.reader.item(f"{first + len(made.children)}. " if tag == "ol" else "- ", text))
        for made in self.blocks[before:]:
            made.kinds |= kinds_of([made])
        self.items.clear()

    def end(self) -> None:
        self.end_paragraph()
        self.end_list()

    def add(self, block: Block) -> None:
        self.end()
        self.blocks.append(block)

    def read(self) -> list[Block]:
        reader, lines, para, items = self.reader, self.lines, self.para, self.items
        i, blank = 0, True
        while i < len(lines):
            line, was_blank = lines[i], blank
            blank = not line.strip()
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            i += 1
            if blank:
                self.end_paragraph()
                if items and not (ITEM.match(nxt) or WIKI_ITEM.match(nxt)):
                    self.end_list()
                continue
            start = line.lstrip(" \t")[0]
            if "\x00" in line and (m := BLOCK_MARK.match(line)) and reader.kept[int(m.group(1))][2]:
                self.add(reader.marked(int(m.group(1))))
            elif start == "#" and (m := ATX.match(line)):
                self.add(reader.heading(len(m.group(1)), m.group(2)))
            elif start == "=" and (m := WIKI_HEAD.match(line)):
                self.add(reader.heading(len(m.group(1)), m.group(2)))
            elif start in "-*_" and RULE.match(line) and not para:
                self.add(Block("hr", kinds={"other"}))
            elif "|" in line and "|" in nxt and SEPARATOR.match(nxt):
                self.end()
                rows = [line]
                i += 1
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(lines[i])
                    i += 1
                self.blocks.append(reader.table([r.strip().strip("|").split("|") for r in rows]))
            elif (m := ITEM.match(line)) or WIKI_ITEM.match(line):
                self.end_paragraph()
                if m:
                    ordered = m.group(3) is not None
                    items.append([len(m.group(1).expandtabs(4)), "ol" if ordered else "ul", int(m.group(3)) if ordered else 1, m.group(4)])
                else:
                    w = WIKI_ITEM.match(line)
                    items.append([2 * (len(w.group(1)) - 1), "ol" if w.group(1)[-1] == "#" else "ul", 1, w.group(2)])
            elif not items and not para and nxt.strip(" ")[:1] in ("=", "-") and UNDERLINE.match(nxt) and not BLOCK_MARK.match(line):
                self.add(reader.heading(1 if "=" in nxt else 2, line))
                i += 1
            elif start == ">" and QUOTE.match(line) and not para:
                self.end()
                quoted = []
                i -= 1
                while i < len(lines) and (m := QUOTE.match(lines[i])):
                    quoted.append(m.group(1))
                    i += 1
                self.blocks.append(Block("quote", children=_Lines(reader, quoted).read(), kinds={"other"}).counted())
            elif start == "[" and DEFINITION.match(line) and not para:
                self.add(Block("definition", kinds={"other"}))
            elif was_blank and not items and not para and re.match(r"(?: {4}|\t)\s*\S", line):
                self.end()
                code = [line[4:] if line.startswith("    ") else line[1:]]
                while i < len(lines) and re.match(r"(?: {4}|\t)", lines[i]):
                    code.append(lines[i][4:] if lines[i].startswith("    ") else lines[i][1:])
                    i += 1
                self.blocks.append(Block("code", reader.raw("\n".join(code)), kinds={"code"}))
            elif items and line[:1] in " \t":
                items[-1][3] += " " + line.strip()
            else:
                self.end_list()
                para.append(line)
        self.end()
        return self.blocks


def parse(text: str | None) -> list[Block]:
    """The blocks of a text; none for null, empty or blank text."""
    if not text or not text.strip():
        return []
    if not SIGNS.search(text) and not LINE_SIGNS.search(text):
        plain = re.sub(r"\n[ \t\n]*\n", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "�"))
        lines = ([re.sub(r"[ \t]+", " ", x).strip() for x in part.split("\n")] for part in plain.split("\n\n"))
        return [Block("p", "\n".join(x for x in part if x)) for part in lines if any(part)]
    return _Reader(text).read()


def flow(blocks: list[Block]) -> Iterator[tuple[Block | None, str | None, int]]:
    """The tree in the order of the text: (block, None, 0) where one that holds blocks opens and (None, None, 0) where it closes.

    A leaf is (block, clean text, line): cells with one line, above 0, are in one row of a table.
    """
    open_ = [(iter(blocks), -1, "")]  # (blocks to come, depth of lists, mark of an item that waits for its text)
    line = 0
    while open_:
        rest, depth, mark = open_[-1]
        block = next(rest, None)
        if block is None:
            open_.pop()
            if open_:
                yield None, None, 0
        elif block.children or block.tag in HOLDERS:
            line += block.tag == "tr"
            yield block, None, 0
            open_.append((iter(block.children), depth + (block.tag in ("ul", "ol", "dl")), block.mark))
        elif block.tag == "li":
            yield block, "  " * depth + block.mark + block.text, 0
        elif block.tag == "text":
            yield block, ("  " * depth + mark if mark else "  " * (depth + 1)) + block.text, 0
            open_[-1] = (rest, depth, "")
        else:
            yield block, rendered(block), line if block.tag == "td" else 0


#: Blocks that are no leaves even where they are empty.
HOLDERS = {"ul", "ol", "dl", "table", "tr", "quote"} | CONTAINER_TAGS


def rendered(block: Block) -> str:
    if block.tag[0] == "h" and block.tag[1:].isdigit():
        return "#" * int(block.tag[1:]) + " " + block.text
    if block.tag == "code":
        fence = "```" if "```" not in block.text else "````"
        return f"{fence}\n{block.text}\n{fence}"
    if block.tag == "math":
        return f"$$\n{block.text}\n$$" if "\n" in block.text else f"$${block.text}$$"
    return block.text


def leaves(block: Block) -> list[tuple[str, str]]:
    """(tag, clean text) of a block's leaves; a table is one, with its rows on lines."""
    made: list[tuple[str, str]] = []
    row = 0
    fresh = False
    for b, text, line in flow([block]):
        if text is None:
            fresh = fresh or (b is not None and b.tag == "table")
        elif line and made and row and not fresh:
            made[-1] = ("table", made[-1][1] + (" | " if line == row else "\n") + text)
            row = line
        else:
            made.append(("table" if line else b.tag, text))
            row, fresh = line, False
    return made


def kinds_of(blocks: list[Block]) -> set[str]:
    """Kinds of markup of blocks and of all that is in them."""
    return set().union(*(b.kinds for b, _, _ in flow(blocks) if b is not None))
