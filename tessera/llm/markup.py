"""Markup residue in text: HTML, Markdown, wiki markup and LaTeX become clean text that keeps its structure.

HTML is read as the events of the standard library's streaming parser; names that are no HTML elements (generic types,
addresses in angle brackets) stay text. The content regions of every body with tags are selected by the text-to-tag ratio
of the lines, smoothed with a Gaussian and cut at a threshold; of the lines below it, those of links go. No other text
outside tags is lost: what is opened and never closed stays. Structure comes out in one plain notation: headings as "# " lines, list items as "- " or "1. " lines, code indented by four blanks, table rows as cells joined by " | ",
formulas between dollar signs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, commands of LaTeX that stand without braces.
HTML_NAMES = frozenset(
    "a abbr acronym address area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data "
    "datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i "
    "iframe img input ins kbd label legend li link main map mark menu meta meter nav nobr noframes noscript nowiki object ol optgroup option output p param picture pre "
    "progress q ref references rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr track tt u ul var video wbr math".split()
)
LATEX_WORDS = (
    "alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega Delta Sigma Omega sum prod int frac sqrt log ln exp sin cos le ge leq geq neq approx times cdot "
    "infty partial nabla in to rightarrow leftarrow ldots dots item maketitle tableofcontents noindent newpage centering hline par".split()
)

_I = re.IGNORECASE
_M = re.MULTILINE
_NAMES = "|".join(sorted(HTML_NAMES, key=len, reverse=True))
_TAG = re.compile(rf"(\w)?<(/?)({_NAMES})(?=[\s/>])((?:\s[^<>]*)?)(/?>|(?=<|$))", _I)
_REF = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*);|(?:amp|lt|gt|nbsp|quot|apos|mdash|ndash|hellip|copy)(?![\w=]))")
_ANY = re.compile(r"[<&#*`\[\]{}\\|~_=$>+'-]|^\s*\d+[.)]", _M)

#: kind, pattern: what the cleaning acted on is a construct of that kind if one of its patterns matches in the body.
_SIGNS = [
    ("html", re.compile(r"<!--|<!doctype\b|<!\[CDATA\[|-->", _I)),
    ("heading", re.compile(r"^ {0,3}#{1,6}[ \t]+(?!\d+\s*$)\S|^ {0,3}#{2,6}[^\s#\d]", _M)),
    ("heading", re.compile(r"^[^\n]*\w[^\n]*\n(?:={3,}|-{3,})[ \t]*$", _M)),
    ("code", re.compile(r"^[ \t]{0,3}(?:`{3,}|~{3,})", _M)),
    ("code", re.compile(r"(?<!`)`{1,2}[^`\s](?:[^`\n]*[^`\s])?`{1,2}")),
    ("emphasis", re.compile(r"(?<!\w)\*\*(?=[^\s*])(?!(?:kw)?args\b|\w+\))[^\n*]+|(?<![\w/])__(?=[^\W_])[^\n]*?\w__(?!\w)")),
    ("emphasis", re.compile(r"(?<![\w*\\/(])\*(?=[^\s*/])[^*\n]*[^\s*]\*(?![\w*/])|(?<![\w/\\.-])_(?=[^\W_])[^_\n]*[^\s_]_(?![\w])")),
    ("emphasis", re.compile(r"~~(?=\S)[^~\n]+(?:~~|$)", _M)),
    ("link", re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+[^()\n]*\)")),
    ("link", re.compile(r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+|\[\^[^\[\]\s]+\]", _M)),
    ("list", re.compile(r"^[ \t]*[-*+•][ \t]+(?:\[[ xX]\][ \t]+)?\S", _M)),
    ("list", re.compile(r"(?:\A|\n[ \t]*\n|\n)[ \t]*1[.)][ \t]+\S|^[ \t]*\d{1,3}[.)][ \t]+\S[^\n]*\n[ \t]*\d{1,3}[.)][ \t]+\S", _M)),
    ("quote", re.compile(r"^[ \t]{0,3}>+[ \t]*[^\s>=]", _M)),
    ("table", re.compile(r"^[ \t]*\|[^\n]*\|[ \t]*$|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", _M)),
    ("rule", re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", _M)),
    ("wiki", re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^[ \t]*\{\|[ \t]*(?:\w+=|$)|^\|[-}][ \t]*$|^={2,6}[^=\n]+={2,6}[ \t]*$|__(?:NO)?TOC__|\[https?://\S+[ \t][^\]\n]+\]", _M)),
    ("wiki", re.compile(r"(?<![\w'])'{2,5}(?=[^\s'])[^'\n]*\w[^'\n]*'{2,5}(?![\w'])")),
    ("latex", re.compile(r"(?<![\w:\\/.])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|(?:" + "|".join(LATEX_WORDS) + r")(?![A-Za-z])|\(|\[)|\\begin\{|\\end\{|\\(?:frac|textbf|textit|emph|cite|section)\{")),
    ("formula", re.compile(r"\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[^\s$\\]\$(?![\w$])|(?<![\w$\\])\$[A-Za-z]\$(?![\w$])")),
]

#: Of each sign, strings of which its match has at least one.
_NEEDS = [
    ("<!", "-->"), ("#",), ("\n===", "\n---"), ("```", "~~~"), ("`",), ("**", "__"), ("*", "_"), ("~~",), ("](",), ("][", "]:", "[^"), ("-", "*", "+", "•"),
    (".", ")"), (">",), ("|",), ("---", "***", "___", "- -", "* *", "_ _"), ("[[", "{{", "{|", "\n|", "==", "TOC__", "[http"), ("''",), ("\\",), ("$",),
]


def _is_tag(m: re.Match) -> bool:
    """Not a type argument such as Option<A> or List<Object>."""
    before, close, name, attrs = m.group(1), m.group(2), m.group(3), m.group(4)
    return not (before and not close and not attrs.strip() and name[0].isupper() and (len(name) == 1 or not name.isupper()))


def _confirmed(text: str, kinds: set[str]) -> list[str]:
    """Those of kinds, recorded by the cleaning, that the exact patterns find in the text too; sorted."""
    found: set[str] = set()
    for (kind, sign), needs in zip(_SIGNS, _NEEDS):
        if kind in kinds and kind not in found and any(x in text for x in needs) and sign.search(text):
            found.add(kind)
    if "html" in kinds and "html" not in found:
        if "<" in text and any(_is_tag(m) for m in _TAG.finditer(text)):
            found.add("html")
        elif "&" in text and any(not m.group(1) or m.group(1) + ";" in html.entities.html5 for m in _REF.finditer(text)):
            found.add("html")
    return sorted(found)


class _Events(HTMLParser):
    """Text with line structure from the parser's events."""

    _BLOCKS = frozenset("p div section article header footer ul ol dl table tr blockquote details summary figure form center address main aside nav dd dt caption hr".split())
    _SILENT = frozenset(("script", "style", "template"))
    _BARE = frozenset("open checked disabled hidden selected required readonly multiple controls autoplay loop muted reversed nowrap noshade compact async defer itemscope ismap allowfullscreen".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.code: list[str] = []
        self.silent = 0
        self.lists: list[int] = []
        self.cells = 0
        self.pre = 0
        self.last = ""
        self.seen = False  # an event of HTML itself: element, comment or declaration

    def _known(self, tag: str, raw: str) -> bool:
        plain = raw.strip("</> ")
        generic = bool(self.last and (self.last[-1].isalnum() or self.last[-1] == "_")) and not raw.startswith("</") and plain[:1].isupper() and (len(plain) == 1 or not plain.isupper())
        return tag in HTML_NAMES and not generic

    def _put(self, s: str) -> None:
        if s:
            self.out.append(s)
            self.last = s

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or f"<{tag}>"
        if not self._known(tag, raw) or any(v is None and a not in self._BARE and a.isalnum() for a, v in attrs) and not any(v for _, v in attrs):  # words between two comparisons
            return self._put(raw)
        self.seen = True
        if tag in self._SILENT:
            self.silent = 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._put("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            n = self.lists[-1] if self.lists else 0
            if n and self.lists:
                self.lists[-1] += 1
            self._put("\n" + (f"{n}. " if n else "- "))
        elif tag in ("td", "th"):
            self._put(" | " if self.cells else "")
            self.cells += 1
        elif tag in ("br",):
            self._put("\n")
        elif tag == "pre":
            self.pre += 1
            self._put("\n\x01")
        elif tag == "img":
            self._put(dict(attrs).get("alt") or "")
        elif tag in self._BLOCKS:
            self._put("\n")
        if tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else 0)
        if tag == "tr":
            self.cells = 0

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_comment(self, data: str) -> None:
        self.seen = True

    def handle_decl(self, decl: str) -> None:
        self.seen = True

    def handle_endtag(self, tag: str) -> None:
        self.seen = self.seen or tag in HTML_NAMES
        if tag in self._SILENT:
            self.silent = 0
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self._put("\x02\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._put("\n")
        elif tag in self._BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._put("\n")
        elif tag not in HTML_NAMES:
            self._put(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if "-->" in data or data.startswith("<") and _TAG.match(data):  # the end of a comment, or a tag that is never closed
            self.seen = True
        if not self.silent:
            self._put(data)

    def unknown_decl(self, data: str) -> None:
        self.seen = True
        self._put(data.removeprefix("CDATA["))


_OPENED = re.compile(r"<(?:(!--)|(script|style|template)\b|(!doctype\b[^<>]*>|!\[CDATA\[)|[!?]|/(?![A-Za-z]))", _I)


def _shielded(text: str) -> str:
    """The text with the signs escaped behind which the parser would drop text: comments and silent elements that are
    never closed, processing instructions, declarations of other kinds. One pass: what opens before the last of its ends
    is closed."""
    low = text.lower()
    last = {"!--": low.rfind("-->"), "![cdata[": low.rfind("]]>"), **{x: low.rfind("</" + x) for x in _Events._SILENT}}

    def one(m: re.Match) -> str:
        kind = (m.group(1) or m.group(2) or m.group(3) or "").lower()
        closed = kind.startswith("!doctype") or kind in last and m.start() < last[kind]
        return m.group(0) if closed else "&lt;" + m.group(0)[1:]

    return _OPENED.sub(one, text)


def _html(text: str) -> tuple[str, bool]:
    """The text of the parser's events, and whether they held anything of HTML: an element, a comment, a declaration or
    a character reference, which the parser resolves by html.unescape."""
    if "<" not in text and "&" not in text and "-->" not in text:
        return text, False
    p = _Events()
    p.feed(_shielded(text) if "<" in text else text)
    p.close()
    return "".join(p.out), p.seen or "<!--" in text or "&" in text and html.unescape(text) != text


#: What makes a line part of the structure, and what stands in it without being text of its own.
_STRUCTURE = re.compile(r"</?(?:li|ul|ol|dl|dt|dd|table|caption|tr|td|th|h[1-6]|pre|code|script|style|template)\b|<!|-->|\x00", _I)
_LINKED = re.compile(r"<a\b[^<>]*>.*?</a\s*>|<button\b[^<>]*>.*?</button\s*>|<option\b[^<>]*>.*?</option\s*>", _I)


def _own_text(line: str) -> bool:
    """Whether the line says more than links and buttons do, one link alone included."""
    rest, n = _LINKED.subn(" ", line)
    return n < 2 or re.search(r"\w", _TAG.sub(lambda m: m.group(1) or "", rest)) is not None


def content_lines(lines: list[str], sigma: float = 1.5) -> np.ndarray:
    """Which lines of an HTML body are content: text-to-tag ratio per line, smoothed with a Gaussian, clustered by the
    threshold of one standard deviation, whatever the size of the body. Below it only lines of links are no content:
    lines of lists, tables, headings and code stay, and so do those with text of their own and those without tags."""
    tags = np.array([sum(1 for m in _TAG.finditer(x) if _is_tag(m)) for x in lines], np.float64)
    if not tags.any():
        return np.ones(len(lines), bool)
    text = np.array([len(_TAG.sub(lambda m: m.group(1) or "", x).strip()) for x in lines], np.float64)
    ratio = text / np.maximum(tags, 1)
    r = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ratio, r, mode="edge"), kernel / kernel.sum(), "valid")
    keep = (smooth >= smooth.std()) | (tags == 0)
    for i in np.flatnonzero(~keep):
        keep[i] = _STRUCTURE.search(lines[i]) is not None or _own_text(lines[i])
    return keep


def _tags_only(line: str) -> str:
    """The line's tags without its text, so that what they open or close stays so."""
    return "".join(m.group(0)[len(m.group(1) or "") :] for m in _TAG.finditer(line) if _is_tag(m) and m.group(3).lower() not in ("img", "br"))


_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", _M | re.DOTALL)
_MATH = re.compile(r"\$\$.+?\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[^\s$\\]\$(?![\w$])|(?<![\w$\\])\$[A-Za-z]\$(?![\w$])|\\\[.+?\\\]|\\\(.+?\\\)", re.DOTALL)
_INLINE = re.compile(r"(?<!`)(`{1,2})([^`\n]+)\1(?!`)")
#: kinds, pattern, replacement: where the pattern acts, the body may hold a construct of those kinds.
_STEPS = [
    ("heading", re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", _M), r"\1 \2"),
    ("heading", re.compile(r"^((?=[^\n]*\w)[^\n]+)\n(?:={3,}|-{3,})[ \t]*$", _M), r"# \1"),
    ("wiki", re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$", _M), lambda m: "#" * len(m.group(1)) + " " + m.group(2)),
    ("latex", re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}"), r"\n# \1\n"),
    ("wiki", re.compile(r"^[ \t]*\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[^\n]*\n?|^\|\+[^\n]*\n?", _M), ""),
    ("wiki|table", re.compile(r"^[!|][ \t]*([^\n|][^\n]*?(?:!!|\|\|)[^\n]*)$", _M), lambda m: " | ".join(x.strip() for x in re.split(r"!!|\|\|", m.group(1)))),
    ("table", re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|[ \t]*\n?", _M), ""),
    ("table", re.compile(r"^[ \t]*\|([^\n]*)\|[ \t]*$", _M), lambda m: " | ".join(x.strip() for x in m.group(1).split("|"))),
    ("latex", re.compile(r"\\begin\{(?:itemize|enumerate|description|center|quote)\}[^\n]*\n?|\\end\{(?:itemize|enumerate|description|center|quote)\}\n?"), "\n"),
    ("latex", re.compile(r"\\item\b[ \t]*(?:\[([^\]\n]*)\])?[ \t]*"), lambda m: "- " + (m.group(1) + " " if m.group(1) else "")),
    ("latex", re.compile(r"\\(?:cite|ref|eqref|label|footnote|url|citep|citet)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"[\1]"),
    ("latex", re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    ("latex", re.compile(r"\\(?:text\w*|emph|underline|mbox|texttt|mathrm)\{([^{}]*)\}"), r"\1"),
    ("latex", re.compile(r"\\(?:begin|end)\{[^{}]*\}"), ""),
    ("link", re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    ("link", re.compile(r"\[([^\[\]\n]+)\]\([^()\s]+[^()\n]*\)"), r"\1"),
    ("link", re.compile(r"^[ \t]{0,3}\[\^([^\[\]\n]+)\]:[ \t]*", _M), ""),
    ("link", re.compile(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]*\S+[^\n]*\n?", _M), ""),
    ("link", re.compile(r"\[\^[^\[\]\s]+\]"), ""),
    ("link", re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    ("wiki", re.compile(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]"), r"\1"),
    ("wiki", re.compile(r"\[https?://\S+[ \t]+([^\]\n]+)\]"), r"\1"),
    ("wiki", re.compile(r"\{\{([^{}\n|]+)(?:\|([^{}\n]*))?\}\}"), lambda m: m.group(1).strip() if m.group(2) is None else m.group(2).replace("|", ", ")),
    ("wiki", re.compile(r"(?<![\w'])'{2,5}([^'\n]+)'{2,5}(?![\w'])"), r"\1"),
    ("emphasis", re.compile(r"(?<!\w)\*\*\*?([^\s*][^*\n]*?)\*\*\*?"), r"\1"),
    ("emphasis", re.compile(r"(?<![\w/])__([^\W_][^\n]*?)__(?!\w)"), r"\1"),
    ("emphasis", re.compile(r"(?<![\w*\\/(])\*([^\s*/](?:[^*\n]*[^\s*])?)\*(?![\w*/])"), r"\1"),
    ("emphasis", re.compile(r"(?<![\w/\\.-])_([^\W_](?:[^_\n]*[^\s_])?)_(?!\w)"), r"\1"),
    ("emphasis", re.compile(r"~~([^~\n]+)(?:~~|$)", _M), r"\1"),
    ("emphasis", re.compile(r"(?<!\w)\*\*(?=[^\s*])(?!(?:kw)?args\b|\w+\))([^\n*]+)"), r"\1"),  # never closed
    ("list", re.compile(r"^([ \t]*)[*+•][ \t]+", _M), r"\1- "),
    ("list", re.compile(r"^([ \t]*)-[ \t]+\[[ xX]\][ \t]+", _M), r"\1- "),
    ("list", re.compile(r"^([ \t]*)(\d{1,3})\)[ \t]+", _M), r"\1\2. "),
    ("list", re.compile(r"^([ \t]*(?:-|\d{1,3}\.))[ \t]+(?=\S)", _M), r"\1 "),
    ("quote", re.compile(r"^[ \t]{0,3}(?:>[ \t]?)+", _M), ""),
    ("rule", re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$\n?", _M), ""),
]

#: Of each step, strings of which a text has one if the step can act.
_STEP_NEEDS = [
    ("#",), ("\n===", "\n---"), ("==",), ("\\",), ("|",), ("!!", "||"), ("|",), ("|",), ("\\",), ("\\",), ("\\",), ("\\",), ("\\",), ("\\",), ("![",), ("](",), ("[^",), ("]:",), ("[^",), ("][",),
    ("[[",), ("[http",), ("{{",), ("''",), ("**",), ("__",), ("*",), ("_",), ("~~",), ("**",), ("*", "+", "•"), ("- ", "-\t"), (")",), ("-", "."), (">",), ("---", "***", "___", "- -", "* *", "_ _"),
]


def cleaned(text: str | None) -> tuple[str | None, list[str]]:
    """The text without markup and the kinds of markup it held, from one pass: the events of the parser show HTML, each
    cleaning step records its kind where it acts, and the exact patterns confirm what was recorded. Text in which nothing
    is confirmed comes out as it is."""
    if not text or not _ANY.search(text):
        return text, []
    raw = text.replace("\r\n", "\n").replace("\r", "\n")
    made = raw.replace("\x00", "").replace("\x01", "").replace("\x02", "")
    kept: list[str] = []
    kinds: set[str] = set()

    def keep(s: str, *kind: str) -> str:
        kinds.update(kind)
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    indented = lambda s: "\n".join("    " + x if x else x for x in s.strip("\n").split("\n"))
    if "```" in made or "~~~" in made:
        made = _FENCE.sub(lambda m: keep(indented(m.group(3)), "code") + "\n", made)
    if "`" in made:
        made = _INLINE.sub(lambda m: keep(m.group(2).strip(), "code"), made)
    made = made if "$" not in made and "\\" not in made else _MATH.sub(lambda m: keep("$" + re.sub(r"^(?:\$\$?|\\\[|\\\()\s*|\s*(?:\$\$?|\\\]|\\\))$", "", m.group(0)) + "$", "formula", "latex"), made)
    lines = made.split("\n")
    if "<" in made:
        made = "\n".join(x if on else _tags_only(x) for x, on in zip(lines, content_lines(lines)))
    made, seen = _html(made)
    if seen:
        kinds.add("html")
    made = made if "\x01" not in made else re.sub("\x01(.*?)(?:\x02|$)", lambda m: keep(indented(m.group(1))), made, flags=re.DOTALL)
    for (kind, pattern, to), needs in zip(_STEPS, _STEP_NEEDS):
        if not any(x in made for x in needs):
            continue
        made, n = pattern.subn(to, made)
        if n:
            kinds.update(kind.split("|"))
    found = _confirmed(raw, kinds)
    if not found:
        return text, []
    for _ in range(3):  # code within code within a formula at most
        if "\x00" not in made:
            break
        made = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], made)
    made = re.sub(r"[ \t]+$", "", made, flags=_M)
    return re.sub(r"\n{3,}", "\n\n", made).strip("\n"), found


def constructs(text: str | None) -> list[str]:
    """Kinds of markup that the text holds, well-formed or not; sorted, each once."""
    return cleaned(text)[1]


def clean(text: str | None) -> str | None:
    """The text without markup, its structure in the module's plain notation; text without markup as it is."""
    return cleaned(text)[0]


def _batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        results = [cleaned(t) for t in texts]
        made = [pa.array([k for _, k in results], pa.list_(pa.string()))]
        if with_text:
            made.append(pa.array([t for t, _ in results], pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "constructs", "clean_text"][: b.num_columns - 1 + len(made)])


def clean_markup(bodies: DataFrame, text_col: str = "body", with_text: bool = True) -> DataFrame:
    """bodies without text_col, with constructs array<string> (the kinds of markup found, empty if none) and clean_text.

    A null body has no constructs and a null clean_text; an empty one stays empty. Rows come out one for one, in their
    partitions, without a shuffle; columns of those names in the input are replaced.
    """
    others = [c for c in bodies.columns if c not in (text_col, "constructs", "clean_text")]
    df = bodies.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(lambda it: _batches(it, with_text), f"{kept}, constructs array<string>" + (", clean_text string" if with_text else ""))
