"""Markup residue: which constructs a text holds, and its clean text.

A text is read in one language: HTML, LaTeX, wiki or Markdown, whichever its
constructs speak for; HTML tags count in every language. Headings, lists,
code blocks and formulas are found by that language's rules, and the clean
text shows them in one plain form: '# ' headings, '- ' items, fenced code
and '$$' formulas.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.runtime import spread

_M, _I, _S = re.M, re.I, re.S

# the constructs of the four languages
TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*|/)?>|</?[a-z][a-z0-9]*(?:\s+[a-z-]+\s*=[^<>]*)?$|<!--|<!doctype\b|<\?xml\b", _I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});", _I)
HTML_BLOCK = re.compile(r"</?(?:p|h[1-6]|div|li|ul|ol|table|tr|td|th|html|head|body|title|blockquote|section|article)\b[^<>]*>", _I)
HTML_HEADING = re.compile(r"<h[1-6]\b[^<>]*>", _I)
HTML_LIST = re.compile(r"<(?:ul|ol|li|dl)\b[^<>]*>", _I)
CODE_TAG = re.compile(r"<(?:pre|syntaxhighlight|source)\b[^<>]*>", _I)
MATH_TAG = re.compile(r"<math\b[^<>]*>", _I)
TEX_DELIMITED = re.compile(r"\$\$.+?\$\$|\\\(.+?\\\)|\\\[.+?\\\]", _S)
DOLLARS = re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?:[^$\n]*?[^\s$\\])\$(?![\w$])")

WIKI = re.compile(r"'''|\[\[\w|\{\{\w|^={2,6}[^=\n]+={2,6}[ \t]*$|^\{\||^\|\}|<ref\b|<syntaxhighlight\b", _M)
WIKI_INLINE = re.compile(r"'{2,5}(?=[^\s'])[^'\n]+'{2,5}|'''|\[\[\w|\{\{\w|^\{\|[^\n]*|__[A-Z]{3,}__", _M)
WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*={2,6}[ \t]*$", _M)
WIKI_LIST = re.compile(r"^[*#]+[ \t]*[^\s*#]", _M)

_LINK = r"!?\[[^\[\]\n]*\]\([^()\s]*(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*\)"
MD = re.compile(rf"\*\*(?=[^\s*])|{_LINK}|^(?:```|~~~)|^#{{1,6}} +\S|(?<![\w`])`[^`\n]+`(?![\w`])", _M)
# one lower-case word between double underscores is a name, as code writes it (__init__)
MD_INLINE = re.compile(
    rf"\*\*(?=[^\s*])[^*\n]+\*\*|(?<![\w*])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*])|(?<!\w)(?!__[a-z0-9]+__(?!\w))__?(?=[^\s_])[^_\n]*[^\s_]__?(?!\w)|(?<![\w`])`[^`\n]+`(?![\w`])|{_LINK}|~~(?=\S)[^~\n]+~~|^ {{0,3}}>[ \t]+\S",
    _M,
)
MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)(?:[ \t]+#+)?[ \t]*$", _M)
MD_SETEXT = re.compile(r"^(?=[^\n]*\w)(?![ \t]*(?:[-*+>|]|\d+[.)])[ \t])([^\n]+)\n(={2,}|-{2,})[ \t]*$", _M)
MD_LIST = re.compile(r"^[ \t]*(?:[-*+]|\d{1,4}[.)])[ \t]+\S", _M)
QUANTITY = re.compile(r"^[ \t]*[-+*][ \t]+\d[\d.,]*[ \t]*[^\s\w]?\w{0,3}[ \t]*$", _M)
MD_FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n`]*$", _M)
MD_TABLE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*\|", _M)

TEX = re.compile(r"\\(?:(?:sub)*section|(?:sub)?paragraph|chapter|text[a-z]{2}|emph|underline|cite[a-z]?|footnote|ref|label|url|href|caption|title|author|documentclass|usepackage|includegraphics)\*?(?:\[[^\]\n]*\])?\{|\\(?:begin|end)\{|\\item\b|\{\\(?:it|bf|em|tt|sc|rm|sl|sf)\b|\\\\[ \t]*$", _M)
TEX_INLINE = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{", 0)
TEX_HEADING = re.compile(r"\\((?:sub)*)(?:section|paragraph|chapter)\*?\{([^{}]*)\}?")
TEX_LIST = re.compile(r"\\begin\{(?:itemize|enumerate|description)\*?\}|\\item\b")
TEX_CODE = re.compile(r"\\begin\{(?:verbatim|lstlisting|minted|Verbatim)\*?\}")
TEX_FORMULA = re.compile(r"\\begin\{(?:equation|align|displaymath|math|gather|multline|eqnarray)\*?\}")

ANY_SIGN = re.compile(r"[<&\\\[{*_`#=~>$]|''|^[-+] |^\d+[.)] |^-{2,}", _M)
KINDS = ("markup", "heading", "list", "code", "formula")


def _count(pattern: re.Pattern, text: str, signs: tuple[str, ...]) -> int:
    """Matches of a pattern that needs one of these signs; most texts have none and cost no search."""
    return len(pattern.findall(text)) if any(x in text for x in signs) else 0


_WIKI_SIGNS = ("''", "[[", "{{", "==", "{|", "|}", "<ref", "<syntax")
_MD_SIGNS = ("**", "](", "```", "~~~", "# ", "`")


def _underlined(text: str) -> bool:
    return ("\n==" in text or "\n--" in text) and MD_SETEXT.search(text) is not None


def language(text: str) -> str | None:
    """'html', 'latex', 'wiki' or 'markdown', or None for a text without a language of its own."""
    wiki = _count(WIKI, text, _WIKI_SIGNS)
    tex = _count(TEX, text, ("\\",))
    md = _count(MD, text, _MD_SIGNS) + _underlined(text)
    if not wiki and "<" in text and (blocks := len(HTML_BLOCK.findall(text))) and (blocks > 1 or not (tex or md)):
        return "html"
    if wiki:  # numbered wiki items look like Markdown headings
        md -= sum(1 for m in MD_HEADING.finditer(text) if len(m[1]) == 1)
    votes = {"latex": tex, "wiki": wiki, "markdown": md}
    best = max(votes, key=lambda k: (votes[k], k == "wiki"))
    if votes[best] > 0:
        return best
    return "markdown" if len(MD_LIST.findall(text)) - len(QUANTITY.findall(text)) > 1 or any(x in text for x in "*_`>~[") and MD_INLINE.search(text) else None


def constructs(text: str | None) -> set[str]:
    """The part kinds of a text; empty for null, empty or plain texts."""
    if not text or not ANY_SIGN.search(text):
        return set()
    lang = language(text)
    found: set[str] = set()
    tags = "<" in text
    if tags:
        found |= {k for k, p in (("heading", HTML_HEADING), ("list", HTML_LIST), ("code", CODE_TAG), ("formula", MATH_TAG)) if p.search(text)}
    if ("$$" in text or "\\(" in text or "\\[" in text) and TEX_DELIMITED.search(text):
        found.add("formula")
    if lang == "latex":
        found |= {k for k, p in (("heading", TEX_HEADING), ("list", TEX_LIST), ("code", TEX_CODE), ("formula", TEX_FORMULA), ("formula", DOLLARS)) if p.search(text)}
    elif lang in ("wiki", "markdown"):
        bare = _without_code(text, lang)
        if lang == "wiki":
            found |= {k for k, p in (("heading", WIKI_HEADING), ("list", WIKI_LIST)) if p.search(bare)}
        else:
            found |= {k for k, p in (("heading", MD_HEADING), ("list", MD_LIST), ("formula", DOLLARS)) if p.search(bare)}
            if _underlined(bare):
                found.add("heading")
            if MD_FENCE.search(text):
                found.add("code")
    if found or lang or tags and TAG.search(text) or "&" in text and ENTITY.search(text) or "\\" in text and TEX_INLINE.search(text) or "''" in text and WIKI_INLINE.search(text):
        found.add("markup")
    return found


_CODE_BODY = re.compile(r"(<(pre|syntaxhighlight|source)\b[^<>]*>)(.*?)(</\2\s*>|\Z)", _I | _S)
_FENCED = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[ \t]*$|\Z)", _M | _S)
_TEX_VERBATIM = re.compile(r"\\begin\{((?:verbatim|lstlisting|minted|Verbatim)\*?)\}(?:\[[^\]\n]*\])?(.*?)(?:\\end\{\1\}|\Z)", _S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", _S)
_HIDDEN = re.compile(r"<(script|style|head)\b[^<>]*>.*?(?:</\1\s*>|\Z)", _I | _S)


def _without_code(text: str, lang: str) -> str:
    if "<" in text:
        text = _CODE_BODY.sub(r"\1\4", text)
    return _FENCED.sub("\n", text) if lang == "markdown" and ("```" in text or "~~~" in text) else text


def clean_text(text: str | None) -> str | None:
    """The text without markup, structures in their plain form; null stays null.

    Comments, scripts, styles, templates, references and table frames go;
    what a page shows stays. Code is kept character by character.
    """
    if not text or not ANY_SIGN.search(text):
        return text
    lang = language(text)
    kept: list[str] = []
    mark = next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in text)  # stands around the number of a block that is kept

    def keep(block: str) -> str:
        kept.append(block)
        return f"\n{mark}{len(kept) - 1}{mark}\n"

    def code(body: str) -> str:
        body = html.unescape(re.sub(r"</?code\b[^<>]*>", "", body, flags=_I)) if lang == "html" else body
        return keep("```\n" + body.strip("\n") + "\n```")

    def formula(body: str) -> str:
        return keep("$$" + " ".join(body.split()) + "$$")

    t = _CODE_BODY.sub(lambda m: code(m[3]), text)
    if lang == "markdown":
        t = _FENCED.sub(lambda m: code(m[2]), t)
    if lang == "latex":
        t = _TEX_VERBATIM.sub(lambda m: code(m[2]), t)
        t = re.sub(r"\\begin\{((?:equation|align|displaymath|math|gather|multline|eqnarray)\*?)\}(.*?)(?:\\end\{\1\}|\Z)", lambda m: formula(m[2]), t, flags=_S)
    t = re.sub(r"<math\b[^<>]*>(.*?)(?:</math\s*>|\Z)", lambda m: formula(m[1]), t, flags=_I | _S)
    t = re.sub(r"\$\$(.+?)\$\$|\\\((.+?)\\\)|\\\[(.+?)\\\]", lambda m: formula(m[1] or m[2] or m[3]), t, flags=_S)
    if lang in ("latex", "markdown"):
        t = DOLLARS.sub(lambda m: formula(m[0][1:-1]), t)
    t = _HIDDEN.sub(" ", _COMMENT.sub("", t))
    if lang == "wiki":
        t = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)", "", t, flags=_I | _S)
        while (cut := re.sub(r"\{\{[^{}]*\}\}", "", t)) != t:
            t = cut
        t = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", t, flags=_I)
        t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)(?:\]\]|\Z)", r"\1", t)
        t = WIKI_HEADING.sub(lambda m: "#" * (len(m[1]) - 1) + " " + m[2], t)
        t = _wiki_items(t, text)
        t = re.sub(r"^(?:\{\||\|\}|\|-)[^\n]*$", "", t, flags=_M)
        t = re.sub(r"^[|!][ \t]*", "", t, flags=_M)
        t = re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", "\t", t)
        t = re.sub(r"'{2,5}", "", t)
    elif lang == "markdown":
        t = MD_SETEXT.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), t)
        t = re.sub(r"^[ \t]*(?:[-*+]|\d{1,4}[.)])[ \t]+(?=\S)", "- ", t, flags=_M)
        t = re.sub(r"^ {0,3}>[ \t]?", "", t, flags=_M)
        t = re.sub(_LINK, lambda m: m[0][m[0].index("[") + 1 : m[0].index("](")], t)
        t = re.sub(r"\*\*([^*\n]+)\*\*|~~([^~\n]+)~~", lambda m: m[1] or m[2], t)
        t = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])|(?<!\w)(?!__[a-z0-9]+__(?!\w))__?(?=[^\s_])([^_\n]*[^\s_])__?(?!\w)|(?<![\w`])`([^`\n]+)`(?![\w`])", lambda m: m[1] or m[2] or m[3], t)
    elif lang == "latex":
        t = TEX_HEADING.sub(lambda m: "\n" + "#" * (1 + len(m[1]) // 3) + " " + m[2] + "\n", t)
        t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", "\n", t)
        t = re.sub(r"\s*\\item\b(?:\[[^\]\n]*\])?[ \t]*", "\n- ", t)
        t = re.sub(r"~?\\(?:cite[a-z]?|label|footnote|ref)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}?", "", t)
        t = re.sub(r"\{\\[a-z]{2}\b[ \t]*([^{}]*)\}", r"\1", t)
        while (cut := re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)) != t:
            t = cut
        t = re.sub(r"\\\\[ \t]*(?=\n|\Z)", "", t).replace("~", " ")
    else:
        t = re.sub(r"\\(?:cite[a-z]?|label|footnote|ref)\*?\{[^{}]*\}", "", t)
        t = re.sub(r"\\[a-zA-Z]+\*?\{([^{}]*)\}|\{\\(?:it|bf|em|tt|sc|rm)\b[ \t]*([^{}]*)\}", lambda m: m[1] or m[2] or "", t)
    if "<" in t:
        t = re.sub(r"<h([1-6])\b[^<>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", t, flags=_I)
        t = re.sub(r"<li\b[^<>]*>\s*", "\n- ", t, flags=_I)
        t = re.sub(r"</t[dh]\s*>", "\t", t, flags=_I)
        t = re.sub(r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|br|hr|body|html|blockquote)\b[^<>]*>", "\n", t, flags=_I)
        t = TAG.sub("", t)
    if "&" in t:
        t = ENTITY.sub(lambda m: html.unescape(m[0]), t).replace("\xa0", " ")
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n")]
    t = "\n".join(x for x, before in zip(lines, ["", *lines]) if x or before)
    return re.sub(f"{mark}(\\d+){mark}", lambda m: kept[int(m[1])], t).strip("\n")


def _wiki_items(t: str, original: str) -> str:
    """'* ' and '# ' items of a wiki text as '- ' items; lines made headings before stay."""
    heads = {"#" * (len(m[1]) - 1) + " " + m[2] for m in WIKI_HEADING.finditer(original)}
    return "\n".join(x if x in heads else re.sub(r"^[*#]+[ \t]*(?=\S)", "- ", x) for x in t.split("\n"))


def _kinds(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid, kind = [], []
        for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k in constructs(t):
                rid.append(r)
                kind.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.string()), pa.array(kind, pa.string())], names=["rid", "part_kind"])


def _cleaned(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        kinds = [sorted(constructs(t)) for t in texts]
        langs = [language(t) if k else None for t, k in zip(texts, kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array([clean_text(t) for t in texts], pa.string())], names=["rid", "language", "part_kinds", "clean"])


def part_kinds(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rid, part_kind): what each record's text holds; rows with one id count once, null ids are left out."""
    return spread(docs.select(F.col(doc_id).cast("string").alias("rid"), F.col(text).alias("txt")).where("rid is not null and txt is not null")).mapInArrow(_kinds, "rid string, part_kind string").distinct()


def clean_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(rid, language, part_kinds, clean), a row per distinct id; a null text stays null, an empty one empty."""
    once = spread(docs.select(F.col(doc_id).cast("string").alias("rid"), F.col(text).alias("txt")).where("rid is not null")).dropDuplicates(["rid"])
    return once.mapInArrow(_cleaned, "rid string, language string, part_kinds array<string>, clean string")
