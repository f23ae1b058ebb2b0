import random

import pytest

from orrery.llm import differencing as D
from orrery.llm import markup as M
from orrery.llm.markup import clean_documents, clean_text, constructs, language, part_kinds

PLAIN = [
    "It ran from $28 to $14 a unit.",
    "They logged 58 * 81 * 2 counts [sic].",
    "See C:\\logs\\1\\80 for it.",
    "The set {54, 61} was dropped. Readings of 59 < 89 were kept.",
    "File log_13_11 lists R&D notes. Tank #20 and tank #7 agreed. Grade 52/64 was given (see below).",
    "",
]
CASES = [
    ("<h2 id=a>T</h2><p>Text <b>bold</b></p><ul><li>one<li>two</ul>", "html", {"heading", "list"}),
    ("<html><head><title>T</title></head><body><p>x &amp; y</p><script>var n = 1;</script></body></html>", "html", set()),
    ("<p>a</p><pre><code>if x < 1\n# no heading</code></pre><div>$$x = y$$</div>", "html", {"code", "formula"}),
    ("# Title\n\nText **bold** and [a](/b).\n\n- one\n- two\n\n```\n# code\n```\n\nThe bound is $x = y$ here.", "markdown", {"heading", "list", "code", "formula"}),
    ("Title\n=====\n\nMore\n----\n\ntext _so_ on", "markdown", {"heading"}),
    ("Text with **bold** words only.", "markdown", set()),
    ("```\n# not a heading\n- no item\n```\n\nSee [a](/b).", "markdown", {"code"}),
    ("'''T''' is here.\n== H ==\n# one\n# two\n<syntaxhighlight lang=c>x</syntaxhighlight>\n:<math>a</math>\n[[Category:X]]", "wiki", {"heading", "list", "code", "formula"}),
    ("'''T''' is here.\n# one item\n[[Category:X]]", "wiki", {"list"}),
    ("{| class=\"wikitable\"\n! a !! b\n|-\n| 1 || 2\n|}\nText {{cite|p=1}}.", "wiki", set()),
    ("\\section*{T} Text \\emph{x}. \\begin{itemize} \\item a \\item b \\end{itemize} $x$ \\begin{verbatim}\n# x\n\\end{verbatim}", "latex", {"heading", "list", "code", "formula"}),
    ("Out of four {\\it tries,} done. \\\\\nNext line~\\cite{a}.", "latex", set()),
    ("A plain page with one <!-- note --> only.", None, set()),
    ("The soil&#8217;s dark.", None, set()),
    ("Fifteen hours from</p> the nearest.", "html", set()),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_isnt_markup(text):
    assert constructs(text) == set() and clean_text(text) == text


@pytest.mark.parametrize("text,lang,kinds", CASES)
def test_constructs(text, lang, kinds):
    assert language(text) == lang
    assert constructs(text) == kinds | {"markup"}


def test_clean_text():
    assert clean_text("<h2>T</h2><p>a &amp; <b>b</b></p><ul><li>x<li>y</ul>").split("\n") == ["## T", "", "a & b", "", "- x", "- y"]
    assert clean_text("'''T''' [[a|b]] [[c]].\n== H ==\n# one\n<pre>\n'''kept'''\n</pre>") == "T b c.\n# H\n- one\n\n```\n'''kept'''\n```"
    assert clean_text("\\section{T}\\begin{enumerate}\\item a\\item b\\end{enumerate}\\( x^2 \\)") == "# T\n- a\n- b\n\n$$x^2$$"
    assert clean_text("T\n=\n\nno") == "T\n=\n\nno" and clean_text(None) is None
    code = clean_text("See [a](/b).\n\n~~~\n  two  spaces\n~~~")
    assert "  two  spaces" in code and "[a]" not in code


def test_frames(spark):
    rows = [("1", "# T\n\n**b**"), ("1", "# T\n\n**b**"), ("2", None), (None, "# x\n\n**y**"), ("3", "plain"), ("4", ""), ("5", "<p>" + "x " * 200000)]
    df = spark.createDataFrame(rows, "part_kind string, clean string")
    assert {tuple(r) for r in part_kinds(df, "part_kind", "clean").collect()} == {("1", "markup"), ("1", "heading"), ("5", "markup")}
    got = {r["rid"]: r["clean"] for r in clean_documents(df, "part_kind", "clean").collect()}
    assert set(got) == {"1", "2", "3", "4", "5"} and got["2"] is None and got["4"] == "" and got["3"] == "plain"
    assert part_kinds(df.limit(0), "part_kind", "clean").count() == 0


@pytest.mark.parametrize("text", ["call __init__ first", "Readings:\n- 5 C\n- 7 C", "see [3](page 4)", "a < b and c > d", "cost $5 and $6"])
def test_plain_text_with_the_same_signs(text):
    assert M.constructs(text) == set() and M.clean_text(text) == text


def test_placeholders_never_meet_the_text():
    text = "a \x000\x00 b \U000f00000\U000f0000\n\n```\ncode\n```\nand **c**"
    assert M.clean_text(text) == "a \x000\x00 b \U000f00000\U000f0000\n\n```\ncode\n```\n\nand c"


def test_common_lines_against_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = D.common_lines(a, b)
        assert len(at) == best[-1][-1] and at == sorted(set(at))
        it = iter(b)
        assert all(any(y == a[i] for y in it) for i in at)


def test_differencing_deletes_the_frame_of_a_host(spark):
    frame = "menu\n{}\nfooter"
    rows = [("1", "h", "/a/x", frame.format("one"), "x"), ("2", "h", "/a/y", frame.format("two"), "x"), ("3", "h", "/b", "three\nfooter", "x"), ("4", "g", "/a/x", frame.format("four"), "x"), ("5", None, None, None, "x"), ("1", "h", "/a/x", frame.format("one"), "x"), (None, "h", "/", "menu", "x"), ("6", None, "p", "", "x")]
    got = {r["rid"]: (r["partner"], r["n_lines"], r["shared_lines"], r["kept"]) for r in D.differenced(spark.createDataFrame(rows, "id string, host string, path string, txt string, place string"), "id", "host", "path", "txt").collect()}
    assert got == {"1": ("2", 3, 2, "one"), "2": ("1", 3, 2, "two"), "3": ("2", 2, 1, "three"), "4": (None, 3, 0, frame.format("four")), "5": ("6", 0, 0, None), "6": ("5", 1, 0, "")}
    empty = spark.createDataFrame([], "id string, host string, path string, txt string")
    assert D.differenced(empty, "id", "host", "path", "txt").count() == 0
