import pytest

from docfathom.llm import markup as M

MARKED = {
    "html": ["<p>Hi", "a<br/>b", "x &amp; y", "A&nbsp;b", "<!-- note -->", "<H3>Title</H3>"],
    "markdown": ["# Title", "a **bold** word", "an *odd* word", "~~gone~~", "use `code`", "- item", "+ item", "> quote", "![](a.png)", "See [FAQ](./p.md).", "[more][ref0]\n\n[ref0]: ../a.md", "Title\n=====", "| a |\n| --- | :-: |\n| b |", "```\nx\n```", "- [x] done"],
    "wiki": ["== Title ==", "[[Page|see there]]", "'''bold'''", "{{Note|Hi}}", "__TOC__", '{| class="wikitable"\n! key !! value\n|-\n| a || b\n|}', "** item"],
    "latex": ["\\section{A}", "a \\textbf{b} c", "cf.~\\ref{eq:a}", "\\begin{itemize}\n\\item a\n\\end{itemize}", "so $\\sqrt{a^2}$ holds", "So \\(U = R \\cdot I\\) follows", "We get $$f_c = \\frac{1}{2}$$"],
}
PLAIN = ["Check that 65 < 1036 and 1036 > 3 hold.", "Use C# or C++ for cfg_a_b, not both.", "Ratio a/b ~ 2, tolerance +/- 40 ppm.", "Press Ctrl + C or send * to stop.", "The R&D sample costs $5, the full kit $80.", "Set $HOME and $TAV_ROOT.",
         "The mode map is { fast: 4, slow: 3 }.", "Files live in C:\\tools\\begin\\run_x on the host.", "Answers >= 5 pass && answers <= 2 fail.", "The log shows [WARN] (code 1).", "Signal x_1 leads x_2.", "Multiply 5 * 4 * 2.", "See issue #4 and merge #5.",
         "Replace <board-ip> here.", "Dear {{ board_name }}.", "Is <<MODEL>>.", "A __SECTION_BODY__ x.", "Use $$name$$.", "See [[TODO: pin table]].", "The <%= doc.summary %> x.", "[insert value here]", "bus_ring_delay and _v2", "ｂｕｓ_ｒｉｎｇ_ｄｅｌａｙ", "a\nb\n\nc", ""]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in MARKED.items() for t in ts])
def test_markup_is_found(kind, text):
    assert kind in M.markup_kinds(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_unchanged(text):
    kinds = M.markup_kinds(text)
    assert kinds == [] and M.clean_text(text, kinds) == text


def clean(text):
    return M.clean_text(text, M.markup_kinds(text))


def test_structure_stays():
    assert clean("<h2>Title<a class=\"hash-link\" href=\"#x\">#</a></h2><ul><li>a</li><li>b &amp; c</li></ul><pre><code>x = 1\ny &lt; 2</code></pre><script>track()</script>") == "## Title\n\n- a\n- b & c\n\n```\nx = 1\ny < 2\n```"
    assert clean("== T ==\n# one\n** two\n'''x''' [[A|b]]<ref>n</ref>") == "## T\n- one\n  - two\nx b"
    assert clean("\\section{A}\n\\begin{itemize}\n\\item a \\textbf{b}\n\\end{itemize}\n\\begin{equation}\nU = R\\label{e}\n\\end{equation}") == "# A\n\n- a b\n\n$$U = R$$"
    assert clean("T\n===\n\n- [x] a **b** ~~c~~ [d](e)\n\n| k | v |\n| --- | --- |\n| 1 | 2 |") == "# T\n\n- a b c d\n\nk | v\n1 | 2"


def test_frame_lines_are_cut_between_surge_and_dive():
    page = "<html><body><nav><a href=1>Home</a>\n<a href=2>Docs</a>\n<a href=3>News</a></nav><p>One two three.</p><p>Four.</p><footer>a\nb\nc\nd</footer></body></html>"
    assert clean(page) == "One two three.\n\nFour."
    assert M.surges([0, 0, 5, 0, 0, 0, 0, 7], 3) == [(2, 3), (7, 8)]


def test_distribution_alone_cuts_a_list_of_links():
    menu = "<div class='menu'>" + "<br>".join(f"<a href='/{x}'>{x} pages and more</a>" for x in ("Home", "Products", "Support", "Contact")) + "</div>"
    page = f"<body>{menu}<h1>Flashing</h1><p>Hold the button until the lamp on the board is lit, then connect the cable.</p><ul><li>one</li><li>two</li></ul><p>See <a href='/x'>the guide</a>.</p></body>"
    assert clean(page) == "# Flashing\n\nHold the button until the lamp on the board is lit, then connect the cable.\n\n- one\n- two\n\nSee the guide."
    assert "Home pages" in M.clean_text(menu, ["html"])  # nothing else is there


def test_limit_comes_from_the_blocks_of_the_text():
    assert M.surges([0, 0, 0, 5, 1, 1, 1, 1, 1, 300, 1, 1, 1]) == [(3, 4), (7, 10)]
    assert M.surge_limit([]) == M.surge_limit([0, 0]) == M.surge_limit([3, 4]) == 1 and M.surge_limit([500] * 9) == M.SURGE_MOST
    assert M.surges([2, 2, 2]) == [(0, 3)] and M.surges([]) == [] and M.surges([0, 0]) == []


def test_operator_over_odd_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", None, "c"), (1, "<p>a", "", "c"), (None, None, "x" * 50_000 + " **b**", "c")], "row_id long, text string, answer string, clean string")
    got = sorted((str(r.row_id), r.field_name, len(r.clean), len(r.markups)) for r in M.without_markup(df, "row_id", "text", "answer").collect())
    assert got == [("1", "answer", 0, 0), ("1", "text", 1, 1), ("1", "text", 1, 1), ("None", "answer", 50_002, 1)]
    assert M.without_markup(df.limit(0), "row_id", "text").count() == 0
