import pytest

from docfathom.llm import residue as R

SPOTS = ["Dear {{ board_name }}, hello.", "Since ${RELEASE_TAG}.", "For %PRODUCT_NAME% owners.", "The {% block intro %} part.", "See <%= doc.summary %>.", "为__SECTION_BODY__准备。", "自@@VERSION@@起。",
         "A $$name$$ here.", "Use #{part_number} now.", "Hello {board}.", "Step {0}.", "See [[TODO: pin table]].", "The [insert value here] part.", "欢迎使用【待补充】。", "（占位文字）", "XX_FILL_ME_XX", "TK TK TK", "missing translation: guide.zh.lead",
         "Is [object Object].", "Is $t('guide.intro.lead').", "Welcome <<MODEL>>.", "欢迎使用%型号%。", "[Product name] quick start"]
WHOLE = ["404 Not Found", "502 Bad Gateway\nedge-proxy/1.23", "<html><head><title>403 Forbidden</title></head><body><center><h1>403 Forbidden</h1></center><hr></body></html>", "Just a moment...", "Please enable JavaScript to view this page.",
         "<noscript>This site works only with scripts switched on.</noscript>", "Access denied. You do not have permission to view this resource.", "Your session has expired. Sign in again to continue.", "页面不存在或已被删除，返回首页", "Seite nicht gefunden",
         "Lorem ipsum dolor sit amet tempor vita", "内容内容内容内容", "test test", "Untitled document", "undefined | Docs", "示例段落示例段落，稍后替换示例段落示例段落，稍后替换", "New page (3)", "Checking your browser before access. This takes a few seconds. Ray 9c9"]
CONTENT = ["Access denied in the log means that cfg_a_b was written by another user.", "If the web console answers 404 Not Found, restart the page service.", "Enable JavaScript in the kiosk browser, otherwise the live viewer stays grey.",
           "Replace <board-ip> in the command with the address shown.", "The launcher replaces the text between two curly brackets.", "Type lorem ipsum on the panel to judge the font.", "```yaml\nname: {{ unit_name }}\nrate: ${RATE}\n```",
           "{{Note|Overview}}\nWe saw it.", "__TOC__\n== A ==", "Access denied: fixing file owners", "Errors 400 to 499 explained", "页面不存在时的排查方法", "So \\(f_c = \\frac{1}{2}\\) follows, \\textbf{word} and x_{out}.", "Set $HOME and $TAV_ROOT, then log out.",
           "In templates a placeholder such as {{ name }} is filled in later.", "Write \"{{ name }}\" there.", "The mode map is { fast: 4, slow: 3 } by default.", "See [FAQ](./p.md) and [more][ref0].", "待机电流（待机时）", None, ""]


@pytest.mark.parametrize("text", SPOTS)
def test_unfilled_spots(text):
    assert any(x.startswith("spot:") for x in R.residue_of(text))


@pytest.mark.parametrize("text", WHOLE)
def test_whole_notices(text):
    assert any(x.startswith("whole:") for x in R.residue_of(text))


@pytest.mark.parametrize("text", CONTENT)
def test_content_stays(text):
    assert R.residue_of(text) == []


def test_a_spot_counts_in_long_content_but_a_notice_only_as_a_whole():
    body = "The cross toolchain ships with a unit test. " * 300
    assert R.residue_of(body) == []
    assert R.residue_of(body + "Dear {{ name }}.") == ["spot:mustache"]
    assert R.residue_of(body + "404 Not Found") == []


def test_operator_over_odd_rows(spark):
    df = spark.createDataFrame([(1, "404 Not Found", None, "x"), (1, "404 Not Found", "", "x"), (None, "Real title", "Hello {board}.", "x")], "row_id long, title string, text string, reasons string")
    got = sorted((str(r.row_id), r.field_name) for r in R.residue(df, "row_id", "text", "title").collect())
    assert got == [("1", "title"), ("1", "title"), ("None", "text")]
    kept = R.without_residue(df, "text", "title")
    assert kept.columns == df.columns and kept.count() == 3 and kept.where("title is not null").count() == 1
    assert R.residue(df.limit(0), "row_id", "text").count() == 0


@pytest.mark.parametrize("text", ["Replace this paragraph with your own text. ", "<div class='wide'><p>404 Not Found</p></div>", "Blindtext für diese Seite. ", "Please enable JavaScript to view this page. "])
def test_a_notice_of_any_length_is_one(text):
    assert R.whole_notice(text * 10) and R.whole_notice(text * 200) == R.whole_notice(text * 10)


def test_tutorials_are_told_by_context_and_density():
    lead = "Templates use the following form:\n{{ name }} is put in here.\n"
    assert R.residue_of(lead) == []
    taught = "The placeholder {{ name }} is filled in. The placeholder {{ date }} too. The placeholder {{ place }} as well. "
    rest = "We then write it to the disk and look at the log of the unit. " * 5
    assert R.residue_of(taught + rest + "Dear {{ owner }}, hello.") == []
    assert R.residue_of("A placeholder {{ name }} is filled in. Dear {{ owner }}, {{ date }} {{ place }}.") == ["spot:mustache"]
    dense = "The placeholder {{ name }} " + "which stands for a word that is long " * 8 + "is filled in. The placeholder {{ date }} " + "which stands for a word that is long " * 8 + "too. {{ owner }}"
    assert R.residue_of(dense) == ["spot:mustache"]


def test_long_notices_are_found_whole():
    trace = "Traceback (most recent call last): File \"/srv/app/pages.py\", line 214, in render " + "File \"/srv/app/views.py\", line 77, in show " * 9 + "KeyError: 'title'"
    assert len(trace) > 400 and R.whole_notice(trace) == "error"
    assert R.whole_notice("<div>" * 400 + "404 Not Found" + "</div>" * 400) == "error"
