import pytest

from marginwise.llm import html

PROSE = "A long paragraph of plain prose that any reader would call the content of this page, with a full stop."
TERMS = {"words5": 2.0, "links0": 1.5, "end1": 2.0, "heading0": 1.0}


@pytest.mark.parametrize(
    "tag",
    ["<svg width='1'/>", "<button>Menu", "<select><option>one", "<object data='x'>", "<svg-icon></svg-icon>", "<title-card></title-card>",
     "<math><mi>x</mi></math>", "<iframe src='x'/>", "<button>", "<template>", "<textarea>"],
)
def test_nothing_after_a_tag_is_lost(tag):
    page = f"<body><div>{tag}</div><article><p>{PROSE}</p></article></body>"
    assert PROSE in html.main_text(page, {})


def test_a_formula_stays_and_closed_controls_go():
    page = "<article><p>The value of <math><mi>alpha</mi></math> grows <button>Share</button><svg><text>icon</text></svg> with time.</p></article>"
    text = html.main_text(page, {})
    assert "The value of alpha grows with time." == text


@pytest.mark.parametrize(
    "page",
    ["<main class='content has-sidebar'><p>{}</p></main>", "<div class='has-sidebar'><article><p>{}</p></article></div>",
     "<div class='page-with-sidebar'><div class='content'><p>{}</p></div></div>", "<div id='widget'><p>{}</p></div>"],
)
def test_a_bad_name_of_a_wrapper_is_no_veto(page):
    assert html.main_text(page.format(PROSE), TERMS) == PROSE


def test_boilerplate_stays_out():
    for page in ("<nav class='content'><article><p>{}</p></article></nav>", "<footer><p>{}</p></footer>"):
        assert html.main_text(page.format(PROSE), TERMS) == ""
    assert html.main_text("<div class='sidebar'><p>Short links</p></div>", {}) == ""
