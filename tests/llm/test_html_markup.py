"""Markup in which text that a browser shows is easily lost: heads without an end tag, drawings and formulas."""

import pytest

from tideloom.llm import html_extract

BODY = "<article><h1>A heading here</h1><p>First part of the text, which is long enough to be kept.</p></article>"
TEXT = "A heading here First part of the text, which is long enough to be kept."


def shown(page):
    return " ".join("".join("".join(n.text) if n.text is not None else "" for n in html_extract.parse(page)).split())


@pytest.mark.parametrize("head", ["<head><title>x</title>", "<head><meta charset=utf-8><script>a<b</script><!-- c --><link rel=x>\n", "<head>", "<head></head>", "<head><template><p>no</p></template>"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_head_without_end_tag(head, body):
    page = f"<!DOCTYPE html><html>{head}{body}{BODY}</html>"
    assert html_extract.default_model().extract(page) == TEXT


def test_text_ends_a_head_and_a_second_head_hides_nothing():
    assert shown("<html><head><title>t</title> \n words<p>more</p>") == "wordsmore"
    assert shown("<html><head><title>t</title><b>words</b>") == "words"
    assert shown("<html><head><title>t</title></head><body><div><head>words</div>") == "words"


def test_slash_closes_in_drawings_and_formulas():
    for icon in ('<svg width="1" class="icon"/>', '<svg><path d="M 0"/><script href="x"/><style/></svg>', "<svg><title>t</svg>", "<math/>", "<svg><title/></svg>", "<svg><path d=M/ >"):
        page = f"<html><body><article><h1>A heading here</h1>{icon}<p>First part of the text, which is long enough to be kept.</p></article>"
        assert html_extract.default_model().extract(page) == TEXT, icon
        assert shown(f"<div>{icon}<p>one</p></div>") == "one", icon
    assert shown("<div><script/>no</script>one") == "one"  # not in HTML
    assert shown("<svg width=1/><text>in</text>") == "in"  # the slash is a part of the value


def test_formulas_and_text_of_drawings():
    assert shown("<p>let <math><mi>x</mi><mo>=</mo><mn>42</mn></math>, so</p>") == "let x = 42, so"
    assert shown("<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>\\x</annotation></semantics></math>y") == "xy"
    assert shown("<math><mtext>a <b>bold</b> word</mtext></math>") == "a bold word"
    assert shown("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs>no<g><text>Label <tspan x=0>two</tspan></text></g></svg>after") == "Label twoafter"
    assert shown("<svg><foreignObject><div>in<p>side</p></div></foreignObject>no</svg>") == "inside"
    assert shown("<svg><text><![CDATA[a < b > c]]></text></svg>") == "a &lt; b &gt; c"
    assert shown("<p>a<svg><foreignObject><p>b</p></foreignObject><desc>no</desc></svg>c") == "abc"
    m = html_extract.default_model()
    text = m.extract("<html><body><article><h1>A heading here</h1><p>We know that <math><mi>x</mi><mo>=</mo><mn>42</mn></math> holds, for all of these cases.</p><svg><text>Figure of the growth, by year.</text></svg><p>And here is the next part, longer than the one before.</p></article></body></html>")
    assert "We know that x = 42 holds, for all of these cases." in text and "Figure of the growth, by year." in text
