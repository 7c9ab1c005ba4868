"""Elements without text of the page end with their parent at the latest; formulas stay."""

import pytest

from loomstone.llm.extract import blocks

REST = "<article><p>First of it.</p><p>Second of it.</p></article>"


@pytest.mark.parametrize("before", [
    "<form><datalist><option value=a><option value=b></datalist></form>", "<select><option>a<option>b</select>", "<div><select><option>a</div>", "<select><option>a",
    "<select><optgroup><option>a<optgroup><option>b</select>", "<div><canvas>x</div>", "<div><object><p>x</div>", "<svg><text>x</text>", "<div><noscript>x</div>", "<template><div><p>x</p></div><li>y</template>",
])
def test_the_article_stays(before):
    assert [b[0] for b in blocks(before + REST)] == ["First of it.", "Second of it."]


def test_formulas_and_hidden_parts_inside_a_paragraph():
    page = '<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="t">x=2</annotation></math> hold<template><div>no</div></template> and <svg><title>no</title><text>no</text></svg> so on.</p>'
    assert [b[0] for b in blocks(page)] == ["Let x=2 hold and so on."]
