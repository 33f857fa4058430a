"""HTML and Markdown reading: goldens and the documented quirks."""

import pytest

from tidemark.sources.html import html_blocks
from tidemark.sources.markdown import markdown_to_html


def html_lines(markup):
    return [(t, x) for t, x in html_blocks(markup) if x]


@pytest.mark.parametrize(
    "markup, expected",
    [
        (
            "<body><style>p { color: red }</style><h1>Harbour</h1><script>let p = '<p>x</p>'</script><p>Ships</p></body>",
            [("h1", "Harbour"), ("p", "Ships")],
        ),
        # A table outside a paragraph or item disappears.
        (
            "<p>Tides</p><table><tr><th>low</th></tr><tr><td>04:10</td></tr></table><p>Winds</p>",
            [("p", "Tides"), ("p", "Winds")],
        ),
        # Text nodes are stripped and glued.
        ("<p>Sail <i>north</i> at dawn</p>", [("p", "Sailnorthat dawn")]),
        # Nested blocks count twice.
        ("<ul><li><p>x</p></li></ul>", [("li", "x"), ("p", "x")]),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", [("li", "ab"), ("li", "b")]),
        # An unclosed paragraph nests the next one and repeats its text.
        ("<div><p>a<p>b</div>c", [("p", "ab"), ("p", "b")]),
        # An end tag closes the innermost element of its name; a stray one is ignored.
        ("<p>a<b>c</p>d</b>e<p>f</i>g</p>", [("p", "ac"), ("p", "fg")]),
        ("<p>a<br>b<br/>c<br></br>d</p>", [("p", "abcd")]),
        ("<p>x &amp; y&nbsp;&#65;&#x42;&#150;&bogus; z</p>", [("p", "x & y\xa0AB–&bogus z")]),
        ("<p>a <!-- no --> b</p>", [("p", "ab")]),
        ('<script>var t="</p><p>no</p>"</script><p>yes</p>', [("p", "yes")]),
        ("<h4>no</h4><pre>no</pre><h2>H</h2><h3>I</h3>", [("h2", "H"), ("h3", "I")]),
        ("<noscript><p>no</p></noscript><template><p>no</p></template><p> </p>", []),
        ("<p>a<rt>ruby</rt>b</p>", [("p", "ab")]),
    ],
)
def test_html(markup, expected):
    assert html_lines(markup) == expected


def in_item(table):
    return html_lines(f"<li>{table}</li>")[0][1]


def test_html_tables():
    two = "<table><tr><th>Knot</th><th>Use</th></tr><tr><td>bowline</td><td>loop</td></tr><tr><td>reef</td><td>join</td></tr></table>"
    assert in_item(two) == "bowline: loop\nreef: join"
    three = "<table><tr><th>Ship</th><th>Mast</th><th>Crew</th></tr><tr><td>Gull</td><td>3</td><td>40</td></tr></table>"
    assert in_item(three) == "Ship: Gull, Mast: 3, Crew: 40"
    bare = "<table><tr><td>Port</td><td>Depth</td></tr><tr><td>Ely</td><td>7</td></tr></table>"
    assert in_item(bare) == "Ely: 7"
    # Without th a row equal to the first one is a header too.
    repeated = "<table><tr><td>K</td></tr><tr><td>K</td></tr><tr><td>x</td><td>y</td></tr></table>"
    assert in_item(repeated) == "K: x, y"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("# Log\n\nWind **west** all day", [("h1", "Log"), ("p", "Windwestall day")]),
        ("Voyage\n==\n\nDay one\n-----\ncalm sea", [("h1", "Voyage"), ("h2", "Day one"), ("p", "calm sea")]),
        ("### a ###\n#### no\n#no", [("h3", "a"), ("p", "#no")]),
        ("- a\n- b", [("li", "a"), ("li", "b")]),
        ("- a\n\n- b", [("li", "a"), ("p", "a"), ("li", "b"), ("p", "b")]),
        ("1. a\n2. b\n   - c", [("li", "a"), ("li", "bc"), ("li", "c")]),
        ("```\n# no\n```\n\n    no\n\nyes", [("p", "yes")]),
        ("> quoted\nlazy\n\nafter", [("p", "quoted\nlazy"), ("p", "after")]),
        ("a `b*c*` d", [("p", "ab*c*d")]),
        ("[t](http://x 'y') ![alt](i.png)", [("p", "t")]),
        ("[t][r] [r] [n]\n\n[r]: http://x", [("p", "tr[n]")]),
        ("a\\*b\\* c_d_e", [("p", "a*b* c_d_e")]),
        ("one  \ntwo\nthree", [("p", "onetwo\nthree")]),
        ("<div>\n<p>raw</p>\n</div>\n\n&lt;x&gt; a < b & c", [("p", "raw"), ("p", "<x> a < b & c")]),
        ("***x***", [("p", "x")]),
        ("&copy; &nope; &#35;", [("p", "© &nope; #")]),
        ("- a\n  > q\n  ```\n  x\n  ```\n- b", [("li", "aqx"), ("p", "q"), ("li", "b")]),
        ("*foo `*`* __bold__ a_b", [("p", "foo*bolda_b")]),
        ("* * *\n***\n- - -", []),
        ("Ship: Gull\nMast: 3\n\nShip: Tern", [("p", "Ship: Gull\nMast: 3"), ("p", "Ship: Tern")]),
        ("", []),
    ],
)
def test_markdown(text, expected):
    assert html_lines(markdown_to_html(text)) == expected


def test_hostile_markdown_is_read_in_bounded_time():
    import time

    start = time.monotonic()
    for text in ("*a " * 20000 + "b_ " * 20000, "[" * 5000 + "]" * 5000):
        html_lines(markdown_to_html(text))
    assert html_lines(markdown_to_html(">" * 5000 + " x")) == [("p", "x")]
    assert html_lines(markdown_to_html("- " * 2000 + "x")) == [("li", "x")] * 2000
    assert html_lines(markdown_to_html("> > x")) == [("p", "x")]
    assert time.monotonic() - start < 20


def test_every_level_of_a_nested_list_is_read():
    lines = [f"{'  ' * level}- level{level}" for level in range(14)]
    found = [text for tag, text in html_lines(markdown_to_html("\n".join(lines))) if tag == "li"]
    assert found == ["".join(f"level{k}" for k in range(level, 14)) for level in range(14)]
    deep = "\n".join("> " * level + f"quote{level}\n" + "> " * level for level in range(1, 40))
    texts = [text for _, text in html_lines(markdown_to_html(deep))]
    assert texts == [f"quote{level}" for level in range(1, 40)]


def test_deeply_nested_html():
    assert html_lines("<div>" * 5000 + "<p>x") == [("p", "x")]
    assert html_lines("<p>a" * 50)[0][1] == "a" * 50
