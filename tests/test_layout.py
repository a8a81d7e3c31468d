"""Layout of HTML: random trees of lists and tables, written with and without the ends that may be left out, against what the trees say."""

from __future__ import annotations

import random
import time

import pytest

from loomtext.sources.layout import layout, layout_elements
from loomtext.sources.readers import element_sections

CASES = {
    "<h1>A</h1>x<p>y<p>z <b>w": [("h1", "A"), ("p", "x"), ("p", "y"), ("p", "z w")],
    "<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>f": [("li", "- a"), ("li", "  - b"), ("li", "  - c"), ("li", "  d"), ("li", "- e"), ("p", "f")],
    "<ol><li>a<li>b<p>c</ol>": [("li", "1. a"), ("li", "2. b"), ("li", "  c")],
    "<table><tr><th rowspan=2>n<th colspan=2>m<tr><th>b<th>s<tr><td>x|y<td><td>2</table>": [("table", "| n | m | m |\n| --- | --- | --- |\n| n | b | s |\n| x\\|y |  | 2 |")],
    "<table><tr><td>a<table><tr><td>b<td>c</table>d<td>e</table>": [("table", "| a b c d | e |\n| --- | --- |")],
    "<table><caption>C</caption><thead><tr><th>h</thead><tbody><tr><td rowspan=0>v<tr><td>w</table>t": [("caption", "C"), ("table", "| h |  |\n| --- | --- |\n| v |  |\n| v | w |"), ("p", "t")],
    "<p>so <math alttext='x^2'><mi>x</mi></math> is<script type='math/tex'>y_1</script>": [("p", "so"), ("formula", "x^2"), ("p", "is"), ("formula", "y_1")],
    "<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>\\alpha</annotation></semantics></math>": [("formula", "\\alpha")],
    "<style>a</style><script>b</script>": [],
    "<table></table><table><tr></table>": [],
    "<td>a</tr></li></table>": [("p", "a")],
    "": [],
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert layout(html) == CASES[html]


PIECES = "<![foo[ <![ <! <!-- --> <?x ]]> <![CDATA[ <![if]> <!DOCTYPE <p <p> </p> </ < <a&href=' &quot; ' > &# &#x &#99999999999; &amp <script> </script> <table> <tr> <td&rowspan=x> <td&colspan=99999> </table> <li> <ul> </ul> <ol> text <math> </math> <title> <style> <svg> <body> <head> <!E&x> <td&rowspan=0>".replace("&quot;", '"').split(" ")


@pytest.mark.parametrize("seed", range(20))
def test_any_text_is_read(seed):
    rng = random.Random(seed)
    for _ in range(200):
        layout("".join(rng.choices([p.replace("&", " ", 1) if p.startswith("<") else p for p in PIECES], k=rng.randint(1, 14))))


@pytest.mark.parametrize("text", ["<div>" * 50_000 + "x", "<p>" * 50_000, "<table>" * 20_000, "<ul><li>" * 20_000 + "y", "</div>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 50_000, "<" * 50_000, "<a " * 50_000, "&" * 50_000, "<table>" + "<tr><td colspan=1000 rowspan=65000>x" * 100 + "</table>"])
def test_long_texts_of_one_kind(text):
    began = time.time()
    layout(text)
    assert time.time() - began < 20


def test_what_is_never_closed(spark):
    assert layout("<p>a<!-- b <p>c") == [("p", "a")] and layout("<p>a<![x[ b>c<!d>e<?f>g") == [("p", "ac eg".replace(" ", ""))]
    assert layout("<p>a</p><p") == [("p", "a")] and layout("<p>1 < 2") == [("p", "1 < 2")] and layout("<!-->a<!--->b") == [("p", "ab")]
    assert layout("<div>" * 2000 + "<p>deep</p>" + "</div>" * 2000 + "<h1>h") == [("p", "deep"), ("h1", "h")]


def tree(rng: random.Random, depth: int = 0):
    kind = rng.choice(["text", "p", "list", "table"] if depth < 3 else ["text", "p"])
    word = "".join(rng.choices("abcde", k=3))
    if kind == "list":
        return (kind, rng.random() < 0.5, [[tree(rng, depth + 1) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 3))])
    if kind == "table":
        return (kind, [[(word + str(i), rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 2])) for i in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))])
    return (kind, word)


def written(node, rng: random.Random) -> str:
    end = lambda t: f"</{t}>" if rng.random() < 0.5 else ""
    if node[0] == "text":
        return f"<div>{node[1]}</div>"
    if node[0] == "p":
        return f"<p>{node[1]}" + end("p")
    if node[0] == "list":
        name = "ol" if node[1] else "ul"
        return f"<{name}>" + "".join("<li>" + "".join(written(n, rng) for n in item) + end("li") for item in node[2]) + f"</{name}>"
    rows = ("<tr>" + "".join(f"<td rowspan={r} colspan='{c}'>{t}" + end("td") for t, r, c in row) + end("tr") for row in node[1])
    return "<table>" + "".join(rows) + "</table>"


def told(node, lists: list, out: list) -> None:
    if node[0] in ("text", "p"):
        if lists:
            last = lists[-1]
            mark = "  " if last["told"] else f"{last['n']}. " if last["ordered"] else "- "
            out.append(("li", "  " * (len(lists) - 1) + mark + node[1]))
            last["told"] = True
        else:
            out.append(("p", node[1]))
    elif node[0] == "list":
        here = {"ordered": node[1], "n": 0, "told": False}
        for item in node[2]:
            here["n"] += 1
            here["told"] = False
            for n in item:
                told(n, [*lists, here], out)
    else:
        taken: dict[tuple[int, int], str] = {}
        for y, row in enumerate(node[1]):
            x = 0
            for text, rows, columns in row:
                while (y, x) in taken:
                    x += 1
                for dy in range(rows):
                    for dx in range(columns):
                        if y + dy < len(node[1]):
                            taken[y + dy, x + dx] = text
                x += columns
        width = max(x for _, x in taken) + 1
        lines = ["| " + " | ".join(taken.get((y, x), "") for x in range(width)) + " |" for y in range(len(node[1])) if any((y, x) in taken for x in range(width))]
        out.append(("table", "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])))


@pytest.mark.parametrize("seed", range(200))
def test_random_trees(seed):
    rng = random.Random(seed)
    nodes = [tree(rng) for _ in range(rng.randint(1, 4))]
    want: list = []
    for n in nodes:
        told(n, [], want)
    assert layout("".join(written(n, rng) for n in nodes)) == want


def test_of_rows(spark):
    pages = spark.createDataFrame([(1, "<h2>A</h2><table><tr><td>x</table><p>y"), (None, "<p>z"), (2, None), (3, "")], "page_id long, html string")
    rows = layout_elements(pages)
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [(1, 0, "h2", "A"), (1, 1, "table", "| x |\n| --- |"), (1, 2, "p", "y"), (None, 0, "p", "z")]))
    first = element_sections(rows.filter("doc_id = 1")).first()
    assert (first["heading"], first["text"], first["tables"]) == ("A", "| x |\n| --- |\n\ny", ["| x |\n| --- |"])
