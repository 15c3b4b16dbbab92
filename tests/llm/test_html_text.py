import re

import random
import time

import duckdb

from verdant.llm import html_text as ht


def test_blocks_lists_and_blanks():
    assert ht.render("<p>a <b>b</b>\n c<p>d<br>e<div>f</div>g") == "a b c\n\nd\ne\n\nf\ng"
    assert ht.render("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  3. x\n  4. y\n- c"
    assert ht.render("<pre>\n a\n  b</pre>x") == " a\n  b\n\nx"
    assert ht.render("x&amp;y &lt;z&gt; &nbsp;") == "x&y <z> \xa0".rstrip()


def test_tables_are_aligned():
    assert ht.render("<table><tr><th>Name<th>N<tr><td>al<td>1<tr><td>x<td>22</table>") == "Name | N\nal   | 1\nx    | 22"
    two = ht.render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>")
    assert two == "a | b\n  | c"
    assert ht.render("<table><tr><td>a<br>bb<td>c</table>") == "a  | c\nbb |"
    assert "in | ner" in ht.render("<table><tr><td><table><tr><td>in<td>ner</table><td>z</table>")


def test_visibility():
    assert ht.render("<style>.h, #i{display:none}</style><p class='a h'>no<p id=i>no<p hidden>no<p style='display: none'>no<p>yes") == "yes"
    assert ht.render("<div style='visibility:hidden'>no <i style='visibility:visible'>yes</i></div>") == "yes"
    assert ht.render("<head><title>t</title></head><script>var a='</p>'</script><template>x</template><!-- c -->seen") == "seen"


def test_broken_markup():
    for html in ("", "<", "<p", "</td></p>x", "<td>x", "<tr><td>y", "<li>z", "<table>t<tr>u<td>v", "<![if", "<!x", "&#xFFFFFFFF;", "<a" * 50, "<b>" * 20000 + "deep"):
        assert isinstance(ht.render(html), str)
    assert ht.render("<b>" * 20000 + "deep") == "deep" and ht.render("<td>x") == "x"
    assert ht.render("<div>" * 3000 + "<table><tr><td>" * 300 + "low") == "low"


def test_head_ends_without_its_tags():
    assert ht.render("<head><title>t</title><p>text") == "text" and ht.render("<html><head><meta charset=x>\n text") == "text"
    assert ht.render("<head><title>t</title><style>p{}</style><script>a</script>\n<link href=x><div>a</div>b</head>c") == "a\nbc"
    assert ht.render("<head></p><title>no</title></body>yes") == "yes" and ht.render("<head><title>no</title></br>yes") == "yes"
    assert ht.render("<head><title>t</title></head><body>a<head>b</head>c") == "abc" and ht.render("a<head>b") == "ab"


def test_unknown_declarations_are_comments():
    for mark in ("<![foo]>", "<![>", "<![if !IE]>", "<![endif]>", "<![CDATA[x]]>", "<![temp[ x>", "<!>", "<!x y>"):
        assert ht.render(f"a{mark}b<p>c{mark}d") == "ab\n\ncd", mark
    assert ht.render("<p>a<![foo") == "a" and ht.render("x<!--[if IE]>no<![endif]-->y") == "xy"


def test_text_in_table_parts_goes_before_the_table():
    assert ht.render("<table><tr>note<td>x</table>") == "note\n\nx"
    assert ht.render("a<table>\n<thead>b <tr>\n<th>h\n</thead><tbody>c <tr><td>x</table>d") == "a\n\nb c\n\nh\nx\n\nd"
    assert ht.render("<table><caption>t</caption><tr><td>x</table>") == "t\nx"


def test_svg_and_math_text():
    assert ht.render("<div><svg/>Text</div>") == "Text" and ht.render("a <math/>b") == "a b"
    svg = "<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no</style><path d=''/><g/>no<g><text>in <tspan>side</tspan></text><text>x</text></g></svg>"
    assert ht.render(f"<p>a {svg} b") == "a in side x b"
    assert ht.render("<svg><desc/><text>a</text><title/><foreignObject><p>b<br/>c</p></foreignObject></svg>d") == "a\n\nb\nc\n\nd"
    assert ht.render("<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math>") == "x=1"
    assert ht.render("<svg><defs><p>out</p>") == "out" and ht.render("<mask>seen</mask><desc>too</desc>") == "seentoo"


def test_given_pages_keep_every_visible_word():
    """Brute force: tags cut out of the visible parts of a page leave the same words."""
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        seen = re.sub(r"(?is)<head>.*?</head>|<(script|style)\b.*?</\1>|<!--.*?-->", " ", html)
        if re.search(r"hidden|display:\s*none", seen):
            continue
        seen = re.sub(r"(?s)</?(b|i|a|em|strong|span|u|code)\b[^>]*>", "", seen)
        seen = re.sub(r"(?s)<[^>]*>", " ", seen)
        from html import unescape

        strip = lambda t: [w for w in t.split() if w not in ("-", "|") and not re.fullmatch(r"\d+\.", w)]
        assert strip(ht.render(html)) == strip(unescape(seen))


def test_frame(spark):
    pages = spark.createDataFrame([(1, None, "u", "t"), (2, "<p>x", "u", "t"), (2, "<p>x", "u", "t"), (None, "", "u", "t")], "page_id long, html string, url string, text string")
    assert sorted((r.page_id or 0, r.text) for r in ht.extract(pages).collect()) == [(0, ""), (1, ""), (2, "x"), (2, "x")]
    assert ht.extract(pages.limit(0)).count() == 0


def test_style_sheets_for_screens():
    for css in ("@media print{.x{display:none}}", ".x{display:none} .x{display:block}", "@media (max-width: 600px){.x{display:none}}", "@font-face{src:url(a)} @import 'a.css'; .y{display:none}", ".x{display:nonsense}",
                ".x{display:block!important} .x{display:none}", "div p .x{display:none}", ".x:hover{display:none}", "@keyframes k{0%{display:none}} .x::before{display:none}", "p.x{display:none}", ".x{content:'}.x{display:none'}"):
        assert ht.render(f"<style>{css}</style><div class=x>text") == "text", css
        assert ht.render(f"<style media=print>.x{{display:none}}</style><style>{css}</style><div class=x>text") == "text", css
    for css in (".x{display:none", "@media screen{.x{display:none}}", "@media print,all and (min-width:40em){@supports (a:b){div.x{display:none}}}", "body > .x, .q{visibility:hidden}", ".x{display:none;color:red} .x{color:blue}", "div[class~=x]{display:none}",
                "#a .x{display:none} .x{display:block}", ".x{display:none!important} .x{display:block}", "html .x{display:none;;}", "/* .x{} */.x{display:/**/none}<!-- -->", '[id="b"]{display:none}'):
        assert ht.render(f"<body id=a><style>{css}</style><div class=x id=b>text</div>seen") == "seen", css
    assert ht.render("<p style='display:none;display:block'>yes<p style='display:block;display:none'>no<p style='display:none!important;display:block'>no") == "yes"
    assert ht.render("<style>.x{display:block} p{display:none!important}</style><div hidden class=x>yes</div><div hidden>no</div><p style='display:block'>no") == "yes"


def test_closed_details_show_their_summary():
    assert ht.render("<details><p>no<summary>sum</summary>no</details>a<details open><summary>b</summary>c</details>") == "sum\na\nb\nc"


def test_visibility_equals_brute_force():
    """Random trees and sheets; every text's visibility is worked out by walking up from it, rule by rule."""
    rng = random.Random(3)
    for _ in range(300):
        sheet = []
        for _ in range(rng.randrange(6)):
            parts = [rng.choice(["div", "span", "*", "i"]) * rng.randrange(2) + "".join(rng.choice([".a", ".b", "#c"]) for _ in range(rng.randrange(2))) for _ in range(rng.randrange(1, 4))]
            sheet.append(([p or ".a" for p in parts], [rng.choice([" ", " > "]) for _ in parts[1:]], rng.choice(["display", "visibility"]), rng.choice(["none", "block", "hidden", "visible"]), rng.random() < 0.2))
        css = " ".join("".join(p + (c[i] if i < len(c) else "") for i, p in enumerate(parts)) + "{%s:%s%s}" % (name, value, "!important" * bang) for parts, c, name, value, bang in sheet)
        html, want, path = [f"<body><style>{css}</style>"], [], [("html", "", ""), ("body", "", "")]

        def fits(part, node):
            names = re.findall(r"[.#]?[a-z]+", part)
            return all((n[1:] == node[1]) if n[0] == "." else (n[1:] == node[2]) if n[0] == "#" else n == node[0] for n in names)

        def matches(parts, signs, at):
            if not fits(parts[-1], path[at]):
                return False
            if len(parts) == 1:
                return True
            above = [at - 1] if signs[-1] == " > " else range(at)
            return any(i >= 0 and matches(parts[:-1], signs[:-1], i) for i in above)

        def visible():
            shown = True
            for at in range(len(path)):
                won = {}
                for order, (parts, signs, name, value, bang) in enumerate(sheet):
                    if value in {"display": ("none", "block"), "visibility": ("hidden", "visible")}[name] and matches(parts, signs, at):
                        whole = "".join(parts)
                        rank = (bang, whole.count("#"), whole.count("."), sum(bool(re.match("[a-z]", p)) for p in parts), order)
                        won[name] = max(won.get(name, ((),)), (rank, value))
                if won.get("display", (0, ""))[1] == "none":
                    return False
                shown = {"hidden": False, "visible": True}.get(won.get("visibility", (0, ""))[1], shown)
            return shown

        for word in range(25):
            if len(path) < 8 and rng.random() < 0.6:
                path.append((rng.choice(["div", "span", "i"]), rng.choice(["", "a", "b"]), rng.choice(["", "", "c"])))
                html.append("<%s class='%s' id='%s'>" % path[-1])
            elif len(path) > 2:
                html.append(f"</{path.pop()[0]}>")
            html.append(f" w{word} ")
            if visible():
                want.append(f"w{word}")
        assert ht.render("".join(html)).split() == want, html


def test_deep_pages_take_time_in_proportion():
    start = time.process_time()
    for mark in ("<div>", "<b></p>", "<p><span>", "<svg></svg><i>", "<ul><li>x", "<table><tr><td>y", "<a></td>", "<details open>"):
        assert isinstance(ht.render(mark * 200_000), str)
    sheet = "<style>p .q .x{display:none} .x > .x > .y{display:none} div *{color:red}</style>"
    assert ht.render(sheet + "<div class=x>" * 200_000 + "low") == "low"
    assert time.process_time() - start < 120
    assert ht.render("<ul><li>x" * 40 + "<table><tr><td>y" * 40).count("y") == 40
