"""Golden strings for HTML bodies, one rule a case."""

import pytest

from postmill.functions.html import convert, escape_brackets

CASES = {
    # emphasis
    "<b><span>Note for read</span></b><b>ers</b>": "**Note for readers**",
    "<b><a href='https://example.com/x'>Sign up</a></b><b>!</b>": "**[Sign up](https://example.com/x)!**",
    "<span><em><strong>Now</strong></em></span><span><em>, or later</em></span>": "***Now**, or later*",
    "<b>One</b> <b>Two</b>": "**One** **Two**",
    "<b>One </b><b>Two</b>": "**One** **Two**",
    "<b>Thick</b><i>thin</i>": "**Thick***thin*",
    "<b>first<br>second</b><b> more</b>": "**first**\n**second** **more**",
    "<b>first<br>second</b><b>, more</b>": "**first**\n**second, more**",
    "<b>all <strong>of</strong> it</b>": "**all of it**",
    "<table><tr><td><ul><li>Item</li></ul></td><td><b>a</b><b>b</b></td></tr></table>": "- Item\n\n**ab**",
    "<div style='font-weight:bold'>Name</div><div>line</div>": "**Name**\nline",
    "<div>Sum <span style='font-weight:bold'> 3.50</span></div>": "Sum **3.50**",
    "<a href='https://example.com' style='font-weight:700'>Home</a>": "**[Home](https://example.com)**",
    "<span style='font-weight:600!important'>x</span>": "**x**",
    "<b style='font-weight:400'>thin</b><span style='font-weight:599'>too</span>": "thintoo",
    "<b>in <span style='font-weight:normal'>out</span> in</b>": "**in** out **in**",
    "<b>in <span style='font-weight:normal'>out <b>back</b></span></b>": "**in** out **back**",
    "<b><i>both <span style='font-weight:normal'>slant</span></i></b>": "***both** slant*",
    "<table><tr><td>A</td><td style='font-weight:bold'>1 <span style='font-weight:normal'>(x)</span></td></tr><tr><td>B</td><td>2</td></tr></table>": "|  |  |\n|---|---|\n| A | **1** (x) |\n| B | 2 |",
    "<table><tr style='font-weight:bold'><th>H</th><td>V <span style='font-weight:normal'>n</span></td></tr></table>": "**H** **V** n",
    "<b>a<span style='font-weight:normal'> </span>b</b>": "**a b**",
    "<b>a <span style='font-weight:normal;display:none'>no</span> b</b>": "**a b**",
    "<span style='font-style:oblique 10deg'>s</span> <i style='font-style:normal'>t</i>": "*s* t",
    "<span style='font-weight:bold;font-style:italic'>both</span>": "***both***",
    "<b>Um</b><span style='font-weight:bold'>welt</span>": "**Umwelt**",
    "<b><ul><li>Item</li></ul></b>": "- Item",
    "<h2 style='font-weight:bold'>All <b>of</b> it</h2>": "## All **of** it",
    # blocks
    "<div>a</div><div><br></div><div>b</div>": "a\n\nb",
    "<div>a,<div>b</div></div>": "a,\nb",
    "<div>a<br></div><div>b</div>": "a\nb",
    "<p>a<br><br><br>b</p>": "a\n\nb",
    "<blockquote>a<br><br><br>b</blockquote>": "> a\n>\n> b",
    "<p style='margin:0'>a</p><p style='margin: 0px'>b</p>": "a\nb",
    "<p class=MsoNormal>a<o:p></o:p></p><p class='MsoNormal'>b</p>": "a\nb",
    "<p class=MsoNormal style='margin:0cm 0cm 12.0pt'>a</p><p class=MsoNormal>b</p>": "a\n\nb",
    "<p class=MsoNormal>a</p><p class=MsoNormal><o:p>&nbsp;</o:p></p><p class=MsoNormal>b</p><div> </div><div>c</div>": "a\n\nb\nc",
    "<div>a</div><p style='margin:0;padding-top:0.5em'>b</p><div>c</div>": "a\n\nb\nc",
    "<div>a</div><ul><li>b</li></ul><div>c</div><hr><div>d</div>": "a\n\n- b\n\nc\n\n---\n\nd",
    "<div>a</div><div style='height:20px'>&#8202;</div><div>b</div>": "a\n\nb",
    "<div>a</div><table role=presentation><tr><td height=20></td></tr></table><div>b</div>": "a\n\nb",
    "<div>a</div><div style='height:2px'></div><span style='height:20px'></span><div>b</div>": "a\nb",
    "<div>a</div><div style='height:40px'>m</div><div>b</div>": "a\nm\nb",
    "<div>a</div><ul style='margin:0;list-style:none'><li>b</li><li>c</li></ul><div>d</div>": "a\nb\nc\nd",
    "<div>a</div><ol style='list-style-type:none'><li>b</li><li>c</li></ol><div>d</div>": "a\n\nb\nc\n\nd",
    "<ul style='list-style: square none'><li>b</li>loose<li>c</li></ul>": "- b\nloose\n- c",
    "<ol><li>a<li>b</ol>": "1. a\n2. b",
    "<div><a href='/a' style='display:block!important;padding:12px 0'>A</a><a href='/b' style='display:block'>B</a></div>": "[A](/a)\n\n[B](/b)",
    "<p><a href='/a'><span style='padding:0 8px'>A</span></a><a href='/b'>B</a></p>": "[A](/a) [B](/b)",
    "<p><a href='https://www.example.ch/'>www.example.c</a><a href='https://e.org'>om</a></p>": "[www.example.c](https://www.example.ch/)[om](https://e.org)",
    "<div>~~~~ <b>x</b><br>y</div>": "\\~~~~ **x**\ny",
    "<ul><li>~~~ a</li></ul>": "- \\~~~ a",
    "<p><code>```x</code></p>": "`` ```x ``",
    # hidden
    "<div style='DISPLAY : none!important'>p</div><div hidden>q</div><span style='visibility:hidden'>r</span><i data-skip-in-text>s</i><p>t</p>": "t",
    "<!--[if mso]><b>x</b><![endif]--><a href='/a' style='mso-hide:all'>A</a>": "[A](/a)",
    "<i data-skip-in-text=false>s</i>": "*s*",
    # code
    "<pre><code>def f():\n    pass\n\n\nf()</code></pre>": "```\ndef f():\n    pass\n\n\nf()\n```",
    "<pre>```x\ny\n```</pre>": "````\n```x\ny\n```\n````",
    "<pre><div>Dear all,</div><div><br></div><div>bye</div></pre>": "Dear all,\n\nbye",
    # links
    "<a href='https://example.com/'>https://EXAMPLE.com</a> <a href='mailto:a@b.c'><b>a@b.c</b></a>": "https://EXAMPLE.com **a@b.c**",
    "<a href='/x y'>[t]</a>": "[\\[t\\]](</x y>)",
    "<a href='/a(b'>t</a> <a href='/a(b)'>u</a> <a href='<v'>w</a>": "[t](</a(b>) [u](/a(b)) [w](<\\<v>)",
    "<a href='/o'>o <a href='/i'>i</a></a>": "[o](/o) [i](/i)",
    "<a href=' /a\n b '>t</a><a href=''>n</a><a>m</a>": "[t](</a b>)nm",
    "<a href='/a'>x<br>y</a>": "[x y](/a)",
    # tables
    "<table><thead><tr><th>A</th><th>B</th></tr></thead><tr><td>c</td><td>5</td></tr></table>": "| A | B |\n|---|---|\n| c | 5 |",
    "<table><tr><th colspan=2>Top</th></tr><tr><td>a</td><td>1</td></tr><tr><th colspan=2>Mid</th></tr><tr><td>b</td><td>2</td></tr></table>": "**Top**\n\n|  |  |\n|---|---|\n| a | 1 |\n\n**Mid**\n\n|  |  |\n|---|---|\n| b | 2 |",
    "<table><tr><td>a|b</td><td>x<br>y</td></tr><tr><td>c</td><td>d</td></tr></table>": "|  |  |\n|---|---|\n| a\\|b | x<br>y |\n| c | d |",
    "<table><tr><td>a</td><td>&nbsp;</td><td>1</td></tr><tr><td>b</td><td></td><td>2</td></tr></table>": "|  |  |\n|---|---|\n| a | 1 |\n| b | 2 |",
    "<table><caption>Cap</caption><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>": "Cap\n\n|  |  |\n|---|---|\n| a | 1 |\n| b | 2 |",
    "<table><tr><td><a href='/a'>A</a><br><a href='/b'>B</a></td><td><strong>Dear,</strong><br>hi</td></tr></table>": "[A](/a)\n[B](/b)\n**Dear,**\nhi",
    "<table role=presentation><tr><td>a<br>b</td><td>c</td></tr></table>": "a\nb\nc",
    "<table role=presentation><tr><td>&bull;</td><td>one</td></tr><tr><td colspan=2>&nbsp;</td></tr><tr><td>&bull;</td><td>two</td></tr></table>": "• one\n\n• two",
    "<table><tr><td>2</td><td><table><tr><td>go<br>on</td></tr></table></td></tr></table>": "2 go\non",
    "<table role=presentation><tr><td><h3>T</h3></td><td>m</td></tr></table>": "### T\n\nm",
    "<div>a</div><table role=presentation><tr><td style='padding:12px 0'>&bull;</td><td>b</td></tr></table><div>c</div>": "a\n\n• b\n\nc",
    "<table><tr><th><b>a</b> b <b>c</b></th></tr></table>": "**a b c**",
    "<table><tr><td>n</td><td>v</td></tr><tr><th>h</th><td>4</td></tr></table>": "|  |  |\n|---|---|\n| n | v |\n| **h** | 4 |",
    "<table><tr><th style='font-weight: normal'>a</th></tr></table>": "a",
    "<table><tr><th><div>a</div><div>b</div></th></tr></table>": "a\nb",
    "<table><tr><td>K</td><td><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table></td></tr></table>": "K\n\n|  |  |\n|---|---|\n| a | 1 |\n| b | 2 |",
    # trees that need repair
    "<p><b>a<p>b</b> c": "**a**\n\n**b** c",
    "<b>a<div>b</b>c</div>": "**a**\n**b**c",
    "<p>a<table><tr><td>b</table>c": "a\n\nb\nc",
    "a</p>b": "a\n\nb",
    "<table><tr><td>a<td>b<tr><td>c<td>d</table>": "|  |  |\n|---|---|\n| a | b |\n| c | d |",
    "<title>t</title><script>var a='</p>'</script><style>p{}</style><noscript>n</noscript>x": "x",
    "&amp;lt; &#55357;&#56832; &#xD83D;&#xDE00; &#55357;": "&lt; \U0001f600 \U0001f600 �",
    "&#55357;&#55357;&#56832; a&#55357; b&#56832;&#65;": "\ufffd\U0001f600 a\ufffd b\ufffdA",
    "<a href='/r'><table><tr><td><a href='/r'>x/r</a> <a href='/s'>s</a></td></tr></table></a>": "[x/r](/r) [s](/s)",
    "<a href='/k'><table><tr><td><a name=k></a>To k<a href='/h' style='display:none'>h</a></td></tr></table></a>": "[To k](/k)",
    "<div>\u200ba\u200b</div><div>\u200bb</div>": "\u200ba\u200b\n\u200bb",
    "<div dir=ltr>Hi,<div><br></div><div>thanks.</div><div><br></div><div>J</div></div><br><div class=q><div>On Mo wrote A &lt;<a href='mailto:a@x'>a@x</a>&gt;:<br></div><blockquote class=q style='margin:0 0 0 0.8ex'><div>Hello,<div><br></div><div>cv.</div></div></blockquote></div>": "Hi,\n\nthanks.\n\nJ\n\nOn Mo wrote A <a@x>:\n\n> Hello,\n>\n> cv.",
    "Dear,<div><br></div><div>form.</div><div><br><blockquote type=cite><div>At 9 wrote J:</div><br class=x><div><div>Dear,</div><div>send.</div></div></blockquote></div>": "Dear,\n\nform.\n\n> At 9 wrote J:\n>\n> Dear,\n> send.",
    "<p class=MsoNormal style='margin-bottom:12.0pt'>Best<br>J<o:p></o:p></p><p class=MsoNormal>HR</p>\n<p class=MsoNormal><o:p>&nbsp;</o:p></p><div style='border:none;border-top:solid #E1E1E1 1.0pt;padding:3.0pt 0cm 0cm 0cm'><p class=MsoNormal><b>From:</b> A<br><b>To:</b> J</p></div>": "Best\nJ\n\nHR\n\n**From:** A\n**To:** J",
    "<body style='background-color:#f4f4f5'><table role=presentation><tbody><tr><td style='padding-top:24px'><table role=presentation><tr><td><img src=l.png></td></tr></table><h1>T</h1><p style='margin:0;padding-top:0.5em;padding-bottom:0.5em'>Hi <!-- -->all<!-- -->,</p><ul style='margin:0'><li><p style='margin:0'><strong>A</strong> b.</p></li></ul></td></tr></tbody></table></body>": "# T\n\nHi all,\n\n- **A** b.",
    "": "",
    "<div></div><p> </p>": "",
}


@pytest.mark.parametrize("html", CASES)
def test_conversion(html):
    assert convert(html)[0] == CASES[html]


NAMES = {"a@x": "a.png", "b@x": "b.png"}


@pytest.mark.parametrize(
    "html,expected",
    [
        ("<p>see</p><p><img src='cid:a@x'></p>", "see\n\n![[a.png]]"),
        ("<img alt='Two\nlines' src='cid:a%40x'>", "![[a.png|Two lines]]"),
        ("<img alt='A dog\n\nDescription automatically generated' src=cid:a@x><img alt='120x40' src=cid:a@x><img alt='x | y' src=cid:a@x><img alt='q.PNG' src=cid:a@x>", "![[a.png]]" * 4),
        ("<a href='/l'><img alt='L' src='cid:a@x'></a>", "![[a.png|L]]"),
        ("<a href='/l'>J<img style='display:none' src='cid:a@x'></a>", "[J](/l)"),
        ("<a href='/l'><img alt='\U0001f609' src='cid:a@x'></a>", "[\U0001f609](/l)"),
        ("<b><img src=cid:a@x></b><p><b>J<br><img src=cid:b@x></b></p>", "![[a.png]]\n\n**J**\n![[b.png]]"),
        ("<table><tr><td>J</td><td>G</td></tr><tr><td><img src='cid:a@x'></td><td><img src='cid:b@x'></td></tr></table>", "J G\n![[a.png]] ![[b.png]]"),
        ("<table><tr><td>L</td><td><img alt=F src=cid:a@x></td></tr><tr><td>N</td><td>M</td></tr></table>", "|  |  |\n|---|---|\n| L | ![[a.png\\|F]] |\n| N | M |"),
        ("<img src='cid:other@x'><img src='https://example.com/a.png'>x", "x"),
    ],
)
def test_embedded_pictures(html, expected):
    assert convert(html, NAMES)[0] == expected


@pytest.mark.parametrize(
    "attributes,size",
    [
        ("width=47 height='46'", (47, 46)),
        ("width=600 style='width:4.9375in;height:10pt'", (474, 13)),
        ("width='100%' height=40 style='height:auto'", (None, None)),
        ("", (None, None)),
    ],
)
def test_sizes(attributes, size):
    assert convert(f"<div style='display:none'><img src=cid:z></div><img {attributes} src=' CID:l@x '>")[1] == [("l@x", *size)]


CARD = "<div>a</div><table role=presentation><tr><td style='border:2px solid #ccc;padding:12px'><div style='font-weight:bold'>T</div><div>b</div></td></tr></table><div>c</div>"


def test_cards():
    assert convert(CARD)[0] == "a\n\n---\n\n**T**\nb\n\n---\n\nc"
    assert convert(CARD, style="obsidian")[0] == "a\n\n> [!quote] T\n> b\n\nc"


@pytest.mark.parametrize("look", ["style='background-color:#4976BA26'", "style='background: url(white.png) #eee'", "bgcolor=4976ba", "style='background:rgb(1, 2, 3)'", "style='background:yellow'"])
def test_cards_on_a_background(look):
    html = f"<div>a</div><div {look}><b>T</b><div>b</div></div><div>c</div>"
    assert convert(html, style="obsidian")[0] == "a\n\n> [!quote] T\n> b\n\nc"


@pytest.mark.parametrize(
    "box,expected",
    [
        ("<div style='background:#eee'><div>x</div><div>y</div></div>", "x\ny"),
        ("<div style='border:1px solid #ccc'><b>T</b></div>", "**T**"),
        ("<div style='background:white'><b>T</b><div>y</div></div>", "**T**\ny"),
        ("<div style='background:rgba(0,0,0,0)'><b>T</b><div>y</div></div>", "**T**\ny"),
        ("<div style='border:1px solid red;border-bottom:none'><b>T</b><div>y</div></div>", "**T**\ny"),
        ("<div style='border:0 solid red'><b>T</b><div>y</div></div>", "**T**\ny"),
        ("<div style='border:1px solid red'><div><b>a</b> u <b>b</b></div><div>y</div></div>", "**a** u **b**\ny"),
        ("<div>E <span style='background:#eee'><b>T</b><br>y</span></div>", "E **T**\ny"),
        ("<div style='border:1px solid #ccc'><div>K</div><div style='background:#eee'><b>I</b><div>y</div></div></div>", "K\n**I**\ny"),
        ("<table><tr><td style='background:#757575'><div style='color:#FFF'>Go</div></td></tr></table>", "**Go**"),
        ("<table><tr><td bgcolor='#0f4527'><font color='#ffffff'>Go</font></td></tr></table>", "**Go**"),
        ("<table><tr><td style='background:#0f4527;color:#fff'>P <b>1</b></td></tr></table>", "**P 1**"),
        ("<table><tr><td style='background:#E5E5E5'><div style='color:#333'>Go</div></td></tr></table>", "Go"),
        ("<table><tr><td style='background:#0f4527'><a href='/a' style='color:#fff'>Go</a></td></tr></table>", "[Go](/a)"),
    ],
)
def test_what_is_no_card(box, expected):
    assert convert(f"<div>a</div>{box}<div>c</div>", style="obsidian")[0] == f"a\n{expected}\nc"


def test_pages_footers_and_headings():
    inner = "<div>a</div><div style='border:1px solid red'><h3>T</h3><div>b</div></div><div>c</div>"
    expected = "a\n\n> [!quote] T\n>\n> b\n\nc"
    assert convert(f"<div style='background:#f4f4f4'><div style='background:#fff'>{inner}</div></div>", style="obsidian")[0] == expected
    assert convert("<div>x</div><div style='background:#4976ba;color:#fff'><b>T</b><div>y</div></div>", style="obsidian")[0] == "x\n**T**\ny"
    table = "<table><tr><td><b>n</b></td><td>1</td></tr><tr><td>m</td><td>2</td></tr></table>"
    html = f"<div style='border:1px solid red'><div><b>T</b></div>{table}</div><div>c</div>"
    assert convert(html, style="obsidian")[0] == "> [!quote] T\n>\n> | **n** | 1 |\n> |---|---|\n> | m | 2 |\n\nc"


def test_two_cards_share_a_rule():
    one = "<div style='border:1px solid red'><b>T</b><div>b</div></div>"
    assert convert(f"<div>a</div>{one}<div style='height:20px'></div>{one}<div>c</div>")[0] == "a\n\n---\n\n**T**\nb\n\n---\n\n**T**\nb\n\n---\n\nc"


@pytest.mark.parametrize(
    "widths,contents,expected",
    [
        (("35", "65"), ("<div><b>A</b></div><div>b</div>", "<div><b>C</b></div><div>d|e</div>"), "\n| A | C |\n|---|---|\n| b | d\\|e |\n"),
        (("33-3", "65"), ("<div>a</div><div>b</div>", "<div>c</div><div>d</div>"), "\n|  |  |\n|---|---|\n| a | c |\n| b | d |\n"),
        (("49", "49"), ("<div>a</div><div>b</div>", "<div>c</div>"), "a\nb\nc"),
        (("60", "60"), ("<div>a</div><div>b</div>", "<div>c</div><div>d</div>"), "a\nb\nc\nd"),
    ],
)
def test_columns(widths, contents, expected):
    columns = "<!-- x -->".join(f"<div class='x mj-column-per-{w}'>{c}</div>" for w, c in zip(widths, contents, strict=True))
    assert convert(f"<div>y</div><div>{columns}</div><div>z</div>")[0] == f"y\n{expected}\nz"


def test_brackets():
    assert escape_brackets("[a] `[b]` ``[`c``[") == "\\[a\\] `[b]` ``[`c``\\["


def test_elements_of_any_depth():
    for levels in (505, 520, 5000):
        html = "<div>" * levels + "<b>bold</b><ul><li>i</ul><code>c</code>" + "</div>" * levels
        assert convert(html)[0] == "**bold**\n\n- i\n\n`c`"


def test_formatting_alike_is_reopened_three_times_at_most():
    assert convert("<p>" + "<i>" * 500 + "x<p>y<p>z")[0] == "*x*\n\n*y*\n\n*z*"
