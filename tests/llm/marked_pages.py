"""Pages written and marked by hand: (name, html, main text)."""

A = "The river rises in the hills above the town and runs south for some forty miles before it meets the sea."
B = "In spring the water is high, and the meadows on both banks are flooded for a week or two; nobody minds, since the soil is better for it."
C = "Old maps show a second channel, which was filled in when the railway came, and of which only a row of willows is left."
D = "A short walk leads from the bridge to the mill, where bread is still made from the flour of the valley."
E = "Boats may be hired by the hour."
MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About</a></li></ul>'
NAV = '<nav><a href="/">Home</a> <a href="/a">Topics</a> <a href="/b">Contact</a></nav>'
FOOT = '<footer><p>&copy; 2024 The Valley Press. All rights reserved.</p><ul><li><a href="/t">Terms</a></li></ul></footer>'
SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Ten walks</a></li><li><a href="/2">The old mill</a></li></ul></aside>'
AD = '<div class="advertisement"><p>Buy two pairs of boots and get one free, this week only.</p></div>'
COOKIE = '<div id="cookie-notice"><p>We use cookies to make this site better.</p><button>Accept</button></div>'
COMMENTS = '<section id="comments"><h2>Comments</h2><div class="comment"><p>Lovely place, we went there last year.</p></div><div class="comment"><p>The bridge is closed at the moment.</p></div></section>'
FORM = '<form action="/search"><label>Search</label><input name="q"><button>Go</button></form>'
TOP = '<header class="site-header"><a href="/">The Valley Press</a><p>News from the valley since 1901</p></header>'


def page(*parts, head="<title>x</title>"):
    return f"<!doctype html><html><head>{head}</head><body>{''.join(parts)}</body></html>"


def ps(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def lines(*texts):
    return "\n".join(texts)


PAGES = [
    ("article", page(NAV, f"<article><h1>The river</h1>{ps(A, B, C)}</article>", FOOT), lines("The river", A, B, C)),
    ("unwrapped", page(MENU, "<h1>The river</h1>", ps(A, B, D), "<hr>", FOOT), lines("The river", A, B, D)),
    ("unwrapped with menu and cookie notice", page(COOKIE, NAV, "<h1>The river</h1>", ps(A, C), FOOT), lines("The river", A, C)),
    ("main with a list", page(TOP, NAV, f"<main><h1>The river</h1>{ps(A)}<ul><li>Bring boots.</li><li>Bring bread and cheese.</li></ul>{ps(B)}</main>", FOOT), lines("The river", A, "Bring boots.", "Bring bread and cheese.", B)),
    ("main with a table", page(NAV, f"<main><h1>Boats</h1>{ps(D)}<table><tr><td>Rowing boat</td><td>Four pounds</td></tr><tr><td>Canoe</td><td>Three pounds</td></tr></table>{ps(E, A)}</main>", FOOT), lines("Boats", D, "Rowing boat", "Four pounds", "Canoe", "Three pounds", E, A)),
    ("main with pre", page(NAV, f"<main><h1>Levels</h1>{ps(A)}<pre>level = 3.2\nflow = 11</pre>{ps(B)}</main>"), lines("Levels", A, "level = 3.2 flow = 11", B)),
    ("header inside the article", page(TOP, f"<article><header><h1>The river</h1></header>{ps(A, B)}</article>", SIDE, FOOT), lines("The river", A, B)),
    ("figure", page(NAV, f'<article><h1>The mill</h1>{ps(D)}<figure><img src="m.jpg" alt="m"><figcaption>The mill from the east bank.</figcaption></figure>{ps(C)}</article>', FOOT), lines("The mill", D, "The mill from the east bank.", C)),
    ("aside inside the article", page(NAV, f"<article><h1>The river</h1>{ps(A)}{SIDE}{ps(B, C)}</article>", FOOT), lines("The river", A, B, C)),
    ("advert inside the article", page(NAV, f"<article><h1>The river</h1>{ps(A)}{AD}{ps(B, C)}</article>", FOOT), lines("The river", A, B, C)),
    ("definition list", page(TOP, NAV, f"<main><h1>Words of the valley</h1>{ps(A)}<dl><dt>Leat</dt><dd>A channel that feeds a mill.</dd><dt>Weir</dt><dd>A low dam across the stream.</dd></dl></main>", FOOT), lines("Words of the valley", A, "Leat", "A channel that feeds a mill.", "Weir", "A low dam across the stream.")),
    ("quotation", page(NAV, f"<article><h1>A letter</h1>{ps(C)}<blockquote><p>{B}</p></blockquote>{ps(D)}</article>", COMMENTS, FOOT), lines("A letter", C, B, D)),
    ("div content", page(f'<div class="header">The Valley Press</div>{MENU}<div class="content"><h1>The river</h1>{ps(A, B, C)}</div><div class="footer">Terms and privacy</div>'), lines("The river", A, B, C)),
    ("wrapped twice", page(f'<div id="page"><div class="wrap">{TOP}{NAV}<div id="main"><h1>The river</h1>{ps(A, B)}</div>{SIDE}</div></div>', FOOT), lines("The river", A, B)),
    ("sections", page(NAV, f"<main><h1>The valley</h1><section><h2>Water</h2>{ps(A, B)}</section><section><h2>Bread</h2>{ps(D, C)}</section></main>", FOOT), lines("The valley", "Water", A, B, "Bread", D, C)),
    ("comments after", page(f"<article><h1>The river</h1>{ps(A, B)}</article>", COMMENTS, FOOT), lines("The river", A, B)),
    ("form between", page(NAV, f"<article><h1>The river</h1>{ps(A)}{FORM}{ps(B, C)}</article>", FOOT), lines("The river", A, B, C)),
    ("references", page(NAV, f"<article><h1>The river</h1><p>The river &amp; its <b>two</b> banks: {A}</p><p>{B}&nbsp;&mdash; so it is said.</p></article>", FOOT), lines("The river", f"The river & its two banks: {A}", f"{B} — so it is said.")),
    ("white space", page(NAV, f"<article>\n <h1>The\n   river</h1>\n <p>  {A}\n</p>\n\n<p>{B}</p></article>", FOOT), lines("The river", A, B)),
    ("script and style inside", page(NAV, f"<article><h1>The river</h1>{ps(A)}<script>var x = '<p>no</p>';</script><style>p {{ }}</style>{ps(B)}</article>", FOOT), lines("The river", A, B)),
    ("unwrapped with lists and quotation", page(TOP, NAV, "<h1>The valley</h1>", ps(A), "<ol><li>Walk to the bridge.</li><li>Turn left at the mill.</li></ol>", f"<blockquote>{C}</blockquote>", ps(B), COMMENTS, FOOT), lines("The valley", A, "Walk to the bridge.", "Turn left at the mill.", C, B)),
    ("table layout", page(f'<table><tr><td class="nav">{MENU}</td><td><h1>The river</h1>{ps(A, B, C)}</td></tr></table>', '<div class="footer">All rights reserved.</div>'), lines("The river", A, B, C)),
    ("role main", page(NAV, f'<div role="main"><h1>The river</h1>{ps(A, D)}</div>', SIDE, FOOT), lines("The river", A, D)),
    ("post with headings", page(TOP, f'<div class="post"><h2>The river</h2>{ps(A)}<h3>The mill</h3>{ps(D, B)}</div>', '<div class="widget"><h3>Archive</h3><ul><li><a href="/3">March</a></li></ul></div>', FOOT), lines("The river", A, "The mill", D, B)),
    ("newsletter at the end", page(NAV, f'<article><h1>The river</h1>{ps(A, B)}<div class="newsletter"><p>Get our letter every week.</p><form><input><button>Subscribe</button></form></div></article>', FOOT), lines("The river", A, B)),
    ("no article", page(NAV, FORM, FOOT), ""),
    ("empty", page(), ""),
    ("links in the text", page(NAV, f'<article><h1>The river</h1><p>See <a href="/m">the mill</a> and <a href="/b">the bridge</a>. {A}</p>{ps(C)}</article>', FOOT), lines("The river", f"See the mill and the bridge. {A}", C)),
    ("unwrapped in a wrapper", page(f'<div class="container">{NAV}<h1>The river</h1>{ps(A, B)}{AD}{ps(C, D)}</div>', FOOT), lines("The river", A, B, C, D)),
    ("story with pictures", page(TOP, f'<div class="story"><h1>The mill</h1><figure><img src="a.png"><figcaption>Flour, 1910.</figcaption></figure>{ps(D, B)}<figure><img src="b.png"></figure>{ps(C)}</div>', SIDE, COOKIE, FOOT), lines("The mill", "Flour, 1910.", D, B, C)),
]
