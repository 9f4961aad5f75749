"""Hand-marked pages of varied markup: (html, main text)."""

MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>Sports</a></li><li><a href='/c'>Weather</a></li></ul>"
LONG = ("The council met on Tuesday and agreed to rebuild the old bridge over the river, "
        "which had been closed since the flood of last spring.")
MORE = "Work begins in May and should end within two years, the mayor said, if the money holds."

PAGES = [
    # an article element inside a marked or half-marked layout
    (f"<body><div class='content-with-sidebar'><article><h1>Bridge</h1><p>{LONG}</p></article></div></body>",
     f"Bridge\n{LONG}"),
    (f"<body><div class='layout has-sidebar'><main><h2>Bridge</h2><p>{LONG}</p></main><div class='sidebar'><p>Popular now</p>"
     "</div></div></body>", f"Bridge\n{LONG}"),
    (f"<body><div class='article-header'><h1>Bridge</h1></div><article><p>{LONG}</p></article></body>", f"Bridge\n{LONG}"),
    (f"<body><article><p>{LONG}</p><p class='notice-period'>Three months' notice is due.</p></article></body>",
     f"{LONG}\nThree months' notice is due."),
    (f"<body><form id='aspnetForm'><div id='nav'>{MENU}</div><div class='story'><h1>Bridge</h1><p>{LONG}</p></div></form></body>",
     f"Bridge\n{LONG}"),
    (f"<body class='menu-open ad-free'><nav>{MENU}</nav><article><p>{LONG}</p></article></body>", LONG),
    (f"<div class='sidebar-layout'><div id='main-content'><p>{LONG}</p><p>{MORE}</p></div><div id='sidebar-right'><p>Ten "
     "tips</p></div></div>", f"{LONG}\n{MORE}"),
    # adverts, forms and asides between paragraphs
    (f"<article><h1>Bridge</h1><p>{LONG}</p><div class='ad-slot'>Buy a boat</div><p>{MORE}</p></article>",
     f"Bridge\n{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p><aside>Our boat test</aside><p>{MORE}</p><form><label>Mail</label><button>Join</button></form>"
     "</article>", f"{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p><div class='newsletter-signup'>Get our letter</div><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
    (f"<article><p>{LONG}</p><ul class='share-buttons'><li>Tweet</li><li>Post</li></ul></article>", LONG),
    (f"<article><p>{LONG}</p><div class='relatedLinks'><a href='x'>A tunnel</a></div></article>", LONG),
    # comments of readers
    (f"<article><p>{LONG}</p><section id='comments'><article class='comment'><p>Nonsense! I have waited for this bridge "
     f"for years and years and years.</p></article></section></article>", LONG),
    (f"<div class='post'><p>{LONG}</p></div><div class='comments-area'><div class='comment'><p>I agree.</p></div></div>", LONG),
    (f"<main><p>{LONG}</p></main><div id='disqus_thread'><p>Loading the discussion, wait a moment please</p></div>", LONG),
    # headers and footers
    (f"<header><h1>The Daily</h1></header><article><header><h1>Bridge</h1></header><p>{LONG}</p><footer>By Ann</footer>"
     "</article><footer>All rights reserved</footer>", f"Bridge\n{LONG}"),
    (f"<div id='header'><h1>The Daily</h1></div><div id='content'><h2>Bridge</h2><p>{LONG}</p></div>"
     "<div id='footer'>Imprint</div>", f"Bridge\n{LONG}"),
    (f"<header class='entry-header'><h1>Bridge</h1></header><div class='entry-content'><p>{LONG}</p></div>", f"Bridge\n{LONG}"),
    (f"<div class='site-header'><div class='logo'>Daily</div></div><div class='post-body text'><p>{LONG}</p></div>", LONG),
    (f"<div class='masthead'>Daily</div><table><tr><td id='menu'>{MENU}</td><td class='main'><p>{LONG}</p><p>{MORE}</p></td>"
     "</tr></table>", f"{LONG}\n{MORE}"),
    # notices
    (f"<div class='cookie-banner'><p>We use cookies to make this site work and to measure how it is used by all of you. "
     f"You may refuse them.</p></div><article><p>{MORE}</p></article>", MORE),
    (f"<div role='alert'>Our app is out</div><div role='main'><p>{LONG}</p></div>", LONG),
    (f"<dialog open>Sign in</dialog><article><p>{LONG}</p></article>", LONG),
    # lists, quotes, tables, code, definitions inside the text
    (f"<article><p>{LONG}</p><ul><li>steel</li><li>stone</li></ul><blockquote><p>At last!</p></blockquote></article>",
     f"{LONG}\nsteel\nstone\nAt last!"),
    (f"<article><p>{LONG}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>1</td><td>5</td></tr></table></article>",
     f"{LONG}\nYear\nCost\n1\n5"),
    (f"<article><p>{LONG}</p><pre>a = 1\n  b = 2</pre><dl><dt>Span</dt><dd>90 m</dd></dl></article>",
     f"{LONG}\na = 1 b = 2\nSpan\n90 m"),
    (f"<article><figure><img src='b.jpg' alt='no'><figcaption>The old bridge</figcaption></figure><p>{LONG}</p></article>",
     f"The old bridge\n{LONG}"),
    # markup that is broken or unusual
    (f"<article><p>{LONG}<p>{MORE}<ul><li>steel<li>stone</ul>", f"{LONG}\n{MORE}\nsteel\nstone"),
    (f"<ARTICLE><P>{LONG}</P><SCRIPT>if (a < b) document.write('<p>no</p>')</SCRIPT><P>{MORE}</P></ARTICLE>", f"{LONG}\n{MORE}"),
    (f"<article><p>AT&amp;T &lt;b&gt; &eacute;t&#233; &#x201c;so&#x201d;&nbsp;x<br>next   line</p><p>{LONG}</p></article>",
     f"AT&T <b> été “so” x next line\n{LONG}"),
    (f"<article><!-- <p>no</p> --><p>{LONG}</p><style>p {{ color: red }}</style></article>", LONG),
    (f"<article><p title='hidden gems > all'>{LONG}</p><p hidden>not shown</p><p style='display: none'>nor this</p></article>", LONG),
    (f"<article><p>5 < 6 and 7 > 3. {LONG}</p></article>", f"5 < 6 and 7 > 3. {LONG}"),
    (f"<article><p>{LONG}</p><noscript>Turn it on</noscript><iframe src='x'>no frames</iframe><svg><text>icon</text></svg>"
     "</article>", LONG),
    # no article element and no telling class
    (f"<div><div><a href='/a'>Home</a> <a href='/b'>Sports</a></div><div><p>{LONG}</p><p>{MORE}</p></div></div>", f"{LONG}\n{MORE}"),
    (f"<h1>Bridge</h1><p>{LONG}</p><p>{MORE}</p>", f"Bridge\n{LONG}\n{MORE}"),
    (f"<div id='c1'><span>{LONG}</span><br><br><span>{MORE}</span></div><div id='c2'><a href='x'>Imprint</a></div>",
     f"{LONG} {MORE}"),
    (f"<section itemprop='articleBody'><p>{LONG}</p><h3>When</h3><p>{MORE}</p></section><div class='widget'>Clock</div>",
     f"{LONG}\nWhen\n{MORE}"),
    (f"<main><section><h2>Bridge</h2><p>{LONG}</p></section><section><h2>Next</h2><p>{MORE}</p></section></main>",
     f"Bridge\n{LONG}\nNext\n{MORE}"),
    (f"<div class='w-1/2 col'><article class='post type-post has-comments'><p>{LONG}</p></article></div>", LONG),
    (f"<div class='page'><div class='breadcrumbs'><a href='/'>Home</a> / News</div><div class='article__body'><p>{LONG}</p>"
     f"<p>{MORE}</p></div><div class='pagination'>1 2 3</div></div>", f"{LONG}\n{MORE}"),
]
