"""Pages written by hand, with their main text; nothing here comes from the composer of training pages."""

A = "The committee met on Tuesday to discuss the new bridge over the river. Several members asked for more time, as the costs had not been agreed."
B = "After two hours the vote was taken, and the plan passed by a narrow margin. Work will start in the spring, weather permitting."
C = "Residents who live near the site were pleased with the result. One of them said that the old bridge had been closed too often."
T = "Bridge plan passes"
ROW = '<a href="/">Home</a><a href="/n">News</a><a href="/s">Sport</a><a href="/w">Weather</a>'
LIST = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'


def p(*texts):
    return "".join(f"<p>{x}</p>" for x in texts)


PAGES = [
    (f'<html><body><div id="hd"><a href="/">Daily Post</a></div><div id="c1">{p(A, B)}</div><div id="r">{LIST}</div><div id="b">© 2020 Daily Post</div></body></html>', [A, B]),
    ("<p>Only one short paragraph.</p>", ["Only one short paragraph."]),
    (p(A, B), [A, B]),
    (f"<html><head><title>T</title></head><body><h1>{T}</h1>{p(A, B, C)}</body></html>", [T, A, B, C]),
    (f"<html><body><nav>{LIST}</nav><h1>{T}</h1>{p(A, B, C)}<footer>Copyright 2020</footer></body></html>", [T, A, B, C]),
    (f'<html><body><div class="x7q"><div class="zz">{LIST}</div></div><div class="kk2"><div class="ww"><h1>{T}</h1>{p(A, B, C)}</div></div><div class="pq">Copyright 2020 Post</div></body></html>', [T, A, B, C]),
    (f"<html><body><div>{ROW}</div><div><h2>{T}</h2>{p(A, B)}</div><div>Copyright 2020</div></body></html>", [T, A, B]),
    (f"<table><tr><td width=100>{LIST}</td><td><h1>{T}</h1>{p(A, B, C)}</td></tr></table>", [T, A, B, C]),
    (
        f'<body><div class="navbar">{LIST}</div><div class="cookie-banner"><p>We use cookies to make this site better.</p><button>OK</button></div><div class="post-content"><h1>{T}</h1>{p(A, B)}<div class="advert">Buy shoes now</div>{p(C)}</div>'
        f'<div class="sidebar"><h3>Most read</h3>{LIST}</div><div id="comments"><h3>Comments</h3><div class="comment">{p("Great news, I have waited for this bridge for years and years.")}</div></div><div class="footer">© 2020</div></body>',
        [T, A, B, C],
    ),
    (f'<body><header><a href="/">Post</a><p>News for the valley</p></header><main><h1>{T}</h1>{p(A, B, C)}</main><aside><h3>Related</h3><p>Ten bridges you should see this summer.</p></aside><footer><p>Copyright 2020 Valley Post. All rights reserved.</p></footer></body>', [T, A, B, C]),
    (f'<body><form id="login"><label>Name</label><input><button>Sign in</button></form><article><h1>{T}</h1>{p(A, B)}</article><form class="newsletter"><p>Get our letter every week.</p><input><button>Go</button></form></body>', [T, A, B]),
    (
        f'<body><section class="top">{ROW}</section><section class="entry"><h1>{T}</h1>{p(A)}<blockquote>{p(B)}</blockquote><ul><li>Costs were agreed</li><li>Work starts in spring</li></ul></section>'
        '<section class="comments"><h2>2 comments</h2><p>Great news for all of us in the valley, at last.</p></section></body>',
        [T, A, B, "Costs were agreed", "Work starts in spring"],
    ),
    (f'<body><nav>{ROW}</nav><div id="content"><p>The <b>committee</b> met <a href="/t">on Tuesday</a>, as&nbsp;planned &amp; agreed.</p>{p(B, C)}</div></body>', ["The committee met on Tuesday, as planned & agreed.", B, C]),
    (f"<html><body><div class=nav>{LIST}</div>{'<div>' * 30}{p(A, B, C)}{'</div>' * 30}<div class=footer>© 2020</div></body></html>", [A, B, C]),
    (f'<body><script>var a="<p>no</p>";</script><style>p{{}}</style><article>{p(A, B)}<script>x()</script></article><noscript><p>Turn on scripts.</p></noscript></body>', [A, B]),
    (f'<body><div class="menu">{ROW}</div><div class="text">{A}<br><br>{B}</div><div class="footer">Contact us</div></body>', [f"{A} {B}"]),
    (
        f'<body class="home blog"><div id="page" class="site"><header id="masthead" class="site-header"><h2>Valley blog</h2></header><div id="primary" class="content-area"><main id="main"><article id="post-12" class="post-12 post hentry">'
        f'<h1 class="entry-title">{T}</h1><div class="entry-content">{p(A, B, C)}</div></article></main></div><div id="secondary" class="widget-area"><h3>Recent posts</h3>{LIST}</div><footer id="colophon" class="site-footer"><p>Proudly made in the valley.</p></footer></div></body>',
        [T, A, B, C],
    ),
    (f'<div id=""><div class="">{p(A, B)}</div></div>', [A, B]),
    (f"<html><body><nav>{LIST}</nav><footer>© 2020</footer></body></html>", []),
    ('<body><ul class="menu">' + "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(40)) + f'</ul><div class="story">{p(A, B)}</div></body>', [A, B]),
    # not looked at while the composer was written
    (f'<body><div role="navigation">{ROW}</div><div role="main"><h1>{T}</h1>{p(A, C)}</div><div role="complementary"><h4>See also</h4>{LIST}</div></body>', [T, A, C]),
    (f"<center><font size=2>{ROW}</font></center><hr><h1>{T}</h1>{p(A, B, C)}<hr><small>Last change: May 2001</small>", [T, A, B, C]),
    (f'<body><div class="wrap"><div class="a1">{LIST}</div><div class="a2"><p>{A}</p><p>{B}</p><p>{C}</p><p>{A}</p></div><div class="a3">{LIST}</div></div></body>', [A, B, C, A]),
    (f'<body><header><nav>{LIST}</nav></header><article><header><h1>{T}</h1></header>{p(A, B)}<h2>What is next</h2>{p(C)}</article><section id="discussion"><ol><li><p>First!</p></li><li><p>About time that somebody did something about it.</p></li></ol></section></body>', [T, A, B, "What is next", C]),
    (f'<html><body bgcolor=white><p>{A}<p>{B}<p>{C}</body></html>', [A, B, C]),
]

D = "The survey, which ran for three months, found that most people drive less than they did ten years ago, and that few of them miss it."
E = "Its authors warn that the figures for rural areas rest on a small number of answers; they plan to repeat it next year."
F = "Buses have become more frequent on all main routes since the reform, and the number of passengers has grown by a fifth."
H = "Fewer cars than ever"
SAID = "I could not agree more with this, my own street has been so much quieter since the change came in."
TOO = "Nobody asked us out here in the hills, where the last bus leaves at four in the afternoon."
MENU = "<ul>" + "".join(f'<li><a href="/{x.lower()}">{x}</a></li>' for x in ("Start", "Politics", "Culture", "Travel", "Contact")) + "</ul>"

#: Written at once, before any run over them, and not changed after.
UNSEEN = [
    (f'<body><nav>{MENU}</nav><main><h1>{H}</h1>{p(D, E, F)}<section id="disqus_thread"><div class="post"><p>{SAID}</p></div><div class="post"><p>{TOO}</p></div></section></main></body>', [H, D, E, F]),
    (f'<body><div class="hero"><h1>{H}</h1></div><div class="content">{p(D, E, F)}</div><div class="footer">© 2021 The Courier</div></body>', [H, D, E, F]),
    (f'<body><header>{MENU}</header><article><h1>{H}</h1>{p(D, E)}<footer>Filed under: <a href="/t">Traffic</a>, <a href="/s">Surveys</a></footer></article></body>', [H, D, E]),
    (f'<body><header class="site"><a href="/">Courier</a></header><article><h1>{H}</h1>{p(D, E, F)}</article><section class="comments-area"><h2>Two replies</h2><ol class="comment-list"><li class="comment"><p>{SAID}</p></li><li class="comment"><p>{TOO}</p></li></ol></section></body>', [H, D, E, F]),
    (f"<html><body><main>{p(D, E, F)}</main></body></html>", [D, E, F]),
    (f'<body><div class="topbar">{MENU}</div><div class="story"><h2>{H}</h2>{p(D)}<div class="sponsored">Try our new shoes today</div>{p(E, F)}</div></body>', [H, D, E, F]),
    (f'<body><div id="cookie-consent"><p>This site uses cookies, as all of them do.</p><button>Fine</button></div><div id="main-content"><h1>{H}</h1>{p(D, E)}</div></body>', [H, D, E]),
    (f'<body><div class="layout"><div class="sidebar"><h3>Latest</h3>{MENU}</div><div class="article-text">{p(D, E, F)}</div></div></body>', [D, E, F]),
    (f'<body><article><h1>{H}</h1><p class="lead">{D}</p><h2>Doubts</h2>{p(E)}<ol><li>More buses</li><li>Fewer lanes</li></ol></article><aside><p>Ten towns that you should see before you turn forty.</p></aside></body>', [H, D, "Doubts", E, "More buses", "Fewer lanes"]),
    (f'<body><form action="/search"><input name="q"><button>Search</button></form><div class="entry">{p(D, E)}</div><div id="footer">Imprint and privacy</div></body>', [D, E]),
    (f'<body><table class="page"><tr><td class="left">{MENU}</td><td class="text"><h1>{H}</h1>{p(D, E, F)}</td></tr></table></body>', [H, D, E, F]),
    (f'<body><nav>{MENU}</nav><article><h1>{H}</h1>{p(D, F)}<blockquote><p>{E}</p></blockquote></article><footer><p>All content is ours.</p></footer></body>', [H, D, F, E]),
    (f'<body><div class="share-buttons"><a href="/f">Share</a> <a href="/m">Mail</a></div><div class="post-body">{p(D, E, F)}</div></body>', [D, E, F]),
    (f'<body><div class="wrapper"><div class="wrapper-inner"><header><h2>The Courier</h2></header><div class="body-text"><h1>{H}</h1>{p(D, E)}</div></div></div></body>', [H, D, E]),
    (f'<body><article>{p(D, E)}<div class="newsletter-signup"><p>Get the best of the week by mail.</p><form><input><button>Join</button></form></div>{p(F)}</article></body>', [D, E, F]),
    (f'<body><div class="breadcrumbs"><a href="/">Start</a> / <a href="/t">Traffic</a></div><h1>{H}</h1>{p(D, E, F)}<div class="copyright">© 2021</div></body>', [H, D, E, F]),
    (f'<body class="single"><main class="site-main"><article class="post"><header class="entry-header"><h1>{H}</h1></header><div class="entry-content">{p(D, E, F)}</div></article><div id="comments" class="comments-area"><p>{SAID}</p></div></main></body>', [H, D, E, F]),
    (f'<body><p>{D}</p><p>{E}</p><div class="promo"><p>Half price on all tickets until Sunday.</p></div><p>{F}</p></body>', [D, E, F]),
    (f'<body><div class="nav">{MENU}</div><div class="kx"><div class="ky"><h1>{H}</h1>{p(D, E, F)}</div></div><div class="kz">© 2021 Courier</div></body>', [H, D, E, F]),
    (f"<body>{MENU}<h1>{H}</h1>{p(D, E, F)}{MENU}</body>", [H, D, E, F]),
    (f'<body><section class="intro"><h1>{H}</h1></section><section class="text">{p(D, E)}</section><section class="responses"><h3>What readers say</h3><p>{SAID}</p><p>{TOO}</p></section></body>', [H, D, E]),
    (f'<body><article><h1>{H}</h1><table><tr><th>Year</th><th>Cars</th></tr><tr><td>2010</td><td>900</td></tr></table>{p(D, E)}</article></body>', [H, "Year", "Cars", "2010", "900", D, E]),
    (f'<body><div class="alert"><p>We have new terms of use.</p></div><main><p>{D} <a href="/x">More</a>.</p>{p(E)}</main><footer>{MENU}</footer></body>', [f"{D} More.", E]),
    (f'<body><header><nav>{MENU}</nav></header><div role="main">{p(D, E, F)}</div><footer role="contentinfo"><p>The Courier, Market Street 5</p></footer></body>', [D, E, F]),
    (f'<body><div id="top"><a href="/">The Courier</a></div><div id="body"><h1>{H}</h1>{p(D)}<h3>Rural areas</h3>{p(E, F)}</div><div id="related"><h3>Read on</h3>{MENU}</div></body>', [H, D, "Rural areas", E, F]),
]
