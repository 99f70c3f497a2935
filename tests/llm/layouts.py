"""Pages written by hand in many layouts, each with the lines of its main text."""

A = "The harbour froze early that year, and the boats stayed where they were until the middle of March."
B = "Nobody in the village remembered such a winter, though the oldest of them had seen eighty of them."
C = "When the ice finally broke, it took two of the piers with it and left the rest leaning to one side."
D = "Repairs began in April with timber from the north, paid for by a fund that the council had kept since the war."
E = "Ships came back in June."


def links(*names):
    return "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)


MENU = links("Home", "News", "Sport", "Weather", "Contact")

LAYOUTS = {
    "blog": (
        f"""<html><head><title>x</title></head><body class="home"><header class="site-header"><p class="logo">Harbour Notes</p><nav class="main-menu"><ul>{MENU}</ul></nav></header>
        <div id="content"><article class="post"><h1>A cold spring</h1><p>{A}</p><p>{B}</p><h2>The thaw</h2><p>{C}</p></article>
        <section id="comments" class="comments"><h3>2 comments</h3><ol><li class="comment"><p>My father told me about it.</p></li><li class="comment"><p>Great piece!</p></li></ol></section></div>
        <aside class="sidebar"><h3>Recent posts</h3><ul>{links("Summer", "Autumn")}</ul></aside><footer>&copy; 2020 Harbour Notes</footer></body></html>""",
        ["A cold spring", A, B, "The thaw", C],
    ),
    "news": (
        f"""<html><body><div class="topbar"><ul>{MENU}</ul></div><div class="masthead"><p>The Daily Paper</p></div><main><div class="story"><h1>Ice takes two piers</h1><p class="lead"><b>{A}</b></p>
        <figure><img src="a.jpg"><figcaption>The western pier in March</figcaption></figure><p>{B}</p><div class="ad-slot">Cheap flights from 9 euros, book now</div><p>{C}<p>{D}</div></main>
        <aside class="related"><h3>Read more</h3><ul>{links("Council votes", "Timber prices")}</ul></aside><footer class="site-footer"><ul>{links("Imprint", "Privacy")}</ul></footer></body></html>""",
        ["Ice takes two piers", A, "The western pier in March", B, C, D],
    ),
    "manual": (
        f"""<html><body><nav class="sidebar"><h4>Contents</h4><ul>{links("Install", "Configure", "Run", "Upgrade", "Remove", "Questions")}</ul></nav><main class="content"><h1>Configure the server</h1>
        <p>The server reads its settings from one file when it starts, and again when it is told to.</p><pre>port = 8080
        workers = 4</pre><ul><li>Set the port to one that no other service uses.</li><li>Set the number of workers to the number of cores.</li></ul><h2>Check the result</h2><p>Run the command below and compare what it prints with the table.</p></main>
        <div class="pagination"><a href="/i">Install</a> <a href="/r">Run</a></div><footer><p>Built from source</p></footer></body></html>""",
        ["Configure the server", "The server reads its settings from one file when it starts, and again when it is told to.", "port = 8080 workers = 4", "Set the port to one that no other service uses.", "Set the number of workers to the number of cores.", "Check the result", "Run the command below and compare what it prints with the table."],
    ),
    "recipe": (
        f"""<body><div class="wrapper"><header><p>Kitchen of the North</p><nav><ul>{MENU}</ul></nav></header><section class="content" id="recipe"><h1>Rye bread</h1><p>A dense loaf that keeps for a week and needs no kneading at all.</p>
        <ul><li>500 g of rye flour</li><li>400 ml of warm water</li></ul><ol><li>Mix all of it in a large bowl and wait for a night.</li><li>Bake it for an hour at a high heat.</li></ol></section>
        <form class="newsletter" action="/n"><label>Your address</label><input name="m"><button>Subscribe</button></form>
        <div class="comment-list"><h3>Replies</h3><div class="comment"><p>Mine stuck to the tin, what did I do wrong?</p></div></div><footer>All rights reserved</footer></div></body>""",
        ["Rye bread", "A dense loaf that keeps for a week and needs no kneading at all.", "500 g of rye flour", "400 ml of warm water", "Mix all of it in a large bowl and wait for a night.", "Bake it for an hour at a high heat."],
    ),
    "tables": (
        f"""<html><body><table><tr><td class="menu"><a href=1>Home</a><br><a href=2>Guestbook</a><br><a href=3>Links</a></td><td class="content"><h1>The winter of the piers</h1><p>{A}<p>{B}<p>{C}</td></tr></table><p class="copyright">&copy; 1998 the author</p></body></html>""",
        ["The winter of the piers", A, B, C],
    ),
    "bare": (f"<html><body><h1>The winter of the piers</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></body></html>", ["The winter of the piers", A, B, C, D]),
    "encyclopedia": (
        f"""<html><body><div id="header"><p>Open Book of Harbours</p></div><div id="navigation" class="menu"><ul>{links("Main page", "Random page", "Help")}</ul></div><div id="main" class="page-content"><h1>Piers</h1>
        <p>A <a href="/p">pier</a> is a raised structure that stands in <a href="/w">water</a> on <a href="/q">pillars</a>, and differs from a <a href="/k">quay</a> in that water flows beneath it.</p>
        <h2>History</h2><p>The oldest ones known were made of <a href="/t">timber</a> and lasted for some thirty years each.</p><ul><li>Working piers, at which goods are handled</li><li>Pleasure piers, on which people walk</li></ul></div>
        <div class="footer"><ul>{links("About", "Disclaimers")}</ul></div></body></html>""",
        ["Piers", "A pier is a raised structure that stands in water on pillars, and differs from a quay in that water flows beneath it.", "History", "The oldest ones known were made of timber and lasted for some thirty years each.", "Working piers, at which goods are handled", "Pleasure piers, on which people walk"],
    ),
    "press": (
        f"""<body><div class="cookie-banner"><p>We and our partners store data on your device.</p><button>Accept</button><button>Refuse</button></div><div class="page"><div class="navbar"><ul>{MENU}</ul></div>
        <div class="post-content"><h1>New piers for the harbour</h1><p>{D}</p><blockquote>We build for another hundred years, said the mayor.</blockquote><p>{B}</p></div><div class="share"><ul>{links("Mail", "Print")}</ul></div>
        <div class="recommended"><h3>You may also like</h3><ul>{links("Older news", "Newer news")}</ul></div></div><footer><p>Press office, Harbour Street 1</p></footer></body>""",
        ["New piers for the harbour", D, "We build for another hundred years, said the mayor.", B],
    ),
    "roles": (
        f"""<body><div role="banner"><p>Coast Radio</p></div><div role="navigation"><ul>{MENU}</ul></div><div role="main"><h1>Boats return</h1><p>{C}</p><p>{E}</p></div><div role="contentinfo"><p>&copy; Coast Radio</p></div></body>""",
        ["Boats return", C, E],
    ),
    "shouted": (
        f"""<HTML><BODY><DIV CLASS=NAV><A HREF=a>HOME</A> <A HREF=b>NEWS</A></DIV><DIV CLASS=TEXT><H1>Boats return</H1><P>{A}<P>{D}<P>{E}</DIV><DIV CLASS=FOOTER>&copy; nobody</DIV></BODY></HTML>""",
        ["Boats return", A, D, E],
    ),
    "utilities": (
        f"""<body class="bg-white text-gray"><header class="flex px-4"><p class="font-bold">Tide</p><nav class="ml-auto"><ul class="flex">{MENU}</ul></nav></header><div class="grid mt-8"><article class="prose col-span-2"><h1 class="text-xl">Boats return</h1><p class="mt-4">{A}</p><p class="mt-4">{B}</p></article>
        <aside class="mt-8"><h3 class="font-bold">Popular</h3><ul>{links("Storms", "Fog")}</ul></aside></div><div class="newsletter mt-8"><p>Get the tide in your inbox every week.</p><form><input><button>Join</button></form></div><footer class="py-4">Made by the sea</footer></body>""",
        ["Boats return", A, B],
    ),
    "interrupted": (
        f"""<body><nav><ul>{MENU}</ul></nav><article><h1>Boats return</h1><p>{A}</p><div class="promo"><p>Ten issues for the price of five</p></div><p>{B}</p><aside><p>Related: the storms of last year</p></aside><p>{C}</p><form><p>Tell us what you think of this page</p><button>Send</button></form><p>{D}</p></article><div class="popup"><p>Do not leave yet!</p></div></body>""",
        ["Boats return", A, B, C, D],
    ),
    "german": (
        f"""<body><header><p>Hafenblatt</p><nav><ul>{links("Start", "Wetter", "Impressum")}</ul></nav></header><div class="hinweis notice"><p>Diese Seite verwendet Cookies.</p></div><main><h1>Die Boote kehren zurück</h1><p>Der Hafen war in diesem Jahr früh zugefroren, und die Boote lagen bis Mitte März fest.</p><p>Niemand im Dorf erinnerte sich an einen solchen Winter; die Ältesten hatten achtzig davon erlebt.</p></main><div class="kommentare comments"><div class="comment"><p>Sehr schöner Bericht.</p></div></div><footer>&copy; Hafenblatt</footer></body>""",
        ["Die Boote kehren zurück", "Der Hafen war in diesem Jahr früh zugefroren, und die Boote lagen bis Mitte März fest.", "Niemand im Dorf erinnerte sich an einen solchen Winter; die Ältesten hatten achtzig davon erlebt."],
    ),
}
