"""Pages written by hand in other shapes than those the model is trained on, each with its main text."""

PAGES = [
    (  # a blog of nested wrappers without article or main
        """<html><head><title>My blog</title><link rel=stylesheet href=a.css></head><body class="home"><div id="wrapper"><div id="masthead"><a href="/"><img src=l.png alt="Logo"></a></div>
        <div id="main-nav"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/archive">Archive</a></div>
        <div id="content"><div class="post"><h2>Repairing an old clock</h2><p>Last week I found a mantel clock at the market. It did not run, but nothing seemed to be broken.</p>
        <p>After an evening of <a href="/cleaning">cleaning</a> the movement with warm water and a soft brush, it started at once.</p><ol><li>Take off the hands.</li><li>Lift the dial.</li></ol></div></div>
        <div id="sidebar"><h4>Categories</h4><ul><li><a href="/c1">Clocks</a></li><li><a href="/c2">Tools</a></li></ul></div><div id="footer">Powered by a blog engine. All rights reserved.</div></div></body></html>""",
        "Repairing an old clock Last week I found a mantel clock at the market. It did not run, but nothing seemed to be broken. After an evening of cleaning the movement with warm water and a soft brush, it started at once. Take off the hands. Lift the dial.",
    ),
    (  # news with a cookie notice, an advert inside and reader comments after
        """<!DOCTYPE html><html lang="en"><body><div class="cookie-consent">We use cookies to improve your visit. <button>Accept</button></div><header><nav><ul><li><a href=/a>World</a><li><a href=/b>Sport</a></ul></nav></header>
        <main><article><h1>Bridge reopens after three years</h1><p>The old bridge over the river was opened again on Monday, three years after the flood that carried away two of its arches.</p>
        <div class="ad-slot"><a href="//ads"><span>Buy new tyres today</span></a></div><p>&ldquo;It is a good day for both banks,&rdquo; the mayor said. Some 4&nbsp;000 people crossed it on foot.</p></article>
        <section id="comments"><h3>2 comments</h3><div class="comment"><b>anna</b><p>At last! I had to drive twenty minutes every day because of this.</p></div></section></main><footer><p>Imprint, contact, and privacy.</p></footer></body></html>""",
        "Bridge reopens after three years The old bridge over the river was opened again on Monday, three years after the flood that carried away two of its arches. “It is a good day for both banks,” the mayor said. Some 4 000 people crossed it on foot.",
    ),
    (  # documentation with code, data attributes and titles that say hidden
        """<body><nav class="toc"><a href="#a">Install</a><a href="#b">Use</a></nav><main class="markdown"><h1 id="a" data-state="hidden">Install</h1><p>Run the following line in a shell, then see <a href="/hidden-options" title="hidden options">all the options</a> that the tool has.</p>
        <pre><code>tool install --all
tool check</code></pre><h2>Use</h2><p hidden>Never shown.</p><p data-hidden="false">Every command prints what it does, and ends with a status of zero.</p><p style="display:none">Nor is this one.</p></main></body>""",
        "Install Run the following line in a shell, then see all the options that the tool has. tool install --all tool check Use Every command prints what it does, and ends with a status of zero.",
    ),
    (  # bare paragraphs in the body, unclosed
        """<html><body><h1>Notes on bread</h1><p>Flour, water and salt are all that is needed, and time does most of the work.<p>Leave the dough in a cool place over night.<p>Bake it until the crust is dark &amp; the loaf sounds hollow.<hr><script>track("<p>no</p>")</script></body></html>""",
        "Notes on bread Flour, water and salt are all that is needed, and time does most of the work. Leave the dough in a cool place over night. Bake it until the crust is dark & the loaf sounds hollow.",
    ),
    (  # a recipe with a table, inside section and div
        """<body><div class="topbar"><a href="/">Kitchen</a> <a href="/login">Log in</a></div><section class="entry-content"><div><h1>Lentil soup</h1><div><p>A plain soup for a cold day; it keeps for a week and gets better with every warming.</p></div>
        <table><tr><th>Lentils</th><td>250 g</td></tr><tr><th>Carrots</th><td>3</td></tr></table><div><p>Cook everything for forty minutes, then add vinegar and pepper.</p></div></div></section>
        <aside class="related"><h3>You may also like</h3><a href="/1">Bean stew</a><a href="/2">Onion tart</a></aside><form action="/newsletter"><label>Your mail</label><input name=m><button>Subscribe</button></form></body>""",
        "Lentil soup A plain soup for a cold day; it keeps for a week and gets better with every warming. Lentils 250 g Carrots 3 Cook everything for forty minutes, then add vinegar and pepper.",
    ),
    (  # German, role attributes
        """<html><body><div role="banner">Stadtarchiv</div><div role="navigation"><ul><li><a href="/">Start</a></li><li><a href="/k">Kontakt</a></li></ul></div><div role="main"><h1>Die Mühle am Bach</h1><p>Die Mühle wurde vor dreihundert Jahren gebaut und mahlte bis in die Zeit unserer Großeltern Korn für das ganze Tal.</p><blockquote>Wer zuerst kommt, mahlt zuerst.</blockquote><p>Heute wohnt dort eine Familie mit vier Kindern.</p></div><div role="contentinfo">Impressum</div></body></html>""",
        "Die Mühle am Bach Die Mühle wurde vor dreihundert Jahren gebaut und mahlte bis in die Zeit unserer Großeltern Korn für das ganze Tal. Wer zuerst kommt, mahlt zuerst. Heute wohnt dort eine Familie mit vier Kindern.",
    ),
    (  # definition list, figure, inline markup split in words
        """<body><article class="story"><h2>What the signs mean</h2><dl><dt>Red</dt><dd>Stop and wait for the guard.</dd><dt>Green</dt><dd>Go on at a walking pace.</dd></dl><figure><img src=s.png><figcaption>The signs as they hung in the old station.</figcaption></figure><p>The <b>y</b>ellow one was <em>never</em> used, as far as we know.</p></article><div class="social share"><a href=x>Share</a><a href=y>Tweet</a></div></body>""",
        "What the signs mean Red Stop and wait for the guard. Green Go on at a walking pace. The signs as they hung in the old station. The yellow one was never used, as far as we know.",
    ),
    (  # nothing but navigation
        """<html><body><nav><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></nav><footer>&copy; 2020</footer></body></html>""",
        "",
    ),
]

PARA = [
    "The ferry leaves the old harbour at seven in the morning and needs a little under an hour for the crossing, so that most people who work on the island take it twice a day. In winter it goes only when the ice allows, and then everybody has to wait for the mail boat instead.",
    "Nobody remembers who built the first landing stage. A map in the town hall shows it already, with a crane beside it and a small house for the man who kept the lamp. The house is still there; the lamp was sold to a museum some forty years ago, together with its brass frame.",
    "Since spring there is a second boat. It is smaller and has no room for cars, but it is quiet, needs no oil at all, and can be steered by one person alone. The crew have given it a name that the company does not like, and painted it on the side in white letters.",
    "Whoever wants to see the island should stay for a night. The last boat back leaves at six, long before the light is at its best, and the path along the northern shore is too far to walk in an afternoon with a heavy bag and a child that would rather look for shells.",
]
_P = "".join(f"<p>{x}</p>" for x in PARA)
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/contact">Contact</a></li></ul></nav>'
_FOOT = "<footer><p>&copy; 2021 The Island Paper. All rights reserved.</p></footer>"
_ALL = " ".join(PARA)

#: Pages without article, main, telling class or heading, with misleading or foreign names, or of odd shapes.
PLAIN_PAGES = [
    (f"<html><body>{_NAV}<div>{_P}</div>{_FOOT}</body></html>", _ALL),
    (f"<body>{_NAV}<div><p>{PARA[0]}</p><p>{PARA[1]}</p><p>{PARA[2]}</p></div>{_FOOT}</body>", " ".join(PARA[:3])),
    (f"<body><section>{_P}</section></body>", _ALL),
    (f"<body>{_NAV}<div><p>{PARA[0]}</p><p>{PARA[1]}</p></div>{_FOOT}</body>", " ".join(PARA[:2])),
    (_ALL, _ALL),
    (f"<p>{PARA[0]}<p>{PARA[1]}", " ".join(PARA[:2])),
    (f"<article><h1>Sums</h1><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds in this case, and in every other one that we have tried so far.</p><p>{PARA[0]}</p></article>", f"Sums The sum x+1 holds in this case, and in every other one that we have tried so far. {PARA[0]}"),
    (f"<article><h1>Pills</h1><p>{PARA[0]}</p><p class='side-effects'>Some people feel tired after the second dose, which passes within a day.</p><p class='author-note'>I have taken them myself for a year without any trouble.</p></article>",
     f"Pills {PARA[0]} Some people feel tired after the second dose, which passes within a day. I have taken them myself for a year without any trouble."),
    (f"<body><div class='kopfzeile'><a href='/'>Inselblatt</a></div><div class='werbung'>Jetzt neue Reifen kaufen und sparen!</div><div class='inhalt'>{_P}</div><div class='kommentare'><p>Das stimmt so nicht, ich war dabei.</p></div><div class='fuss'>Alle Rechte vorbehalten.</div></body>", _ALL),
    (f"<body><div id='entete'><a href='/'>Le Journal</a></div><div class='contenu'><h1>Le bac</h1>{_P}</div><div class='commentaires'><p>Merci pour cet article, je le trouve tres juste.</p></div><div class='publicite'>Achetez maintenant</div></body>", f"Le bac {_ALL}"),
    (f"<body><table><tr><td><a href='/'>Home</a><br><a href='/a'>Archive</a><br><a href='/l'>Links</a></td><td>{PARA[0]}<br><br>{PARA[1]}<br><br>{PARA[2]}</td></tr></table></body>", " ".join(PARA[:3])),
    (f"<body>{_NAV}<div>{PARA[0]}<br><br>{PARA[3]}</div>{_FOOT}</body>", f"{PARA[0]} {PARA[3]}"),
    (f"<body><div><div><div><div>{_P}</div></div></div></div></body>", _ALL),
    (f"<body><div><a href='/1'>One</a> <a href='/2'>Two</a> <a href='/3'>Three</a></div><div><h2>The boat</h2>{_P}</div><div><a href='/x'>Imprint</a> <a href='/y'>Privacy</a></div></body>", f"The boat {_ALL}"),
    (f"<body><header><h1>The Island Paper</h1></header>{_P}<div class='share-bar'><a href='#'>Share</a></div>{_FOOT}</body>", _ALL),
    (f"<body class='page-template-default'><div class='c1 x9'><div class='y3'>{_P}</div></div><div class='cookie-banner'><p>This site uses cookies. <button>Fine</button></p></div></body>", _ALL),
    (f"<body><main><p>{PARA[1]}</p><aside class='related-posts'><h3>More to read</h3><ul><li><a href='/1'>The mail boat</a></li><li><a href='/2'>The lamp</a></li></ul></aside><p>{PARA[2]}</p></main></body>", f"{PARA[1]} {PARA[2]}"),
    (f"<body><div><p>{PARA[0]}</p><blockquote><p>It is our only road.</p></blockquote><p>{PARA[1]}</p></div><div id='comments'><p>First!</p><p>I take it every day and it is never late, whatever they say.</p></div></body>", f"{PARA[0]} It is our only road. {PARA[1]}"),
    (f"<body><div><ul><li>{PARA[0]}</li><li>{PARA[1]}</li></ul></div>{_FOOT}</body>", " ".join(PARA[:2])),
    (f"<body><div role='navigation'><a href='/'>Start</a></div><div role='main'>{_P}</div><div role='contentinfo'>Printed on the island</div></body>", _ALL),
    (f"<body><form action='/s'><input name=q><button>Search</button></form><section><h2>Boats</h2><p>{PARA[2]}</p><pre>07:00  out\n18:00  back</pre><p>{PARA[3]}</p></section><footer>Contact us</footer></body>", f"Boats {PARA[2]} 07:00 out 18:00 back {PARA[3]}"),
    (f"<body><div class='story-text'><p>{PARA[0]}</p><div class='ad-unit'><p>Tyres at half the price, this week only!</p></div><p>{PARA[1]}</p><div class='newsletter-box'><p>Get our letter every Monday.</p><input><button>Go</button></div><p>{PARA[2]}</p></div></body>", " ".join(PARA[:3])),
    (f"<body><div class='message-history'><p>{PARA[0]}</p></div><div class='search-party'><p>{PARA[1]}</p></div></body>", " ".join(PARA[:2])),
    (f"<body>{_NAV}<p>{PARA[0]}</p><p>{PARA[1]}</p><hr><p>{PARA[2]}</p>{_FOOT}</body>", " ".join(PARA[:3])),
]
