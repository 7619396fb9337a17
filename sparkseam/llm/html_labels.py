"""The labelled table of the block classifier: pages as lists of (markup of whole blocks, 1 for main text else 0).

Written for this purpose; the words are filler, the forms those of common page templates.
"""

S = "The harbour office opened early and the pilots waited for the tide to turn before the first ship left"
L = f"{S}. {S}, although the wind had grown since the night and nobody was certain that it would last until noon. {S}."

PAGES = [
    [
        ("<title>Harbour news</title>", 0),
        ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li><li><a href='/c'>Contact</a></li></ul></nav>", 0),
        ("<div class='ad'>Buy two boats and get one oar for nothing today.</div>", 0),
        ("<article><h1>Harbour opens early</h1>", 1),
        (f"<p>{L}</p><p>{S}.</p><p>No.</p><p><b>{L}<br></p><p>See <a href='/x'>the tide table</a>.</p><ul><li>Ropes</li><li>Two lamps</li></ul></article>", 1),
        (f"<footer>&copy; harbour.example &middot; {S}.</footer>", 0),
    ],
    [
        ("<title>Lamps</title>", 0),
        ("<header><div>Lamp shop</div><p>We sell lamps of every kind in all the towns along the coast and the rivers.</p></header>", 0),
        (f"<main><h1>On lamps</h1><p>{L}</p><h2>Oil</h2><p>Oil burns.</p><blockquote>{S}</blockquote><p>{L}</p>", 1),
        (f"<aside><h3>More</h3><p>{S}.</p><a href='/1'>{S}</a></aside>", 0),
        ("<p>It ends.</p>", 1),
        (f"<div class='comments'><h3>Comments</h3><p>Nice.</p><p>{L}</p></div></main>", 0),
        ("<form><label>Mail</label><button>Send</button></form>", 0),
        (f"<div id='cookie-notice'><p>{S}.</p></div><footer><p>{L}</p></footer>", 0),
    ],
    [
        ("<div class='menu'><a href='/'>Home</a> <a href='/b'>Boats</a></div>", 0),
        (f"<div><h1>Boats of the north</h1><p>{L}</p><p>{S}.</p><p>{L}</p><p>A short one.</p><p>{L}</p></div>", 1),
        ("<div><a href='/n'>Next page</a> <a href='/p'>Page before</a></div>", 0),
        (f"<div class='sidebar'><p>{S}.</p><p>Short.</p></div>", 0),
        ("<div><a href='/t'>Terms</a></div>", 0),
    ],
    [
        ("<div><a href='/'>Home</a></div><div>Search</div><div><a href='/r'>Rivers and lakes</a></div>", 0),
        (f"<h1>Rivers</h1><p>{S}. {S}.</p><p>{L}</p><p>{S}, <a href='/s'>says the pilot</a>.</p>", 1),
        (f"<ul><li><a href='/1'>{S}</a></li><li><a href='/2'>Rope</a></li><li><a href='/3'>Oars of ash and oak</a></li></ul>", 0),
        ("<div class='newsletter'>Get the letter each week in your mail box.</div><div>Imprint</div>", 0),
    ],
    [
        ("<title>Sails</title>", 0),
        ("<nav><a href='/'>Home</a></nav>", 0),
        (f"<article><header><h1>Sails</h1></header><p>Yes.</p><p>{L}</p><p>One <a href='/l'>two three four</a></p><p><a href='/m'>A list of sails</a></p>", 1),
        ("<div class='share'>Share this with friends</div><section class='related'><h2>Related</h2><p><a href='/q'>Masts</a></p></section>", 0),
        ("<p>The end of it.</p></article>", 1),
        (f"<section id='comments'><article><p>{S}.</p><p>Agreed.</p></article></section>", 0),
        (f"<div class='advert'><p>{L}</p></div><footer>Sails, a page about sails</footer>", 0),
    ],
    [(f"<h1>Masts</h1><p>{L}</p><p>{S}.</p>", 1)],
    [(f"<p>{S}</p>", 1)],
    [("<div class='content has-tabs'><p>Just text</p></div>", 1)],
    [("<div><a href='/'>Home</a></div><div><a href='/s'>Sign in</a></div>", 0), (f"<div>{L}</div><div>{S}.</div>", 1), ("<div>Imprint</div>", 0)],
]
