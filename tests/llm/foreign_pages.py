"""Hand-labelled pages of structures that the page generator does not know: blocks to keep, and blocks to leave out."""

PAGES = [
    # a table layout of the nineties
    ("""<html><head><title>Tide tables</title></head><body bgcolor=white><table width=600><tr><td colspan=2><img src=logo.gif alt="x"><font size=1>Home | Charts | Contact us</font></td></tr>
    <tr><td width=120 valign=top><a href=a.html>Harbours</a><br><a href=b.html>Weather</a><br><a href=c.html>Books</a></td><td><font size=4><b>How the tide tables are made</b></font>
    <p>The height of the water is measured every ten minutes by a float in a stilling well beside the old customs quay.
    <p>From a year of such readings the pull of the moon and of the sun is worked out, and the curve is carried on for the next year.
    <p>Strong winds from the west can still raise the water by half a metre more than the table says.</td></tr>
    <tr><td colspan=2 align=center><font size=1>Copyright 1998 Harbour Office. All rights reserved.</font></td></tr></table></body></html>""",
     ["The height of the water is measured", "From a year of such readings", "Strong winds from the west"], ["Home | Charts", "Harbours", "Copyright 1998"]),
    # a documentation page: generic names, code and a definition list
    ("""<!doctype html><html><body><div class=wrap><div class=top><a href=/>Docs</a> <a href=/api>API</a> <a href=/blog>Blog</a> <a href=/login>Sign in</a></div><div class=col1><ul><li><a href=1>Install</a></li><li><a href=2>Configure</a></li><li><a href=3>Upgrade</a></li><li><a href=4>Troubleshoot</a></li></ul></div>
    <div class=col2><h1>Configure the scheduler</h1><p>The scheduler reads its settings from a single file in the home folder of the user that starts it.</p><pre>interval = 30\nretries = 4</pre><p>Changes take effect when the process receives a signal, so a restart is not needed in most cases.</p>
    <dl><dt>interval</dt><dd>Seconds between two runs of the same job, measured from the start of the first.</dd><dt>retries</dt><dd>How often a job that failed is started again before it is given up for good.</dd></dl></div><div class=bottom><a href=/t>Terms</a> <a href=/p>Privacy</a></div></div></body></html>""",
     ["The scheduler reads its settings", "Changes take effect when", "Seconds between two runs", "How often a job that failed"], ["Docs", "Install", "Troubleshoot", "Terms"]),
    # a news page with semantic elements, unquoted attributes and an embedded script
    ("""<html><body><header><a href=/>The Daily Lantern</a><nav><a href=/w>World</a><a href=/s>Sport</a><a href=/c>Culture</a></nav></header><script src=/a/b/>var p = "<p>not text</p>";</script><main><article><h1>Bridge over the estuary opens</h1><p class=byline>By Ana Ferreira</p><p>After eleven years of work the bridge between the two halves of the town was opened to walkers on Sunday morning.</p><p>Cars will have to wait until the spring, because the lamps and the noise barriers are not yet in place.</p><p>The mayor said that the ferry will go on running for at least two more years.</p></article><aside><h2>Most read</h2><ol><li><a href=/1>Ten beaches to visit</a></li><li><a href=/2>Why eggs cost more</a></li></ol></aside></main><footer>Subscribe | Imprint | Cookies</footer></body></html>""",
     ["After eleven years of work", "Cars will have to wait", "The mayor said that the ferry"], ["World", "Most read", "Ten beaches", "Subscribe", "not text"]),
    # a blog with machine-made class names and a cookie banner
    ("""<html><body><div class="x9f2"><p>We use cookies to give you the best experience.</p><button>Accept all</button></div><div class="a11 b7"><div class="q"><a href=/>mira bakes</a></div><div class="zz"><h2>Rye bread without a scale</h2><div class="p0">I stopped weighing flour the winter the battery of my kitchen scale died and no shop was open for days.</div><div class="p0">A cup of rye flour is heavier than a cup of wheat flour, so start with a little less water than you think you need.</div><div class="p0">Let the dough stand over night in a cold room and bake it when it has cracks the width of a finger.</div></div><div class="zq"><span>3 comments</span><form><input name=c><button>Send</button></form></div><div class="f1">Made with love &middot; RSS &middot; Archive</div></div></body></html>""",
     ["I stopped weighing flour", "A cup of rye flour is heavier", "Let the dough stand over night"], ["We use cookies", "3 comments", "Made with love"]),
    # an encyclopedia entry: sections, lists, a box beside the text
    ("""<html><body><div id=mw><div id=side><h3>Navigation</h3><ul><li><a>Main page</a></li><li><a>Random entry</a></li><li><a>Recent changes</a></li></ul></div><div id=content><h1>Common swift</h1><p>The common swift is a bird that spends most of its life in the air and lands only to breed.</p><h2>Food</h2><p>It feeds on flying insects, which it catches in its open beak, and drinks by skimming the surface of lakes.</p><ul><li>On warm evenings it hunts high above the roofs of the town, often in screaming groups.</li><li>In rain it leaves the area altogether and may fly several hundred kilometres around a storm.</li></ul><h2>Nest</h2><p>Both parents glue feathers and straw together with spit under the eaves of tall old houses.</p></div><div id=foot>This page was last edited on 3 May. Text is free to use.</div></div></body></html>""",
     ["The common swift is a bird", "It feeds on flying insects", "On warm evenings it hunts", "In rain it leaves the area", "Both parents glue feathers"], ["Main page", "Random entry", "last edited"]),
]

#: More pages, as (html, starts of the article's blocks, starts of all other blocks): precision and recall are taken over them.
MORE = [
    # a recipe with an ingredient list and a rating box
    ("""<body><div id=hd><a href=/>Plate & Spoon</a> <a href=/r>Recipes</a> <a href=/v>Videos</a></div><div id=bd><h1>Lentil soup with lemon</h1><p>This soup is ready in half an hour and tastes even better when it is warmed up on the second day.</p><ul><li>300 grams of red lentils, rinsed until the water runs clear</li><li>two onions, cut into fine cubes</li><li>the juice of one large lemon</li></ul><p>Fry the onions slowly in olive oil until they are golden, then add the lentils and a litre of stock.</p><p>Let it simmer for twenty minutes and stir in the lemon juice just before you serve it.</p></div><div class=rate>Rate this recipe</div><div class=more><a href=1>Pumpkin soup</a></div><div class=more><a href=2>Onion tart</a></div><div id=ft>Imprint | Privacy</div></body>""",
     ["Lentil soup with lemon", "This soup is ready", "300 grams of red", "two onions", "the juice of one", "Fry the onions slowly", "Let it simmer"], ["Plate & Spoon", "Rate this recipe", "Pumpkin soup", "Onion tart", "Imprint"]),
    # a government notice with a breadcrumb and a contact box
    ("""<html><body><div class="l-top"><span>City of Arnhall</span></div><div class="crumbs"><a>Start</a> &gt; <a>Traffic</a> &gt; Roadworks</div><div class="l-main"><h1>Closure of Mill Street from 4 to 19 May</h1><p>Between 4 and 19 May the city will renew the water main under Mill Street, and the street will be closed to cars.</p><p>People who live in the street can reach their garages from the north end on all days except for 11 May.</p><p>The number 6 bus will run through Station Road and stop in front of the library instead.</p></div><div class="l-right"><h3>Contact</h3><p>Roads office, room 12</p><p>Open Monday to Friday</p></div><div class="l-bot"><a>Accessibility</a> <a>Data protection</a></div></body></html>""",
     ["Closure of Mill Street", "Between 4 and 19 May", "People who live in the street", "The number 6 bus"], ["City of Arnhall", "Start", "Contact", "Roads office", "Open Monday", "Accessibility"]),
    # a science press release with a quote and a newsletter form
    ("""<body><ul class="n"><li><a href=/>News</a></li><li><a href=/e>Events</a></li><li><a href=/p>People</a></li></ul><div class="release"><h2>Old maps show how a delta moved</h2><p>By laying eighteen maps over one another, researchers have shown that the mouth of the river wandered by nine kilometres in two centuries.</p><blockquote>We had expected a slow drift, but most of the change happened in three single floods, said the geographer who led the work.</blockquote><p>The maps were drawn by the navy between 1780 and 1960 and have only recently been scanned.</p></div><form><label>Your e-mail</label><button>Sign up for our newsletter</button></form><div>Media contact</div></body>""",
     ["Old maps show how", "By laying eighteen maps", "We had expected a slow", "The maps were drawn"], ["News", "Events", "People", "Your e-mail", "Sign up for", "Media contact"]),
    # a manual page in preformatted and plain paragraphs
    ("""<body><center><a href=idx.html>Index</a> <a href=prev.html>Previous</a> <a href=next.html>Next</a></center><h1>Replacing the filter</h1><p>Switch the pump off and wait until the lamp on the front has gone out before you open the lid.</p><ol><li>Turn the ring to the left until the mark points to the notch, and lift the old filter out.</li><li>Rinse the housing with clean water; do not use soap or vinegar.</li><li>Set the new filter in with the arrow pointing up and close the ring hand-tight.</li></ol><p>If water drips from the lid after five minutes, the sealing ring is not seated well.</p><hr><center><a href=idx.html>Index</a></center><address>Pump works Ltd, 2004</address></body>""",
     ["Replacing the filter", "Switch the pump off", "Turn the ring to the left", "Rinse the housing", "Set the new filter", "If water drips"], ["Index", "Pump works"]),
    # a personal page without any container
    ("""<html><title>x</title><body><a href=/>start</a> - <a href=/photos>photos</a> - <a href=/guestbook>guestbook</a><h2>A week on the canal</h2>On the first morning we pushed off at six, because the locks open early and the water was as smooth as glass.<p>By noon we had passed nine locks, and the dog had fallen in twice without minding it at all.<p>We moored under poplars, ate bread and cheese on the roof, and listened to the frogs until it was dark.<p><small>last update: June</small> <small><a href=mailto:x>write to me</a></small></body></html>""",
     ["A week on the canal", "On the first morning", "By noon we had passed", "We moored under poplars"], ["start - photos", "last update"]),
    # a magazine with an advert in the middle of the text and a box of teasers
    ("""<body><div class=m1><div class=m2><a href=/a>Culture</a></div><div class=m2><a href=/b>Travel</a></div></div><div class=st><div class=hl>The last paper mill in the valley</div><div class=tx>Every Tuesday at four in the morning Josef Brandl lights the boiler that his grandfather bought second-hand in 1931.</div><div class=tx>It takes five hours until there is enough steam to turn the rollers, and he spends them sorting rags by hand.</div><div class=sp>Advertisement</div><div class=sp>New: the folding bike that fits under your desk. Order now!</div><div class=tx>Printers from eleven countries order from him, because nobody else still makes a sheet of that weight.</div></div><div class=ts><a href=/1>Why bridges sing</a></div><div class=ts><a href=/2>Ten walks for rainy days</a></div><div class=ts><a href=/3>The clockmaker of Lund</a></div></body>""",
     ["The last paper mill", "Every Tuesday at four", "It takes five hours", "Printers from eleven"], ["Culture", "Travel", "Advertisement", "New: the folding bike", "Why bridges sing", "Ten walks", "The clockmaker"]),
    # a help article with reader comments behind it
    ("""<body><div role=banner><a>Help centre</a></div><div role=main><h1>Why is my meter reading estimated?</h1><p>If we receive no reading from you by the end of the month, we estimate it from what you used in the same month a year ago.</p><p>You can replace an estimate at any time: send us a photo of the meter, and the next bill will be corrected.</p></div><div class=u><h4>14 replies</h4><div>Thanks, that helped me a lot</div><div>Still wrong on my bill, third month now</div><a>Show all replies</a></div><div role=contentinfo>Northern Power, all rights reserved</div></body>""",
     ["Why is my meter", "If we receive no reading", "You can replace an estimate"], ["Help centre", "14 replies", "Thanks, that helped", "Still wrong", "Show all", "Northern Power"]),
    # a museum page: table of opening hours around the text
    ("""<body><table><tr><td><a href=/>Museum of Locks and Keys</a></td><td><a href=/de>Deutsch</a></td><td><a href=/fr>Francais</a></td></tr></table><table><tr><td><h1>The thief's chair</h1><p>Built in 1702, the chair closes two iron bands around the arms of whoever sits down in it without turning a hidden screw.</p><p>It stood in the hall of a banker in Graz and is said to have caught three burglars and one uncle.</p></td></tr></table><table><tr><td>Tue-Sun</td><td>10 - 18</td></tr><tr><td>Tickets</td><td>from 6 euro</td></tr></table></body>""",
     ["The thief's chair", "Built in 1702", "It stood in the hall"], ["Museum of Locks", "Deutsch", "Francais", "Tue-Sun", "10 - 18", "Tickets", "from 6 euro"]),
    # a forum-like question page whose question is the article
    ("""<body><div class=bar><a>Questions</a><a>Tags</a><a>Users</a></div><div class=post><h1>How do I keep a clay pot from cracking in the kiln?</h1><div class=t>I dry my pots for a week on a wooden board, and still every third one cracks at the bottom during the first firing.</div><div class=t>The walls are about six millimetres thick, the base is a little thicker, and I heat the kiln by eighty degrees an hour.</div></div><div class=side><div>Related</div><div><a>Which glaze for stoneware?</a></div><div><a>Cone 6 or cone 10?</a></div></div><div class=foot><a>Privacy</a> <a>Terms</a> <a>Contact</a></div></body>""",
     ["How do I keep a clay", "I dry my pots", "The walls are about six"], ["Questions", "Related", "Which glaze", "Cone 6 or", "Privacy"]),
    # an obituary in a newspaper with share buttons and a subscription notice
    ("""<body><div><a href=/>The Westmoor Post</a></div><div><a href=/n>News</a> | <a href=/o>Opinion</a> | <a href=/b>Obituaries</a></div><div><h1>Edith Marlowe, who counted the herons, dies at 91</h1><div>Share</div><div>Print</div><p>For sixty-two years Edith Marlowe walked the same eleven miles of river bank every April and wrote down each nest she saw.</p><p>Her notebooks, which fill four shelves, became the longest unbroken record of herons in the country.</p><p>She is survived by a sister and by the colony at Ferry Wood, which this spring counted ninety-four nests.</p></div><div>You have read 2 of 5 free articles</div><div>Subscribe from 1 a week</div></body>""",
     ["Edith Marlowe, who counted", "For sixty-two years", "Her notebooks", "She is survived by"], ["The Westmoor Post", "News", "Share", "Print", "You have read 2", "Subscribe from"]),
]
