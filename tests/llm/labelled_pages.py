"""Hand-labelled pages of layouts written independently of the training generator.

``¶`` stands before every block that belongs to the main text; it is taken out before extraction.
"""

PAGES = [
    "<h1>¶Notice</h1><p>¶Shop closed today.</p>",
    "<p>¶The library will reopen on Monday at nine.</p>",
    "<html><body><h2>¶Lost cat</h2>¶Grey, answers to Tom. Call the bakery.<br><br>¶</body></html>".replace("<br><br>¶", ""),
    """<div id="page"><div class="topbar"><a href="/">Daily Herald</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div><div id="story">
    <h1>¶Council approves new bridge over the river</h1><p class="byline">¶By Anna Stone, 3 May</p><p>¶The city council voted nine to two on
    Tuesday to build a second bridge, ending a debate that had lasted eleven years.</p><p>¶Work will begin in spring and is expected to take
    three years.</p><p>¶Residents of the old harbour had asked for a tunnel instead.</p></div><div class="related"><h3>Related</h3><ul><li>
    <a href="/1">Harbour plans</a></li><li><a href="/2">Bridge costs rise</a></li></ul></div><div id="comments"><p>Waste of money, says Bob.</p>
    <p>Finally! I can walk to work.</p></div><div id="footer">Copyright Daily Herald. Terms of use</div></div>""",
    """<div id="mw-head"><ul><li><a href=/r>Read</a></li><li><a href=/e>Edit</a></li><li><a href=/h>View history</a></li></ul></div>
    <div id="content"><h1 id="firstHeading">¶Otter</h1><div id="bodyContent"><p>¶Otters are <a href=/m>carnivorous mammals</a> in the
    subfamily <i>Lutrinae</i>. The 13 extant species are all semiaquatic.</p><ul><li>¶Sea otter, found along the
    <a href=/p>Pacific coast</a></li><li>¶Giant otter of South America</li></ul><p>¶Their play includes sliding down
    muddy banks into the water.</p></div></div><div id="mw-panel"><ul><li><a href=/x>Main page</a></li><li><a href=/y>Random article</a></li></ul></div>""",
    """<h1>¶How do I sharpen a plane iron?</h1><div class="post"><p>¶Mine came with a nick and no matter what I do it will not take an edge.</p></div>
    <div class="post"><p>¶Start with a coarse stone until the nick is gone, then move up. It takes patience, not force.</p></div>""",
    """<nav><a href=/>Home</a><a href=/blog>Blog</a></nav><main><h1>¶Why I moved back to paper</h1><p>¶For ten years my notes lived in
    three different apps.</p><p>¶None of them survived a change of phone.</p></main><footer><p>Written with love. All rights reserved.</p></footer>""",
    """<body><table width=760><tr><td><a href=a.htm>Home</a><br><a href=b.htm>Links</a><br><a href=c.htm>Guestbook</a></td><td>
    <h2>¶My model railway</h2><p>¶I started with a single oval of track in 1978 and a second hand engine.</p><p>¶The layout now fills the attic,
    and my wife has stopped asking about it.</p></td></tr></table></body>""",
    """<header><div class="logo">Kitchen Notes</div><nav><ul><li><a href=/r>Recipes</a></li><li><a href=/t>Tips</a></li></ul></nav></header>
    <article class="recipe"><h1>¶Lentil soup</h1><p>¶A warm bowl for a wet evening.</p><h2>¶Ingredients</h2><ul><li>¶200 g red lentils</li>
    <li>¶1 onion, chopped</li><li>¶2 carrots</li></ul><h2>¶Method</h2><ol><li>¶Fry the onion until soft.</li><li>¶Add the rest and simmer for
    twenty minutes.</li></ol></article><aside class="sidebar"><h3>Popular</h3><a href=/q>Ten quick dinners</a></aside>
    <footer>&copy; 2020 Kitchen Notes</footer>""",
    """<div class="cookie-banner"><p>We use cookies to improve our service.</p><button>Accept</button></div><section class="content"><h1>¶Trains to run
    hourly</h1><p>¶From December the line between the two towns will be served every hour, the operator said.</p></section>""",
    """<h1>¶Release notes 2.4</h1><p class="lead">¶This version fixes crashes on start and adds a dark theme.</p><div class="body"><h3>¶Fixed</h3><ul>
    <li>¶Crash when the settings file is missing</li><li>¶Wrong date in exports</li></ul><h3>¶Known issues</h3><p>¶Printing from the preview is
    slow on some machines.</p></div><div class="share-buttons"><a href=/f>Share</a> <a href=/t>Tweet</a></div>""",
    """<div class="wrapper"><div class="menu"><a href=/1>Start</a><a href=/2>About us</a><a href=/3>Contact</a></div><div class="main"><p>¶Our
    workshop repairs violins, violas and cellos. We work by appointment only.</p><p>¶Please bring the bow as well.</p></div></div>""",
    """<ul class="breadcrumb"><li><a href=/>Home</a></li><li><a href=/g>Guides</a></li></ul><article><header><h1>¶Growing tomatoes on a balcony</h1></header>
    <p>¶Choose a pot of at least ten litres.</p><div class="ad">Sponsored: garden tools at half price</div><p>¶Water in the morning, never on
    the leaves.</p><figure><img src=t.jpg><figcaption>¶A ripe truss in August.</figcaption></figure></article>""",
    """<article><h1>¶The long walk</h1><p>¶He closed the gate behind him. The dog did not follow.</p><p>¶At the crossroads he turned left, as
    he had every day for forty years.</p><blockquote><p>¶All roads lead somewhere, his mother used to say.</p></blockquote></article>
    <section class="comments"><h2>3 comments</h2><div class="comment"><p>Lovely story, thank you.</p></div><div class="comment"><p>I cried at the end.
    </p></div></section>""",
    """<div role="navigation"><a href=/a>Docs</a> <a href=/b>API</a> <a href=/c>Community</a></div><div class="document"><h1>¶Installing</h1><p>¶Download
    the archive and unpack it anywhere.</p><pre>¶tar xf tool.tar && ./tool --init</pre><p>¶The first run creates a configuration file in your home
    folder.</p></div><div class="footer">Built with care. Last updated in June.</div>""",
    """<div id="nav"><ul><li><a href=/>Startseite</a></li><li><a href=/k>Kontakt</a></li><li><a href=/i>Impressum</a></li></ul></div><div id="inhalt">
    <h1>¶Wanderung zum Gipfel</h1><p>¶Der Weg beginnt hinter der Kirche und führt durch einen lichten Wald bergauf.</p><p>¶Nach zwei Stunden
    erreicht man die Hütte, in der es auch Suppe gibt.</p></div><div id="fuss">Alle Rechte vorbehalten</div>""",
    """<nav class="menu"><a href=/>Inicio</a><a href=/n>Noticias</a></nav><div class="noticia"><h1>¶El mercado abre de nuevo</h1><p>¶Tras dos años de
    obras, el mercado central vuelve a recibir clientes este sábado.</p><p>¶Los vendedores esperan una gran afluencia.</p></div>
    <footer>Aviso legal. Política de privacidad</footer>""",
    """<header class="masthead">Le Petit Journal</header><div class="article"><h1>¶La bibliothèque fête ses cent ans</h1><p>¶Une exposition retrace
    l'histoire du bâtiment depuis sa construction.</p></div><aside><h4>Les plus lus</h4><ul><li><a href=/1>Météo du week-end</a></li></ul></aside>""",
    """<div class="thread"><h1>¶Bread will not rise</h1><div class="message"><div class="username">¶floury_hands</div><p>¶Third loaf this week that came out
    flat. Same yeast as always.</p></div><div class="message"><div class="username">¶old_baker</div><p>¶Check the date on the yeast and the
    temperature of the water.</p></div><div class="message"><div class="username">¶floury_hands</div><p>¶It was the water. Thanks!</p></div></div>""",
    """<form class="search"><label>Search the site</label><input><button>Go</button></form><main><article><h1>¶Annual report</h1><table><tr><th>¶Year</th>
    <th>¶Members</th></tr><tr><td>¶2018</td><td>¶412</td></tr><tr><td>¶2019</td><td>¶455</td></tr></table><p>¶Membership grew for the fifth year in
    a row.</p></article></main>""",
    """<main><h1>¶Frequently asked questions</h1><dl><dt>¶When do you open?</dt><dd>¶At ten, except on Sundays.</dd><dt>¶Can I bring a dog?</dt><dd>¶Yes,
    on a lead.</dd></dl></main><footer><a href=/p>Privacy</a> <a href=/t>Terms</a></footer>""",
    """<div class="container"><div class="row"><div class="col-8"><h1>¶A week on the canal</h1><p>¶We hired the boat in Braunston and had no idea how a
    lock works.</p><p>¶By Thursday we could do a flight of five without shouting.</p></div><div class="col-4 sidebar"><h3>Tags</h3><a href=/b>boats</a>
    <a href=/h>holidays</a></div></div></div>""",
    """<h1>¶Minutes of the meeting</h1><p>¶Present: eight members.</p><p>¶The treasurer's report was accepted.</p><p>¶The next meeting is on 4 June.</p>
    <div class="footer">Village hall committee, contact us</div>""",
    """<nav><a href=/>Home</a></nav><h1>¶Page under repair</h1><p>¶We are moving to a new server. Please come back tomorrow.</p>""",
    """<div class="post-content"><p>¶I promised photos of the new kitchen, so here they are.</p><p>¶The tiles come from a demolished dairy.</p></div>
    <div class="newsletter"><p>Subscribe to our newsletter</p><input><button>Sign up</button></div><div class="replies"><p>Where did you get the tap?</p></div>""",
    """<section><h2>¶Opening hours</h2><p>¶Monday to Friday: 8 to 18</p><p>¶Saturday: 9 to 13</p></section><nav><a href=/>Home</a> <a href=/s>Services</a></nav>""",
    """<div class="advert">Buy now and save 20 percent today</div><div class="text"><h1>¶Storm damages pier</h1><p>¶Waves of up to six metres tore planks from
    the northern end of the pier on Sunday night.</p><p>¶Nobody was hurt.</p></div><div class="advert">Limited offer: umbrellas</div>""",
    """<div class="content"><h1>¶Chess club results</h1><p>¶Round four was played on Friday.</p><ol><li>¶Marta Klein 4 points</li><li>¶Jo Adams 3 points</li>
    <li>¶Lee Wong 2.5 points</li></ol></div><div class="social"><a href=/f>Facebook</a><a href=/i>Instagram</a></div>""",
    """<article><p>¶In the beginning there was a shed.</p><p>¶It leaned to the east, and every winter it leaned a little more.</p></article><div id="disqus">
    <p>Posted by Kim: mine fell over last year</p></div><footer>Powered by a small server in a cupboard. Sitemap</footer>""",
    """<header><h1><a href=/>The Bird Blog</a></h1><nav><a href=/a>Archive</a><a href=/b>About</a></nav></header><div class="entry"><h2>¶Swifts are back</h2>
    <p>¶The first pair arrived over the church on 2 May, a day earlier than last year.</p></div><footer>Subscribe by feed</footer>""",
    """<body><div>¶Dear neighbours,</div><div>¶the water will be turned off on Thursday from eight to noon.</div><div>¶Yours, the caretaker</div></body>""",
    """<div class="alert">Please log in to save this page</div><article class="story"><h1>¶Ferry timetable changes</h1><p>¶The last boat now leaves at
    21:40.</p><p>¶Bicycles travel free before seven.</p></article>""",
    """<div id="header"><img src=l.png>Mountain Rescue</div><div id="menu"><a href=/>Home</a><a href=/t>Team</a><a href=/d>Donate</a></div><div id="text">
    <h2>¶Call-out 31</h2><p>¶Two walkers were reported overdue on the north ridge at dusk.</p><p>¶They were found cold but well at half past
    two.</p></div><div id="bottom">Registered charity. All rights reserved</div>""",
    """<main><div class="product"><h1>¶Oak stool</h1><p>¶Turned by hand from a single board, finished with oil.</p><ul><li>¶Height 45 cm</li><li>¶Weight 3 kg
    </li></ul></div></main><div class="recommended"><h3>You may also like</h3><a href=/c>Ash chair</a><a href=/t>Pine table</a></div>""",
    """<nav><ul><li><a href=/1>Chapter 1</a></li><li><a href=/2>Chapter 2</a></li></ul></nav><div class="chapter"><h2>¶Chapter 2</h2><p>¶"You are late," said
    the clockmaker, without looking up.</p><p>¶"The bridge was out," I said.</p><p>¶"The bridge," he said, "is always out."</p></div>""",
    """<div class="layout"><main class="page-content"><h1>¶Terms used in weaving</h1><h3>¶Warp</h3><p>¶The threads held in tension on the loom.</p><h3>¶Weft</h3>
    <p>¶The thread drawn through them.</p></main><aside class="widget"><h3>Latest posts</h3><ul><li><a href=/d>Dyeing with onion skins</a></li></ul></aside></div>""",
    """<article class="press"><h1>¶Mill to close after 140 years</h1><p>¶The owners blamed energy prices and falling orders. All 86 employees were told on
    Monday.</p><aside class="ad"><p>Advertisement</p></aside><p>¶A buyer is still being sought for the building.</p></article>""",
    """<div class="question"><h1>¶Is rain water safe for fish?</h1><p>¶I have a butt of it and a small pond.</p></div><div class="answer"><p>¶Mostly yes, if the
    roof is clean and you add it slowly.</p></div><div class="answer"><p>¶Test the acidity first.</p></div><div class="footer">Help centre. Terms</div>""",
    """<section class="entry-content"><h1>¶Poem for a bus stop</h1><p>¶The seven is late,<br>the nine is full,<br>the rain has no timetable.</p></section>""",
    """<div class="gdpr">Your privacy matters. <a href=/s>Settings</a> <a href=/a>Agree</a></div><header class="site-header"><a href=/>Coast News</a></header>
    <main><h1>¶Lighthouse for sale</h1><p class="intro">¶It has no road, no mains water and the best view in the county.</p><div class="richtext"><p>¶The
    asking price has not been published.</p></div></main><footer class="site-footer"><a href=/i>Imprint</a></footer>""",
    """<div id="main"><h1>¶Bus 14 diverted</h1><p>¶Because of road works the bus will not stop at the market until Friday.</p></div>""",
    """<div class="header">City Museum</div><div class="story-body"><h1>¶Coins found in a field</h1><p>¶A farmer turned up a pot with 300 silver coins.</p><div class="share">
    <a href=/e>Email</a><a href=/p>Print</a></div><p>¶They will be shown from autumn on.</p></div>""",
    """<table><tr><td colspan=2>Welcome to Jim's homepage</td></tr><tr><td><a href=/f>Fishing</a><br><a href=/c>Cars</a></td><td><p>¶Last weekend I caught a pike of
    nine pounds in the gravel pit.</p><p>¶It went back, of course.</p></td></tr></table>""",
    """<article><h1>¶Letter to the editor</h1><p>¶Sir, your paper states that herons do not perch in trees. They do.</p><p>¶I enclose a photograph.</p><p>¶R. Hale
    </p></article><form><label>Your name</label><input><label>Your message</label><textarea></textarea><button>Send</button></form>""",
    """<nav><a href=/>Home</a><a href=/c>Courses</a></nav><div class="lesson"><h1>¶Lesson 3: fractions</h1><p>¶A fraction is a part of a whole.</p><p>¶Half of a
    cake is written as 1/2.</p><h2>¶Exercise</h2><p>¶Write three quarters as a fraction.</p></div><div class="pagination"><a href=/2>Previous</a><a href=/4>Next</a></div>""",
    """<div class="content"><p>¶Diese Seite beschreibt den Aufbau der Pumpe.</p><h2>¶Werkzeug</h2><ul><li>¶Schraubenschlüssel 13 mm</li><li>¶Dichtband</li></ul>
    <p>¶Vor Beginn den Strom abschalten.</p></div><div class="footer">Impressum und Datenschutz</div>""",
    """<h1>¶404</h1><p>¶There is nothing here.</p><p>¶Try the search or go back.</p>""",
    """<div class="top"><a href=/l>Login</a> <a href=/r>Register</a></div><div class="topic"><h2>¶Tent for two</h2><div class="post"><p>¶Which one survives a Scottish
    summer?</p></div><div class="post"><p>¶Any with a full fly and steel pegs.</p></div></div><div class="bottom">Forum software by volunteers</div>""",
    """<main><article><h1>¶Interview with a diver</h1><p>¶<b>How deep did you go?</b></p><p>¶Forty metres, on air, in the dark.</p><p>¶<b>Were you afraid?</b></p><p>¶Only
    on the way up.</p></article><section class="more-news"><h2>More news</h2><a href=/1>Harbour seal counts</a><a href=/2>Wreck mapped</a></section></main>""",
    """<div class="popup"><p>Sign up and get 10 percent off</p></div><div class="post"><h1>¶Mending a kettle</h1><p>¶The lid had lost its knob.</p><p>¶A cork and a
    screw did the job.</p></div><div class="comment-list"><h3>Comments</h3><ol><li><p>Clever!</p></li><li><p>Mine exploded, be careful.</p></li></ol></div>""",
    """<section class="hero"><h1>¶Seeds for short summers</h1><p>¶We grow everything we sell at 62 degrees north.</p></section><section><h2>¶How we test</h2><p>¶Every
    variety is sown three years in a row.</p></section><footer><ul><li><a href=/s>Shipping</a></li><li><a href=/k>Contact</a></li></ul></footer>""",
    """<div id="wrapper"><div id="sidebar"><h3>Categories</h3><ul><li><a href=/a>Astronomy</a></li><li><a href=/b>Books</a></li></ul></div><div id="post"><h1>¶Saturn in
    August</h1><p>¶Look low in the south after eleven.</p><p>¶A small telescope will show the rings.</p></div></div>""",
]
