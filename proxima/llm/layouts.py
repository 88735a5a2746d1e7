"""Labelled pages in the layouts of common publishing systems; blocks whose text holds a tick are main text.

Extraction trains on every other page of ``LAYOUTS``; the others are held out for its tests.  The words are invented,
the mark-up follows what such systems write: wrappers, widgets, tables, forms and lists around the text.
"""

from __future__ import annotations

_L = ("The council met on Tuesday evening to hear from residents about the plan to move the bus station, and more than sixty "
      "people stood up to say what the change would mean for their streets, their shops and their way to work.")
_L2 = ("Engineers who looked at the old mill last autumn found that the roof beams were sound but that water had come in along the "
       "north wall for many years, so the first task will be to dry the stones before any painting can begin.")
_M = "Work should begin in early spring, once the frost is out of the ground."
_M2 = "Tickets for the summer fair go on sale at the library next week."
_S = "A quiet start"
_NAV = "<ul><li><a href=/>Home</a></li><li><a href=/local>Local</a></li><li><a href=/sport>Sport</a></li><li><a href=/about>About</a></li></ul>"
_LINKS = f"<ul><li><a href=/1>{_M2}</a></li><li><a href=/2>{_M}</a></li><li><a href=/3>Ten walks near the river</a></li></ul>"

LAYOUTS = [
    # blog themes
    f"<body class='post-template single'><div id=page class='hfeed site'><header id=masthead class=site-header><p class=site-title><a href=/>The Valley Post</a></p><p class=site-description>News from the valley</p></header><nav class=main-navigation>{_NAV}</nav><div id=content class=site-content><div id=primary class=content-area><main id=main class=site-main><article id=post-12 class='post hentry'><header class=entry-header><h1 class=entry-title>{_S}✓</h1></header><div class=entry-content><p>{_L}✓</p><p>{_M}✓</p><h2>What next✓</h2><p>{_L2}✓</p></div></article></main></div><aside id=secondary class=widget-area><section class=widget><h2>Recent posts</h2>{_LINKS}</section></aside></div><footer class=site-footer>Proudly made with care</footer></div>",
    f"<div class='outer'><div class=navbar>{_NAV}</div><div class='blog-posts hfeed'><div class=post-outer><h3 class='post-title'>{_S}✓</h3><div class='post-body entry-content'><p>{_L}✓</p><p>{_M}✓</p><p>{_L2}✓</p></div></div></div><div class='sidebar section'><div class=widget><h2>Archive</h2>{_LINKS}</div></div><div class='footer'>Powered by letters</div></div>",
    f"<div id=wrapper><div id=header><h1><a href=/>Green Pages</a></h1></div><div id=main class=clearfix><div id=content><div class='node node-article'><h2>{_S}✓</h2><div class='field field-body'><p>{_L2}✓</p><p>{_L}✓</p><ul><li>bring a coat✓</li><li>bring a lamp✓</li></ul></div></div></div><div id=sidebar-first class='column sidebar'>{_LINKS}</div></div><div id=footer>All rights reserved</div></div>",
    f"<div class=mw-page-container><div class=vector-header>{_NAV}</div><div id=content class=mw-body role=main><h1 id=firstHeading>Old mill✓</h1><div id=mw-content-text><p>{_L2}✓</p><h2>History✓</h2><p>{_L}✓</p><p>{_M}✓</p></div></div><div id=mw-navigation><h2>Navigation menu</h2>{_NAV}</div><footer class=mw-footer><p>This page was last edited in May.</p></footer></div>",
    # one form around the page
    f"<body><form method=post action='./default.aspx' id=form1><input type=hidden name=state value=x><div class=top>{_NAV}</div><div id=ctl00_Body><h1>{_S}✓</h1><p>{_L}✓</p><p>{_L2}✓</p><p>{_M}✓</p></div><div class=bottom><a href=/terms>Terms of use</a> <a href=/privacy>Privacy</a></div></form></body>",
    f"<form id=aspnetForm action=/page.aspx><div id=Banner><a href=/>Town hall</a></div><table><tr><td><a href=/a>Bins</a><br><a href=/b>Parking</a></td><td><p>{_L2}✓</p><p>{_M2}✓</p><p>{_L}✓</p></td></tr></table></form>",
    # page builders
    f"<div class=elementor-section><div class=elementor-container><div class='elementor-widget elementor-widget-heading'><h1>{_S}✓</h1></div><div class='elementor-widget elementor-widget-text-editor'><div class=elementor-widget-container><p>{_L}✓</p><p>{_M}✓</p></div></div><div class='elementor-widget elementor-widget-text-editor'><p>{_L2}✓</p></div></div></div><footer>Call us any day</footer>",
    f"<div class='sqs-layout'><nav>{_NAV}</nav><div class='row sqs-row'><div class='sqs-block html-block'><div class=sqs-block-content><h2>{_S}✓</h2><p>{_L2}✓</p></div></div><div class='sqs-block html-block'><p>{_M}✓</p><p>{_L}✓</p></div></div></div><div class=newsletter-form><p>Sign up and get our letter every month, free of charge.</p></div>",
    f"<div class=wp-block-group><div class='wp-block-columns'><div class=wp-block-column><p>{_L}✓</p><p>{_L2}✓</p></div></div><div class='wp-block-buttons'><a class=button href=/join>Join us</a></div></div><div class='wp-block-latest-posts'>{_LINKS}</div>",
    f"<div class='framer-container'><header>{_NAV}</header><div class='rich-text'><h1>{_S}✓</h1><p>{_L}✓</p><p>{_M2}✓</p><p>{_L2}✓</p></div><footer><p>Made in the valley</p></footer></div>",
    # tables of old pages
    f"<table width=100%><tr><td colspan=2><font size=5>Valley Walkers</font></td></tr><tr><td width=150><a href=/w1>Walks</a><br><a href=/w2>Maps</a><br><a href=/w3>Huts</a></td><td><font face=arial><p>{_L2}✓</p><p>{_L}✓</p><p>{_M}✓</p></font></td></tr><tr><td colspan=2><a href=mailto:x>write to us</a></td></tr></table>",
    f"<center><a href=/>home</a> | <a href=/news>news</a> | <a href=/links>links</a></center><hr><h2>{_S}✓</h2><p>{_L}✓<p>{_M}✓<p>{_L2}✓<hr><center><a href=/>back to the first page</a></center>",
    # news sites
    f"<div class=app><header role=banner><a href=/>Daily</a></header><div role=navigation>{_NAV}</div><div class='layout has-sidebar'><article class=story><h1>{_S}✓</h1><div class='byline social-share'><a href=/x>Share</a></div><p>{_L}✓</p><div class='ad-slot'>Buy two chairs and the table is yours for half the price this week only</div><p>{_L2}✓</p><aside class=related><h3>Read also</h3>{_LINKS}</aside><p>{_M}✓</p></article><div class=sidebar>{_LINKS}</div></div></div>",
    f"<div id=cookie-consent><p>We and our partners keep small files on your machine to make the site work and to show you what may be of use to you.</p></div><div class=story-wrapper><h1>{_S}✓</h1><p>{_L2}✓</p><p>{_M2}✓</p><div class=newsletter><p>Get the day's news by mail each morning before six.</p></div><p>{_L}✓</p></div><section id=comments><h2>2 comments</h2><p>{_L}</p><p>I said so all along.</p></section>",
    f"<main><section><h1>{_S}✓</h1><p>{_M}✓</p></section><section><h2>Why now✓</h2><p>{_L}✓</p><table><tr><th>Year✓</th><th>Cost✓</th></tr><tr><td>1990✓</td><td>12✓</td></tr></table></section></main><footer>{_NAV}</footer>",
    f"<div class=topbar>Order by noon for next day</div><div class=content><div class=breadcrumbs><a href=/>Home</a> / <a href=/n>Notes</a></div><h1>{_S}✓</h1><p>{_L}✓</p><blockquote><p>{_M}✓</p></blockquote><p>{_L2}✓</p><div class=pager><a href=/p>Older</a> <a href=/q>Newer</a></div></div>",
    # documents, questions, lists
    f"<div class=book><div class=toc>{_NAV}</div><div class=chapter><h1>{_S}✓</h1><p>{_L}✓</p><pre>make all✓</pre><p>{_M}✓</p><dl><dt>key✓</dt><dd>{_M2}✓</dd></dl></div><div class=nav-links><a href=/c1>Chapter one</a> <a href=/c3>Chapter three</a></div></div>",
    f"<nav>{_NAV}</nav><div class=doc-content><h2>{_S}✓</h2><ol><li>{_M}✓</li><li>{_M2}✓</li></ol><p>{_L}✓</p></div><div class=feedback-form><form><p>Was this page of help to you?</p><button>Yes</button></form></div>",
    f"<div><a href=/>home</a> <a href=/faq>questions</a> <a href=/map>map of the site</a></div><p>{_L}✓</p><p>{_L2}✓</p><div><a href=/a>{_M}</a></div><div><a href=/b>{_M2}</a></div>",
    f"<div><a href=/>start</a></div><div>{_L2}✓</div><div>{_M}✓</div><div>{_L}✓</div><div><a href=/x>terms</a> <a href=/y>contact</a> <a href=/z>press</a></div>",
    f"<p><a href=/l1>News</a> <a href=/l2>Sport</a> <a href=/l3>Weather</a> <a href=/l4>Mail</a></p><p>{_L}✓ <a href=/in>more about the station✓</a> {_M}✓</p><p>{_L2}✓</p><p><a href=/n1>First</a> <a href=/n2>Last</a></p>",
    f"<div><a href=/h>home</a> <a href=/i>index</a></div><h2>{_S}✓</h2><div>{_L}✓</div><div>{_L2}✓ <a href=/mill>the mill✓</a></div><div>{_M}✓</div><div><a href=/j>jobs</a> <a href=/k>partners</a></div>",
]
