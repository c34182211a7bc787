"""Pages laid out by hand, which the labeller's generator has no part in: {0} is the heading, {1} to {3} are the text."""

TEXTS = [
    "Lighthouse keepers of the northern coast",
    "The last keeper left the island in the autumn of 1978, when the lamp was made automatic. For a hundred and twelve years before that, somebody had climbed the stairs each evening.",
    "Logbooks of the station are held in the county archive. They tell of storms, of ships that passed, and of the price of oil; most entries are a line long.",
    "Visitors can reach the tower at low tide. The path is marked with white stones, and the climb takes about ten minutes.",
]
P = "<p>{1}</p><p>{2}</p><p>{3}</p>"
H = "<h1>{0}</h1>"
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/a>Articles</a></li><li><a href=/c>Contact</a></li></ul>"
FOOT = "<p>&copy; 2019 Coast Press. All rights reserved.</p>"
SIDE = "<h4>Related</h4><ul><li><a href=/1>Harbours of the south</a></li><li><a href=/2>Fog signals</a></li></ul>"

LAYOUTS = {
    "col-8": f"<div class='container'><div class='row'><div class='col-8'>{H}{P}</div><div class='col-4'>{SIDE}</div></div></div><footer>{FOOT}</footer>",
    "col-md-8": f"<nav>{NAV}</nav><div class='container'><div class='row'><div class='col-md-8'>{H}{P}</div></div></div><footer>{FOOT}</footer>",
    "col-lg-9 offset": f"<header>{NAV}</header><div class='container-fluid'><div class='row'><div class='col-lg-9 offset-lg-1'>{H}{P}</div></div></div>",
    "col-xs-12 col-sm-6": f"<div class='row'><div class='col-xs-12 col-sm-6'>{H}{P}</div></div>",
    "grid numbers": f"<div class='grid_12'><div class='grid_8'>{H}{P}</div><div class='grid_4'>{SIDE}</div></div>",
    "columns": f"<div class='columns'><div class='column is-two-thirds'>{H}{P}</div><div class='column sidebar'>{SIDE}</div></div>",
    "w-full": f"<nav>{NAV}</nav><div class='max-w-3xl mx-auto px-4'><div class='flex flex-col'>{H}{P}</div></div><footer class='bg-gray-100 py-8'>{FOOT}</footer>",
    "hashed names": f"<div class='css-1x2y3z'><div class='sc-bdVaJa kZqWbN'>{H}{P}</div></div><footer class='css-9ab8c7'>{FOOT}</footer>",
    "plain div": f"<div>{H}{P}</div>",
    "section": f"<nav>{NAV}</nav><section>{H}{P}</section><footer>{FOOT}</footer>",
    "nested sections": f"<main><section><h1>{{0}}</h1><p>{{1}}</p></section><section><p>{{2}}</p><p>{{3}}</p></section></main><footer>{FOOT}</footer>",
    "left right": f"<div id='left'>{H}{P}</div><div id='right' class='sidebar'>{SIDE}</div>",
    "inner": f"<div id='page'><div id='inner'>{H}{P}</div></div><div id='footer'>{FOOT}</div>",
    "main-column": f"<div class='main-column'>{H}{P}</div><aside>{SIDE}</aside>",
    "post body": f"<div class='post'><h2 class='post-title'>{{0}}</h2><div class='post-body entry-content'>{P}</div></div><div id='comments'><p>Great read!</p><p>I was there last year.</p></div>",
    "role": f"<div role='navigation'>{NAV}</div><div role='main'>{H}{P}</div><div role='contentinfo'>{FOOT}</div>",
    "microdata": f"<div itemscope itemtype='http://schema.org/Article'><h1 itemprop='headline'>{{0}}</h1><div itemprop='articleBody'>{P}</div></div><footer>{FOOT}</footer>",
    "table cells": f"<table width=100%><tr><td width=150>{NAV}</td><td>{H}{P}</td></tr></table>",
    "table with footer": f"<table><tr><td colspan=2><a href=/>Coast Press</a></td></tr><tr><td class=menu>{NAV}</td><td>{H}{P}</td></tr><tr><td colspan=2 class=footer>{FOOT}</td></tr></table>",
    "font tags": "<center><font size=5>{0}</font></center><p><font face=arial>{1}</font><p><font face=arial>{2}</font><p><font face=arial>{3}</font>",
    "pre": "<h1>{0}</h1><pre>{1}</pre><pre>{2}</pre><pre>{3}</pre>",
    "pre in div": f"<nav>{NAV}</nav><div class='col-8'><h1>{{0}}</h1><pre>{{1}}</pre><p>{{2}}</p><p>{{3}}</p></div>",
    "no wrapper": f"{H}{P}",
    "breaks and divs": "<div class='txt'><h1>{0}</h1><div>{1}</div><div>{2}</div><div>{3}</div></div>",
    "list article": f"<header><a href=/>Coast Press</a></header><main>{H}<p>{{1}}</p><ul><li>{{2}}</li><li>{{3}}</li></ul></main>",
    "quote": f"<article>{H}<p>{{1}}</p><blockquote>{{2}}</blockquote><p>{{3}}</p></article><footer>{FOOT}</footer>",
    "definition list": f"<nav>{NAV}</nav><main>{H}<dl><dt>{{1}}</dt><dd>{{2}}</dd></dl><p>{{3}}</p></main>",
    "cookie bar": f"<div class='cookie-banner'><p>We use cookies to improve your visit.</p><button>OK</button></div><div class='col-sm-9'>{H}{P}</div>",
    "advert inside": "<div class='col-8'><h1>{0}</h1><p>{1}</p><div class='ad'><p>Buy sturdy boots now.</p></div><p>{2}</p><p>{3}</p></div>",
    "share bar": f"<article>{H}<div class='share-buttons'><a href=x>Tweet</a> <a href=y>Share</a></div>{P}</article>",
    "newsletter form": f"<main>{H}{P}<form><label>Your address</label><input><button>Subscribe</button></form></main>",
    "wiki": f"<div id='mw-panel' class='navigation'>{NAV}</div><div id='content' class='mw-body'><h1 id='firstHeading'>{{0}}</h1><div id='bodyContent' class='mw-body-content'>{P}</div></div><div id='footer'>{FOOT}</div>",
    "forum comments": f"<div class='story'>{H}{P}</div><ol class='commentlist'><li>Thanks for this.</li><li>First!</li></ol>",
    "docs": f"<div class='toc sidebar'><ul><li><a href=#a>Intro</a></li><li><a href=#b>Usage</a></li></ul></div><div class='document'><div class='body'>{H}{P}</div></div>",
    "amp": f"<header class='header'><a href=/>Press</a></header><div class='wrap'><div class='lede'>{H}</div><div class='copy'>{P}</div></div><footer>{FOOT}</footer>",
}


def filled(layout: str) -> str:
    for i, text in enumerate(TEXTS):
        layout = layout.replace(f"{{{i}}}", text)
    return f"<html><head><title>Coast Press</title></head><body>{layout}</body></html>"
