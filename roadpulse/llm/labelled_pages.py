"""Small labelled pages to train the extraction model on.

Written for this purpose. `data-main="1"` marks an element whose content is
main text, `data-main="0"` one within it that is not; children inherit. The
marks are taken out before features are made.
"""

_SHELLS = [
    '<body><header><a href="/">{n}</a></header><nav><ul><li><a href="/a">{n}</a></li><li><a href="/b">{n}</a></li></ul></nav><main data-main="1"><h1>{h}</h1><p>{t}</p><p>{t}</p></main><aside><h3>{n}</h3><p>{s}</p></aside><footer>&copy; {n} <a href="/i">{n}</a></footer></body>',
    '<body><nav><a href="/a">{n}</a> <a href="/b">{n}</a></nav><div class="ad">{s}</div><article data-main="1"><h1>{h}</h1><p><b>{h}</b></p><p>{t}</p><p>{s}</p><p>{t} <a href="/x">{n}</a> {s}</p></article><footer>{s}</footer></body>',
    '<body><div id="header"><a href="/">{n}</a></div><div class="menu"><ul><li><a href="/a">{n}</a></li><li><a href="/b">{n}</a></li></ul></div><div id="content" data-main="1"><h2>{h}</h2><p>{t}</p><ul><li>{s}</li><li>{s}</li></ul><p>{t}</p></div><div class="sidebar"><p>{s}</p><ul><li><a href="/c">{n}</a></li></ul></div><div id="footer"><p>{s}</p></div></body>',
    '<body><div class="cookie-notice"><p>{s}</p><button>{n}</button></div><div class="post" data-main="1"><h1>{h}</h1><p>{t}</p><blockquote><p>{t}</p></blockquote><div class="share" data-main="0"><a href="/f">{n}</a></div><p>{s}</p></div><div class="comments"><h3>{n}</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{s}</p></div></div></body>',
    '<body><header><h2>{n}</h2><form><input name="q"><button>{n}</button></form></header><section class="story" data-main="1"><h1>{h}</h1><p>{t}</p><table><tr><td>{s}</td><td>{s}</td></tr></table><pre>{t}</pre><div class="advert" data-main="0"><p>{s}</p></div></section><section id="comments"><p>{t}</p><form><textarea>{n}</textarea></form></section><footer><p>{s}</p></footer></body>',
    '<body><div class="banner promo"><p>{s}</p></div><article data-main="1"><header><h1>{h}</h1></header><p>{t}</p><figure><img src="a"><figcaption>{s}</figcaption></figure><p>{t}</p><aside class="related" data-main="0"><h4>{n}</h4><ul><li><a href="/r">{n}</a></li></ul></aside><p>{t}</p><footer data-main="0"><a href="/t">{n}</a></footer></article><div class="newsletter"><form><label>{n}</label></form></div></body>',
    '<body><div class="top-bar"><span>{n}</span></div><div class="wrapper"><div class="left-nav"><a href="/a">{n}</a><a href="/b">{n}</a></div><div class="entry-content" data-main="1"><h1>{h}</h1>{t}<p>{t}</p><p><i>{s}</i> {t}</p></div></div><div class="legal"><p>{s}</p></div></body>',
    '<body><nav><ul><li><a href="/a">{n}</a></li></ul></nav><article data-main="1"><h1>{h}</h1><p>{s}</p></article><footer>&copy; {n} &middot; {t}</footer></body>',
    '<body><div class="ad">{t}</div><article data-main="1"><h1>{h}</h1><p>{t}</p><div><p>{t}</p></div><ol><li>{t}</li></ol></article><div class="ads"><p>{t}</p></div><footer>{t}</footer></body>',
    # Text in the page itself, in forms and tables around it, in boxes that say nothing.
    '<body data-main="1"><h1>{h}</h1><p>{t}</p><p>{t}</p><p>{t}</p></body>',
    '<body data-main="1"><div class="nav" data-main="0"><a href="/a">{n}</a> <a href="/b">{n}</a></div><h1>{h}</h1><p>{t}</p><p>{t} <b>{s}</b></p><ul><li>{s}</li></ul><p>{t}</p><div class="footer" data-main="0">{s}</div></body>',
    '<body><form id="f1" action="x"><div class="menu"><a href="/a">{n}</a></div><div class="c7" data-main="1"><h1>{h}</h1><p>{t}</p><p>{t}</p></div><div id="footer"><p>{s}</p></div></form></body>',
    '<body data-main="1"><center><h2>{h}</h2></center><p>{t}<p>{t}<hr><p data-main="0"><a href="/i">{n}</a> <a href="/j">{n}</a></p></body>',
    '<body><table><tr><td><a href="/a">{n}</a><br><a href="/b">{n}</a></td><td data-main="1"><h1>{h}</h1><p>{t}</p><p>{t}</p><p>{s}</p></td></tr></table></body>',
    '<body><div class="x1"><div class="k"><a href="/">{n}</a></div><div class="w2" data-main="1"><h2>{h}</h2><p>{t}</p><p>{t}</p></div></div><div class="k"><a href="/c">{n}</a><a href="/d">{n}</a></div></body>',
    '<body><div class="a b" data-main="1"><p>{t}</p><p>{t}</p></div></body>',
    '<body><div class="q9" data-main="1"><h1>{h}</h1><p>{t}</p></div></body>',
    # Long paragraphs that are none of it.
    '<body><main data-main="1"><article><h1>{h}</h1><p>{t}</p></article><section id="comments" data-main="0"><h2>{n}</h2><article class="comment"><p>{t}</p></article><article class="comment"><p>{t}</p><p>{t}</p></article></section></main></body>',
    '<body><article data-main="1"><h1>{h}</h1><p>{t}</p></article><div id="respond"><article class="comment reply"><p>{t}</p></article><ol><li class="comment"><p>{t}</p></li></ol></div></body>',
    '<body><div class="sidebar"><p>{t}</p><p>{t}</p></div><main data-main="1"><h1>{h}</h1><p>{t}</p></main><div class="promo"><p>{t}</p><p>{t}</p></div></body>',
    '<body><article data-main="1"><h1>{h}</h1><p>{t}</p></article><div class="comments"><div class="comment"><p>{t}</p><p>{t}</p></div><div class="comment"><p>{t}</p></div></div></body>',
    '<body><div class="post" data-main="1"><h2>{h}</h2><p>{t}</p><p>{t}</p></div><section class="discussion"><div><p>{t}</p></div><div><p>{t}</p><p>{t}</p></div></section><footer><p>{t}</p><p>{t}</p></footer></body>',
]

_WORDS = "the river carries old boats past quiet towns where people trade bread wool and stories every autumn before snow closes".split()


def _text(n: int, seed: int) -> str:
    chosen = [_WORDS[(seed * 7 + i * 5 + i * i) % len(_WORDS)] for i in range(n)]
    return " ".join(chosen).capitalize() + "."


def labelled_pages() -> list[str]:
    """Each shell with short, middling and long texts."""
    pages = []
    for i, shell in enumerate(_SHELLS):
        for k, (short, long) in enumerate([(2, 12), (6, 40), (12, 90), (9, 6)]):
            seed = 4 * i + k
            parts = {"n": _text(1 + k % 2, seed), "h": _text(4 + k, seed + 1), "s": _text(short, seed + 2), "t": _text(long, seed + 3)}
            pages.append("<!DOCTYPE html><html><head><title>{h}</title><script>var a;</script><style>p{{}}</style></head>".format(**parts) + shell.format(**parts) + "</html>")
    return pages
