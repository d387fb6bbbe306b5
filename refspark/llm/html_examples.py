"""Labelled pages for the HTML model: common layouts, filled with invented sentences. data-label marks an element and all within it."""

from __future__ import annotations

_LONG = (
    "The harbour was quiet that morning, and only two boats had left before the fog came in from the west. By noon the crews were back at the quay, mending nets and waiting for the wind to turn.",
    "Prices rose again in the spring, although the harvest had been better than anyone expected. Several growers said they would plant less next year, because the cost of storage had eaten most of the gain.",
    "She kept a notebook with the dates of every frost since 1961. When the museum asked for it, she made a copy by hand and gave them that instead.",
    "Water enters the upper lock through four culverts, each wide enough for a child to walk through. The gates are oak, and they are replaced about every thirty years.",
    "Nobody at the meeting could say who had signed the first agreement. The archive holds two drafts, and neither of them has a signature.",
)
_SHORT = ("It rained.", "Nothing changed for a year.", "He said no.", "Then the lights went out.", "A small note.")


def _p(k: int, n: int = 4) -> str:
    return "".join(f"<p>{(_LONG[(k + i) % 5] if i % 3 != 2 else _SHORT[(k + i) % 5])}</p>" for i in range(n))


def _links(n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{w}</a></{tag}>' for i, w in enumerate(("Home", "News", "About us", "Contact", "Archive", "Weather", "Jobs")[:n]))


def _page(body: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>A page</title><style>p{{margin:0}}</style><script>var a="<p>";</script></head><body>{body}</body></html>'


def _layout(k: int) -> str:
    head = '<h1>Fog over the harbour</h1>'
    body, other, third = _p(k), _LONG[(k + 1) % 5], _LONG[(k + 3) % 5]
    choices = [
        f'<nav data-label="0"><ul>{_links(6)}</ul></nav><div class="ad" data-label="0">{other}</div><article data-label="1">{head}{body}</article><footer data-label="0">&copy; example.com &middot; {third}</footer>',
        f'<header data-label="0"><div class="logo">Harbour News</div><p>{other}</p></header><div class="content" data-label="1">{head}{body}</div><aside class="sidebar" data-label="0"><h3>Related</h3><p>{third}</p><ul>{_links(4)}</ul></aside>',
        f'<div id="cookie-notice" data-label="0"><p>We use cookies. {other}</p><button>OK</button></div><main data-label="1">{head}{body}<ul><li>{_LONG[k % 5]}</li><li>{_SHORT[k % 5]}</li></ul></main><div class="footer" data-label="0"><p>{third}</p></div>',
        f'<div id="wrap"><div class="nav" data-label="0">{_links(5, "span")}</div><div class="post-body" data-label="1">{head}{body}<blockquote><p>{third}</p></blockquote></div><section class="comments" data-label="0"><h2>Comments</h2><div class="comment"><p>{other}</p></div><div class="comment"><p>I was there too. {third}</p></div></section></div>',
        f'<div class="menu" data-label="0"><ul>{_links(7)}</ul></div><article data-label="1">{head}{body}<aside data-label="0"><p>{other}</p></aside><div class="advert" data-label="0"><p>Buy boots now. {third}</p></div>{_p(k + 2, 2)}</article><form data-label="0"><label>Your address</label><p>{other}</p></form>',
        f'<table><tr><td class="sidebar" data-label="0"><ul>{_links(6)}</ul><p>{other}</p></td><td class="main" data-label="1">{head}{body}</td></tr></table><p class="copyright" data-label="0">Copyright. {third}</p>',
        f'<div><div data-label="1">{head}{body}</div></div><div data-label="0"><ul>{_links(6)}</ul></div><div class="newsletter" data-label="0"><p>{other}</p></div><div class="related" data-label="0"><p>{third}</p></div>',
        f'<div role="banner" data-label="0"><p>{other}</p></div><div role="navigation" data-label="0"><p>{_links(3, "b")}</p></div><div role="main" data-label="1">{head}{body}<pre>x = 1</pre></div><div role="complementary" data-label="0"><p>{third}</p></div><div role="contentinfo" data-label="0"><p>{other}</p></div>',
        f'<section class="story" data-label="1">{head}{body}<h2>Later</h2><p>{other}</p><div class="share" data-label="0"><p>{third}</p></div><table><tr><th>Year</th><td>1961</td></tr></table></section><div id="disqus_thread" data-label="0"><p>{third}</p><p>{other}</p></div><div class="popup" data-label="0"><p>{other}</p></div>',
        f'<article data-label="1"><header>{head}</header><section>{body}</section><nav data-label="0"><ol>{_links(4)}</ol></nav><section class="comments" data-label="0"><p>{other}</p><p>{third}</p></section><footer data-label="0"><p>{third}</p></footer></article><div class="alert" data-label="0">{other}</div><div class="sponsored" data-label="0"><p>{third}</p></div>',
    ]
    return _page(choices[k % len(choices)])


#: Pages of plain words without a tag are all content.
PLAIN = (
    "A page of plain words that nobody has marked up. It says all it has to say in one go, and a reader wants the whole of it.",
    "Notes of the meeting: the bridge is shut until spring, the ferry runs every hour, and the council will vote again in March.",
)
PAGES = tuple(_layout(k) for k in range(30)) + PLAIN
