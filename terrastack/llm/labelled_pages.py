"""Pages whose main text is marked, from which the weights of html_extract are learned: data-main stands on the elements of the article.

Written for this purpose, one for each common layout: article and main elements, content divisions with and without telling names, tables, bare markup, lists.
"""

WORDS = "The river rose again in the night and by morning the lower road was under water , so the carrier turned back at the mill and left the letters with the smith ."
LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "Home News Sport Weather Travel Money Music Science".split())
MORE = "".join(f'<li><a href="/s/{i}">{w} and what came after it that day</a></li>' for i, w in enumerate("Floods Markets Harvest Elections Trains".split()))
TEXT = f"<p data-main>{WORDS}</p><p data-main>Nobody there had seen the like. <a href='/mill'>The mill</a> stood empty, {WORDS}</p><p data-main>{WORDS} {WORDS}</p>"
POINTS = f"<ul data-main><li>First the bridge was closed to carts</li><li>Then <a href='/ford'>the ford</a> was marked with poles</li></ul><p data-main>{WORDS}</p>"
SHORT = "<p data-main>The road is open.</p>"

PAGES = [
    f"<html><head><title>t</title></head><body><nav><ul>{LINKS}</ul></nav><article><h1 data-main>High water at the mill</h1>{TEXT}</article><footer>All rights reserved.</footer></body></html>",
    f"<body><header>The Daily Paper</header><div>Weather today: rain, later fair, wind from the west.</div><main><h1 data-main>Road closed</h1>{TEXT}{POINTS}</main><aside>{MORE}</aside></body>",
    f"<body><div><a href='/'>Logo</a> <a href='/in'>Sign in</a> <a href='/up'>Register</a></div><article><h1 data-main>Open again</h1>{SHORT}</article><p>You are reading the free edition.</p></body>",
    f"<body><table><tr><td><ul>{LINKS}</ul></td><td><h2 data-main>Letters</h2>{TEXT}{TEXT}</td><td><ul>{MORE}</ul></td></tr></table><p>Copyright The Paper</p></body>",
    f"<body><div><ul>{LINKS}</ul></div><div><h1 data-main>Notes</h1>{TEXT}<h2 data-main>Later</h2>{POINTS}{TEXT}</div><div><h3>More</h3><ul>{MORE}</ul></div><div>Contact | Imprint</div></body>",
    f"<body><h1 data-main>Bare page</h1>{TEXT}{POINTS}{TEXT}<hr><p><a href='/a'>About</a> | <a href='/b'>Terms</a> | <a href='/c'>Privacy</a></p></body>",
    f"<body><div><span><a href='/'>Front</a></span> &gt; <span><a href='/n'>News</a></span></div><section><h1 data-main>A long report</h1>{TEXT}{TEXT}{TEXT}</section><ul>{MORE}</ul><ul>{LINKS}</ul></body>",
]
