"""Toxicity and page text: held-out accuracy, planted cases, odd rows."""

import zlib

from collections import Counter

import numpy as np

from barwright.llm import html_text, toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    pos = y.sum()
    return (rank[y > 0].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_held_out_documents_of_the_larger_table(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    own = toxicity.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    own = own[own["held_out"] & own["toxic"].notna()]
    y = own["toxic"].to_numpy(int)
    found = auc(own["score"].to_numpy(), y)
    assert y.sum() >= 60 and found >= 0.9, (y.sum(), found)


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    own = got.merge(labels.toPandas(), on="doc_id")
    own = own[own["held_out"] & own["toxic"].notna()]
    y = own["toxic"].to_numpy(int)
    found = auc(own["score"].to_numpy(), y)
    assert y.sum() >= 3 and found > 0.85, (y.sum(), found, own[["toxic", "score"]].to_numpy().tolist())
    # labels of held-out rows are never learned from
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scored(docs, turned).toPandas()
    assert np.allclose(got.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])


def test_disguised_words_are_restored(spark):
    words = "you are a stupid moron and nobody wants to read this hateful garbage from an idiot".split()
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(200)], "doc_id long, text string")
    lm = toxicity.language_model(docs)
    got = toxicity.restored(["you st0pid m0r0n", "such 1d1ot here", "a s-t-u-p-i-d one", "stuuuupid", "plain words stay as they are", "", "2024 and 3.14 remain"], lm)
    assert "moron" in got[0] and "idiot" in got[1] and "stupid" in got[2].replace(" ", "") and got[3] == "stupid"
    assert got[4:] == ["plain words stay as they are", "", "2024 and 3.14 remain"]


def test_decoding_against_every_reading():
    """Viterbi's reading is the likeliest of all readings of short stretches, and long stretches are decoded whole."""
    from itertools import product

    rng = np.random.default_rng(3)
    lm = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    at = {c: k + 1 for k, c in enumerate(toxicity.LETTERS)}

    def score(letters, cost):
        a = b = 0
        for c in letters:
            k = at.get(c, 0)
            cost, a, b = cost + float(lm[a, b, k]), b, k
        return cost + float(lm[a, b, 0])

    for w in ("m0r0n", "a$$", "1d1ot", "s.t4p", "xx0", "l!t"):
        options, before = [], ""
        for ch in w:
            o = [(ch, 0.0)] + ([("", -0.7)] if ch == before else []) if ch in at else [(c, -1.5) for c in toxicity.PICTURES.get(ch, "")] + [("", -1.0 if ch in toxicity.SEPARATORS else -3.0)]
            options.append(o)
            before = ch
        best = max(score("".join(c for c, _ in x), sum(s for _, s in x)) for x in product(*options))
        got = toxicity.decode(w, lm)
        reached = max(score("".join(c for c, _ in x), sum(s for _, s in x)) for x in product(*options) if "".join(c for c, _ in x) == got)
        assert abs(best - reached) < 1e-4
    long = "m0r0n" * 400
    assert len(toxicity.decode(long, lm)) <= len(long)


def test_repeated_ids_and_labels(spark):
    docs = spark.createDataFrame([(k, f"{'hateful idiot' if k % 2 else 'kind friend'} number {k} said so") for k in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 0) for k in range(60)] + [(1, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 120 and all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)


def test_disguises_open_windows(spark):
    words = "you are a stupid moron and nobody wants to read this hateful garbage from an idiot loser ass".split()
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 60))) for i in range(200)], "doc_id long, text string")
    lm = toxicity.language_model(docs)
    cases = {"m 0 r 0 n": "moron", "l 0 s 3 r": "loser", "i d 1 0 t": "idiot", "i   d   i   o   t": "idiot", "i . d . i . o . t": "idiot", "iiddiioott": "idiot", "a$$": "ass", "idio7": "idiot"}
    got = toxicity.restored([f"they called {c} there" for c in cases], lm)
    assert got == [f"they called {w} there" for w in cases.values()]
    same = ["coffee and balloons for the committee", "1 2 3 4 5 and 1.2.3.4", "he has a cat", "x"]
    assert toxicity.restored(same, lm) == same
    assert toxicity.windows(["s-t-u-p-i-d st0pid", "", "m0r0n"]) == [[(0, 11), (12, 18)], [], [(0, 5)]]


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 1), (4, 1, 0), (None, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for d, lab in ((odd, labels), (odd, labels.limit(0)), (odd, labels.where("toxic = 1")), (odd.limit(0), labels)):
        got = toxicity.scored(d, lab).collect()
        assert len(got) == d.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = '<p>x</p>';</script><style>p{}</style></head><body><header><p>Site name</p></header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p>First   paragraph with
a break &eacute;&#8212;and more words in it.</p><aside class="ad"><p>Buy now!</p></aside><p>Second one, which goes on for a while and ends here.</p></article><section class="comments"><p>Nice post!</p></section><footer><p>&copy; 2024 Someone</p></footer></body></html>"""


def test_article_without_the_rest(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    field = html_text.field_from([r["html"] or "" for r in pages.limit(150).collect()], 1500)  # as in production
    found = html_text.blocks(PAGE)
    text = "\n\n".join(b[2] for b, y in zip(found, field.decode(found), strict=True) if y)
    assert text == "A & B\n\nFirst paragraph with a break é—and more words in it.\n\nSecond one, which goes on for a while and ends here."
    held = html_text.made_pages(200, ["Some words that make up a line of text here.", "Short one", "Another line, with a comma and more of it to read."], seed=77)
    right = [int(a == b) for bs, ys in held for a, b in zip(field.decode(bs), ys, strict=True)]
    assert np.mean(right) > 0.95
    got, wanted, common, whole = 0, 0, 0, 0
    pages = list(layouts())
    for page, want in pages:
        found = html_text.blocks(page)
        main = [b[2] for b, y in zip(found, field.decode(found), strict=True) if y]
        got, wanted, common, whole = got + len(main), wanted + len(want), common + sum((Counter(main) & Counter(want)).values()), whole + (main == want)
    assert 2 * common / (got + wanted) >= 0.95 and whole >= 0.85 * len(pages), (2 * common / (got + wanted), whole, len(pages))
    got = wanted = common = 0
    for page, want in unseen():
        found = html_text.blocks(page)
        main = [b[2] for b, y in zip(found, field.decode(found), strict=True) if y]
        got, wanted, common = got + len(main), wanted + len(want), common + sum((Counter(main) & Counter(want)).values())
    assert 2 * common / (got + wanted) >= 0.95
    for page, want in pages[:9]:  # those that were lost once
        found = html_text.blocks(page)
        assert [b[2] for b, y in zip(found, field.decode(found), strict=True) if y] == want, page[:80]


def layouts():
    """Pages written by hand, of layouts without telling elements or class words."""
    line = "The committee met on Tuesday to discuss the new rules for the harbour, and most of its members agreed that they were late."
    article, two = f"<h1>Title here</h1><p>{line}</p><p>{line} {line}</p>", ["Title here", line, f"{line} {line}"]
    nav, foot, poem = "<nav><a href=/>Home</a> <a href=/n>News</a></nav>", "<footer><p>&copy; 2024 X</p></footer>", ["Poem", "Roses are red", "Violets are blue", "Sugar is sweet"]
    yield "<body><article><h1>Poem</h1><p>Roses are red</p><p>Violets are blue</p><p>Sugar is sweet</p></article>" + foot, poem
    yield f'<body><div class="xq7"><p>We use cookies on this site.</p></div><section><h2>Water</h2><p>{line}</p><p>{line}</p></section>{foot}', ["Water", line, line]
    yield f'<body><article>{article}</article><div id="reader-voices"><p>Great post, thanks a lot for it!</p><p>I do not agree with any of this.</p></div>', two
    yield f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div>{article}</div><div>&copy; 2024 X</div>", two
    yield f"<body><nav><a href=/>Home</a></nav><main>{line} {line}</main><footer>Contact</footer>", [f"{line} {line}"]
    yield f'<body><article>{article}</article><div id="disqus_thread"><p>Great post, thanks a lot for it!</p><p>I do not agree with this.</p></div>', two
    yield f'<body><article>{article}</article><section class="reader-replies"><p>{line}</p><p>I do not agree.</p></section>', two
    yield f"<body><table><tr><td><a href=/>Home</a></td><td><a href=/b>Boats</a></td></tr><tr><td><p>{line}</p></td></tr></table>", [line]
    yield f"<body><div/><article class=post/>{article}</article><footer>x</footer>", two
    yield f"<body>{nav}<div><div><h1>Title here</h1><div><p>{line}</p></div><div><p>{line} {line}</p></div></div></div>{foot}", two
    yield f"<body>{nav}<section><h1>Title here</h1><p>{line}</p><p>{line} {line}</p></section><section><h3>Related</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></section>{foot}", two
    yield f"<body>{nav}<main><h1>Poem</h1><div>Roses are red</div><div>Violets are blue</div><div>Sugar is sweet</div></main>{foot}", poem
    yield f"<body>{nav}<div id=k3><h1>Soup</h1><ul><li>Two onions</li><li>One leek</li><li>Salt</li></ul><p>{line}</p></div>{foot}", ["Soup", "Two onions", "One leek", "Salt", line]
    yield f"<body>{nav}<article>{article}<blockquote>{line}</blockquote><p>And so it ended.</p></article>{foot}", [*two, line, "And so it ended."]
    yield f'<body><header><h1>My site</h1><form><input name=q><button>Search</button></form></header><article>{article}</article><aside><h4>Newsletter</h4><p>Leave your address and we will write to you.</p></aside>', two
    yield f'<body><div class="zz"><p>{line}</p><p>{line} {line}</p></div><div class="yy"><a href=/1>One more story</a><a href=/2>Another story here</a></div>', two[1:]
    yield f"<body>{nav}<article><h1>Title here</h1><p>{line}</p><div class=ad><p>Buy the best boats now!</p></div><p>{line} {line}</p></article>{foot}", two
    yield f'<body><article>{article}</article><ol><li><b>anna</b> Lovely.</li><li><b>bert</b> I was there and it was late.</li></ol>{foot}', two
    yield f"<body><main><article>{article}</article><article class=comment><p>Nice one.</p></article><article class=comment><p>Thanks for this.</p></article></main>", two
    yield f'<body><div id="top"><ul><li><a href=/>Start</a></li><li><a href=/x>More</a></li></ul></div><div id="mid"><h2>Title here</h2><p>{line}</p><p>{line} {line}</p></div><div id="low"><p>Imprint</p><p>All rights reserved.</p></div>', two
    yield f"<body>{nav}<article><h1>Table</h1><p>{line}</p><table><tr><td>1999</td><td>Oslo</td></tr><tr><td>2003</td><td>Rome</td></tr></table></article>{foot}", ["Table", line, "1999", "Oslo", "2003", "Rome"]
    yield f"<body><dialog><p>Please accept our terms.</p><button>OK</button></dialog>{nav}<main><p>{line}</p></main>{foot}", [line]
    yield f"<body><article><header><h1>Title here</h1></header><p>{line}</p><p>{line} {line}</p><footer><p>Filed under boats</p></footer></article>", two[1:]
    yield f"<body>{nav}<pre>{line}\n{line}</pre>{foot}", [f"{line} {line}"]


def unseen():
    """Layouts written after the features were settled: they guided nothing."""
    a = "The ferry left the old pier at noon with forty people on board, and it came back before dark."
    b = "Nobody had asked for the bridge to be closed, but the engineers said that the cables needed a week of work."
    return [
        (f"<html><body><div id=wrap><div id=hd><a href=/>Logo</a></div><div id=bd><h1>Ferry</h1><p>{a}</p><p>{b}</p><ul><li>Forty people</li><li>One pier</li></ul></div><div id=ft>Contact us | Terms</div></div></body></html>", ["Ferry", a, b,"Forty people", "One pier"]),
        (f"<body><main><h1>Ferry</h1><p>{a}</p><h2>Why</h2><p>{b}</p></main><aside><p>More from this author</p></aside>", ["Ferry", a, "Why", b]),
        (f"<body><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><article><p>{a}<p>{b}</article><p>Copyright 2020</p>", [a, b]),
        (f"<body><section id=hero><h1>Welcome</h1></section><article><h2>Ferry</h2><p>{a}</p><figure><img src=x><figcaption>The pier at noon</figcaption></figure><p>{b}</p></article>", ["Ferry", a, "The pier at noon", b]),
        (f"<body><article><h1>Ferry</h1><p>{a}</p><p>{b}</p></article><h3>3 answers</h3><div class=u1><p>Was it really forty?</p></div><div class=u2><p>I counted thirty nine.</p></div><div class=u3><p>Thanks!</p></div>", ["Ferry", a, b]),
        (f"<body><div class=gdpr-x><p>This site stores data. <a href=/p>Privacy</a></p><button>Fine</button></div><article><h1>Ferry</h1><p>{a}</p><p>{b}</p></article>", ["Ferry", a, b]),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Haiku</h1><p>old pier at noon</p><p>a ferry leaves with forty</p><p>dark water waits</p></article><footer>x</footer>", ["Haiku", "old pier at noon", "a ferry leaves with forty", "dark water waits"]),
        (f"<body><table width=100%><tr><td colspan=2><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td><a href=/1>One</a><br><a href=/2>Two</a></td><td><h2>Ferry</h2><p>{a}</p><p>{b}</p></td></tr></table>", ["Ferry", a, b]),
        (f"<body><header><p>Daily paper</p></header><div class=c9><div class=c1><h1>Ferry</h1></div><div class=c2><p>{a}</p><p>{b}</p></div></div><div class=c4><h4>Most read</h4><a href=/1>{a}</a><a href=/2>{b}</a></div>", ["Ferry", a, b]),
        (f"<body><article><h1>Ferry</h1><p>{a}</p><blockquote><p>It was late.</p></blockquote><dl><dt>Pier</dt><dd>Where boats land</dd></dl><p>{b}</p></article><form><label>Name</label><input></form>", ["Ferry", a, "It was late.", "Pier", "Where boats land", b]),
    ]


def test_every_page_and_odd_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.extracted(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>cut <b"), (4, "u", "no tags at all"), (5, "u", "<" * 5000), (6, "u", "<div>" * 3000 + "deep"), (None, None, None), (7, "u", "</p></div><article><p>x"), (7, "u", "</p></div><article><p>x"), (8, "u", "<p>" + "long text. " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    assert html_text.extracted(df).count() == len(rows) and html_text.extracted(df.limit(0)).count() == 0


def test_hits_do_not_depend_on_the_texts_beside():
    used = np.ones(1 << toxicity.BITS, bool)
    texts = ["first words here", "! and others there.", "", "plain", "...", "one more?!", "x"]
    t, g = toxicity.hits(texts, used)
    assert t.min() >= 0
    for k, text in enumerate(texts):
        assert sorted(g[t == k].tolist()) == sorted(toxicity.hits([text], used)[1].tolist())
