"""Toxicity, language and HTML: held-out accuracy, and the odd cases."""

import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from massgrid.llm import html_text, langid, toxicity
from massgrid.llm.bytesops import text_bytes

WORDS = "the of and to in that with for on by this from they which".split()
BAD = "vileword nastyterm".split()


def corpus(spark, n=1500):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(WORDS) + rng.choice(("", "s", "ed")) for _ in range(rng.randint(5, 80))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(("", ",", "."))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "vileword", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark, empty):
    docs, labels = corpus(spark)
    rows = toxicity.classify(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) > 0.97 * len(held)
    by = {r.doc_id: r for r in rows}
    assert by[1500].score == by[1501].score < 0.5 <= by[1502].score
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 1503
    kept = toxicity.accepted(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)
    assert toxicity.classify(empty, labels).count() == 0
    none = toxicity.classify(docs, labels.where("false"))
    assert none.agg(F.max("score")).first()[0] == 0


def test_language(spark, empty):
    rng = random.Random(3)
    syllables = {"aa": "ka to mi ru sen", "bb": "sch ein ung ver hau", "cc": "que eau ment tion ré"}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang if i % 10 else None, lang))
    rows += [(600, None, "aa", "und"), (601, "12 34 !?", "bb", "und"), (602, "", None, "und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    models = langid.train(docs)
    out = langid.identify(docs, models).join(docs.select("doc_id", "truth"), "doc_id").collect()
    assert sum(r.lang_pred == r.truth for r in out) > 0.98 * len(out)
    assert all(r.score == 0 and r.lang_pred == "und" for r in out if r.doc_id >= 600)
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(empty, models).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.where("false"))).collect()} == {"und"}


def test_learning_by_the_plain_formula():
    """Every step of the classifier against the published per-coordinate update."""
    rng = np.random.default_rng(1)
    model, z, n = toxicity.Ftrl(0.5, 1.0, 0.3, 0.7), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.3:
            return 0.0
        return -(z[i] - math.copysign(0.3, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.7)

    for _ in range(300):
        at, label = np.unique(rng.integers(0, 20, 5)), int(rng.integers(0, 2))
        w = {int(i): weight(int(i)) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i, x in w.items():
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5
            z[i], n[i] = z.get(i, 0.0) + g - sigma * x, n.get(i, 0.0) + g * g
        model.learn(at, label)
    assert np.allclose(model.weights(np.arange(20)), [weight(i) for i in range(20)])


def test_bounded_samples(spark):
    docs, labels = corpus(spark, 400)
    assert len(toxicity.train(docs, labels, max_bytes=2000)[0]) < len(toxicity.train(docs, labels)[0])
    rows = [(i, "abc def " * 20, f"l{i % 40:02d}" if i % 2 else "zz") for i in range(900)]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20, max_bytes=2000, max_langs=5)
    assert len(models.names) <= 5 and "zz" in models.names


def test_cross_entropy_by_dictionaries():
    """Interpolated Kneser-Ney from dictionaries of strings, for two languages and texts with unseen letters."""
    corpora = {"aa": ["kato miru senka", "toka mika"], "bb": ["schung verhau", "einver hauung sch"]}
    texts = ["kato schung", "mika", "zzz senka vq", "h"]
    padded = lambda t: "   " + t

    def model(lines, size):
        top = Counter(padded(t)[i : i + 4] for t in lines for i in range(len(t)))
        counts = {4: top}
        for k in (3, 2, 1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        discount = {}
        for k, c in counts.items():
            ones, twos = (sum(v == x for v in c.values()) for x in (1, 2))
            discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5

        def chance(g):
            k = len(g)
            if not k:
                return 1 / size
            after = [v for h, v in counts[k].items() if h[:-1] == g[:-1]]
            if not after:
                return chance(g[1:])
            return max(counts[k][g] - discount[k], 0) / sum(after) + discount[k] * len(after) / sum(after) * chance(g[1:])

        return chance

    grams = lambda lines: langid.grams(*langid.symbols(*text_bytes(pa.array(lines))))
    models = langid.Models(sorted(corpora), [langid.Counts(grams(corpora[k])) for k in sorted(corpora)])
    size = 2 + len({c for lines in corpora.values() for t in lines for c in t})
    entropy, n = models.cross_entropy(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert n[i] == len(t)
        for j, name in enumerate(sorted(corpora)):
            chance = model(corpora[name], size)
            want = -sum(math.log(chance(padded(t)[k : k + 4])) for k in range(len(t))) / len(t)
            assert abs(entropy[i, j] - want) < 1e-5


def test_viterbi_against_all_labellings():
    rng = random.Random(2)
    for _ in range(200):
        field = html_text.Field({f: rng.uniform(-2, 2) for f in "abcd"}, np.array([[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]))
        features = [set(rng.sample("abcdef", rng.randint(0, 4))) for _ in range(rng.randint(1, 9))]

        def value(labels):
            own = sum(field.weights.get(f, 0.0) for fs, x in zip(features, labels) if x for f in fs)
            return own + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value(labels) for labels in itertools.product((0, 1), repeat=len(features)))
        assert abs(value(field.decode(features)) - best) < 1e-9


def test_chances_sum_to_one():
    text = "abracadabra abra cadabra"
    s = np.array([ord(c) for c in text], np.uint16)
    c = langid.Counts(langid.grams(s, np.array([0, len(s)])))
    size = 256
    for context in ("abr", "zzz", " ab"):
        head = sum(ord(x) << (16 * (3 - k)) for k, x in enumerate(context))
        keys = np.array([head | i for i in range(size)], np.uint64)
        assert abs(c.chance(keys, langid.ORDER, size).sum() - 1) < 1e-9


PAGES = [
    ('<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p><b>One\n  two<br><p>Three &lt;3.</article><footer>&copy; me</footer>', "A & B\nOne two\nThree <3."),
    ('<div class="cookie-notice">We use cookies on this site.</div><main><h1>Title of it</h1><p>A first sentence of prose, long enough to read.</p><p>And a second one that says more.</p></main><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>x</a></li></ul></div><div class="comments"><p>Great post, thanks!</p></div>', "Title of it\nA first sentence of prose, long enough to read.\nAnd a second one that says more."),
    (None, ""),
    ("", ""),
    ("<nav><a href=1>only a menu</a></nav><!-- never closed", ""),
]


def test_pages(spark):
    field = html_text.Field.trained(html_text.labelled_pages(html_text.TRAINING_PAGES))
    rows = spark.createDataFrame([(i, "u", p, "x") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(rows, field).collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert html_text.extract(rows.where("false"), field).count() == 0
    wrong = total = 0
    for page in html_text.labelled_pages(150, seed=77):
        blocks = html_text.leaf_blocks(page)
        labels = [html_text.MARK in b[0] for b in blocks]
        plain = [(b[0].replace(html_text.MARK, "").strip() or "-", b[1], b[2]) for b in blocks]
        wrong += sum(bool(a) != b for a, b in zip(field.decode(html_text.block_features(plain)), labels))
        total += len(blocks)
    assert wrong < 0.02 * total


def test_long_page_and_unclosed_quotes():
    page = "<article>" + "<p>word " * 3000 + '<a href="x>' * 50 + "</article>"
    blocks = html_text.leaf_blocks(page)
    assert len(blocks) >= 2999


BROKEN = ["<script ", "<a ", '<a "', "<!", "<", "<p class='<b>' ", "<div>x", '<x "<a\' \'" ', "<svg><title>", "&#9", "<p <"]


@pytest.mark.parametrize("unit", BROKEN)
def test_broken_pages_take_time_in_proportion(unit):
    start = time.monotonic()
    html_text.leaf_blocks(unit * (2_000_000 // len(unit)), {"tag:div"})
    assert time.monotonic() - start < 10


def test_deep_pages():
    start = time.monotonic()
    assert html_text.leaf_blocks("<div>" * 200_000 + "</p>" * 200_000 + "x" + "</div>" * 200_000)[0][0] == "x"
    assert time.monotonic() - start < 10


def test_references_beyond_all_characters():
    read = lambda page: html_text.leaf_blocks(page)[0][0]
    assert read("<p>a&#65;b&#" + "9" * 6000 + ";c&#" + "0" * 6000 + "66;d&#x43;</p>") == "aAb\ufffdcBdC"


def test_quotes_may_hold_signs():
    read = lambda page: [b[0] for b in html_text.leaf_blocks(page)]
    assert read('<p title="a > b">One</p><p data-x="<b>bold</b>" class=\'<\'>Two</p><p>3 < 4 <b>and</b> 5 > 4</p>') == ["One", "Two", "3 < 4 and 5 > 4"]


#: Layouts that no composed page has: tables as columns, a blog theme, documentation, a news page with definition lists.
UNSEEN = [
    ('<table><tr><td class="leftmenu"><a href=1>Start</a><br><a href=2>News</a></td><td class="maintext"><h1>Harbour reopens</h1><p>The harbour opened again on Monday after a long winter.</p><p>Ships may enter from the north.</p></td></tr></table><div id="footer">Copyright 2011</div>', "Harbour reopens\nThe harbour opened again on Monday after a long winter.\nShips may enter from the north."),
    ('<header class="site-header"><a href="/">My blog</a></header><div class="hentry"><h2 class="entry-title">A walk</h2><div class="entry-content"><p>We went up the hill before breakfast.</p><blockquote><p>It was cold.</p></blockquote><ol><li>Bread.</li><li>Cheese.</li></ol></div></div><div id="respond" class="comment-respond"><form><label>Name</label></form></div>', "A walk\nWe went up the hill before breakfast.\nIt was cold.\nBread.\nCheese."),
    ('<nav class="toc"><ol><li><a href=#a>Install</a><li><a href=#b>Use</a></ol></nav><main><section><h1>Manual</h1><p>Install it first, then read on.</p><pre>run it</pre><h2>Options</h2><p>There are two options, and both are explained below.</p></section></main><footer><p>Made by us</p></footer>', "Manual\nInstall it first, then read on.\nrun it\nOptions\nThere are two options, and both are explained below."),
    ('<div class="consent">We value your privacy. <button>Accept</button></div><article><h1>Prices rise</h1><figure><img><figcaption>A market in spring.</figcaption></figure><p>Prices rose again in May, the office said.</p><dl><dt>Bread</dt><dd>Up by two in a hundred.</dd></dl></article><aside class="related"><h3>More</h3><ul><li><a href=1>Rents fall</a></li></ul></aside>', "Prices rise\nA market in spring.\nPrices rose again in May, the office said.\nBread\nUp by two in a hundred."),
]


def test_unseen_layouts():
    """Share of blocks that are judged alike on layouts the field was not trained on."""
    field = html_text.Field.trained(html_text.labelled_pages(html_text.TRAINING_PAGES))
    wrong = total = 0
    for page, want in UNSEEN:
        got, blocks = html_text.main_text(page, field).split("\n"), [b[0] for b in html_text.leaf_blocks(page)]
        wrong += len(set(got) ^ set(want.split("\n")))
        total += len(blocks)
    assert wrong <= 0.1 * total


def test_self_closed_and_custom_tags_hide_no_text():
    read = lambda page: [b[0] for b in html_text.leaf_blocks(page)]
    assert read('<article><p>One <svg class="i"/> two.</p><p>Three.</p></article>') == ["One two.", "Three."]
    assert read("<p>a<math/>b</p><p>Let <math><mi>x</mi><mo> = </mo><mn>3</mn></math>.</p><p>c</p>") == ["ab", "Let x = 3.", "c"]
    for name in ("object-card", "title-bar", "svg-icon", "template-view", "script-box"):
        assert read(f"<{name}><p>In</p></{name}><p>After</p><{name}>Open") == ["In", "After", "Open"]
    assert read("<object data=x><p>Fallback</p></object><canvas>Chart</canvas><iframe src=x /><p>After</p>") == ["Fallback", "Chart", "After"]
    assert read("<p>A<svg><title/><style/><path d=''/></svg>B</p><p>C<svg><title>icon</svg>D</p><title>t</title><p>E") == ["AB", "CD", "E"]
    assert read('<svg><p>A</p><script>x = "</svg>"</script>B') == ["A", "B"]
    assert read('<p>A<script src="x" />var a = "<p>";</script >B</p><STYLE>p {}</style><noscript>n</noscript>C<template>t</template><script>x') == ["AB", "C"]


def test_a_late_copyright_notice_counts():
    late, never = html_text.block_features([("word " * 90 + "Copyright 2020 me", (), 0), ("word " * 90, (), 0)])
    assert "copyright" in late and "copyright" not in never


def test_values_of_any_length_are_no_text():
    read = lambda page: [b[0] for b in html_text.leaf_blocks(page)]
    long = "x <b>y</b> > " * 8000
    for quote, other in ('"', "'"), ("'", '"'):
        assert read(f"<article><p>A</p><div data-json={quote}{long}{other}{long}{quote} class=c>B</div><p>C</p></article>") == ["A", "B", "C"]
        many = " ".join(f"a{i} = {quote}<p>{i}>{quote}" for i in range(1000))
        assert read(f"<p>A</p><p {many}>B<img {many}/>C</p {many}>D<script {many}>var x</script>E") == ["A", "B C", "DE"]
    assert read("<p title=it's>A</p><p title=\"B>C</p>") == ["A", "C"]  # quotes that open nothing
    assert read('<p a="1"b="2>"c>A') == ["A"]
    assert html_text.leaf_blocks(f'<p data-x="{long}" class="lead">A')[0][1] >= {"name:lead"}


def nested_quotes(n):
    """Tags that all end at one <, each reached through values of both kinds of quotes."""
    return '<b x="' + "".join(f"""<b y='{i} z="{i}' """ for i in range(n)) + "<"


@pytest.mark.parametrize("page", [nested_quotes(100_000), """<b x="<b y='""" * 150_000, """<b x="<b y=' ">""" * 100_000, "<b x=" * 300_000, '<b x="' + "<b " * 400_000, "<p " + "= " * 500_000])
def test_quotes_take_time_in_proportion(page):
    start = time.monotonic()
    html_text.leaf_blocks(page, {"tag:div"})
    assert time.monotonic() - start < 10


def test_comments_in_the_article():
    field = html_text.Field.trained(html_text.labelled_pages(html_text.TRAINING_PAGES))
    for name in ("comment", "comment-body", "reply"):
        page = f'<article><h1>Ships return</h1><p>The ships came back on Monday after a month at sea.</p><p>They will sail again.</p><div class="{name}"><p>I was there and saw them come in, it was quite a sight.</p></div><div class="{name}"><p>Nice.</p></div></article>'
        assert html_text.main_text(page, field) == "Ships return\nThe ships came back on Monday after a month at sea.\nThey will sail again."


SHELLS = [
    '<div id="masthead"><p>Daily paper</p></div><div class="crumbs breadcrumb"><a href=1>Home</a> <a href=2>World</a></div><article class="{c}">{b}</article><div class="widget"><h3>Most read</h3><ol><li><a href=3>One</a></li></ol></div>',
    '<table><tr><td class="sidebar-left"><a href=1>Start</a></td><td id="content">{b}</td></tr></table><p class="legal">&copy; 2012 the owners</p>',
    '<nav><a href=1>Home</a></nav><main><div class="grid"><div class="{c}">{b}</div><aside><p>Subscribe to our letter today.</p></aside></div></main><footer><p>Imprint</p></footer>',
    '<div role="banner"><a href=1>Logo</a></div><div role="main">{b}</div><div role="complementary" class="related"><ul><li><a href=4>Next one</a></li></ul></div>',
    '<form class="search"><input><button>Find</button></form><section class="{c}">{b}</section><div class="comment"><p>I do not agree with this at all, sorry.</p></div><div class="cookie-bar">We use cookies.</div>',
    '<body><header><h2>Site</h2></header><div class="wrapper"><div class="{c} story">{b}<div class="reply"><p>Thanks for this, it helped me a lot.</p></div></div></div><footer>Copyright us</footer></body>',
]
BODIES = [
    ["<h1>|Rain in May</h1>", "<p>|It rained for most of the month, as the station said on Friday.</p>", "<p>|June was dry.</p>"],
    ["<h2>|How to bake</h2>", "<ol><li>|Mix the flour with water.</li><li>|Wait for an hour.</li></ol>", "<p>|Then bake it until the crust is brown and hard.</p>"],
    ["<p>|No title here, only a long paragraph that tells what happened on the way.</p>", "<blockquote><p>|Nobody saw it.</p></blockquote>", "<p>|We went home.</p>"],
    ["<h1>|Results</h1>", "<table><tr><th>|Team</th><td>|Four</td></tr></table>", "<p>|The match ended late in the evening.</p>"],
    ["<h1>|Notes</h1>", "<p>|First came the letters, then the long books.</p>", "<pre>|x = 1</pre>", "<h3>|Sources</h3>", "<p>|All of them are in the archive of the town.</p>"],
]


LATER_SHELLS = [
    '<div class="topnav"><a href=1>Home</a> <a href=2>Blog</a></div><div class="columns"><div class="col-main"><div class="{c}">{b}</div></div><div class="col-side"><h4>Tags</h4><a href=3>red</a> <a href=4>blue</a></div></div><div class="site-info">All rights reserved</div>',
    '<article id="post-12" class="{c}">{b}<ul class="share-buttons"><li><a href=1>Post it</a></li><li><a href=2>Mail it</a></li></ul></article><section id="comments"><h3>Two replies</h3><ol><li><p>Well said, I think so too.</p></li><li><p>No.</p></li></ol></section>',
    '<div class="modal"><p>Sign up for our newsletter and never miss a story.</p><form><label>Mail</label><input><button>Go</button></form></div><main class="{c}">{b}</main><div class="promo"><p>Buy two boxes and get one more for nothing.</p></div>',
    '<ul class="menu"><li><a href=1>A</a></li><li><a href=2>B</a></li></ul><div><div>{b}</div></div><div class="footer"><p>Contact us by mail.</p><p>&copy; 2020</p></div>',
    '<header><p>The town gazette</p><nav><a href=1>News</a><a href=2>Sport</a></nav></header><section><article>{b}<aside class="pullquote related"><a href=9>Read also: the flood</a></aside></article></section><footer><ul><li><a href=5>Terms</a></li></ul></footer>',
    '<div class="alert">This page is out of date.</div><div itemprop="articleBody" class="{c}">{b}</div><div class="discussion"><div class="response"><p>Where can one buy it? I looked in every shop.</p></div></div>',
]
LATER_BODIES = [
    ["<h1>|The old mill</h1>", "<p>|The mill stood by the river for two hundred years.</p>", "<h4>|Decay</h4>", "<p>|Then the roof fell in.</p>"],
    ["<h2>|Steps</h2>", "<ul><li>|Open the lid.</li><li>|Take out the filter and wash it with warm water.</li></ul>", "<p>|Done.</p>"],
    ["<h1>|Interview</h1>", "<p>|<b>Why now?</b></p>", "<p>|Because nobody else wanted to do it, and somebody had to.</p>"],
    ["<p>|A short note.</p>", "<p>|It has two lines, of which this one is the longer.</p>"],
    ["<h1>|Figures</h1>", "<figure><img src=a><figcaption>|The harbour at night.</figcaption></figure>", "<p>|Trade grew by a third, the office reported on Tuesday, after years of decline.</p>"],
]


#: Written after the composed pages and the training were last changed, and not used to change them.
HELD_OUT_SHELLS = [
    '<div class="brand"><a href=1>The Echo</a></div><div class="tabs menu"><a href=2>All</a><a href=3>Local</a></div><div class="main-column"><div class="text">{b}</div><div class="author-box author"><p>Written by the editors.</p></div></div><div class="bottom-bar"><p>Made with care</p></div>',
    '<aside><h3>Chapters</h3><ul><li><a href=1>First</a><li><a href=2>Second</a></ul></aside><article>{b}</article><nav class="pager pagination"><a href=3>Next chapter</a></nav>',
    '<main><div class="banner-ad">Cheap flights to the south.</div>{b}<div class="thread"><div class="msg reply"><p>Is there a map of the place somewhere?</p></div></div></main>',
    '<div id="header"><h1>Village news</h1></div><div id="article">{b}</div><div id="related"><p>See also the report on the bridge.</p></div><div id="footer"><a href=1>Contact</a></div>',
    '<dialog class="consent"><p>Do you agree to be measured?</p><button>Yes</button></dialog><section class="post">{b}<p class="meta">Filed on Monday</p></section><form><textarea>Your view</textarea></form>',
    '<header class="top"><a href=1>Start</a></header><div><section class="story">{b}</section><section class="recommended"><h2>For you</h2><ul><li><a href=1>The lake</a></li></ul></section></div>',
]
HELD_OUT_BODIES = [
    ["<h1>|Bees at work</h1>", "<p>|A bee visits some thousand flowers on a good day.</p>", "<p>|So they say.</p>", "<blockquote>|Bees never rest.</blockquote>"],
    ["<p>|There was no warning before the water came into the street.</p>", "<p>|Two houses were lost</p>"],
    ["<h2>|Rules</h2>", "<ol><li>|Be kind.</li><li>|Bring your own cup</li></ol>", "<h3>|Fines</h3>", "<p>|Those who break a rule pay for the next round.</p>"],
    ["<h1>|Table of tides</h1>", "<table><tr><td>|Noon</td><td>|High</td></tr></table>", "<p>|All times are local ones.</p>"],
    ["<h1>|Letter</h1>", "<div>|Dear reader, this text stands in a plain box of its own.</div>", "<p>|Yours</p>"],
]


def judged(shells, bodies):
    """(blocks judged wrong, blocks) of every body in every shell."""
    field = html_text.Field.trained(html_text.labelled_pages(html_text.TRAINING_PAGES))
    wrong = []
    total = 0
    for i, shell in enumerate(shells):
        for k, body in enumerate(bodies):
            blocks = html_text.leaf_blocks(shell.format(c=("post", "entry", "text", "article-body")[(i + k) % 4], b="".join(body)))
            labels = field.decode(html_text.block_features([(b[0].lstrip("|"), b[1], b[2]) for b in blocks]))
            wrong += [(i, k, b[0]) for label, b in zip(labels, blocks, strict=True) if bool(label) != b[0].startswith("|")]
            total += len(blocks)
    return wrong, total


def test_pages_of_other_layouts():
    """Sixty pages by which the composed pages and the training were chosen, and thirty of others."""
    for shells, bodies in ((SHELLS, BODIES), (LATER_SHELLS, LATER_BODIES)):
        wrong, total = judged(shells, bodies)
        assert len(wrong) <= 0.05 * total, wrong
    wrong, total = judged(HELD_OUT_SHELLS, HELD_OUT_BODIES)
    assert len(wrong) <= 0.1 * total, wrong
