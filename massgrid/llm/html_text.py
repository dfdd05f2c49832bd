"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A tolerant scan turns a page into its leaf blocks, the runs of text between block-level tags, each with its open
ancestors. Features are ancestor tags, words of their class, id and role attributes, and traits of the text and its
links. The field has the labels main text and other; its weights are fitted by gradient ascent on the conditional
likelihood of labelled pages, which `labelled_pages` composes from a seed, and pages are decoded by Viterbi. The
model is a few hundred weights, so the broadcast is bounded. Each page is handled on its own.

Cases: null or empty html gives an empty text; unclosed and stray tags, comments and quotes are tolerated; long pages
are taken whole, in time that grows with their length; repeated rows are extracted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.common import lean

#: Tags whose content is no text of the page. That of all others, drawings and formulas among them, is for the field to judge.
HIDDEN = "script style title noscript template iframe"
#: Tags in which a self-closed tag of any name is empty.
FOREIGN = ("svg", "math")
#: Tags that end a block where they open or close.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Tags that never hold anything.
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Opening one of these closes an open one of the same list.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
OPEN = re.compile(r"<!--|<(/?)([a-z][a-z0-9-]*)|<[!?]", re.I)
#: What follows a tag's name up to its end, a <, or a = with a quote, which alone opens a value.
UNQUOTED = re.compile(r"""[^<>=]*+(?:=(?!\s*+["'])[^<>=]*+)*+""")
QUOTE = re.compile(r"""=\s*+(["'])""")
DECLARED = re.compile(r"[^<>]*+>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in HIDDEN.split()}
FOREIGN_ENDS = re.compile(rf"</(?:{'|'.join(FOREIGN)})(?=[\s/>])", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Character references with more digits than any character has, and zeros ahead.
ZEROS, NO_CHARACTER = re.compile(r"&#0{7,}"), re.compile(r"&#0*[1-9][0-9]{7,};?")

Block = tuple[str, frozenset[str], int]  # text, features of the ancestors, characters in links


def unescaped(text: str) -> str:
    return html.unescape(NO_CHARACTER.sub("\ufffd", ZEROS.sub("&#0", text))) if "&" in text else text


class Tags:
    """Ends of the tags of a page.

    A value in quotes may hold anything, at any length; a quote that nothing closes is a character like others. A <
    outside quotes shows that there is no tag. Places that led to one are kept, and each quoted value is read
    once for every kind of end, so the time grows with the page however its tags are broken.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()  # places after a value from which no end is reached

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`; -1 if it is none."""
        seen = []
        while at not in self.dead:
            seen.append(at)
            at = UNQUOTED.match(self.page, at).end()
            if self.page[at : at + 1] == ">":
                return at + 1
            if (m := QUOTE.match(self.page, at)) is None:
                break
            at = self.page.index(m[1], m.end()) + 1 if m.end() <= self.last[m[1]] else m.end()
        self.dead.update(seen)
        return -1


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The non-empty blocks of a page in order. known: the features that matter, if not all do.

    Time grows in proportion to the page, however its tags are broken, and to the number of known features.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # open tags, with the features of all up to them
    depth: Counter[str] = Counter()
    parts: list[str] = []
    linked, link, at, foreign = 0, False, 0, 0
    endless: set[str] = set()  # hidden tags that nothing closes any more

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, (stack[-1][1] if stack else frozenset()) | {f"in:{stack[-1][0]}" if stack else "in:none"}, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        depth[tag] -= 1
        return tag

    def add(text: str) -> None:
        nonlocal linked
        text = unescaped(text)
        parts.append(text)
        if link:
            linked += len(text.strip())

    def hidden_end(name: str, start: int, empty: bool) -> int:
        """Where the content of a hidden tag that ends at `start` ends."""
        if foreign and empty:
            return start
        end = None if name in endless else ENDS[name].search(page, start)
        if end is None:
            endless.add(name)
        outer = FOREIGN_ENDS.search(page, start, end.start() if end else len(page)) if foreign else None
        return outer.start() if outer else end.end() if end else start if empty else len(page)

    tags, look = Tags(page), 0
    while m := OPEN.search(page, look):
        look = m.end()
        if m[2]:
            end = tags.end(look)
        elif m[0] == "<!--":
            end = page.find("-->", look) + 3
            end = end if end > 2 else len(page)
        else:
            end = declared.end() if (declared := DECLARED.match(page, look)) else -1
        if end < 0:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        inside, at, look = page[m.end() : end - 1], end, end
        tag = m[2]
        if not tag:
            continue
        tag, closing, empty = tag.lower(), bool(m[1]), inside.endswith("/")
        if tag in ENDS and not closing and (not inside or inside[0] == "/" or inside[0].isspace()):
            at = look = hidden_end(tag, at, empty)
            continue
        if tag not in BLOCK_TAGS:
            if tag in FOREIGN:
                foreign = max(0, foreign - 1) if closing else foreign + (not empty)
            elif tag == "a":
                link = not closing
            elif tag == "br" or tag == "img":
                parts.append(" ")
            continue
        flush()
        foreign = 0  # a block ends an unclosed drawing
        if closing:
            while depth[tag] and pop() != tag:
                pass
            link = False
        elif tag not in VOID:
            closed = CLOSES.get(tag, {"p"} if tag not in ("button", "label") else frozenset())
            while stack and stack[-1][0] in closed:
                pop()
            features = [f"tag:{tag}"]
            if inside:
                for values in NAMES.findall(inside):
                    features += [f"name:{w.lower()}" for w in WORD.findall("".join(values))]
            above = stack[-1][1] if stack else frozenset()
            own = {f for f in features if f not in above and (known is None or f in known)}
            stack.append((tag, above | own if own else above))
            depth[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def block_features(blocks: list[Block]) -> list[set[str]]:
    """Features of every block of a page."""
    out = []
    for i, (text, ancestors, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        share = 10 * linked // max(1, len(text))
        fs = set(ancestors)
        fs.add("words:" + ("1" if words == 1 else "few" if words < 6 else "some" if words < 20 else "many"))
        fs.add("links:" + ("none" if not share else "part" if share < 5 else "all"))
        fs.add("end:stop" if text[-1] in ".!?…»\"" else "end:open")
        if "©" in text or "copyright" in text.lower():
            fs.add("copyright")
        if i == 0:
            fs.add("first")
        if i == len(blocks) - 1:
            fs.add("last")
        out.append(fs)
    return out


MARK = "\ue000"
#: Composed pages that the query's field learns from.
TRAINING_PAGES = 1000
_OTHER = {
    "nav": "nav navbar navigation menu topmenu breadcrumb breadcrumbs pagination toc".split(),
    "header": "header masthead site banner branding logo top topbar".split(),
    "footer": "footer bottom copyright legal credits colophon".split(),
    "aside": "sidebar aside side widget related rail recommended trending popular tags".split(),
    "ad": "ad ads advert advertisement promo promoted sponsor sponsored banner adsense".split(),
    "notice": "notice cookie cookies consent gdpr alert modal popup subscribe newsletter paywall message".split(),
    "comments": "comments comment replies reply discussion disqus respondents responses thread".split(),
    "share": "share social sharing follow author byline meta".split(),
}


def labelled_pages(n: int, seed: int = 20) -> list[str]:
    """n pages in which MARK starts every block of the main text."""
    rng = random.Random(seed)
    syllables = "ta re on mi la su ke do ven tri al er ist og pa".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int, high: int, stop: str = ".") -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + stop

    def box(kind: str, inner: str) -> str:
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(kind)
        tag = own if own and rng.random() < 0.5 else rng.choice(("div", "section", "div"))
        name = "" if tag == own and rng.random() < 0.6 else f' {rng.choice(("class", "id"))}="{rng.choice(_OTHER[kind])}{rng.choice(("", "-box", " wrap"))}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{sentence(1, 3, "")}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def other(kind: str) -> str:
        if kind == "nav":
            return box(kind, links())
        if kind == "form":
            return f'<form><label>{word()}</label><input><select><option>{word()}<option>{word()}</select><button>{word()}</button><p>{sentence(3, 9)}</p></form>'
        if kind == "comments":
            return box(kind, f"<h3>{sentence(1, 3, '')}</h3>" + "".join(f'<div class="comment"><p>{sentence(4, 40)}</p></div>' for _ in range(rng.randint(1, 5))))
        if kind == "footer":
            line = rng.choice(("&copy; ", "Copyright ", "")) + sentence(1, 12, rng.choice((".", "")))
            if rng.random() < 0.2:
                return f'<p class="{rng.choice(_OTHER[kind])}">{line}</p>'
            return box(kind, rng.choice((line, f"<p>{line}</p>")) + (links() if rng.random() < 0.3 else ""))
        if kind == "aside":
            tag = rng.choice(("h3", "h3", "h2", "h4"))
            return box(kind, f"<{tag}>{sentence(1, 4, '')}</{tag}>" + rng.choice((links(), f"<p>{sentence(4, 25)}</p>", f'<a href="#">{word()}</a> <a href="#">{word()}</a>')))
        if kind == "header":
            return box(kind, rng.choice((f"<h1>{sentence(1, 4, '')}</h1>", f"<p>{sentence(2, 8)}</p>", f"<div>{word()}</div>")))
        return box(kind, rng.choice((f"<p>{sentence(3, 30)}</p>", sentence(3, 20), f'<a href="#">{sentence(2, 6, "")}</a>', *([links()] if kind == "share" else []))))

    def body() -> str:
        out = [f"<h1>{MARK}{sentence(2, 14, rng.choice(('', '.')))}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            draw = rng.random()
            if draw < 0.1:
                tag = rng.choice(("h2", "h2", "h3", "h4"))
                out.append(f"<{tag}>{MARK}{sentence(1, 6, '')}</{tag}>")
            elif draw < 0.17:
                out.append("<ul>" + "".join(f"<li>{MARK}{sentence(1, 14, rng.choice(('', '.')))}</li>" for _ in range(3)) + "</ul>")
            elif draw < 0.22:
                out.append(f"<blockquote>{MARK}{sentence(4, 30)}</blockquote>")
            elif draw < 0.24:
                out.append(rng.choice((f"<pre>{MARK}{sentence(1, 12, '')}</pre>", f"<dl><dt>{MARK}{word()}</dt><dd>{MARK}{sentence(2, 14)}</dd></dl>")))
            elif draw < 0.27:
                out.append(f"<table><tr><td>{MARK}{word()}</td><td>{MARK}{word()}</td></tr></table>")
            elif draw < 0.34:
                out.append(f"<p><b>{MARK}{sentence(1, 30)}<br>")
            elif draw < 0.4:
                out.append(f'<p>{MARK}{sentence(2, 20)} <a href="#">{sentence(1, 3, "")}</a> {sentence(1, 20)}</p>')
            else:
                out.append(f"<p>{MARK}{sentence(1, rng.choice((2, 9, 90)), rng.choice(('.', '.', '')))}</p>")
            if rng.random() < 0.06:
                out.append(other(rng.choice(("ad", "share", "aside", "notice"))))
            elif rng.random() < 0.05:  # comments without a box around them
                name = rng.choice(("comment", "comment-body", "reply", "response", "user comment"))
                out += [f'<div class="{name}"><p>{sentence(4, 40)}</p></div>' for _ in range(rng.randint(1, 3))]
        return "".join(out)

    def page() -> str:
        kinds = ["nav", "header", "ad", "notice", "form"]
        before = [other(k) for k in rng.sample(kinds, rng.randint(0, 4))]
        after = [other(k) for k in rng.sample(["aside", "comments", "footer", "ad", "share", "form", "nav", "notice"], rng.randint(0, 5))]
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        name = rng.choice((' class="content"', ' id="article"', ' class="post entry"', ' class="story text"', ' class="article-body"', ' role="main"', ' id="main"', "", "")) if tag in ("div", "section") or rng.random() < 0.2 else ""
        inner = body() + (other("comments") if rng.random() < 0.12 else "") + (other("share") if rng.random() < 0.08 else "")
        wrap = rng.choice(("{}", "{}", '<div class="page">{}</div>', "<main>{}</main>"))
        return f"<html><body>{''.join(before)}{wrap.format(f'<{tag}{name}>{inner}</{tag}>')}{''.join(after)}</body></html>"

    return [page() for _ in range(n)]


class Field:
    """Weights of the difference between the labels main text (1) and other (0), and of the steps between labels."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps

    @classmethod
    def trained(cls, pages: list[str], rounds: int = 250, rate: float = 0.15, decay: float = 0.0003) -> Field:
        found = []
        for page in pages:
            blocks = leaf_blocks(page)
            labels = [MARK in b[0] for b in blocks]
            plain = [(b[0].replace(MARK, "").strip() or "-", b[1], b[2]) for b in blocks]
            found.append((block_features(plain), labels))
        names = sorted({f for features, _ in found for fs in features for f in fs})
        number = {f: i for i, f in enumerate(names)}
        longest = max(len(labels) for _, labels in found)
        page_of, place, feature = (np.array(x) for x in zip(*((p, t, number[f]) for p, (fs, _) in enumerate(found) for t, own in enumerate(fs) for f in own), strict=True))
        size = np.array([len(labels) for _, labels in found])
        truth = np.zeros((len(found), longest), int)
        for p, (_, labels) in enumerate(found):
            truth[p, : len(labels)] = labels
        live = np.arange(longest) < size[:, None]
        weight, steps = np.zeros(len(names)), np.zeros((2, 2))
        moments = [np.zeros_like(x) for x in (weight, weight, steps, steps)]
        for r in range(1, rounds + 1):
            score = np.zeros((len(found), longest, 2))
            np.add.at(score[:, :, 1], (page_of, place), weight[feature])
            forward, backward = score.copy(), np.zeros_like(score)
            for t in range(1, longest):  # log-sum-exp along all pages at once
                forward[:, t] = score[:, t] + np.logaddexp(forward[:, t - 1, :1] + steps[0], forward[:, t - 1, 1:] + steps[1])
            for t in range(longest - 2, -1, -1):
                ahead = score[:, t + 1] + backward[:, t + 1]
                both = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
                backward[:, t] = np.where(live[:, t + 1, None], both, 0.0)
            last = forward[np.arange(len(found)), size - 1]
            total = np.logaddexp(last[:, 0], last[:, 1])
            chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
            slope = np.bincount(feature, (truth - chance)[page_of, place], minlength=len(names)) / len(found) - decay * weight
            step_slope = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    expected = np.exp(forward[:, :-1, a] + steps[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, None])
                    step_slope[a, b] = (((truth[:, :-1] == a) & (truth[:, 1:] == b)) - expected)[live[:, 1:]].sum() / len(found) - decay * steps[a, b]
            for x, g, m, v in ((weight, slope, *moments[:2]), (steps, step_slope, *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        return cls({f: round(float(w), 5) for f, w in zip(names, weight, strict=True)}, np.round(steps, 5))

    def decode(self, features: list[set[str]]) -> list[int]:
        """The likeliest labels by Viterbi."""
        get = self.weights.get
        (s00, s01), (s10, s11) = self.steps.tolist()
        other, main, back = 0.0, 0.0, []
        for t, fs in enumerate(features):
            own = sum([get(f, 0.0) for f in sorted(fs)])
            if t:
                a, b = other + s00 >= main + s10, other + s01 > main + s11
                back.append((not a, not b))
                other, main = (other + s00 if a else main + s10), (other + s01 if b else main + s11) + own
            else:
                main = own
        label, labels = int(main > other), []
        for came in [*back[::-1], None]:
            labels.append(label)
            if came is not None:
                label = int(came[label])
        return labels[::-1]


def main_text(page: str, field: Field) -> str:
    """Blocks of the main text, one on a line."""
    blocks = leaf_blocks(page, field.weights)
    return "\n".join(b[0] for b, label in zip(blocks, field.decode(block_features(blocks)), strict=True) if label) if blocks else ""


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sent.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: main text of every page."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Field.trained(labelled_pages(TRAINING_PAGES)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
