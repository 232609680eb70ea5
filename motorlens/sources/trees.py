"""A page's tags as a tree of intervals, and CSS selectors over it.

A tokeniser and one nesting scan (:func:`trees`, the only Python here) give every element where it is entered and left.
After that everything is interval containment inside the row, in Column expressions: an element is inside another if its
interval is, and its texts are a run of the page's texts. Selectors therefore need no join and no shuffle, and
their work follows the elements that their parts match.

Nesting: end tags close what is open above their element and are ignored without one; void elements hold nothing; list
items, table cells, options and paragraphs end where the next one begins. Scripts, styles and comments have no text. NULL
html has no elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: Opening one of these ends the first open element of the second kind, unless one of the third stands between.
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_INLINE_STOP = frozenset("div article section li td th body button".split())
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))), **{b: (frozenset(("p",)), _INLINE_STOP) for b in _BLOCKS},
}
#: Text; end tag; start tag and its attributes; comments and declarations.
_TOKEN = re.compile(r"""([^<]+)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<!--.*?-->|<[!?/][^>]*>|(<)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

NODE = "struct<enter: int, leave: int, depth: int, parent: int, nth: int, first_text: int, texts: int, tag: string, attrs: map<string, string>>"
TREE = f"nodes array<{NODE}>, texts array<string>"


def parse(html: str) -> tuple[list[list], list[str]]:
    """([enter, leave, depth, parent, nth, texts before, texts inside, tag, attributes] of each element in document order,
    and all texts)."""
    nodes: list[list] = []
    texts: list[str] = []
    open_: list[int] = []
    children = [0]
    at = pos = 0

    def close(down_to: int) -> None:
        for i in open_[down_to:]:
            nodes[i][1] = at
            nodes[i][6] = len(texts) - nodes[i][5]
        del open_[down_to:], children[down_to + 1 :]

    while m := _TOKEN.match(html, pos):
        pos, at = m.end(), at + 1
        text, end, tag, written, loose = m.groups()
        if text or loose:
            if said := (text or loose).strip():
                texts.append(unescape(said).strip() if "&" in said else said)
            continue
        if end:
            end = end.lower()
            for k in range(len(open_) - 1, -1, -1):
                if nodes[open_[k]][7] == end:
                    close(k)
                    break
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in ENDS:
            ended, stops = ENDS[tag]
            for k in range(len(open_) - 1, -1, -1):
                above = nodes[open_[k]][7]
                if above in ended:
                    close(k)
                    at += 1
                    break
                if above in stops:
                    break
        attrs: dict[str, str] = {}
        if written:
            for name, a, b, c in _ATTR.findall(written):
                value = a or b or c
                attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
        children[-1] += 1
        nodes.append([at, at, len(open_), nodes[open_[-1]][0] if open_ else 0, children[-1], len(texts), 0, tag, attrs])
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, pos)
            pos = end.start() if end else len(html)
        if tag not in VOID:
            open_.append(len(nodes) - 1)
            children.append(0)
    at += 1
    close(0)
    return nodes, texts


def _arrow(htmls: list[str | None]) -> pa.Array:
    nodes, texts, first, first_text = [], [], [0], [0]
    for html in htmls:
        n, t = parse(html or "")
        nodes += n
        texts += t
        first.append(len(nodes))
        first_text.append(len(texts))
    ints = [pa.array([n[k] for n in nodes], pa.int32()) for k in range(7)]
    pairs, offsets = [], [0]
    for n in nodes:
        pairs += n[8].items()
        offsets.append(len(pairs))
    attrs = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    node = pa.StructArray.from_arrays([*ints, pa.array([n[7] for n in nodes], pa.string()), attrs], ["enter", "leave", "depth", "parent", "nth", "first_text", "texts", "tag", "attrs"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(first, pa.int32()), node), pa.ListArray.from_arrays(pa.array(first_text, pa.int32()), pa.array(texts, pa.string()))], ["nodes", "texts"])


#: Pages and bytes of an Arrow batch at most: a worker holds what it reads from a whole batch as Python objects.
BATCH_PAGES, BATCH_BYTES = 200, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few pages from here on, unless the session's are smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_PAGES), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def trees(pages: DataFrame, html: str = "html", out: str = "tree") -> DataFrame:
    """pages with the tree of each page."""
    small_batches(pages.sparkSession)
    run = F.arrow_udf(lambda htmls: _arrow(htmls.to_pylist()), TREE)
    return pages.withColumn(out, run(F.col(html)))


# ---------------------------------------------------------------- selectors


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), of), 0)


_PART = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]"""
    r"""|:(?P<pseudo>nth-child|first-child|not)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?"""
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def _word(value: Column, word: str) -> Column:
    """Whether a list of words holds one."""
    return value.contains(word) & value.rlike(f"(?:^|\\s)\\Q{word}\\E(?:\\s|$)")


def _nth(node: Column, formula: str) -> Column:
    text = {"odd": "2n+1", "even": "2n"}.get(f := formula.replace(" ", "").lower(), f)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise ValueError(f"no place among children: {formula!r}")
    if m[3]:
        return node["nth"] == int(m[3])
    a, b = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    if not a:
        return node["nth"] == b
    return ((node["nth"] - b) % a == 0) & ((node["nth"] - b) / a >= 0)


def _simple(m: re.Match) -> Callable[[Column], Column]:
    """The test of one part of a compound selector."""
    value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
    if m["tag"]:
        return (lambda n: F.lit(True)) if m["tag"] == "*" else lambda n: n["tag"] == m["tag"].lower()
    if m["cls"]:
        return lambda n: _word(n["attrs"]["class"], m["cls"])
    if m["id"]:
        return lambda n: n["attrs"]["id"] == m["id"]
    if m["attr"]:
        name = m["attr"].lower()
        tests = {
            "=": lambda a: a == value, "*=": lambda a: a.contains(value), "^=": lambda a: a.startswith(value), "$=": lambda a: a.endswith(value),
            "~=": lambda a: _word(a, value), "|=": lambda a: (a == value) | a.startswith(f"{value}-"),
        }
        if not m["op"]:
            return lambda n: n["attrs"][name].isNotNull()
        if value == "" and m["op"] != "=":  # an empty part is in nothing
            return lambda n: F.lit(False)
        return lambda n: tests[m["op"]](n["attrs"][name])
    if m["pseudo"] == "not":
        inner = compound(m["arg"].strip())
        return lambda n: ~inner(n)
    return lambda n: _nth(n, m["arg"] if m["pseudo"] == "nth-child" else "1")


def compound(text: str) -> Callable[[Column], Column]:
    """The test of a selector without combinators, never NULL."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"no selector: {text!r}")
        tests.append(_simple(m))
        at = m.end()
    if not tests:
        raise ValueError("an empty selector")

    def test(node: Column) -> Column:
        out = tests[0](node)
        for t in tests[1:]:
            out = out & t(node)
        return F.coalesce(out, F.lit(False))

    return test


def steps(selector: str) -> list[tuple[str, str]]:
    """[(combinator, compound)] from left to right; the first combinator is empty."""
    out, at, text = [("", "")], 0, selector.strip()
    while at < len(text):
        if m := _PART.match(text, at):
            out[-1] = (out[-1][0], out[-1][1] + m[0])
        elif m := _COMBINATOR.match(text, at):
            out.append((m[1] or " ", ""))
        else:
            raise ValueError(f"no selector: {selector!r}")
        at = m.end()
    return out


def _related(combinator: str, a: Column, n: Column) -> Column:
    if combinator == " ":
        return (a["enter"] < n["enter"]) & (n["leave"] <= a["leave"])
    if combinator == ">":
        return n["parent"] == a["enter"]
    siblings = n["parent"] == a["parent"]
    return siblings & ((n["nth"] == a["nth"] + 1) if combinator == "+" else (n["nth"] > a["nth"]))


def select(tree: Column, selector: str) -> Column:
    """The elements that a selector names, in document order: tags, *, .class, #id, [attribute] with =, *=, ^=, $=, ~=, |=,
    :nth-child, :first-child, :not, the four combinators, and lists with commas."""
    nodes = tree["nodes"]

    def of(chain: list[tuple[str, str]]) -> Column:
        found = F.filter(nodes, compound(chain[0][1]))
        for combinator, text in chain[1:]:
            found = next_to(found, combinator, compound(text))
        return found

    def next_to(found: Column, combinator: str, test: Callable[[Column], Column]) -> Column:
        return let(found, lambda held: F.filter(nodes, lambda n: test(n) & F.exists(held, lambda a: _related(combinator, a, n))))

    groups = [of(steps(s)) for s in re.split(r",(?![^\[(]*[\])])", selector)]
    if len(groups) == 1:
        return groups[0]
    places = F.concat(*[F.transform(g, lambda n: n["enter"]) for g in groups])
    return let(places, lambda p: F.filter(nodes, lambda n: F.array_contains(p, n["enter"])))


def inside(found: Column, node: Column) -> Column:
    """Those of found that lie in node."""
    return F.filter(found, lambda n: _related(" ", node, n))


def text_of(tree: Column, node: Column) -> Column:
    """All texts in an element, stripped and joined by spaces; NULL if there is none."""
    return F.nullif(F.array_join(F.slice(tree["texts"], node["first_text"] + 1, node["texts"]), " "), F.lit(""))


def read(tree: Column, selector: str, attr: str = "text") -> Column:
    """Text or attribute of the first element that a selector names; NULL if it says nothing."""
    if attr == "text":
        return let(F.get(select(tree, selector), 0), lambda n: F.when(n.isNotNull(), text_of(tree, n)))
    return F.nullif(F.trim(F.get(select(tree, selector), 0)["attrs"][attr.lower()]), F.lit(""))


def css_fields(pages: DataFrame, rules: dict[str, str | dict], html: str = "html") -> DataFrame:
    """pages with one column for each rule (column: selector, or selector and attr), in place of the html."""
    grown = trees(pages, html, "_tree")
    read_ = {c: read(F.col("_tree"), **({"selector": r} if isinstance(r, str) else {"selector": r["selector"], "attr": r.get("attr", "text")})) for c, r in rules.items()}
    return grown.select(*[F.col(c) for c in pages.columns if c != html], *[e.alias(c) for c, e in read_.items()])
