"""Broken markup against a tree builder on top of the standard library's tokenizer."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from auditlake.functions import html as H, tags
from auditlake.operators import facts
from helpers import fetch, fetches, values


class Builder(HTMLParser):
    """Open elements on a stack; anchors and headings collect the text that is met while they are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.anchors, self.headings = [], [], []

    def _pop_to(self, n):
        del self.stack[n:]

    def _innermost(self, names, walls):
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] in names:
                return n
            if self.stack[n][0] in walls:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        lowest = len(self.stack)
        for element, closers in tags.CLOSED_BY.items():
            if tag in closers:
                n = self._innermost({element}, set() if element in tags._ANYWHERE else set(tags._WALLS))
                if n is not None:
                    lowest = min(lowest, n)
        self._pop_to(lowest)
        if tag == "a":
            self.stack = [(name, record) for name, record in self.stack if name != "a"]
        if tag in tags.VOID:
            if tag == "img":
                for _, record in self.stack:
                    if record is not None:
                        record["image"] = True
            return
        record = None
        if tag == "a":
            self.anchors.append(record := {"href": dict(attrs).get("href") or "", "text": [], "image": False})
        elif tag in ("h1", "h2"):
            self.headings.append(record := {"level": tag, "text": [], "image": False})
        self.stack.append((tag, record))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in tags.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        rank = tags.RANKS.get(tag, 100)
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] == tag:
                return self._pop_to(n)
            if tags.RANKS.get(self.stack[n][0], 100) > rank:
                return

    def handle_data(self, data):
        for _, record in self.stack:
            if record is not None:
                record["text"].append(data.strip())


PIECES = [
    '<a href="/{i}">', "</a>", "<a>", "<b>", "</b>", "<div>", "</div>", "<p>", "</p>", "<h1>", "</h1>", "<h2>", "</h2>", "<table><tr><td>", "</td>", "<td>", "<tr>", "</tr></table>", "<ul>", "<li>", "</li>", "</ul>",
    "<br>", '<img src="x">', "<span class='q'>", "</span>", "</section>", "<section>", "uno", "dos {i}", "tres &amp; más", " ",
]


def snippets(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES).format(i=k) for k in range(rnd.randint(2, 24))) for _ in range(n)]


def expected(html):
    b = Builder()
    b.feed(html)
    b.close()
    anchors = [(a["href"], "".join(a["text"]), a["image"]) for a in b.anchors]
    return anchors, ["".join(h["text"]) for h in b.headings if h["level"] == "h1"], ["".join(h["text"]) for h in b.headings if h["level"] == "h2"]


def test_broken_snippets_agree_with_a_tree_builder(spark):
    pages = list(dict.fromkeys(snippets(400, 1)))
    doc = tags.repaired(F.col("html"))
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string").repartition(8).withColumn("doc", doc)
    out = rows.select("i", "html", "doc", H.anchor_parts(H.elements(F.col("doc"), "a")).alias("anchors"), H.heading_texts(F.col("doc"), "h1").alias("h1"), H.heading_texts(F.col("doc"), "h2").alias("h2")).collect()
    odd = 0
    for r in out:
        anchors, h1, h2 = expected(r["html"])
        assert [(a["href"], a["anchor_text"], a["has_image"]) for a in r["anchors"]] == anchors, (r["html"], r["doc"])
        assert (r["h1"], r["h2"]) == (h1, h2), (r["html"], r["doc"])
        odd += r["doc"] != r["html"]
    assert odd > 200


def test_unclosed_and_misnested_elements(spark):
    cases = {
        '<p><a href="/1">uno<p>dos</p>': [("/1", "uno")],
        '<a href="/1">uno<a href="/2">dos</a>': [("/1", "uno"), ("/2", "dos")],
        '<div><a href="/1">uno</div>fuera</a>': [("/1", "uno")],
        '<a href="/1"><b>uno</a>dos</b>': [("/1", "uno")],
        '<table><tr><td><a href="/1">uno<td><a href="/2">dos</table>tres': [("/1", "uno"), ("/2", "dos")],
        '<a href="/1"><div>uno</a>dos</div>tres</a>': [("/1", "unodostres")],
        "</a></p>nada": [], "": [], "<a": [],
    }
    df = spark.createDataFrame([(h,) for h in cases], "html string")
    for html, parts in values(df.select("html", H.anchor_parts(H.elements(tags.repaired(F.col("html")), "a")).alias("parts")), "html", "parts"):
        assert [(p["href"], p["anchor_text"]) for p in parts] == cases[html], html


def test_regular_documents_are_left_alone(spark):
    html = "<html><head><title>t</title></head><body><h1><a href='/x'>x</a></h1><p>y</p><ul><li><a href='/y'><img src='z'></a></li></ul><a><h2>h</h2></a></body></html>"
    row = spark.createDataFrame([(html, "<a href='/x'>x<p>y")], "a string, b string").select(tags.is_regular(F.col("a")).alias("a"), tags.is_regular(F.col("b")).alias("b"), tags.repaired(F.col("a")).alias("same")).first()
    assert row["a"] and not row["b"] and row["same"] == html


def test_facts_of_a_broken_page(spark):
    html = "<html><body><h1>uno<p>texto</p><a href='/a'>a<a href='/b'>b<div><a href='/c'><b>c</div><h2>dos</body>"
    row = facts.page_facts(fetches(spark, [fetch(1, "https://example.com/", html)])).first()
    assert row["h1"] == ["uno"] and row["h2"] == ["dos"]
    assert [(x["target"], x["anchor_text"]) for x in row["outlinks"]] == [("https://example.com/a", "a"), ("https://example.com/b", "b"), ("https://example.com/c", "c")]


def test_a_page_with_thousands_of_unclosed_anchors(spark):
    html = "".join(f"<div><a href='/{i}'>{i}<span>x</div>" for i in range(1500))
    row = spark.createDataFrame([(html,)], "html string").select(F.size(H.elements(tags.repaired(F.col("html")), "a")).alias("n")).first()
    assert row["n"] == 1500
