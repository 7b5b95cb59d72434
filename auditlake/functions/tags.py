"""Broken markup repaired: missing end tags are put where a tree builder would end the element.

The document's tags are one array.  A native fold walks it with a stack of open elements and notes what has to be closed
before which tag; end tags without a start are noted too.  A last pass over the array writes the missing end tags out and
blanks the stray ones, so that every pattern over the result meets well-formed elements.

* An ``<a>`` ends before the next ``<a>`` (what is open within it stays open) and before table parts; a heading before a paragraph, list item, table, form or
  another heading; a paragraph before block elements; list items, table rows and cells before the next of their kind.
* An end tag ends all that was opened within its element, unless an element of higher rank lies between: ``</a>`` can't
  close a ``<div>``.  An end tag whose element is not open is dropped.
* What is still open at the end of the document ends there.

Most documents need none of this: ``is_regular`` tells by one pattern, and only others are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from auditlake.functions.binding import let

TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(?:[\s/][^>]*)?>"
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *_HEADINGS)
#: Which open element ends when a start tag comes: the innermost one and all that lies within it.
CLOSED_BY = {
    "a": ("table", "td", "th", "tr", "fieldset"),
    "p": _BLOCKS,
    **{h: (*_HEADINGS, "p", "li", "table", "form", "fieldset") for h in _HEADINGS},
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "title": ("title", "body"),
}
#: Rank of an element: an end tag closes nothing of a rank above its own.
RANKS = {"p": 10, "div": 150, "section": 150, "article": 150, "li": 150, "ul": 155, "ol": 155, "td": 160, "th": 160, "tr": 170, "tbody": 180, "thead": 180, "table": 190, "head": 200, "body": 200, "html": 220}
#: Elements that a new start tag looks through when it closes an outer one; beyond these it closes nothing.
_WALLS = ("table", "td", "th", "div", "section", "article", "ul", "ol", "body", "html")
#: Elements that are looked for behind walls too: anchors and headings don't nest, and table parts are walls themselves.
_ANYWHERE = ("a", *_HEADINGS, "td", "th")


def _rank(name: Column) -> Column:
    out = F
    for element, rank in RANKS.items():
        out = out.when(name == element, F.lit(rank))
    return out.otherwise(F.lit(100))


def is_regular(doc: Column) -> Column:
    """Every anchor, heading and title ends with nothing in between that could end it.

    The tags that matter are listed by name; pairs that stand next to each other are taken out, inner ones first.
    """
    matter = "a|h[1-6]|title|table|td|th|tr|fieldset|form|li|p|div|section|article|ul|ol|body|html"
    listed = F.lower(F.array_join(F.regexp_extract_all(doc, F.lit(rf"(?i)(</?(?:{matter}))(?=[\s/>])"), F.lit(1)), ";"))
    pairs = lambda s: F.replace(F.concat(s, F.lit(";")), F.lit("<a;</a;"), F.lit(""))
    inner = F.regexp_replace(pairs(listed), r"<(h[1-6]|title);</\1;", "")
    return ~F.replace(inner, F.lit("<a;</a;"), F.lit("")).rlike(r"</?(a|h[1-6]|title);")


def _folded(doc: Column) -> Column:
    tags = F.regexp_extract_all(doc, F.lit(TAG), F.lit(0))
    texts = F.split(doc, TAG, -1)
    name_of = lambda tag: F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))

    def walk(names: Column, tags: Column, texts: Column) -> Column:
        empty = F.array().cast("array<string>")
        start = F.struct(empty.alias("stack"), F.array().cast("array<struct<i:int,ends:string,drop:boolean>>").alias("notes"))
        closing = lambda part: F.array_join(F.transform(F.reverse(part), lambda e: F.concat(F.lit("</"), e, F.lit(">"))), "")

        # every value that is mentioned more than once is bound: spelt out, the expression would grow with each mention
        def step(state: Column, i: Column) -> Column:
            seen = F.struct(
                i.cast("int").alias("i"), F.get(names, i).alias("name"), F.get(tags, i).startswith("</").alias("ending"), F.get(tags, i).endswith("/>").alias("empty"),
                state["stack"].alias("stack"), F.reverse(state["stack"]).alias("back"), F.size(state["stack"]).alias("depth"), state["notes"].alias("notes"),
            )
            return let(seen, moved)

        def moved(s: Column) -> Column:
            last = lambda e: s["depth"] - F.array_position(s["back"], e) + 1  # noqa: E731  place of the innermost e, 1-based; depth + 1: none
            inner = lambda e: F.when(F.array_contains(s["stack"], e), last(e)).otherwise(0)
            places = F.struct(last(s["name"]).alias("at"), F.greatest(F.lit(0), *[inner(w) for w in _WALLS]).alias("wall"), last("a").alias("anchor"))
            return let(places, lambda p: let(cut(s, p, last), lambda c: let(implied(s, p, c), lambda ends: after(s, p, c, ends))))

        def cut(s: Column, p: Column, last) -> Column:
            """How much of the stack stays, and whether an end tag has its element there with nothing of a higher rank within."""
            above = F.slice(s["stack"], p["at"] + 1, F.greatest(s["depth"] - p["at"], F.lit(0)))
            held = (p["at"] <= s["depth"]) & ~F.exists(above, lambda e: _rank(e) > _rank(s["name"]))
            none = s["depth"] + 1
            closed = [
                F.when(s["name"].isin(*closers), last(e) if e in _ANYWHERE else F.greatest(last(e), F.when(last(e) > p["wall"], F.lit(0)).otherwise(none))).otherwise(none)
                for e, closers in CLOSED_BY.items()
            ]
            again = ~s["ending"] & (s["name"] == "a") & (p["anchor"] <= s["depth"])
            held = F.coalesce(held, F.lit(False))
            return F.struct(
                held.alias("held"), again.alias("again"), F.when(s["ending"], F.when(held, p["at"] - 1).otherwise(s["depth"])).otherwise(F.least(*closed) - 1).alias("keep"),
            )

        def implied(s: Column, p: Column, c: Column) -> Column:
            """Elements that end without an end tag of their own, outermost first; of an anchor within an anchor the outer one."""
            within = lambda place: F.slice(s["stack"], place + 1, F.greatest(s["depth"] - place, F.lit(0)))
            return F.when(c["again"], F.array(F.lit("a"))).when(s["ending"] & ~c["held"], empty).otherwise(within(F.when(s["ending"], p["at"]).otherwise(c["keep"])))

        def after(s: Column, p: Column, c: Column, ends: Column) -> Column:
            rest = F.concat(F.slice(s["stack"], F.lit(1), p["anchor"] - 1), F.slice(s["stack"], p["anchor"] + 1, F.greatest(s["depth"] - p["anchor"], F.lit(0))))
            left = F.when(c["again"], rest).otherwise(F.slice(s["stack"], F.lit(1), c["keep"]))
            stack = F.concat(left, F.when(s["ending"] | s["empty"] | s["name"].isin(*VOID), empty).otherwise(F.array(s["name"])))
            drop = s["ending"] & ~c["held"]
            note = F.struct(s["i"].alias("i"), closing(ends).alias("ends"), drop.alias("drop"))
            notes = F.when((F.size(ends) > 0) | drop, F.array_append(s["notes"], note)).otherwise(s["notes"])
            return F.struct(stack.alias("stack"), notes.alias("notes"))

        count = F.size(tags)
        walked = F.aggregate(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), start, step)

        def written(state: Column) -> Column:
            by_place = F.map_from_entries(F.transform(state["notes"], lambda n: F.struct(n["i"], n)))

            def piece(tag: Column, i: Column) -> Column:
                note = F.try_element_at(by_place, i)
                out = F.when(note.isNull(), tag).otherwise(F.concat(note["ends"], F.when(note["drop"], F.lit("")).otherwise(tag)))
                return F.concat(F.get(texts, i), out)

            return F.concat(F.array_join(F.transform(tags, piece), ""), F.get(texts, count), closing(state["stack"]))

        return let(walked, written)

    return let(tags, lambda t: let(texts, lambda x: let(F.transform(t, name_of), lambda n: walk(n, t, x))))


def repaired(doc: Column) -> Column:
    """The document with every element ended; ``doc`` has no comments, scripts or style sheets."""
    return let(doc, lambda d: F.when(is_regular(d), d).otherwise(_folded(d)))
