"""Where the blocks of a page begin and end: one pass over its tags (H4).

A stack of open elements as a forgiving parser keeps it: a paragraph ends where a block starts, an item where
the next item of its list starts, a heading where another starts, and a closing tag ends everything inside its
element. Closing tags without an element are ignored. Nothing reaches out of a table cell but the end of a cell.

The stack is a string, top first, with one letter and a number per open element, so that finding an element
is a search for a letter and closing elements is a cut. What a tag ends is written behind what the tags before
it ended, in one string per stretch of tags; no step copies the results of earlier stretches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow.functions.urls import let

# One letter per tag that ends a block; headings of every rank share one.
LETTERS = {
    "p": "p", "h": "h", "li": "l", "ul": "u", "ol": "o", "div": "d", "nav": "n", "article": "a", "section": "s", "footer": "f", "header": "e",
    "main": "m", "aside": "i", "form": "r", "blockquote": "q", "body": "b", "html": "t", "table": "T", "td": "D", "th": "H",
}
BLOCKS, LISTS, CELLS = "phl", "uo", "TDH"
#: Digits of a tag's number, and tags per stretch.
DIGITS, STRETCH = 9, 256
ENTRY = 1 + DIGITS
REST = 1 << 30


def tag_codes(tags: Column) -> Column:
    """The letter of each tag, behind a slash if it closes."""
    letters = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in LETTERS.items())), F.lit(","), F.lit(":"))
    name = lambda x: F.lower(F.regexp_extract(x, "^</?([A-Za-z]+)", 1))
    return F.transform(tags, lambda x: F.concat(F.regexp_extract(x, "^<(/?)", 1), F.element_at(letters, name(x))))


def _number(at: Column) -> Column:
    return F.lpad(at.cast("string"), DIGITS, "0")


def _behind(stack: Column, n: Column) -> Column:
    """The stack without its first n letters; cut as bytes, which counts no characters."""
    return F.substring(stack.cast("binary"), n + 1, F.lit(REST)).cast("string")


def _closed(stack: Column, code: Column) -> Column:
    """Length of the stack's upper part that a tag ends. An open paragraph is on top: every tag here would end it."""
    letter = F.right(code, F.lit(1))
    on_top = lambda x: F.startswith(stack, F.lit(x))

    def through(wanted: Column, barred: str) -> Column:
        """Down to the first element of that letter, unless a barred one lies above it."""
        return let(F.instr(stack, wanted), lambda k: F.when((k == 0) | F.substring(stack, F.lit(1), k).rlike(f"[{barred}]"), 0).otherwise(k + DIGITS))

    top = F.when(on_top("p") | ((letter == "h") & on_top("h")), ENTRY).otherwise(0)
    return (
        F.when(code == "l", F.greatest(top, through(F.lit("l"), CELLS + LISTS)))
        .when(F.length(code) == 1, top)
        .when(letter.isin(*CELLS), through(letter, " "))
        .otherwise(through(letter, CELLS))
    )


def _step(state: Column, code: Column) -> Column:
    def cut(n: Column) -> Column:
        pushed = F.when(F.length(code) == 1, F.concat(code, _number(state["at"]))).otherwise("")
        ended = F.concat(state["out"], F.substring(state["stack"], F.lit(1), n), F.lit("@"), _number(state["at"]), F.lit(";"))
        return F.struct(
            F.concat(pushed, F.when(n > 0, _behind(state["stack"], n)).otherwise(state["stack"])).alias("stack"),
            F.when(n > 0, ended).otherwise(state["out"]).alias("out"),
            (state["at"] + 1).alias("at"),
        )

    return let(_closed(state["stack"], code), cut)


def block_ends(tags: Column) -> Column:
    """(i, e) of every block in the order of their starts: it holds the pieces i .. e - 1, where piece i is the text
    behind tag i (the first tag is 1)."""
    empty = F.expr("CAST(array() AS array<string>)")

    def stretch(state: Column, codes: Column) -> Column:
        start = F.struct(state["stack"].alias("stack"), F.lit("").alias("out"), state["at"].alias("at"))
        return let(
            F.aggregate(codes, start, _step),
            lambda r: F.struct(r["stack"].alias("stack"), F.concat(state["outs"], F.array(r["out"])).alias("outs"), r["at"].alias("at")),
        )

    def spans(state: Column) -> Column:
        left = F.concat(state["stack"], F.lit("@"), _number(state["at"]))  # open to the end of the page
        groups = F.flatten(F.transform(F.concat(state["outs"], F.array(left)), lambda o: F.split(o, ";")))
        one = lambda i, g: F.struct(i.cast("int").alias("i"), F.right(g, F.lit(DIGITS)).cast("int").alias("e"))
        each = lambda g: F.transform(F.regexp_extract_all(g, F.lit(f"[{BLOCKS}]([0-9]{{{DIGITS}}})"), 1), lambda i: one(i, g))
        return F.array_sort(F.flatten(F.transform(groups, each)))

    def fold(codes: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(codes), F.lit(STRETCH)), lambda k: k < F.size(codes))
        stretches = F.transform(starts, lambda k: F.slice(codes, k + 1, F.lit(STRETCH)))
        return F.aggregate(stretches, F.struct(F.lit("").alias("stack"), empty.alias("outs"), F.lit(1).alias("at")), stretch, spans)

    return let(tag_codes(tags), fold)
