"""Lines of documents that carry no content: what kinds of such lines a line is, and which kinds each reader leaves out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

# Marks and phrases of the documents' furniture. Squeezed phrases are met without blanks and marks.
STAMP_MARK = "[PVER]"
RIGHTS = ["reservesallrights", "copyingandpassingontothirdparties"]
LEGAL = ["reserveallright", "reservesallright", "reservedallright", "thirdpartie", "industrialpropertyright"]
LICENCE = ["copyright", "licensedunder", "allrightsreserved", "license"]
EDITING = ["calibration of function labels", "must be edited by calibration parameter editor", "do not edit these tables manually", "label name", "description", "caution", "apph_labtab"]
CONSTANTS = ["systemconstants"]

#: The kinds that each reader leaves out: of pages, of printed tables, of what continues a record, of sections' texts;
#: and of corpora, which have none of the others' notation.
RULES = {
    "page": ["blank", "bar", "running_head", "legal", "header"],
    "table": ["blank", "stamp", "rights", "page_number", "version", "constants"],
    "continuation": ["blank", "header", "stamp", "rights", "page_number", "version_page", "version"],
    "section": ["editing"],
    "corpus": ["blank", "page_number", "numbers", "licence"],
}


def kinds(line: Column) -> Column:
    """array<string>: all kinds that a line is of, empty for content; a null line is blank.

    A line is read once: its tokens (a bar is one of its own), its lower-case text, and that without blanks and marks; every
    kind is a test of these.
    """
    text = F.coalesce(line, F.lit(""))
    shown = collapsed(F.replace(text, F.lit("|"), F.lit(" | ")))
    facts = F.struct(F.split(shown, " ").alias("t"), F.lower(collapsed(text)).alias("low"), F.regexp_replace(F.lower(text), r"[^a-z]+", "").alias("squeezed"))
    return F.get(F.transform(F.array(facts), _kinds), F.lit(0))


def _kinds(f: Column) -> Column:
    t = f["t"]
    at = lambda n: F.coalesce(F.get(t, F.lit(n)), F.lit(""))
    number = lambda c: c.rlike(r"^\d+$")
    version = lambda c: c.rlike(r"^\d+\.\d+\.\d+;?\d*$")
    holds = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(f["squeezed"], p))
    named = at(0).rlike(r"^\w+$") & version(at(1))
    paged = number(at(2)) & (at(3) == "|")
    three = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 3, F.lit(0))), lambda i: F.struct(F.get(t, i).alias("a"), F.coalesce(F.get(t, i + 1), F.lit("")).alias("b"), F.coalesce(F.get(t, i + 2), F.lit("")).alias("c")))
    found = {
        "blank": f["low"] == "",
        "bar": f["low"] == "|",
        "numbers": f["low"].rlike(r"^[\d. ]*\d[\d. ]*$"),
        "page_number": (F.size(t) == 3) & number(at(0)) & (at(1) == "|") & number(at(2)),
        "stamp": at(0).rlike(r"^\d{4}-\d\d-\d\d$") & (at(1) == "|") & at(2).startswith(STAMP_MARK),
        "version": named & (F.size(t) == 2),
        "version_page": named & paged & number(at(4)) & (F.size(t) == 5),
        "running_head": F.exists(three, lambda x: x["a"].rlike(r"\d\.\d+\.\d+;\d+$") & number(x["b"]) & (x["c"] == "|")),
        "constants": at(0).rlike(r"^\d+(\.\d+)*$") & F.lower(F.concat(at(1), F.when(F.lower(at(1)) == "system", at(2)).otherwise(""))).startswith(CONSTANTS[0]),
        "rights": holds(RIGHTS),
        "legal": holds(LEGAL),
        "licence": holds(LICENCE),
        "header": f["low"].rlike(r"^label ?name\b"),
        "editing": F.exists(F.array(*[F.lit(p) for p in EDITING]), lambda p: F.contains(f["low"], p)),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in found.items()]))


def is_noise(found: Column, rules: str) -> Column:
    """Whether a reader's rules leave out a line of the kinds ``found``."""
    return F.arrays_overlap(found, F.array(*[F.lit(k) for k in RULES[rules]]))
