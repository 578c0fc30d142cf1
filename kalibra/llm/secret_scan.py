"""Secret scans: patterns, and literals that source or configuration text assigns to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the operator's definition: the base kinds in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGNED = 12
#: Runs are taken whole, so a least length in the pattern drops the same runs as a filter after it.
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{14,}"), re.compile("[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "literal"]
#: Without one of these no name is sensitive, so that most texts need no lexing.
HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "salt", "bearer")

#: How much a name says that its value is secret, by its words; words that say that it only describes one.
STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "authtoken", "accesskey", "secretkey", "privatekey"}
MEDIUM, WEAK = {"auth", "bearer", "pass", "salt", "cred", "creds"}, {"key"}
QUALIFIERS = {"api", "access", "private", "auth", "encryption", "signing", "master", "account", "shared", "session"}
DESCRIBING = {"name", "length", "len", "count", "type", "file", "path", "url", "uri", "field", "label", "hint", "placeholder", "ttl", "expiry", "regex", "pattern", "header", "policy", "min", "max", "size", "limit", "public", "id", "index"}
PLACEHOLDER = re.compile(r"(?i)^(?:\W*(?:change_?me.*|(?:replace|your|my|insert|enter|example|sample|dummy|test|todo|none|null|undefined|redacted|placeholder|default)\b.*)|(.)\1*|[x*.#-]+|.*(?:\$\{|\{\{|%\(|<[a-z]).*|(?:https?|file)://[^:@]*|(?:\.{0,2}/)?(?:[a-z_.-]+/)+[a-z_.-]*)$")
#: A literal counts if its name's weight and its own strength reach this.
ENOUGH = 5

_NAME = r"[A-Za-z_$][\w$.\-]*+"
#: A name and what assigns to it: an operator, perhaps after a type; a definition; an option; an XML element.
PAIR = re.compile(
    rf"""(?<![\w$.\-])-{{0,2}}(["'`]?)({_NAME})\1\]?[ \t]*+(?::[ \t]*+([A-Za-z_][\w.<>\[\]|?]*+)[ \t]*+=(?![=~])|:=|=>|=(?![=~])|:(?!:))[ \t]*+"""
    rf"""|\#define[ \t]++(\w++)[ \t]++|(?<!\S)--({_NAME})[ \t]++(?=[^\s\-])|<({_NAME})(?:[ \t][^<>]*+)?>(?=[^<>\s])"""
)
QUOTED = re.compile(r"""[rRbBuUfF@]{0,2}(?:"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\\]*+(?:\\.[^`\\]*+)*+)`)""")
REFERENCE = re.compile(rf"({_NAME})(?=[ \t]*+\+)")
BARE = re.compile(r"""[^\s"'`,;:=(){}\[\]<>|&]++=*+""")
#: What joins the parts of a value, and what a name's words are.
JOIN, WORDS = re.compile(r"""[ \t]*+(?:[+~][ \t]*+(?=["'`\w])|\.\.?[ \t]*+(?=["'`])|(?=["'`]))"""), re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

Part = tuple[int, int, bool]  # start, end, quoted


def weight(name: str) -> int:
    """0 to 3: how sensitive a name is."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in DESCRIBING:
        return 0
    if STRONG & {*words, words[-1].removesuffix("s"), "".join(words[-2:])} or (words[-1] in WEAK | {"keys"} and QUALIFIERS & set(words)):
        return 3
    return 2 if words[-1] in MEDIUM else 1 if words[-1] in WEAK else 0


def strength(literal: str, quoted: bool) -> int:
    """-9 for what is no secret by itself, else 0 to 4 by length, mixture and entropy. A value without quotes must mix
    letters and digits, as a word of prose doesn't."""
    letters, digits = any(c.isalpha() for c in literal), any(c.isdigit() for c in literal)
    if len(literal) < 8 or any(c.isspace() for c in literal) or PLACEHOLDER.match(literal) or not (quoted or (letters and digits)):
        return -9
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    kinds = digits + any(c.islower() for c in literal) + any(c.isupper() for c in literal) + any(not c.isalnum() for c in literal)
    return (len(literal) >= 12) + (letters and digits) + (bits >= 3) + (kinds >= 3)


def value_at(text: str, at: int, defined: dict, joined: bool) -> tuple[list[Part], list[str], int]:
    """The literals that a value joins (the first alone unless ``joined``), the names it refers to, and where it ends. A
    bare word is a reference if it is ``defined``, else a literal; a call has no known value."""
    parts: list[Part] = []
    names: list[str] = []
    while True:
        if m := QUOTED.match(text, at):
            parts.append((*m.span(m.lastindex), True))
        elif (m := REFERENCE.match(text, at)) and m[1] in defined:
            names.append(m[1])
        elif (m := BARE.match(text, at)) and text[m.end() : m.end() + 1] != "(":
            word = m[0].rstrip(".,:!?")
            if word in defined:
                names.append(word)
            elif not parts and not names:
                parts.append((m.start(), m.start() + len(word), False))
        else:
            return parts, names, at
        at = m.end()
        if not joined or not (m := JOIN.match(text, at)):
            return parts, names, at
        at = m.end()


def literals(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, name, score) of the secret literals: those that reach a sensitive name by assignments in the text.

    A name's literals are those of all its assignments; a reference passes on the weight of the name that it is assigned
    to, over any number of names. Each literal counts for its weightiest name, of equals the first by name.
    """
    found = []
    for m in PAIR.finditer(text):
        name, kind = next((g, m[3]) for g in (m[2], m[4], m[5], m[6]) if g)
        found += [(n.removeprefix("self.").removeprefix("this."), m.end()) for n in ([name, kind] if kind and weight(kind) else [name])]
    own: dict[str, list[int]] = defaultdict(list)
    for k, (name, _) in enumerate(found):
        own[name].append(k)
    values, last, reach = [], None, 0
    for name, at in found:
        parts, names, end = value_at(text, at, own, joined=at >= reach)  # what stands within a value is read by its first part
        reach = max(reach, end)
        if name.lower() == "value" and last and last[0].lower() in ("key", "name") and len(last[1]) == 1 and text[last[2] : at].count("\n") < 2:
            name = text[last[1][0][0] : last[1][0][1]]  # <... key="token" value="..."/>
            own[name].append(len(values))
        values.append((name, parts, [n for n in names if n != name]))
        last = (name, parts, end)
    best: dict[Part, tuple[int, str]] = {}
    reached: dict[str, int] = {}
    for w, name in sorted({(-weight(n), n) for n, _, _ in values}):
        if not w:
            break
        todo = list(own[name])
        while todo:
            _, parts, names = values[todo.pop()]
            for p in parts:
                best.setdefault(p, (-w, name))
            for n in names:
                if reached.get(n, 0) < -w:
                    reached[n] = -w
                    todo.extend(own[n])
    scored = [(p[0], p[1], name, w + strength(text[p[0] : p[1]], p[2])) for p, (w, name) in best.items()]
    return sorted(x for x in scored if x[3] >= ENOUGH)


def spans(text: str | None) -> list[tuple[str, int, int, str | None, int | None]]:
    """(kind, start, end, name, score) in code points, by start, then kind as listed, then end; name and score of literals only."""
    if not text:
        return []
    found: list[tuple] = [("access", *m.span(), None, None) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span(), None, None) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", *m.span(), None, None) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGNED]
        found += [("literal", *x) for x in literals(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType())]))


@F.pandas_udf(SPANS)
def found_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in spans(t)] for t in texts], dtype=object)


def scan(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): the spans of each row of ``documents``, an array of (kind, start, end, name, score).

    Kinds: assign, access and hex by pattern; literal by assignment: names and literals are read from source and
    configuration syntax (operators, typed and quoted names, constants, options, XML elements and key-value attributes),
    constants are followed to where they are used, and a literal is scored by the most sensitive name that it reaches
    and by its own looks. A literal may lie within a span by pattern; patterns' spans always stay.
    Whole texts of any length; null and empty ones have no spans; repeated rows each have theirs; other columns are
    ignored; an empty table gives none. A row's work needs its own text alone: nothing is shuffled.
    """
    return documents.select(F.col(id_col).alias("doc_id"), found_spans(F.col(text)).alias("found"))


def redact(documents: DataFrame, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``documents`` with every span in ``text`` replaced by ``mark``, overlapping ones together."""

    @F.pandas_udf(T.StringType())
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([without(t, mark) for t in texts], dtype=object)

    return documents.withColumn(text, redacted(F.col(text)))


def without(text: str | None, mark: str) -> str | None:
    out, at = [], 0
    for _, start, end, _, _ in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if text else text


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of a ``scan``; spans are written kind:start:end."""
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base: Column = F.filter("found", lambda s: s["kind"] != "literal")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
