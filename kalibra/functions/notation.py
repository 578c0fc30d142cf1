"""The notation of calibration texts, read token by token: announced values, units, bounds, ranges and axes.

A text becomes tokens once (numbers, bracketed parts, words, marks); what is looked for is a short walk over them, left
out where the words that it starts with don't occur. The readers run in Arrow batches, a row's text at a time; the tokens
of the last text are kept for the next reader.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache

# Words and marks of the notation.
VALUE_WORDS = "start standard default initial".split()
AXIS_LETTERS = {"x", "X", "y", "Y"}
DASHES = ("", "-", "−", "--")
TOKEN = re.compile(r"\s*(?:(?P<dots>\.{3})|(?P<number>[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)|\[(?P<bracket>[^\]]*)\]|(?P<word>[A-Za-z_]\w*(?:[./-][A-Za-z_]\w*)*)|(?P<mark>\S))")
FILLERS = {":", "=", ",", ";"}
#: Phrases that bound a value: # is a number, a slash parts alternatives; which bounds the numbers are.
BOUNDS = [
    ("explicit_between", ["between # and/to #"], ("lower", "upper")),
    ("explicit_min_max", ["min # max #"], ("lower", "upper")),
    ("explicit_greater_than", ["greater than #", "at least #", "> #"], ("lower",)),
    ("explicit_less_than", ["less than #", "at most #", "< #"], ("upper",)),
]

LEADS = {p.split(" ")[0] for _, phrases, _ in BOUNDS for p in phrases}

Token = tuple[str, str]  # kind, text


@lru_cache(maxsize=1)
def tokens(text: str | None) -> list[Token]:
    return [(m.lastgroup, m[m.lastindex]) for m in TOKEN.finditer(text or "")]


def has_axis_letter(low: str) -> bool:
    return "x" in low or "y" in low


def unit(text: str) -> str:
    bare = text.strip()
    return "dimensionless" if bare in DASHES else bare


@cache
def phrase_words(phrase: str) -> list[list[str] | None]:
    """What may stand at each place of a phrase; none: a number."""
    return [None if w == "#" else w.split("/") for w in phrase.split(" ")]


def phrase_at(found: list[Token], i: int, phrase: str) -> bool:
    words = phrase_words(phrase)
    if i + len(words) > len(found):
        return False
    for k, w in enumerate(words, i):
        if found[k][0] != "number" if w is None else found[k][1].lower() not in w:
            return False
    return True


def marker(found: list[Token]) -> int:
    """The place after the first announcement of a value (*start value*, *startvalue*) and its colon; 0 without one."""
    low = [said.lower() for _, said in found]
    for i, w in enumerate(low):
        size = 1 if w.removesuffix("value") in VALUE_WORDS and w.endswith("value") else 2 if w in VALUE_WORDS and low[i + 1 : i + 2] == ["value"] else 0
        if size:
            return i + size + (low[i + size : i + size + 1] == [":"])
    return 0


def run(found: list[Token], start: int) -> tuple[list[float], int]:
    """The numbers that follow each other from a place, commas and semicolons apart, and the place after the last."""
    values, end, i = [], start, start
    while i < len(found) and (found[i][0] == "number" or found[i][1] in (",", ";")):
        if found[i][0] == "number":
            values.append(float(found[i][1]))
            end = i + 1
        i += 1
    return values, end


def heads(found: list[Token]) -> list[dict]:
    """Axis heads: a letter and a colon, perhaps a signal, a unit and a size in brackets."""
    out = []
    for i, (_, letter) in enumerate(found):
        if letter not in AXIS_LETTERS or found[i + 1 : i + 2] != [("mark", ":")]:
            continue
        at = i + 2 + (found[i + 2 : i + 3] != [] and found[i + 2][0] in ("word", "number"))
        brackets = found[at : at + 2]
        if [k for k, _ in brackets] == ["bracket"] * 2 and brackets[0][1].strip() and brackets[1][1].strip().isdigit():
            out.append({"at": i, "axis": letter.upper(), "signal": found[i + 2][1] if at == i + 3 else None, "unit": unit(brackets[0][1]), "size": int(brackets[1][1]), "after": at + 2})
    return out


def outside_axes(found: list[Token]) -> list[Token]:
    """The tokens that are neither in axis heads nor in bare axes: a letter, perhaps a colon, two numbers or more."""
    within = {k for h in heads(found) for k in range(h["at"], h["after"])}
    rest = [t for k, t in enumerate(found) if k not in within]
    out, i = [], 0
    while i < len(rest):
        if rest[i][1] in AXIS_LETTERS:
            values, end = run(rest, i + 1 + (rest[i + 1 : i + 2] == [("mark", ":")]))
            if len(values) > 1:
                i = end
                continue
        out.append(rest[i])
        i += 1
    return out


def start_value(text: str | None) -> dict:
    low = (text or "").lower()
    out = {"values": None, "unit": None, "for_all": False}
    if "value" not in low and "[" not in low and "all" not in low:
        return out
    found = tokens(text)
    start = marker(found) if "value" in low else 0
    rest = [t for t in (found[start:] if start else outside_axes(found) if has_axis_letter(low) else found) if t[1] not in (",", ";")]
    out["for_all"] = "all" in low and any(said.lower() == "all" for _, said in rest)
    if start and "table" in low and any(phrase_at(rest, i, p) for i in range(len(rest)) for p in ("see table", "table #")):
        return out
    lists = []  # the numbers right before each unit
    for i, (kind, said) in enumerate(rest):
        if kind == "bracket":
            first = i
            while first and rest[first - 1][0] == "number":
                first -= 1
            if first < i:
                lists.append(([float(n) for _, n in rest[first:i]], unit(said)))
    chosen = next((x for x in reversed(lists) if len(x[0]) > 1), lists[-1] if lists else None)
    if chosen:
        out["values"], out["unit"] = chosen
    elif start:
        out["values"] = [float(said) for kind, said in rest if kind == "number"] or None
    return out


def limits(text: str | None) -> dict | None:
    low = (text or "").lower()
    for lead in LEADS:
        if lead in low:
            break
    else:
        return None
    found = [t for t in tokens(text) if t[1] not in FILLERS]
    for kind, phrases, names in BOUNDS:
        leads = [p for p in phrases if p[: p.index(" ")] in low]
        if not leads:
            continue
        for i in range(len(found)):
            for p in leads:
                if phrase_at(found, i, p):
                    values = [float(said) for k, said in found[i : i + len(p.split(" "))] if k == "number"]
                    return {"lower": None, "upper": None, **dict(zip(names, values, strict=True)), "kind": kind}
    return None


def physical_range(text: str | None) -> dict:
    found = tokens((text or "").replace("−", "-").replace("–", "-")) if "..." in (text or "") else []
    at = [i for i in range(len(found)) if phrase_at(found, i, "# ... #")]
    if not at:
        return {"lower": None, "upper": None, "unit": None}
    i = at[min(1, len(at) - 1)]
    after = found[i + 3 : i + 4]
    return {"lower": float(found[i][1]), "upper": float(found[i + 2][1]), "unit": (after[0][1] or None) if after and after[0][0] == "bracket" else None}


def axes(text: str | None) -> list[dict]:
    if not has_axis_letter((text or "").lower()):
        return []
    found, out = tokens(text), []
    own = heads(found)
    for h, end in zip(own, [*(h["at"] for h in own[1:]), len(found)], strict=False):
        tail = found[h["after"] : end]
        points = next((values for i in range(len(tail)) if tail[i][0] == "number" and len(values := run(tail, i)[0]) > 1), None)
        out.append({k: h[k] for k in ("axis", "signal", "unit", "size")} | {"breakpoints": points[: h["size"]] if points and h["size"] > 0 else points})
    return out


def table_reference(text: str | None) -> str | None:
    found = tokens(text)
    rest = found[marker(found) :]
    return next((rest[i + 1][1] for i in range(len(rest)) if phrase_at(rest, i, "table #") and rest[i + 1][1].isdigit()), None)


def before_marker(text: str | None) -> str:
    """The words before the first announcement of a value; all without one."""
    words = (text or "").split()
    low = [re.sub(r"^\W+|\W.*$", "", w.lower()) for w in words]
    at = next((i for i, w in enumerate(low) if (w.endswith("value") and w.removesuffix("value") in VALUE_WORDS) or (w in VALUE_WORDS and low[i + 1 : i + 2] == ["value"])), len(words))
    return " ".join(words[:at])


def colon_after(words: list[str]) -> int | None:
    """The place after the first announcement of a value that ends in a colon, which is a word of its own."""
    low = [re.sub(r"^\W+", "", w.lower()) for w in words]
    for i, w in enumerate(low):
        size = 1 if w.endswith("value") and w.removesuffix("value") in VALUE_WORDS else 2 if w in VALUE_WORDS and low[i + 1 : i + 2] == ["value"] else 0
        if size and words[i + size : i + size + 1] == [":"]:
            return i + size + 1
    return None


def is_marked(text: str | None) -> bool:
    return colon_after((text or "").replace(":", " : ").split()) is not None


def marked_word(text: str | None) -> str | None:
    """The word after such a colon, up to a bracket; null without one."""
    words = (text or "").replace(":", " : ").split()
    at = colon_after(words)
    return (words[at].split("[")[0] or None) if at is not None and at < len(words) else None


def ended_value(line: str | None) -> dict | None:
    """(value, unit) of a line that ends in an announced start or standard value, the unit empty without brackets."""
    text = (line or "").replace("：", ":")
    for at in (k for k, c in enumerate(text) if c == ":"):
        head = "".join(text[:at].lower().split())
        value, bracket, rest = text[at + 1 :].strip().partition("[")
        if head.endswith(("startvalue", "standardvalue")) and (not bracket or (rest.endswith("]") and "]" not in rest[:-1])):
            return {"value": value, "unit": rest[:-1]}
    return None
