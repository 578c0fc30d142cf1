"""Rows of calibration tables in the lines of documents: where tables are open, which lines make a row, which row counts.

``lines`` is (doc_id, page, line_no, line) throughout; a document's lines are ordered by page and line. Windows span one
document, or one page of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, noise
from ..functions import text as tx
from .sequence import ordered, runs

KEY, ORDER = ["doc_id"], ["page", "line_no"]
# Fixed value: the mark before a label table.
TABLE_MARK = r"(?i)\[apph_labtab\]"
#: Punctuation that leaks from cells to the ends of a word.
FRINGE = r"""[.,;:()\[\]{}<>"'|\s]+"""


def cleaned_label(text: Column) -> Column:
    """The word without the punctuation around it; null if it is no label then."""
    bare = F.regexp_replace(text, rf"^{FRINGE}|{FRINGE}$", "")
    return F.when(bare.rlike(tx.LABEL), bare)


def label_in(line: Column) -> Column:
    """The first word of a line that is a label."""
    words = F.transform(F.split(line, r"\s+"), cleaned_label)
    return F.get(F.filter(words, lambda w: w.isNotNull()), F.lit(0))


def words_in(line: Column) -> Column:
    """A line's words; none of a blank line."""
    return F.filter(F.split(F.trim(F.coalesce(line, F.lit("")), F.lit(" \t\r")), r"\s+"), lambda w: w != "")


def word(line: Column, n: int) -> Column:
    """The line's ``n``-th word, from 0; empty where there is none."""
    return F.coalesce(F.get(words_in(line), F.lit(n)), F.lit(""))


def numbering(line: Column) -> Column:
    """How many parts the number has that a line begins with, as in ``3.1.2``; 0 without one or if nothing follows it."""
    parts = F.split(word(line, 0), r"\.")
    return F.when(F.forall(parts, lambda p: p.rlike(r"^\d+$")) & (F.size(words_in(line)) > 1), F.size(parts)).otherwise(0)


def heading_name(line: Column) -> Column:
    """The name that a heading gives: the letters, digits and underscores that its second word begins with, a bracket before them apart."""
    return F.when(numbering(line).between(1, 7), F.nullif(F.regexp_extract(F.ltrim(word(line, 1), F.lit("[")), r"^\w*", 0), F.lit("")))


def is_heading(line: Column) -> Column:
    return heading_name(line).isNotNull() & ~word(line, 1).startswith("[[")


def is_section(line: Column) -> Column:
    """Whether a line looks like a section's head: numbered in two parts at least, or short and ending in a colon."""
    bare = F.trim(line)
    return F.coalesce(numbering(line).between(2, 7) | ((F.length(bare) < 90) & bare.endswith(":")), F.lit(False))


def is_caution(line: Column) -> Column:
    return word(line, 0).rlike(r"(?i)^caution(\W|$)")


def ends_table(line: Column) -> Column:
    """Whether a line ends a label table: a caution about the tables above, or the heading of the system constants."""
    text = F.lower(tx.collapsed(F.coalesce(line, F.lit(""))))
    return (is_caution(line) & text.rlike(r"\btables above\b")) | ((numbering(line) > 0) & F.lower(word(line, 1)).eqNullSafe("system") & F.lower(word(line, 2)).startswith("constants"))


def ends_row(line: Column) -> Column:
    """Whether a line can't go on with the row above it: a label, a heading, an axis, a table's title, a caution, a date of this century."""
    first = F.lower(word(line, 0))
    axis = first.substr(1, 2).isin("x:", "y:")
    date = F.coalesce(F.length(F.regexp_extract(line, r"^20\d\d-", 0)) > 0, F.lit(False))
    return is_heading(line) | label_in(line).isNotNull() | axis | is_title(line) | is_caution(line) | date


def is_title(line: Column) -> Column:
    """Whether a line is a table's title: the word and a number."""
    return F.lower(word(line, 0)).eqNullSafe("table") & word(line, 1).rlike(r"^\d+(\W|$)")


def is_noise(line: Column) -> Column:
    """Whether a section's reader leaves the line out."""
    return noise.is_noise(noise.kinds(line), "section")


def module_of(line: Column) -> Column:
    """The function that a heading names: a word with an underscore, in brackets longer than three letters, plain not beginning with dsd."""
    name, bracketed = heading_name(line), word(line, 1).startswith("[")
    return F.when(name.contains("_") & F.when(bracketed, F.length(name) > 3).otherwise(~F.lower(name).startswith("dsd")), name)


def without_furniture(text: Column, patterns: list[str]) -> Column:
    """The text without the lines that match one of ``patterns`` (page headers), without blanks around it."""
    kept = F.filter(F.split(text, "\n"), lambda ln: ~F.exists(F.array(*[ln.rlike(p) for p in patterns]), lambda hit: hit))
    return F.trim(F.array_join(kept, "\n"), F.lit(" \n\t\r"))


def has_header_and_table(pages: DataFrame, headers: list[str], table: str, first: int = 12) -> DataFrame:
    """``pages(doc_id, page, text)`` that have a line like ``table`` anywhere and one of ``headers`` in their first ``first`` lines that are not blank."""
    full = F.filter(F.split("text", "\n"), lambda ln: F.trim(ln) != "")
    head = F.exists(F.slice(full, 1, first), lambda ln: F.exists(F.array(*[ln.rlike(h) for h in headers]), lambda hit: hit))
    return pages.where(F.col("text").rlike(table) & head)


def tabled(lines: DataFrame, lead: int = 2) -> DataFrame:
    """``lines`` with ``inside``: whether a label table is open there, and ``module``: the function it stands under.

    A mark opens a table, ``lead`` lines before itself on its page; a heading more than ``lead`` lines after the mark, or a
    table end, closes it; a table that reaches the end of a page goes on on the next one. The module is that of the last
    heading at or above the line, over pages too.
    """
    own, page = ordered(KEY, ORDER), Window.partitionBy("doc_id", "page").orderBy("line_no")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike(TABLE_MARK)
    recent = F.max(mark.cast("int")).over(page.rowsBetween(-lead, 0))
    ahead = F.max(mark.cast("int")).over(page.rowsBetween(0, lead))
    closes = ends_table(F.col("line")) | (is_heading(F.col("line")) & (recent == 0))
    flag = F.when(ahead == 1, F.lit(True)).when(closes, F.lit(False))
    return lines.withColumn("_flag", flag).withColumns({"inside": F.coalesce(F.last("_flag", ignorenulls=True).over(upto), F.lit(False)), "module": F.last(module_of(F.col("line")), ignorenulls=True).over(upto)}).drop("_flag")


def label_rows(lines: DataFrame, most: int = 12, everywhere: bool = False) -> DataFrame:
    """(doc_id, page, line_no, label, module, text, context): a label's line and those after it that go on with it.

    Rows are looked for in open tables, with ``everywhere`` also where a page has no table, before its first heading. A row
    ends before a line that ``ends_row``, at the end of its page or table, and after ``most`` lines that are not blank.
    ``context`` is what follows the label.
    """
    page = ["doc_id", "page"]
    marked = tabled(lines)
    if everywhere:
        whole = Window.partitionBy(*page)
        headed = F.max(is_heading(F.col("line")).cast("int")).over(whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
        tables = F.max(F.col("inside").cast("int")).over(whole)
        marked = marked.withColumns({"_headed": headed, "_tables": tables}).withColumn("inside", F.col("inside") | ((F.col("_tables") == 0) & (F.col("_headed") == 0)))
    label = F.when(F.col("inside"), label_in(F.col("line")))
    stops = ends_row(F.col("line")) | ~F.col("inside")
    full = marked.where(F.trim("line") != "").withColumns({"label": label, "_stops": stops})
    blocks = full.withColumn("_block", runs(F.col("_stops"), page, ["line_no"]))
    placed = blocks.withColumn("_k", F.row_number().over(Window.partitionBy(*page, "_block").orderBy("line_no"))).where(F.col("_k") <= most)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda p: tx.collapsed(p["line"])), " ")
    rows = placed.groupBy(*page, "_block").agg(F.min("line_no").alias("line_no"), F.min_by("label", "line_no").alias("label"), F.min_by("module", "line_no").alias("module"), body.alias("text"))
    context = tx.collapsed(F.trim(F.expr("substring(text, instr(text, label) + length(label))"), F.lit(" |-:")))
    return rows.where("label is not null").select(*page, "line_no", "label", "module", "text", context.alias("context"))


def richest(rows: DataFrame, key: list[str], richness: Column) -> DataFrame:
    """One row of each key, the richest; of equally rich ones the first by page and line."""
    names = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*names), F.struct(richness, -F.col("page"), -F.col("line_no")))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def simple_calibration_rows(lines: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, label, context, start_value, unit, page, module): each label's row of the longest context."""
    value = tx.start_value(F.col("text"))
    rows = label_rows(lines, most, everywhere=True).select("doc_id", "page", "line_no", "label", "context", value["values"].alias("start_value"), F.coalesce(value["unit"], F.lit("")).alias("unit"), F.coalesce("module", F.lit("")).alias("module"))
    return richest(rows, ["doc_id", "label"], F.length("context")).select("doc_id", "label", "context", "start_value", "unit", "page", "module")


def section_labels(lines: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(section_id, function, label, description, value, value_structure, context) of ``lines(section_id, function, line_no, line)``.

    A line with a label opens a row; what stands behind the label and the lines after it are its value from a value mark on
    (up to four such parts, later ones only with a mark), else its description. Of a label's rows the one with most text counts.
    """
    own = ["section_id"]
    bare = tx.collapsed(F.coalesce("line", F.lit("")))
    words = F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b"), F.lit(1))
    full = lines.withColumn("line", bare).where("line <> ''").withColumn("label", F.get(F.filter(words, labels.looks_like_label), F.lit(0)))
    blocks = full.withColumn("_block", runs(F.col("label").isNotNull(), own, ["line_no"]))
    tail = F.trim(F.expr("substring(line, instr(line, label) + length(label))"), F.lit(" |:-"))
    said = F.when(F.col("label").isNotNull(), tail).otherwise(F.col("line"))
    spoken = blocks.withColumn("said", F.when((said != "") & ~is_noise(said), said))
    block = Window.partitionBy("section_id", "_block").orderBy("line_no")
    before, upto = block.rowsBetween(Window.unboundedPreceding, -1), block.rowsBetween(Window.unboundedPreceding, 0)
    marked = spoken.withColumn("mark", tx.is_marked(F.col("said"))).withColumn("_since", F.max(F.col("mark").cast("int")).over(upto) == 1)
    counted = marked.withColumn("_part", F.col("mark") | (F.col("_since") & F.coalesce(F.col("said").rlike(r"\d"), F.lit(False))))
    earlier = F.coalesce(F.sum(F.col("_part").cast("int")).over(before), F.lit(0))
    is_value = counted.withColumn("is_value", F.col("mark") | (F.col("_part") & (earlier < 4)))
    gathered = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond & F.col("said").isNotNull(), F.struct("line_no", "said")))), lambda p: p["said"]), " ")
    rows = is_value.groupBy(*own, "function", "_block").agg(F.min_by("label", "line_no").alias("label"), F.min("line_no").alias("line_no"), gathered(~F.col("is_value")).alias("description"), gathered(F.col("is_value")).alias("value"))
    told = rows.where("label is not null").withColumns({"description": labels.shortened(tx.collapsed(F.col("description")), 240), "value": labels.primary_value(F.col("value"))})
    context = labels.shortened(F.when(F.col("description") != "", F.col("description")).otherwise(F.col("value")), 220)
    whole = told.withColumns({"value_structure": labels.structure(F.col("value"), F.col("label")), "context": context, "page": F.lit(0)})
    kept = whole.where(labels.relevant(F.col("label"), F.col("function"), F.col("description"), F.col("value"), prefixes) & (F.col("context") != ""))
    return richest(kept, ["section_id", "function", "label"], F.length("description") + F.length("value") + F.length("context")).select("section_id", "function", "label", "description", "value", "value_structure", "context")


def split_maps(lines: DataFrame) -> DataFrame:
    """(table_key, x, y, z array<array>) of maps printed in pieces: ``lines(table_key, x_size, y_size, line_no, line)``.

    Each line ``Y/X`` opens a piece, whose numbers run to a table's title or a label: the x points, then rows of a y point
    and its cells. A piece has ``x_size`` columns, without it as many as ``y_size`` rows leave. The first piece's x points
    and each y point's first row count, at most ``y_size`` of them in the order they come.
    """
    own = ["table_key"]
    bare = tx.collapsed(F.coalesce("line", F.lit("")))
    opened = lines.withColumn("line", bare).withColumn("opens", F.upper("line") == "Y/X").withColumn("piece", runs(F.col("opens"), own, ["line_no"]))
    closes = (is_title(F.col("line")) | label_in(F.col("line")).isNotNull()).cast("int")
    upto = Window.partitionBy("table_key", "piece").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    live = opened.withColumns({"_headed": F.max(F.col("opens").cast("int")).over(upto), "_closed": F.max(closes).over(upto)}).where("_headed = 1 and _closed = 0 and not opens")
    numeric_line = F.col("line").rlike(r"^[-+0-9.eE\s,;|]*\d[-+0-9.eE\s,;|]*$")
    told = live.where(numeric_line).groupBy("table_key", "piece").agg(F.first("x_size").alias("x_size"), F.first("y_size").alias("y_size"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", tx.numbers(F.col("line")).alias("v")))), lambda p: p["v"])).alias("n"))
    width = F.when(F.col("x_size") > 0, F.col("x_size")).otherwise(F.floor((F.size("n") - F.col("y_size")) / (F.col("y_size") + 1))).cast("int")
    wide = told.where("y_size > 0").withColumn("w", width).where("w > 0 and size(n) > w")
    count = F.floor((F.size("n") - F.col("w")) / (F.col("w") + 1)).cast("int")
    start = lambda i: F.col("w") + 1 + i * (F.col("w") + 1)
    cut = lambda i: F.struct(F.get("n", start(i) - 1).alias("y"), F.slice("n", start(i) + 1, F.col("w")).alias("cells"))
    made = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), cut))
    xs = wide.groupBy("table_key").agg(F.min_by(F.slice("n", 1, F.col("w")), "piece").alias("x"))
    each = wide.select("table_key", "y_size", "piece", F.posexplode(made).alias("i", "r"))
    first = each.groupBy("table_key", F.col("r.y").alias("y")).agg(F.min(F.struct("piece", "i", F.col("r.cells").alias("cells"))).alias("f"), F.first("y_size").alias("y_size"))
    rows = first.groupBy("table_key").agg(F.first("y_size").alias("y_size"), F.sort_array(F.collect_list(F.struct("f.piece", "f.i", "y", "f.cells"))).alias("p")).withColumn("p", F.slice("p", 1, F.col("y_size").cast("int")))
    return xs.join(rows, "table_key", "left").select("table_key", "x", F.coalesce(F.transform("p", lambda e: e["y"]), F.array().cast("array<double>")).alias("y"), F.coalesce(F.transform("p", lambda e: e["cells"]), F.array().cast("array<array<double>>")).alias("z"))
