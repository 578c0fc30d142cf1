"""The tables that reports show, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, linked, sink


def start_value_frame(records: DataFrame) -> DataFrame:
    """Extracted records under the headings of the review sheet; ``ocr`` may be absent."""
    ocr = F.coalesce("ocr", F.lit(False)) if "ocr" in records.columns else F.lit(False)
    return records.select(
        F.col("label").alias("Label name"), F.col("start_value").alias("Start Value"), F.col("unit").alias("Unit"), F.col("condition").alias("IF Condition"), F.col("description").alias("Description"),
        F.col("page").alias("Page"), F.when(F.col("reconstructed"), "YES").otherwise("").alias("Reconstructed?"), F.when(ocr, "OCR (verify)").otherwise("text").alias("Source"),
    )


def apply_frames(log: DataFrame, patch_events: DataFrame) -> dict[str, DataFrame]:
    """The log of applied values, counts by status, counts of the patch, its warnings and its errors.

    ``log`` has (label, status, ...), ``patch_events`` (label, kind, text) with kinds patched, axis, no_char, no_layout,
    warning and error.
    """
    kinds = {"patched": "patched_labels_in_hex", "axis": "axes_patched", "no_char": "skipped_no_char", "no_layout": "skipped_no_layout", "error": "errors_total", "warning": "warnings_total"}
    return {
        "log": log,
        "summary": log.groupBy("status").agg(F.count(F.lit(1)).alias("count")),
        "patch": patch_events.agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()]),
        "warnings": patch_events.where("kind = 'warning'").select(F.col("text").alias("warning")),
        "errors": patch_events.where("kind = 'error'").select(F.col("text").alias("error")),
    }


def run_frames(events: DataFrame) -> dict[str, DataFrame]:
    """A run's audit events (source, label, action, stage, reason): one row of totals, all events, those of updates, of
    skipping, of attention, counts by source and by reason."""
    of = lambda *actions: events.where(F.col("action").isin(*actions))
    total = lambda action: F.count_if(F.col("action") == action)
    return {
        "summary": events.agg(F.count_distinct("label").alias("labels"), total("updated").alias("updated"), total("copied").alias("copied_unchanged"), total("attention").alias("attention"), total("skipped").alias("skipped"), F.count(F.lit(1)).alias("events_total")),
        "events": events,
        "updated": of("updated"),
        "skipped": of("skipped", "padded"),
        "attention": of("attention").select("label").distinct(),
        "by_source": events.groupBy("source", "action").agg(F.count(F.lit(1)).alias("n")),
        "by_reason": events.groupBy("stage", "action", "reason").agg(F.count(F.lit(1)).alias("n")),
    }


def match_frames(source: DataFrame, destination: DataFrame, pairs: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """The five frames of a matching: Source, Destination, Matched, Summary and Function Breakdown.

    ``source`` and ``destination`` have (id, function, label, description, value, value_type, suffix, pages, context),
    ids unique; ``pairs`` (left_id, right_id, score) is their one-to-one matching. A pair counts for its source's function,
    or for its destination's where that is empty. Averages are rounded to two places, 0 of none.
    """
    said = {"Function Component": "function", "Label": "label", "Description": "description", "Value": "value", "Value Type": "value_type", "Suffix": "suffix", "Page(s)": "pages"}
    of = lambda side, name, key: side.select(F.col("id").alias(key), *[F.col(c).alias(f"{name} {heading}") for heading, c in said.items()])
    joined = pairs.join(of(source, "Source", "left_id"), "left_id").join(of(destination, "Destination", "right_id"), "right_id")
    matched = joined.select(
        *[F.col(f"`{name} {heading}`") for heading in said for name in ("Source", "Destination")], F.col("score").alias("Context Similarity %"), F.lit("Semantic Match").alias("Status"), F.lit("OK").alias("Context Flag")
    )
    own, other = (F.trim(F.coalesce(f"{name} Function Component", F.lit(""))) for name in ("Source", "Destination"))
    average = F.coalesce(F.round(F.avg("Context Similarity %"), 2), F.lit(0.0))
    total = matched.agg(F.count(F.lit(1)).cast("double").alias("n"), average.alias("mean"))
    lines = [("Total Semantic Matches", F.col("n")), ("Average Context Similarity %", F.col("mean")), (f"Threshold Used (>= {threshold}%)", F.lit(float(threshold)))]
    return {
        "Source": source,
        "Destination": destination,
        "Matched": matched,
        "Summary": total.select(F.inline(F.array(*[F.struct(F.lit(name).alias("Metric"), value.alias("Value")) for name, value in lines]))),
        "Function Breakdown": matched.groupBy(F.when(own != "", own).otherwise(other).alias("Function Component")).agg(F.count("Source Label").alias("Semantic Matches"), average.alias("Average Context Similarity %")),
    }


def write_match_frames(frames: dict[str, DataFrame], path: str) -> None:
    """Each of ``match_frames`` as sorted CSV files under its name: pairs by falling similarity, then labels; functions by name."""
    falling = frames["Matched"].withColumn("_order", -F.col("Context Similarity %"))
    sink.write_csv(falling, ["_order", "Source Label", "Destination Label"], f"{path}/Matched", leave=["_order"])
    for name, order in (("Source", ["function", "label", "id"]), ("Destination", ["function", "label", "id"]), ("Function Breakdown", ["Function Component"])):
        sink.write_csv(frames[name], order, f"{path}/{name}")
    frames["Summary"].coalesce(1).write.csv(f"{path}/Summary", header=True)


def label_json(decoded: DataFrame) -> DataFrame:
    """(label, json): each decoded label that has no error as one object of label, kind and value: a number, a text or a list."""
    cell = F.transform("value", lambda v: F.when(v["num"].isNotNull(), F.to_json(F.struct(v["num"].alias("v")))).when(v["txt"].isNotNull(), F.to_json(F.struct(v["txt"].alias("v")))).otherwise('{"v":null}'))
    bare = F.transform(cell, lambda j: F.substring(j, 6, F.length(j) - 6))
    value = F.when((F.col("kind") == "VALUE") & (F.size(bare) == 1), F.get(bare, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(bare, ","), F.lit("]")))
    head = F.to_json(F.struct("label", "kind"))
    return decoded.where("error is null").select("label", F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"value":'), value, F.lit("}")).alias("json"))


def missing_kinds(missing: DataFrame, axis_points: DataFrame) -> DataFrame:
    """``missing(label)`` with ``kind``: axis_points if the descriptor has the label among its axes ``axis_points(label)``, else unknown."""
    axes = axis_points.select("label").distinct().withColumn("_axis", F.lit(True))
    return missing.join(axes, "label", "left").withColumn("kind", F.when(F.col("_axis"), "axis_points").otherwise("unknown")).drop("_axis")


def sheet_rows(records: DataFrame) -> DataFrame:
    """Calibration records (label, with structs ``limits(lower, upper, type)`` and ``source(table_id, page, module)``, array
    ``axes``) as flat rows: the structs' fields as columns, axes as JSON, empty without axes."""
    nested = ("limits", "source", "axes")
    rest = [c for c in records.columns if c not in nested]
    axes = F.when(F.col("axes").isNull(), "").otherwise(F.to_json("axes"))
    return records.select(*rest, *[F.col(f"limits.{c}").alias(f"limit_{c}") for c in ("lower", "upper", "type")], axes.alias("axes"), F.col("source.table_id").alias("calibration_table_id"), F.col("source.page").alias("calibration_page"), F.col("source.module").alias("parent_module"))


#: What the columns of the detailed log mean; every frame of ``detailed_log`` is described.
HEADERS = {
    "summary": {"destination_labels": "labels of the destination", "cdfx_updated": "labels with a new value", "cdfx_copied_unchanged": "labels found with the same value", "attention_labels": "labels in no source", "events_total": "events of both steps"},
    "per_source": {"source": "where values came from", "updated": "labels it changed", "copied": "labels it left as they were", "updated_percent": "share of changed labels"},
    "events": {"source": "source or step", "label": "label", "action": "what was done", "stage": "step", "reason": "why"},
    "remaining": {"label": "label in no source"},
    "patched": {"label": "label written to the image"},
    "skipped": {"label": "label not written to the image", "skip_reason": "why it was not"},
    "skipped_no_char": {"label": "label without a characteristic"},
    "skipped_axis_points": {"label": "label that is an axis in the descriptor"},
    "skipped_unknown": {"label": "label that the descriptor does not have"},
    "skipped_no_layout": {"label": "label whose layout is missing"},
    "warnings": {"warning": "what was written with a remark"},
    "errors": {"error": "what could not be written"},
}
# The log's names for kinds of skipping.
SKIP_REASONS = {"axis_points": "no_a2l_characteristic", "unknown": "no_a2l_characteristic", "no_layout": "missing_record_layout"}


def detailed_log(events: DataFrame, per_source: DataFrame, patch: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """The frames of a run's detailed log and, as ``payload``, one row of JSON with the summary.

    ``events`` and ``patch`` are audit events (source, label, action, stage, reason), those of the image with their ``kind``
    (``decode.patch_events``); ``per_source`` is ``reconcile.source_summary``; ``notes`` (kind warning or error, text).
    """
    spark = events.sparkSession
    columns = ["source", "label", "action", "stage", "reason"]
    of = lambda *kinds: patch.where(F.col("kind").isin(*kinds)).select("label")
    count = lambda column, *values: F.count_if(F.col(column).isin(*values))
    of_run = events.agg(F.count_distinct("label").alias("destination_labels"), count("action", "updated").alias("cdfx_updated"), count("action", "copied").alias("cdfx_copied_unchanged"), count("action", "attention").alias("attention_labels"), F.count(F.lit(1)).alias("pipeline_events_total"))
    of_image = patch.agg(
        count("kind", "patched").alias("hex_patched"), count("kind", "axis_points", "unknown").alias("hex_skipped_no_char"), count("kind", "axis_points").alias("hex_skipped_no_char_axis_pts"),
        count("kind", "unknown").alias("hex_skipped_no_char_unknown"), count("kind", "no_layout").alias("hex_skipped_no_layout"), F.count(F.lit(1)).alias("patch_events_total"),
    )
    of_notes = notes.agg(count("kind", "error").alias("hex_errors_total"), count("kind", "warning").alias("hex_warnings_total"))
    summary = of_run.crossJoin(of_image).crossJoin(of_notes).withColumn("events_total", F.col("pipeline_events_total") + F.col("patch_events_total"))  # three tables of one row
    reasons = F.create_map(*[F.lit(x) for kv in SKIP_REASONS.items() for x in kv])
    noted = lambda kind: notes.where(F.col("kind") == kind).select(F.col("text").alias(kind))
    headers = [(frame, column, meaning) for frame, columns_ in HEADERS.items() for column, meaning in columns_.items()]
    return {
        "summary": summary,
        "per_source": per_source,
        "events": events.select(*columns).unionByName(patch.select(*columns)),
        "remaining": events.where("action = 'attention'").select("label").distinct(),
        "patched": of("patched"),
        "skipped": patch.where("action = 'skipped'").select("label", F.try_element_at(reasons, F.col("kind")).alias("skip_reason")),
        "skipped_no_char": of("axis_points", "unknown"),
        "skipped_axis_points": of("axis_points"),
        "skipped_unknown": of("unknown"),
        "skipped_no_layout": of("no_layout"),
        "warnings": noted("warning"),
        "errors": noted("error"),
        "headers": spark.createDataFrame(headers, "frame string, header string, meaning string"),
        "payload": summary.select(F.to_json(F.struct("*")).alias("json")),
    }


def _spread(records: DataFrame, tables: DataFrame, kind: str) -> DataFrame:
    """The records of a class with the series of the table that they mean."""
    own = records.where(F.col("object_class") == kind)
    series = tables.select("doc_id", F.col("seq").alias("table_seq"), "table_id", "x", "y", "val")
    return linked.loosely_linked(own, tables).join(series, ["doc_id", "table_seq"])


def calibration_frames(records: DataFrame, tables: DataFrame) -> dict[str, DataFrame]:
    """The review frames of ``records(doc_id, module, label, object_class, context, start_value, unit, lower, upper, table_ref,
    page)`` and value tables (doc_id, seq, table_id, label, x, y, val): calibration, scalars, curves, maps, arrays and audit.

    A curve's, map's or array's frame has one row per value of its table; audit says of each record what is there.
    """
    columns = ["doc_id", "module", "label", "context", "start_value", "unit", "lower", "upper"]
    keys = ["doc_id", "module", "label", "table_id"]
    curves = extract.unpivoted(_spread(records, tables, "CURVE"), keys, "val", "x").select(*keys, F.col("index").alias("x_index"), F.col("x").alias("x_value"), F.col("value").alias("curve_value"))
    arrays = extract.unpivoted(_spread(records, tables, "VAL_BLK"), keys, "val", "x").select(*keys, "index", "value")
    width = F.greatest(F.size("x"), F.lit(1))
    height = F.ceil(F.size("val") / width).cast("int")
    cells = F.when(F.size("val") > 0, F.transform(F.sequence(F.lit(0), F.greatest(height, F.lit(1)) - 1), lambda r: F.slice("val", r * width + 1, width)))
    maps = extract.unpivoted_maps(_spread(records, tables, "MAP").withColumn("cells", cells), keys, "cells", "x", "y")
    maps = maps.select(*keys, F.col("col").alias("x_index"), F.col("x").alias("x_value"), F.col("row").alias("y_index"), F.col("y").alias("y_value"), F.col("value").alias("z_value"))
    return {
        "calibration": records.select(*columns),
        "scalars": records.where("object_class = 'VALUE'").select(*columns),
        "curves": curves,
        "maps": maps,
        "arrays": arrays,
        "audit": audit(records, tables, curves, maps),
    }


def audit(records: DataFrame, tables: DataFrame, curves: DataFrame, maps: DataFrame) -> DataFrame:
    """Per record what is present, and how many numbers its label's curves and maps hold: one count a label, joined once."""
    counted = lambda df, value, name: df.groupBy("doc_id", "label").agg(F.count(value).alias(name))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    full: Column = F.coalesce(F.trim("context") != "", F.lit(False))
    joined = linked.loosely_linked(records, tables).join(counted(curves, "curve_value", "numeric_curve_values"), ["doc_id", "label"], "left").join(counted(maps, "z_value", "numeric_map_values"), ["doc_id", "label"], "left")
    return joined.select(
        "doc_id", "module", "label", "object_class", full.alias("context_present"), F.col("start_value").isNotNull().alias("start_value_present"), (F.col("lower").isNotNull() | F.col("upper").isNotNull()).alias("physical_range_present"),
        F.col("how").isNotNull().alias("value_table_linked"), n("numeric_curve_values"), n("numeric_map_values"), F.col("page").alias("source_page"),
    )


def write_matches(matches: DataFrame, unmatched: DataFrame, texts: DataFrame, path: str) -> None:
    """Match results as folders under ``path``: matches and unmatched queries as CSV with headings, reports ``texts(text)`` as text."""
    matches.write.mode("overwrite").option("header", True).csv(f"{path}/matches")
    unmatched.write.mode("overwrite").option("header", True).csv(f"{path}/unmatched")
    texts.select("text").write.mode("overwrite").option("lineSep", "\n\n").text(f"{path}/reports")
