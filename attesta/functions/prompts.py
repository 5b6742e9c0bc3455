"""Prompts composed as Columns: instruction, view, exemplars, record and evidence, from a template given by the caller."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.records import apply_view, render_record

#: The tasks and the views of a record.
DETECT, NAME, VIEWS = "detect", "name", ("full", "name_only", "tags_only", "neither")


def view_of(record: dict, view: str) -> dict:
    """The same cut as records.apply_view, of one plain record."""
    if view not in VIEWS:
        raise ValueError(f"no such view: {view}")
    keep = {"full": lambda k: True, "name_only": lambda k: k in ("name", "lat", "lon"), "tags_only": lambda k: k != "name", "neither": lambda k: k in ("lat", "lon")}[view]
    return {k: v for k, v in record.items() if keep(k)}


def exemplar_text(entry: dict, task: str, view: str) -> str:
    """A worked example: its record in the view, and the answer that the task asks for."""
    wrong = entry["label"] != "clean" if task == DETECT else entry["label"] == "wrong" and entry["field"] == "name"
    answer = {"verdict": "wrong" if wrong else "clean" if task == DETECT else "belongs"}
    if task == DETECT:
        answer["field"] = entry["field"] if wrong else None
    return json.dumps(view_of(entry["record"], view), ensure_ascii=False, sort_keys=True, indent=2) + "\n" + json.dumps(answer, sort_keys=True)


def evidence_text(template: dict, evidence: Column) -> Column:
    """evidence: struct<nearest array<struct<name, distance_m>>, similar array<struct<name, distance_km>>, radius_m, radius_km>."""
    line = lambda unit, more: lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e[f"distance_{unit}"].cast("string"), F.lit(f" {unit}{more})"))

    def part(title: str, unit: str, entries: str, more: str) -> Column:
        head = F.replace(F.lit(template[title]), F.lit(f"{{radius_{unit}}}"), evidence[f"radius_{unit}"].cast("string"))
        rows = F.transform(evidence[entries], line(unit, more))
        return F.concat_ws("\n", head, F.when(F.size(rows) > 0, F.concat_ws("\n", rows)).otherwise(template["evidence_none"]))

    return F.concat_ws("\n", F.lit(template["evidence_intro"]), part("evidence_nearest", "m", "nearest", ""), part("evidence_similar", "km", "similar", " away"))


def prompt(template: dict, exemplars: dict[str, dict], task: str, shown: Column, view: str = "full", exemplar_view: str | None = None, evidence: Column | None = None) -> Column:
    """The user's part of a prompt about each record. Tasks, views and evidence that the template doesn't know are refused."""
    if task not in (DETECT, NAME):
        raise ValueError(f"no such task: {task}")
    if (task == DETECT and view != "full") or (task == NAME and view not in template["views"]):
        raise ValueError(f"the template has no view {view} for {task}")
    if ("evidence_intro" in template) != (evidence is not None):
        raise ValueError("the template and the evidence do not match")
    head = [template["instruction"], *([template["views"][view]] if task == NAME else []), template["exemplar_intro"]]
    head += [exemplar_text(exemplars[str(i)], task, exemplar_view or view) for i in template["exemplar_ids"]]
    return F.concat_ws("\n\n", *map(F.lit, head), render_record(apply_view(shown, view)), *([] if evidence is None else [evidence_text(template, evidence)]))
