"""Prompt texts: T01-T04, in both languages, with or without places.

A prompt is text around the trajectory: ``before``, the points as an array, and
``after``. ``as_text`` puts a slot where the points go.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PREFIX_EN, PREFIX_ZH, PROMPT_PARTS, TASK_SUFFIXES, WEEKDAYS_EN, WEEKDAYS_ZH

TRAJ_SLOT = "<traj>"


def template_parts(template: str) -> list[str]:
    """Split a '{weekday}'/'{hour}' template into text and placeholder parts."""
    return [x for x in re.split(r"(\{weekday\}|\{hour\})", template) if x]


def prefix(weekday: Column, hour: Column, lang: str) -> Column:
    """The prefix template of the language filled per row."""
    names = F.array(*[F.lit(w) for w in (WEEKDAYS_ZH if lang == "zh" else WEEKDAYS_EN)])
    fill = {"{weekday}": F.element_at(names, weekday + 1), "{hour}": hour.cast("string")}
    return F.concat(*[fill.get(x, F.lit(x)) for x in template_parts(PREFIX_ZH if lang == "zh" else PREFIX_EN)])


def _head(lang: str) -> Column:
    return prefix(F.col("start_weekday"), F.col("start_hour"), lang)


def _places(lang: str, destination: bool = True) -> list[Column]:
    p = PROMPT_PARTS[lang]
    return [F.lit(p["start"]), F.col("o_text"), *([F.lit(p["end"]), F.col("d_text")] if destination else [])]


def eval_prompts(view: DataFrame, lang: str = "zh", places: bool = True) -> DataFrame:
    """(trip, task, before, points, after) for each trip of a training view
    and each task; the destination task doesn't name the destination."""
    p = PROMPT_PARTS[lang]
    out = []
    for task in ("destination", "tte", "classification"):
        own = _places(lang, task != "destination") if places else []
        out.append(F.struct(F.lit(task).alias("task"), F.concat(_head(lang), *own, F.lit(p["traj"])).alias("before"),
                            F.lit(TASK_SUFFIXES[(task, lang)]).alias("after")))
    return view.select("trip", "points", F.explode(F.array(*out)).alias("_p")).select("trip", "_p.task", "_p.before", "points", "_p.after")


def pretrain_prompts(view: DataFrame, lang: str = "zh", places: bool = True) -> DataFrame:
    """(trip, recover_type, before, points, after): places before the
    trajectory to recover the trip, behind it to recover the places; without
    places one prompt that holds the trajectory alone."""
    p = PROMPT_PARTS[lang]
    if not places:
        return view.select("trip", F.lit("trip").alias("recover_type"), F.concat(_head(lang), F.lit(p["traj"])).alias("before"),
                           "points", F.lit("").alias("after"))
    own = _places(lang)
    out = [F.struct(F.lit("trip").alias("recover_type"), F.concat(_head(lang), *own, F.lit(p["traj"])).alias("before"), F.lit(p["suffix"]).alias("after")),
           F.struct(F.lit("poi").alias("recover_type"), F.concat(_head(lang), F.lit(p["traj"])).alias("before"), F.concat(*own, F.lit(p["suffix"])).alias("after"))]
    return view.select("trip", "points", F.explode(F.array(*out)).alias("_p")).select("trip", "_p.recover_type", "_p.before", "points", "_p.after")


def as_text() -> Column:
    """A prompt as one text with a slot for the points."""
    return F.concat(F.col("before"), F.lit(TRAJ_SLOT), F.col("after"))
