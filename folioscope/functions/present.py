"""Values as people read them: cut texts, previews, durations, changes."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a change up to this is shown as none.
SAME = 0.001


def cut(text: Column, length: int, pad: bool = False) -> Column:
    """At most ``length`` characters, the last of them an ellipsis if any are lost; filled with blanks if ``pad``."""
    short = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)
    return F.rpad(short, length, " ") if pad else short


def snippet(text: str | None, width: int = 100, lines: int = 20) -> str:
    """The first lines of a text, wrapped; a last line ``---`` says that there is more."""
    wrapped = [x for line in (text or "").splitlines() for x in (textwrap.wrap(line, width) or [""])]
    return "\n".join(wrapped[:lines] + ["---"] * (len(wrapped) > lines))


def preview(text: Column, width: int = 100, lines: int = 20) -> Column:
    return F.pandas_udf(lambda s: pd.Series([snippet(x, width, lines) for x in s]), "string")(text)


def duration(seconds: Column) -> Column:
    """Seconds as H:MM:SS, whole ones."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor((s % 3600) / 60)), two(s % 60))


def change(delta: Column) -> Column:
    """``up``, ``down`` or ``same``; null where there is nothing to compare."""
    return F.when(F.abs(delta) <= SAME, "same").when(delta > 0, "up").when(delta < 0, "down")


def change_text(delta: Column, digits: int = 4) -> Column:
    """A change with its sign: an arrow and the amount, or ``=``."""
    amount = F.abs(F.round(delta, digits)).cast("string")
    kind = change(delta)
    return F.when(kind == "same", "=").when(kind == "up", F.concat(F.lit("▲ "), amount)).when(kind == "down", F.concat(F.lit("▼ "), amount))
