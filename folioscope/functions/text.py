"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How letters and signs of author names are written.
NAME_LETTERS = {
    "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue",
    "é": "e", "è": "e", "ê": "e", "á": "a", "à": "a", "ó": "o", "ô": "o", "ç": "c",
    "ż": "z", "ź": "z", "ł": "l", "ń": "n", "ś": "s", "ą": "a", "ę": "e",
}


def _plain_name(part: Column) -> Column:
    long = {k: v for k, v in NAME_LETTERS.items() if len(v) > 1}
    short = {k: v for k, v in NAME_LETTERS.items() if len(v) == 1}
    for letter, written in long.items():
        part = F.replace(part, F.lit(letter), F.lit(written))
    part = F.translate(part, "".join(short), "".join(short.values()))
    return F.lower(F.regexp_replace(part, "[^A-Za-z0-9]", ""))


def author_name(raw: Column) -> Column:
    """"Surname, Given" or "Given Surname" as ``given:surname``; a single name alone; nothing for null."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    comma, space = F.instr(name, ","), F.instr(name, " ")
    given = F.when(comma > 0, F.expr("''")).otherwise("")
    first = lambda at: F.substr(name, F.lit(1), at - 1)
    rest = lambda at: F.substr(name, at + 1)
    given = F.when(comma > 0, rest(comma)).when(space > 0, first(space)).otherwise(name)
    surname = F.when(comma > 0, first(comma)).when(space > 0, rest(space)).otherwise(F.lit(""))
    given, surname = _plain_name(given), _plain_name(surname)
    return F.when(surname != "", F.concat(given, F.lit(":"), surname)).otherwise(given)


def label_name(raw: Column, style: str = "strict") -> Column:
    """Trimmed and in lower case; spaces become hyphens where there are any, underscores only if ``strict``."""
    name = F.lower(F.trim(raw))
    spaced = F.translate(F.replace(name, F.lit(" "), F.lit("-")), ".,\"", "'''")
    out = F.when(name.contains(" ") | name.contains("_"), spaced).otherwise(name)
    return F.replace(out, F.lit("_"), F.lit("-")) if style == "strict" else out


def excerpt_name(raw: Column) -> Column:
    return F.translate(F.lower(raw), "\"':", "")


def flat_text(raw: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(raw), r"(?U)\s+", " "))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur, each once."""


    def hits(low: Column) -> Column:
        out = F.lit(0)
        for k in keywords:
            out = out + F.contains(low, F.lit(k)).cast("int")
        return out

    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), hits), 1)  # binds the text, so that it is lowered once


def title_score(title: Column, rules: list[tuple[list[str], int]]) -> Column:
    low, out = F.lower(title), F.lit(0)
    for keywords, reward in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        out = out + F.when(hit, reward).otherwise(0)
    return out


def link_key(link: Column) -> Column:
    return F.substring_index(link, ":", 1)


def link_target(link: Column) -> Column:
    at = F.instr(link, ":")
    return F.when(at > 0, F.substr(link, at + 1)).otherwise(F.lit(""))


def excerpt_text(x: Column) -> Column:
    """A struct of an excerpt as ``type:name:source|consumer:source_id``."""
    return F.concat_ws(":", x["type"], x["name"], F.when(x["is_source"], "source").otherwise("consumer"), x["source_id"])


def excerpt_struct(text: Column) -> Column:
    """The reverse; null unless there are four fields without colons and none is empty."""
    ok = text.rlike("^[^:]+:[^:]+:[^:]+:[^:]+$")
    p = F.split(text, ":")
    return F.when(ok, F.struct(p[0].alias("type"), p[1].alias("name"), (p[2] == "source").alias("is_source"), p[3].alias("source_id")))


#: Dates in titles, as the page conventions have them.
_AFTER = r"(?=$|[\s\-_:.,;)])"
DATE = rf"(?<!\d)(?:\d{{2}}([-./])\d{{2}}\1\d{{4}}|\d{{4}}[-./]\d{{2}}){_AFTER}"
DATE_BAD = rf"(?i)(?<!\d)\d{{4}}-(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-\d{{2}}{_AFTER}"
DATE_REVERSE = rf"(?<!\d)\d{{2}}-\d{{2}}-\d{{4}}{_AFTER}"


def title_dates(title: Column) -> dict[str, Column]:
    t = F.coalesce(title, F.lit(""))
    return {"date": t.rlike(DATE), "date_bad": t.rlike(DATE_BAD), "date_reverse": t.rlike(DATE_REVERSE)}


def share(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def per_hundred(n: Column, words: Column) -> Column:
    return n / F.coalesce(F.nullif(words / 100.0, F.lit(0.0)), F.lit(1.0))


def euclid(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal, one empty one shares nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(text: Column, k: int = 5) -> Column:
    """The set of ``k``-word runs; fewer words give none."""
    words = F.filter(F.split(flat_text(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words), runs), 1)  # binds the words, so that they are made once


def squash_runs(items: Column, most: int = 3) -> Column:
    """Of each run of equal items the first ``most``."""
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(F.when(run <= most, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"), x.alias("last"), run.alias("run"))

    return F.aggregate(F.coalesce(items, F.array().cast("array<string>")), empty, step, lambda s: s["kept"])


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores after it until no column in ``taken`` is called so in any case of letters."""
    names = {x.lower() for x in taken}
    while base.lower() in names:
        base += "_"
    return base
