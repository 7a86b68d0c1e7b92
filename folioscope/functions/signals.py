"""The 70 structural signals of a page and their fixed scaling, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LEAD_LINKS, LEAD_WORDS, STUB_WORDS
from .dom import link_count
from .text import keyword_hits, per_hundred, title_dates

#: Order of the signals in a vector.
SIGNAL_KEYS = (
    "word_count", "image_count", "image_density", "task_count", "mentions_count", "mention_density", "diagram_count", "bullet_count", "header_count", "digit_to_letter_ratio",
    "para_count", "para_longest", "para_share_long", "para_share_short", "para_average", "para_lead_good", "para_lead_words", "para_lead_links",
    "link_count", "link_git_count", "link_jira_count", "link_density", "child_count", "table_count", "minutes_in_tables", "word_count_outside_tables", "diagram_outside_tables", "img_outside_tables",
    "sig_table_has_cells", "sig_cell_share_low_words", "sig_cell_share_empty", "sig_table_long_cell", "sig_cell_many", "lexic_jargon_share", "lexic_rare_words_share", "lexic_topical_focus",
    "macro_toc", "macro_jira_query", "macro_struct_total", "macro_panels", "macro_expandables", "macro_excerpts", "macro_decisions", "macro_children", "code_blocks", "code_blocks_lines",
    "t_month", "t_g_meeting_minutes", "t_meeting_minutes", "t_g_workshop_minutes", "t_workshop_minutes", "t_release", "t_performance", "t_anti_landing", "t_intro", "t_anti_intro", "t_solution",
    "h_solution", "b_meeting_minutes", "b_workshop", "b_g_release", "b_release", "b_anti_release", "b_performance", "b_anti_performance", "b_bug", "date", "date_bad", "date_reverse", "metric_flags",
)

#: Keywords of titles (t_), headers (h_) and bodies (b_).
KEYWORDS = {
    "t_month": ["january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"],
    "t_g_meeting_minutes": ["meeting minutes", "meeting notes"],
    "t_meeting_minutes": ["sprint review", "retrospective", "omm", "standup", "monthly", "weekly", "meeting"],
    "t_g_workshop_minutes": ["5 why", "5why", "workshop"],
    "t_workshop_minutes": ["sprint review", "retrospective", "retro", "ws", "standup", "butsam", "analysis"],
    "t_release": ["release notes", "release", "deployment", "hotfix"],
    "t_performance": ["performance", "report", "stress", "load", "test"],
    "t_anti_landing": ["onboarding", "plan", "retrospective", "test", "release"],
    "t_intro": ["intro", "hub"],
    "t_anti_intro": ["meeting", "minutes", "retrospective", "status", "review", "release", "deployment", "hotfix", "onboarding"],
    "t_solution": ["ddd", "add"],
    "h_solution": ["solution", "diagram", "revision", "introduction", "component", "microservice", "performance", "considerations", "raid", "rollback", "references", "prerequisites", "pre-requisites", "high-level", "high level"],
    "b_meeting_minutes": ["attendees", "presenter", "participants"],
    "b_workshop": ["why 1", "why1", "why 2", "why2", "why 3", "why3", "why 4", "why4", "why 5", "why5", "topic 1:", "topic 2:", "topic 3:", "topic 4:", "topic 5:"],
    "b_g_release": ["zephyr"],
    "b_release": ["approval", "approver", "deploy", "deployment", "mr", "merge request", "code freeze", "pipeline", "bug", "regression", "hotfix", "patch", "version", "release", "execution", "feature flag", "prod", "p", "qas", "qa", "uat"],
    "b_anti_release": ["meeting", "minutes", "retrospective", "5-why", "5 why", "agenda", "action item", "attendance", "participants", "presenter"],
    "b_performance": ["performance", "stress", "load", "throughput", "latency", "rps", "requests per second", "benchmark", "scalability", "response time", "locust", "loadrunner", "test", "report", "rds", "api", "loaded", "loading", "grafana", "consumed"],
    "b_anti_performance": ["meeting", "minutes", "retrospective", "5-why", "5 why", "agenda", "action item", "attendance", "participants", "presenter", "draft"],
    "b_bug": ["r1", "r2", "r3", "r4", "p1", "p2", "p3", "p4"],
}

#: Divisors of signals that are scaled as log(1 + x) / log(1 + divisor), and as x / divisor.
LOG_DIVISORS = {
    "word_count": 1730.5, "image_count": 6, "image_density": 2.029, "task_count": 4, "mentions_count": 14, "mention_density": 5.193, "diagram_count": 1, "bullet_count": 15, "header_count": 11,
    "digit_to_letter_ratio": 560.458, "para_count": 26, "para_longest": 190, "para_share_long": 0.222, "para_average": 64.138, "para_lead_words": 75, "para_lead_links": 4, "link_count": 31,
    "link_git_count": 1, "link_jira_count": 4, "link_density": 9.276, "child_count": 2, "table_count": 81, "minutes_in_tables": 1, "word_count_outside_tables": 1059.5, "img_outside_tables": 5,
    "sig_table_long_cell": 1, "macro_toc": 1, "macro_struct_total": 1, "macro_panels": 22, "macro_expandables": 192, "macro_excerpts": 4, "t_month": 2, "t_meeting_minutes": 1,
    "t_workshop_minutes": 1, "t_release": 2, "t_performance": 1, "t_anti_landing": 1, "t_anti_intro": 1, "h_solution": 2, "b_meeting_minutes": 1, "b_workshop": 5, "b_bug": 1, "b_release": 8,
    "b_performance": 5, "b_anti_release": 3, "b_anti_performance": 3,
}
DIVISORS = {"code_blocks": 4, "code_blocks_lines": 71}
LEXICAL = ("lexic_jargon_share", "lexic_rare_words_share", "lexic_topical_focus")
CONSTANT = ("metric_flags", "diagram_outside_tables")


def scale(key: str, value: Column) -> Column:
    if key in CONSTANT:
        return F.lit(0.0)
    if key in LOG_DIVISORS:
        return F.log1p(F.greatest(value.cast("double"), F.lit(0.0))) / F.lit(math.log1p(LOG_DIVISORS[key]))
    return value.cast("double") / F.lit(float(DIVISORS.get(key, 1)))


def raw_signals(html: Column, title: Column, plain_text: Column, word_count: Column, child_list: Column, dom: Column, base_url: str = "https://wiki.example/", repo_url: str = "repo.example", lexical: dict[str, Column] | None = None) -> dict[str, Column]:
    """Each signal from a page's columns, its ``dom`` facts and, for the lexical ones, their columns; these are zero without them."""
    html = F.coalesce(html, F.lit(""))
    words = F.coalesce(word_count, F.lit(0))
    macro = lambda name: F.regexp_count(html, F.lit(f'<ac:structured-macro ac:name="{name}"'))
    n = lambda pattern: F.regexp_count(html, F.lit(pattern))
    images, mentions = n("</ac:image>"), n("<ac:link><ri:user ri:account-id=")
    links = link_count(html)
    p, cells = dom["paragraphs"], dom["cells"]
    of = lambda items, f: F.size(F.filter(items, f))
    part = lambda a, items: F.when(F.size(items) > 0, a / F.size(items)).otherwise(0.0)
    letters = F.length(F.regexp_replace(F.coalesce(plain_text, F.lit("")), r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(F.coalesce(plain_text, F.lit("")), r"[^\p{Nd}]", ""))
    panels, expand, excerpts = macro("panel"), macro("expand"), macro("excerpt-include")
    lead = (dom["lead_words"] > LEAD_WORDS[0]) & (dom["lead_words"] < LEAD_WORDS[1]) & (dom["lead_links"] >= LEAD_LINKS)
    out = {
        "word_count": words, "image_count": images, "image_density": per_hundred(images, words), "task_count": n("<ac:task>"), "mentions_count": mentions,
        "mention_density": per_hundred(mentions, words), "diagram_count": macro("drawio"), "bullet_count": n("<ul>"), "header_count": dom["header_count"],
        "digit_to_letter_ratio": letters / (digits + 1), "para_count": F.size(p), "para_longest": F.coalesce(F.array_max(p), F.lit(0)),
        "para_share_long": part(of(p, lambda x: x > 100), p), "para_share_short": part(of(p, lambda x: x < 30), p), "para_average": part(F.aggregate(p, F.lit(0), lambda s, x: s + x), p),
        "para_lead_good": lead, "para_lead_words": dom["lead_words"], "para_lead_links": dom["lead_links"], "link_count": links,
        "link_git_count": n(f'<a href="https://{repo_url}'), "link_jira_count": n(f'<a href="{base_url}browse/') + macro("jira"), "link_density": per_hundred(links, words),
        "child_count": F.coalesce(F.size(child_list), F.lit(0)), "table_count": n("<table>"), "minutes_in_tables": dom["minutes_in_tables"],
        "word_count_outside_tables": dom["words_outside_tables"], "diagram_outside_tables": dom["diagrams_outside_tables"], "img_outside_tables": dom["images_outside_tables"],
        "sig_table_has_cells": F.size(cells) > 0, "sig_cell_share_low_words": part(of(cells, lambda x: x < 5), cells), "sig_cell_share_empty": part(of(cells, lambda x: x == 0), cells),
        "sig_table_long_cell": of(cells, lambda x: x > 100), "sig_cell_many": F.size(cells) > 40, **(lexical or {k: F.lit(0.0) for k in LEXICAL}),
        "macro_toc": macro("toc"), "macro_jira_query": html.contains(base_url + "issues/?jql=project") & html.contains("data-card-appearance="),
        "macro_struct_total": panels + expand + excerpts, "macro_panels": panels, "macro_expandables": expand, "macro_excerpts": excerpts,
        "macro_decisions": macro("decisionreport") > 0, "macro_children": macro("children") > 0, "code_blocks": dom["code_blocks"], "code_blocks_lines": dom["code_lines"],
        **{k: keyword_hits({"t": title, "h": dom["header_titles"], "b": plain_text}[k[0]], v) for k, v in KEYWORDS.items()},
        **title_dates(title), "metric_flags": F.lit(0),
    }
    full = words >= STUB_WORDS
    return {k: F.when(full, out[k].cast("double")).otherwise(0.0) for k in SIGNAL_KEYS}


def with_vectors(rows: DataFrame, signals: dict[str, Column], raw: str = "raw", scaled: str = "scaled") -> DataFrame:
    """``rows`` with the raw and the scaled vector as arrays of floats; each signal is computed once."""
    rows = rows.withColumn(raw, F.array(*(signals[k].cast("double") for k in SIGNAL_KEYS)))
    rows = rows.withColumn(scaled, F.array(*(scale(k, F.col(raw)[i]).cast("float") for i, k in enumerate(SIGNAL_KEYS))))
    return rows.withColumn(raw, F.col(raw).cast("array<float>"))
