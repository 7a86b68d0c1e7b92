"""Schemas of the corpus tables.  Nested values are native arrays and structs; JSON is a matter of the edges.

Schemas are DDL strings, which need no session to be stated.
"""

from __future__ import annotations

#: The columns of the page table, in order.
BASE_COLUMNS = ("id", "title", "version", "last_modified", "space_id", "html", "tiny_link", "retrieved_at", "child_list")
EXCERPT = "struct<type:string,name:string,is_source:boolean,source_id:string>"
PAGES = (
    "id string, title string, version int, last_modified string, authors array<string>, space_id string, html string, tiny_link string, retrieved_at string, "
    "plain_text string, lead_para string, eval_smell double, eval_summary string, word_count int, link_count int, image_count int, has_link_tree boolean, "
    "eval_notes array<string>, page_type string, mm_smell int, rn_smell int, pt_smell int, ws_smell int, sd_smell int, ci_smell int, lp_smell int, "
    f"links_list array<string>, child_list array<string>, mentions_list array<string>, duplicate_list array<string>, excerpts array<{EXCERPT}>, labels array<string>, "
    "llama_summary string, vector_embedding binary, vector_reduced binary, kw_fingerprint string, similarity_cluster int, processed_version int"
)
PAGE_COLUMNS = tuple(x.split()[0] for x in PAGES.replace(EXCERPT, "struct").split(", "))
LABELS = ("id string, label string, space_id string, retrieved_at string")
AUTHORS = ("author_id string, name string, display_name string, email string, name_normalized string, last_modified string")
VECTORS = ("id string, raw array<float>, scaled array<float>, type string, type_confidence double")
SPACES = ("id string, short_id string, alias string")

#: Types that are not content, and those with a role in the overview.
ADMIN_TYPES = ("meeting_minutes", "release_notes", "performance_test")
UNCATEGORIZED = "uncategorized"
CONFIDENCE = 0.6
STUB_WORDS = 25
LEAD_WORDS, LEAD_LINKS = (25, 150), 3
LONG_PAGE_WORDS, TOC_WORDS = 3000, 1000
RADIUS, JACCARD, SHINGLE_WORDS = 0.7, 0.85, 5
