"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

SEGMENTS = (
    "doc_id bigint, segment_id bigint, original_text string, translated_text string, is_new_chapter boolean, chapter_title string, "
    "page_index int, toc_level int, content_type string, image_path string"
)
UNITS = "doc_id bigint, pos bigint, unit_key string, page_index int, content string, content_type string"
TOC = "doc_id bigint, ord int, level int, title string, key string"
CHECKPOINT = (
    "doc_id bigint, completed_segments array<bigint>, failed_segments array<struct<segment_id:bigint,error:string,timestamp:string>>, "
    "total_segments bigint, start_time string, last_update string"
)
BLOCKED = "doc_id bigint, segment_id bigint, page_index int, chapter_title string, original_text string, reason string, timestamp string"
CACHE = "type string, key string, cache_name string, content_hash string, created_at double, expiry_time double, ttl_hours double"
MODES = "mode_id string, name string, role_desc string, style string, context_len string"
GLOSSARY = "batch_id int, ord int, term string, translation string"
RESPONSES = "doc_id bigint, batch_id bigint, expected_ids array<bigint>, raw_text string"

#: Values of a segment's fields where a source leaves them out.
SEGMENT_DEFAULTS = {"original_text": "", "translated_text": "", "is_new_chapter": False, "chapter_title": "", "page_index": 0, "toc_level": 1, "content_type": "text"}
