"""Explicit schemas of the text inputs; nothing is inferred."""

from __future__ import annotations

ARTICLE = "namespace int, title string, source_text string, page_id bigint"
STACK_ROW = "max_stars_repo_name string, max_stars_repo_path string, content string"
WIKI_NODE = "normed_identifier string, raw_identifier string, char_count bigint, outgoing array<string>, incoming array<string>"
CODE_NODE = WIKI_NODE + ", import_count int, links_in_repo int"
TOKENIZED_NODE = CODE_NODE + ", tok_shard_idx bigint, tok_offset_bytes bigint, tok_len bigint, split string"
DATASET_METADATA = "tokenizer string, dtype_str string, shard_filenames array<string>"
SPLITS = "splits map<string, struct<count: int, fraction: double, ids: array<string>>>"
