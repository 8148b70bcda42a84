"""Readers (cohort CSVs, review files, SKU lists, text lines) and writers
(user lists, single-file exports, intermediate tables, contiguous parts)."""

from shoppulse.sources.readers import (
    read_cohort, read_reviews, read_review_dir, read_sku_list, read_lines,
)
from shoppulse.sources.sinks import save_users, save_single_csv, save_table, write_parts

__all__ = ["read_cohort", "read_reviews", "read_review_dir", "read_sku_list", "read_lines",
           "save_users", "save_single_csv", "save_table", "write_parts"]
