"""Whole-table operators: detection, merging, numbering, replacing, restoring."""
