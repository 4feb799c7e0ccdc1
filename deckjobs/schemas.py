"""Explicit schemas of the library's tables."""

from __future__ import annotations

# fixed values: the tables' columns
GLYPHS = "doc_id BIGINT, page INT, seq BIGINT, s STRING, font STRING, size DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE"
PAINTS = "doc_id BIGINT, page INT, seq BIGINT, x DOUBLE, y DOUBLE, comps ARRAY<DOUBLE>"
FILLS = "doc_id BIGINT, page INT, seq INT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, comps ARRAY<DOUBLE>"
PAGE_BOXES = "doc_id BIGINT, page INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
RUNS = "doc_id BIGINT, page INT, line_no INT, run_no INT, text STRING, bold BOOLEAN, italic BOOLEAN, color STRING, highlight BOOLEAN, space_before BOOLEAN"
LINES = "doc_id BIGINT, page INT, line_no INT, text STRING, x0 DOUBLE, x1 DOUBLE, y DOUBLE, size DOUBLE"
OUTLINE_LINES = "doc_id BIGINT, line_no INT, line STRING"
ENTRIES = "doc_id BIGINT, pos INT, kind STRING, text STRING, label STRING, reference STRING, verse STRING, ref STRING, trigger STRING"
STYLES = "name STRING, kind STRING, roles ARRAY<STRING>, regular_color STRING, emphasis_color STRING, force_caps_off BOOLEAN, highlight_bold BOOLEAN, scripture_max_lines INT"
STYLE_FILES = "name STRING, kind STRING, templates MAP<STRING, STRING>, settings STRUCT<regular_color: STRING, emphasis_color: STRING, force_caps_off: BOOLEAN, highlight_bold: BOOLEAN, scripture_max_lines: INT>, _corrupt_record STRING"
