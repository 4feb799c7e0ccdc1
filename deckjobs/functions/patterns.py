"""Line patterns of labelled outlines, for Spark's regular expressions."""

from __future__ import annotations

# fixed values: the line grammar of the outline format ((?d): only \n ends a line; \z: the very end)
TITLE = r"(?id)^Title\s*:\s*(.+)\z"
IMAGE = r"(?id)^(?:\S+\s+){0,3}image\s*:\s*(.+)\z"
QUOTE = r"(?id)^((?:\S+\s+){0,5}?\S+)\s+quote\s*(?::\s*(.*)|)\z"
BACK_TO = r"(?id)^Back to (.+?) when I say\s*:\s*(.*)\z"
BACK_TO_SHORT = r"(?d)^Back to ((?i:title)|[A-Za-z]+ \d+)\s*(?::\s*(.*)|\.)?\z"
POINT = r"(?id)^(SUB\s?POINT|POINT|CONDITION|DRIVEN)\s+(\d+)\s*(?::\s*(.*)|\s+(.+))\z"
MARKER = r"(?id)^Scripture\s*:\s*\z"
SCRIPTURE = (
    r"(?d)^([1-3]?\s?[A-Za-z][A-Za-z ]*?)\s+"
    r"(\d+:\d+(?:\s*[-–]\s*\d+(?::\d+)?)?(?:\s*,\s*\d+(?::\d+)?(?:\s*[-–]\s*\d+(?::\d+)?)?)*)"
    r"\s*\(?([A-Za-z]{2,6})?\)?(?:\s+(?:it\s+)?says)?\s*:?\z"
)
CAPS = r"(?d)^([A-Z]{3,})(?:\s+(\d+))?\s*:\s*(.+)\z"
CAPS_EXCLUDED = ("TITLE", "IMAGE", "SCRIPTURE")
LEADING_VERSE_NUMBER = r"^\d{1,3}(?:\s*[-–]\s*\d{1,3})?\s+"
VERSE_NUMBER = r"(?d)^\d{1,3}\z"
SLIDE_NUMBER = r"(?d)^\d+:?\z"
QUOTE_MARKS = "\"“”'‘’"
SPACE = r"[\s\x{85}\p{Z}]"
