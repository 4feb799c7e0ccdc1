"""SQL that derives the fixtures and the deck tables independently of the library, for DuckDB.

``sql(body)`` puts before ``body`` the common table expressions that it names, directly or
through others.
"""

from __future__ import annotations

import re

from .functions import patterns as P
from .functions.metrics import CAPITAL_WIDTH, PLAIN_WIDTH, WIDTH, width_classes


def rx(pattern: str) -> str:
    """A pattern in RE2's dialect as a quoted literal."""
    p = re.sub(r"^\(\?(i?)d\)", lambda m: "(?i)" if m[1] else "", pattern)
    return "'" + p.replace("'", "''") + "'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {rx(pattern)})"


def group(c: str, pattern: str, n: int) -> str:
    return f"coalesce(regexp_extract({c}, {rx(pattern)}, {n}), '')"


def units(c: str) -> str:
    listed = "".join(WIDTH)
    rest = f"translate({c}, {lit(listed)}, '')"
    out = f"length({rest}) * {PLAIN_WIDTH} + length(regexp_replace({rest}, '[^\\p{{Lu}}]', '', 'g')) * {CAPITAL_WIDTH - PLAIN_WIDTH}"
    for w, chars in width_classes().items():
        out += f" + (length({c}) - length(translate({c}, {lit(chars)}, ''))) * {w}"
    return f"({out})::bigint"


def char_units(c: str) -> str:
    whens = " ".join(f"WHEN contains({lit(chars)}, {c}) THEN {w}" for w, chars in width_classes().items())
    return f"CASE {whens} WHEN regexp_matches({c}, '^\\p{{Lu}}') THEN {CAPITAL_WIDTH} ELSE {PLAIN_WIDTH} END"


def blank(c: str) -> str:
    return f"regexp_matches({c}, '^[\\s\\x{{85}}\\p{{Z}}]*$')"


SEEN = f"NOT {blank('s')}"
def wrapped(text: str, room: float, size: float, caps: str = "false") -> str:
    """Lines that greedy wrapping of a text needs, as one fold over its words."""
    shown = f"CASE WHEN {caps} THEN replace(upper(replace({text}, 'ß', chr(1))), chr(1), 'ß') ELSE {text} END"
    words = f"list_filter(regexp_split_to_array({shown}, '[\\s\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"
    steps = f"list_transform({words}, lambda w: {{'own': {units('w')} / 1000.0::double * {size}::double, 'line': 0::bigint, 'at': 0::double}})"
    space = f"(278 / 1000.0::double * {size}::double)"
    fits = f"(a.at + {space} + b.own <= {room}::double)"
    place = f"(CASE WHEN {fits} THEN a.at + ({space} + b.own) ELSE b.own END)"
    over = f"(CASE WHEN {place} > {room} THEN ceil({place} / {room}::double) - 1 ELSE 0 END)"
    step = f"{{'own': 0::double, 'line': (a.line + CASE WHEN {fits} THEN 0 ELSE 1 END + {over})::bigint, 'at': {place} - {over} * {room}::double}}"
    return f"greatest(list_reduce(list_prepend({{'own': 0::double, 'line': 0::bigint, 'at': 1e18::double}}, {steps}), lambda a, b: {step}).line, 1)"


CAPS_OK = f"({matches('line', P.CAPS)} AND {group('line', P.CAPS, 1)} NOT IN ('TITLE', 'IMAGE', 'SCRIPTURE'))"
QUOTES = P.QUOTE_MARKS.replace("'", "''")


def capitalized(c: str) -> str:
    return f"upper(substr(lower({c}), 1, 1)) || substr(lower({c}), 2)"


def verse(c: str) -> str:
    x = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"trim(ltrim(regexp_replace({x}, {rx(P.LEADING_VERSE_NUMBER)}, ''), '-–'))"


def reference(c: str) -> str:
    version = group(c, P.SCRIPTURE, 3)
    return f"trim({group(c, P.SCRIPTURE, 1)}) || ' ' || regexp_replace({group(c, P.SCRIPTURE, 2)}, '\\s+', '', 'g') || CASE WHEN {version} <> '' THEN ' ' || upper({version}) ELSE '' END"


def escaped(c: str) -> str:
    """Backslash and braces escaped, characters outside ASCII (of one UTF-16 unit) as signed numbers."""
    signed = "CASE WHEN unicode(c) >= 32768 THEN unicode(c) - 65536 ELSE unicode(c) END"
    marks = f"replace(replace(replace({c}, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}')"
    return f"array_to_string(list_transform(string_split({marks}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE '\\u' || ({signed}) || ' ?' END), '')"


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '…' ELSE {c} END"


def both(c: str) -> str:
    return f"trim({c} || ' ' || extra)"


_long = matches("head", P.BACK_TO)
_ref = f"trim(CASE WHEN {_long} THEN {group('head', P.BACK_TO, 1)} ELSE {group('head', P.BACK_TO_SHORT, 1)} END)"
_told = f"(CASE WHEN {_long} THEN {group('head', P.BACK_TO, 2)} ELSE {group('head', P.BACK_TO_SHORT, 2)} END)"
_point_text = f"({group('head', P.POINT, 3)} || {group('head', P.POINT, 4)})"

TABLES = {
    "doc_lines": "SELECT doc_id, (unnest(range(len(l))))::int AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)",
    "outline_lines": """SELECT doc_id, line_no, CASE (line_no * 7 + doc_id) % 13
        WHEN 0 THEN 'Title: ' || line WHEN 1 THEN 'POINT ' || (1 + line_no % 4) || ': ' || line WHEN 2 THEN 'CONDITION ' || (1 + line_no % 4) || ': ' || line
        WHEN 3 THEN 'John ' || (1 + doc_id % 21) || ':' || (1 + line_no) || '-' || (3 + line_no) || ' (NIV)' WHEN 4 THEN 'Back to Point ' || (1 + line_no % 4)
        WHEN 5 THEN 'Image: “' || line WHEN 6 THEN 'Scripture:' WHEN 7 THEN 'TRUTH: ' || line WHEN 8 THEN (1 + line_no)::varchar WHEN 9 THEN 'Back to Title' WHEN 10 THEN 'Mary Ann Smith quote: ' || line ELSE line END AS line FROM doc_lines""",
    "clean_lines": "SELECT doc_id, line_no, trim(line) AS line FROM outline_lines WHERE trim(line) <> ''",
    "kinds": f"""SELECT *, CASE WHEN {matches('line', P.TITLE)} THEN 'title' WHEN {matches('line', P.IMAGE)} THEN 'image' WHEN {matches('line', P.QUOTE)} THEN 'quote'
        WHEN {matches('line', P.BACK_TO)} OR {matches('line', P.BACK_TO_SHORT)} THEN 'backto' WHEN {matches('line', P.POINT)} THEN 'point' WHEN {matches('line', P.MARKER)} THEN 'marker'
        WHEN {matches('line', P.SCRIPTURE)} THEN 'scripture' WHEN {CAPS_OK} THEN 'caps' END AS kind FROM clean_lines""",
    "marked": "SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'marker', false) AND coalesce(kind, '') <> 'marker' AS forced FROM kinds",
    "islands_all": "SELECT *, (kind IS NOT NULL AND kind <> 'marker') OR forced AS starts, sum(((kind IS NOT NULL AND kind <> 'marker') OR forced)::int) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM marked",
    "islands": "SELECT * FROM islands_all WHERE island > 0 AND coalesce(kind, '') <> 'marker'",
    "opened": f"SELECT *, first_value(CASE WHEN forced THEN 'forced' ELSE kind END) OVER i AS island_kind, sum(length(said) - length(replace(said, '“', '')) - length(said) + length(replace(said, '”', ''))) OVER i AS open FROM (SELECT *, CASE WHEN starts THEN {group('line', P.IMAGE, 1)} ELSE line END AS said FROM islands) WINDOW i AS (PARTITION BY doc_id, island ORDER BY line_no)",
    "taken": "SELECT *, starts OR island_kind <> 'image' OR min(open) OVER (PARTITION BY doc_id, island ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS taken FROM opened",
    "grouped": f"SELECT doc_id, island, min(line_no) AS pos, max(line) FILTER (starts) AS head, max(island_kind) AS k, coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT starts AND taken AND (island_kind = 'image' OR NOT {matches('line', P.VERSE_NUMBER)})), '') AS extra FROM taken GROUP BY doc_id, island",
    "entries": f"""SELECT doc_id, pos, CASE WHEN k IN ('quote', 'forced') THEN 'scripture' WHEN k = 'caps' THEN 'point' ELSE k END AS kind,
        CASE k WHEN 'title' THEN {both(group('head', P.TITLE, 1))} WHEN 'image' THEN CASE WHEN extra <> '' THEN {both(group('head', P.IMAGE, 1))} ELSE {group('head', P.IMAGE, 1)} END
            WHEN 'point' THEN {both(_point_text)} WHEN 'caps' THEN {both(group('head', P.CAPS, 3))} END AS text,
        CASE k WHEN 'point' THEN {capitalized("replace(" + group('head', P.POINT, 1) + ", ' ', '')")} || ' ' || {group('head', P.POINT, 2)}
            WHEN 'caps' THEN {capitalized(group('head', P.CAPS, 1))} || CASE WHEN {group('head', P.CAPS, 2)} <> '' THEN ' ' || {group('head', P.CAPS, 2)} ELSE '' END END AS label,
        CASE k WHEN 'quote' THEN {group('head', P.QUOTE, 1)} WHEN 'scripture' THEN {reference('head')} WHEN 'forced' THEN CASE WHEN {matches('head', P.SCRIPTURE)} THEN {reference('head')} ELSE regexp_replace(head, '\\s+', ' ', 'g') END END AS reference,
        CASE WHEN k = 'quote' THEN {verse(both(group('head', P.QUOTE, 2)))} WHEN k IN ('scripture', 'forced') THEN {verse('extra')} END AS verse,
        CASE WHEN k = 'backto' THEN CASE WHEN lower({_ref}) = 'title' THEN 'Title' ELSE {_ref} END END AS ref,
        CASE WHEN k = 'backto' THEN trim(trim(trim({both(_told)}), '{QUOTES}')) END AS trigger FROM grouped""",
    "keyed": "SELECT *, CASE WHEN kind = 'title' THEN 'title' WHEN kind = 'point' THEN lower(label) WHEN kind = 'scripture' THEN lower(reference) WHEN kind = 'backto' THEN lower(ref) END AS key FROM entries",
    "asof_entries": "SELECT b.*, (SELECT max(e.pos) FROM keyed e WHERE e.doc_id = b.doc_id AND e.key = b.key AND e.pos < b.pos AND e.kind NOT IN ('backto', 'image') AND b.kind = 'backto') AS source_pos FROM keyed b",
    "expanded": """SELECT doc_id, pos, 0 AS part_no, c AS copy_no, CASE WHEN kind = 'title' THEN 'title' WHEN kind = 'scripture' THEN 'scripture' WHEN lower(label) LIKE 'point%' OR lower(label) LIKE 'subpoint%' THEN 'point' ELSE 'keyword' END AS role,
        CASE WHEN kind = 'title' THEN 'Title' WHEN kind = 'scripture' THEN reference ELSE label END AS name, CASE WHEN kind = 'scripture' THEN reference END AS reference, coalesce(text, verse) AS text, NULL AS source_pos, c = 0 AS enabled
        FROM entries, (VALUES (0), (1)) v(c) WHERE kind IN ('title', 'point', 'scripture') AND (c = 0 OR kind <> 'scripture')""",
    "cues": """SELECT doc_id, pos, part_no, copy_no, role, CASE WHEN copy_no = 1 THEN 'backto' ELSE role END AS look_role, name, reference, text, source_pos, enabled FROM expanded
        UNION ALL SELECT b.doc_id, b.pos, 0, 0, e.role, 'backto', CASE WHEN b.trigger <> '' THEN b.trigger ELSE 'Back to ' || b.ref END, e.reference, e.text, b.source_pos, true FROM asof_entries b JOIN expanded e ON e.doc_id = b.doc_id AND e.pos = b.source_pos AND e.copy_no = 0""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part_no, copy_no) AS cue_no FROM cues",
    "geo_lines": f"SELECT doc_id, (1 + line_no // 20)::int AS page, line_no, line AS text, CASE WHEN line_no % 10 = 0 THEN 28 WHEN line_no % 17 = 16 THEN 12 ELSE 20 END AS isize, 800 - 27 * (line_no % 20) - 27 * ((line_no % 20) // 4) AS iy, {units('line')} AS units FROM doc_lines",
    "kept_lines": "SELECT g.*, body FROM geo_lines g JOIN bodies USING (doc_id) WHERE isize >= 0.8 * body",
    "bodies": "SELECT doc_id, isize::double AS body, bytes FROM (SELECT doc_id, isize, sum(strlen(text)) AS bytes, row_number() OVER (PARTITION BY doc_id ORDER BY sum(strlen(text)) DESC, isize) AS r FROM geo_lines GROUP BY doc_id, isize) WHERE r = 1",
    "distances": "SELECT *, lag(iy) OVER (PARTITION BY doc_id, page ORDER BY line_no) - iy AS g FROM kept_lines",
    "gaps": "SELECT doc_id, coalesce(list_sort(list(g) FILTER (g > 0))[1 + (count(g) FILTER (g > 0)) // 4]::double, 1.2 * min_by(isize, line_no)) AS gap FROM distances GROUP BY doc_id",
    "columns_of": "SELECT doc_id, max((57.0 + units * isize / 1000.0) - 57.0) AS col FROM kept_lines GROUP BY doc_id",
    "stepped": "SELECT k.*, gap, isize > 1.2 * body AS heading, lag(page) OVER d AS p_page, lag(iy) OVER d AS p_y, lag(isize > 1.2 * body) OVER d AS p_heading FROM kept_lines k JOIN gaps USING (doc_id) WINDOW d AS (PARTITION BY k.doc_id ORDER BY line_no)",
    "blocks": "SELECT *, sum(CASE WHEN p_page IS NULL OR p_page <> page OR p_y - iy > 1.5 * gap OR (heading AND NOT p_heading) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM stepped",
    "stats": "SELECT *, n >= 2 AND has_lower AND 3 * wide >= 2 * (n - 1) AS flowing FROM (SELECT doc_id, block, count(*) AS n, bool_or(regexp_matches(text, '\\p{Ll}')) AS has_lower, coalesce(sum((NOT last AND (57.0 + units * isize / 1000.0) - 57.0 >= 0.75 * col)::int), 0) AS wide, bool_and(heading) AS heading_only FROM (SELECT b.*, col, lead(line_no) OVER (PARTITION BY b.doc_id, block ORDER BY line_no) IS NULL AS last FROM blocks b JOIN columns_of USING (doc_id)) GROUP BY doc_id, block)",
    "chars": f"SELECT doc_id, page, line_no, isize, iy, pos, s, {char_units('s')} AS units FROM (SELECT doc_id, page, line_no, isize, iy, (unnest(range(len(l))))::int AS pos, unnest(l) AS s FROM (SELECT *, string_split(text, '') AS l FROM geo_lines WHERE text <> ''))",
    "glyphs": """SELECT doc_id, page, ((line_no % 20) * 1000000 + pos)::bigint AS seq,
        CASE WHEN s = ' ' AND pos % 11 = 3 THEN chr(160) WHEN s = ' ' AND pos % 11 = 5 THEN chr(9) WHEN s = 'f' AND pos % 5 = 0 THEN 'ﬁ' WHEN s = 'q' AND pos % 3 = 0 THEN 'q' || chr(65533) WHEN s = 'z' AND pos % 4 = 0 THEN chr(13) ELSE s END AS s,
        coalesce(['Avenir-Heavy', 'Avenir-Black', 'Helvetica-Bold', 'Helvetica-Oblique', 'Times-Italic', 'Avenir-HeavyOblique'][(pos // 6 + doc_id) % 7 + 1], 'Avenir-Book') AS font,
        isize * CASE WHEN s BETWEEN '0' AND '9' AND pos % 2 = 0 THEN 0.5 ELSE 1.0 END AS size, 57.0 + before * isize / 1000.0 AS x, (iy - pos % 3)::double AS y, units * isize / 1000.0 AS w, line_no AS src_line, pos
        FROM (SELECT *, sum(units) OVER (PARTITION BY doc_id, line_no ORDER BY pos) - units AS before FROM chars) WHERE NOT (line_no % 4 = 3 AND s = ' ')""",
    "clean_glyphs": "SELECT * FROM (SELECT * REPLACE (replace(replace(s, 'ﬁ', 'fi'), chr(65533), '') AS s) FROM glyphs WHERE s NOT IN ('', chr(10), chr(13))) WHERE s <> ''",
    "paints": """SELECT doc_id, page, seq, x, y, CASE seq % 3 WHEN 0 THEN [q0] WHEN 1 THEN [q0, q1, q3] ELSE [q0, q2, q1, q4] END AS comps
        FROM (SELECT *, ((seq) % 5) * 0.25::double AS q0, ((seq + 1) % 5) * 0.25::double AS q1, ((seq + 2) % 5) * 0.25::double AS q2, ((seq + 3) % 5) * 0.25::double AS q3, ((seq + 4) % 5) * 0.25::double AS q4 FROM glyphs) WHERE seq % 4 <> 3
        UNION ALL SELECT doc_id, page, seq + 100000000, x, y, [0.5::double] FROM glyphs WHERE seq % 50 = 0""",
    "fresh": "SELECT doc_id, page, seq, (sign(x) * floor(abs(x) * 100 + 0.5))::bigint AS kx, (sign(y) * floor(abs(y) * 100 + 0.5))::bigint AS ky, CASE len(comps) WHEN 4 THEN [(1 - comps[1]) * (1 - comps[4]), (1 - comps[2]) * (1 - comps[4]), (1 - comps[3]) * (1 - comps[4])] WHEN 3 THEN comps ELSE [comps[1], comps[1], comps[1]] END AS c FROM paints",
    "inked": "SELECT g.*, p.c AS ink, (g.doc_id + g.page) % 2 = 0 AS dark FROM (SELECT *, (sign(x) * floor(abs(x) * 100 + 0.5))::bigint AS kx, (sign(y) * floor(abs(y) * 100 + 0.5))::bigint AS ky FROM clean_glyphs) g LEFT JOIN (SELECT doc_id, page, kx, ky, arg_max(c, seq) AS c FROM fresh GROUP BY ALL) p USING (doc_id, page, kx, ky)",
    "colored": "SELECT *, CASE WHEN ink IS NULL THEN '' WHEN list_max(ink) >= 0.3 THEN printf('#%02X%02X%02X', floor(ink[1] * 255 + 0.5)::int, floor(ink[2] * 255 + 0.5)::int, floor(ink[3] * 255 + 0.5)::int) WHEN dark THEN '#000000' ELSE '' END AS color, coalesce(list_max(ink) < 0.3 AND dark, false) AS highlight, font LIKE '%Heavy%' OR font LIKE '%Black%' OR font LIKE '%Bold%' AS bold, font LIKE '%Oblique%' OR font LIKE '%Italic%' AS italic FROM inked",
    "rows_of": f"SELECT *, max(y) OVER (PARTITION BY doc_id, page, src_line) AS anchor, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY src_line) AS line_no, row_number() OVER (PARTITION BY doc_id, page, src_line ORDER BY x, seq) AS ord, max(CASE WHEN {SEEN} THEN size END) OVER (PARTITION BY doc_id, page, src_line) AS largest FROM colored",
    "kept_rows": "SELECT * FROM rows_of WHERE NOT coalesce(size < 0.8 * largest AND regexp_matches(trim(s), '^[0-9]+$'), false)",
    "pended": f"SELECT *, coalesce(lag({blank('s')}) OVER r OR x - lag(x + w) OVER r > 3.0, false) AS pending FROM kept_rows WINDOW r AS (PARTITION BY doc_id, page, line_no ORDER BY ord)",
    "broken": f"SELECT *, row_number() OVER r AS rn, coalesce(pending OR bold <> lag(bold) OVER r OR italic <> lag(italic) OVER r OR color <> lag(color) OVER r OR highlight <> lag(highlight) OVER r, false) AS new FROM pended WHERE {SEEN} WINDOW r AS (PARTITION BY doc_id, page, line_no ORDER BY ord)",
    "run_glyphs": "SELECT *, sum(CASE WHEN rn > 1 AND new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_no ORDER BY ord) AS run_no, pending AND rn > 1 AS spaced FROM broken",
    "runs": "SELECT doc_id, page, line_no, run_no, string_agg(s, '' ORDER BY ord) AS text, arg_min(bold, ord) AS bold, arg_min(italic, ord) AS italic, arg_min(color, ord) AS color, arg_min(highlight, ord) AS highlight, arg_min(spaced, ord) AS space_before FROM run_glyphs GROUP BY doc_id, page, line_no, run_no",
    "doc_runs": """SELECT doc_id, page, line_no, run_no, text, (run_no + doc_id) % 7 = 0 AND text <> 'SLIDE' AS bold, (run_no + doc_id) % 11 = 0 AS italic, ['', '#FF0000', '#FAE333', '#ff0000', ''][(run_no + doc_id) % 5 + 1] AS color, (run_no + doc_id) % 17 = 0 AS highlight, run_no > 0 AS space_before
        FROM (SELECT doc_id, (1 + line_no // 20)::int AS page, line_no, (unnest(range(len(l))))::int AS run_no, unnest(l) AS text FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN []::varchar[] WHEN line_no % 9 = 0 THEN ['SLIDE', line_no::varchar] WHEN line_no % 3 = 0 THEN ['SLIDE', line_no || ':'] ELSE []::varchar[] END || list_filter(string_split(line, ' '), lambda w: w <> '') AS l FROM doc_lines))""",
    "marks": "SELECT *, coalesce(text = 'SLIDE' AND regexp_matches(lead(text) OVER l, '^\\d+:?$'), false) AS m FROM doc_runs WINDOW l AS (PARTITION BY doc_id, page, line_no ORDER BY run_no)",
    "sectioned": "SELECT * FROM (SELECT *, coalesce(lag(m) OVER (PARTITION BY doc_id, page, line_no ORDER BY run_no), false) AS n, sum(m::int) OVER (PARTITION BY doc_id ORDER BY line_no, run_no) AS section FROM marks) WHERE section > 0 AND NOT m AND NOT n",
    "slide_runs": "SELECT doc_id, page, line_no, run_no, text, bold, italic, color, highlight, section, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) AS slide_no, CASE WHEN row_number() OVER (PARTITION BY doc_id, section, line_no ORDER BY run_no) = 1 THEN false ELSE space_before END AS space_before FROM sectioned",
    "slide_lines": "SELECT doc_id, slide_no, line_no, string_agg(CASE WHEN space_before THEN ' ' ELSE '' END || text, '' ORDER BY run_no) AS line FROM slide_runs GROUP BY doc_id, slide_no, line_no",
    "palette": """SELECT doc_id, slide_no, upper, hex, 1 + row_number() OVER (PARTITION BY doc_id, slide_no ORDER BY first_use) - 1 AS at FROM (
        SELECT doc_id, slide_no, upper(h) AS upper, arg_min(h, (line_no, run_no, k)) AS hex, min((line_no, run_no, k)) AS first_use FROM (
        SELECT doc_id, slide_no, line_no, run_no, unnest(range(len(u))) AS k, unnest(u) AS h, CASE WHEN doc_id % 3 = 0 THEN '#FAE333' ELSE '#FFFFFF' END AS regular FROM (
        SELECT *, CASE WHEN highlight THEN ['#000000', '#FFFFFF'] WHEN color <> '' THEN [color] ELSE []::varchar[] END AS u FROM slide_runs WHERE doc_id % 2 = 0)) WHERE upper(h) <> regular GROUP BY doc_id, slide_no, upper(h))""",
    "palette_size": "SELECT doc_id, slide_no, count(*) AS n FROM palette GROUP BY doc_id, slide_no",
    "styled_runs": "SELECT r.*, CASE WHEN r.doc_id % 2 = 0 THEN CASE WHEN highlight THEN '#000000' ELSE upper(color) END WHEN bold AND r.doc_id % 5 <> 0 THEN '*' ELSE '' END AS want, r.doc_id % 2 = 0 AS keep, r.doc_id % 4 = 1 AS si, CASE WHEN r.doc_id % 3 = 0 THEN '#FAE333' ELSE '#FFFFFF' END AS regular FROM slide_runs r",
    "colored_runs": """SELECT s.*, CASE WHEN want = '' OR want = regular THEN 0 WHEN want = '*' THEN 1 ELSE p.at END AS color_at, CASE WHEN keep AND highlight THEN 1 + CASE WHEN regular = '#FFFFFF' THEN 0 ELSE w.at END ELSE CASE WHEN keep OR s.doc_id % 5 = 0 THEN 2 ELSE 3 END + coalesce(m.n, 0) END AS mark, CASE WHEN keep OR s.doc_id % 5 = 0 THEN 2 ELSE 3 END + coalesce(m.n, 0) AS clear, si OR (keep AND italic) AS slant
        FROM styled_runs s LEFT JOIN palette p ON p.doc_id = s.doc_id AND p.slide_no = s.slide_no AND p.upper = want LEFT JOIN (SELECT * FROM palette WHERE upper = '#FFFFFF') w ON w.doc_id = s.doc_id AND w.slide_no = s.slide_no LEFT JOIN palette_size m ON m.doc_id = s.doc_id AND m.slide_no = s.slide_no""",
    "verse_words": "SELECT doc_id, line_no, (unnest(range(len(l))))::int AS i, unnest(l) AS w FROM (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[\\s\\x{85}\\p{Z}]+'), lambda w: w <> '') AS l FROM doc_lines)",
    "verse_sentences": "SELECT doc_id, line_no, unit, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT *, coalesce(sum(regexp_matches(w, '[.;?!][\"''”’)\\]]*$')::int) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM verse_words) GROUP BY doc_id, line_no, unit",
    "styles": """SELECT * FROM (VALUES ('Plain', 'prompts', ['body'], '#FFFFFF', '#FFFF00', true, true, 5), ('Loud', 'prompts', ['body'], '#FAE333', '#FF0000', false, true, 0), ('Quiet', 'prompts', ['body'], '  ', NULL, NULL, NULL, NULL),
        ('Deck', 'slides', ['title', 'point', 'keyword', 'scripture'], '#FFFFFF', '', NULL, false, 4), ('Torn', 'slides', ['title', 'point'], '', '#00FF00', true, true, -1), ('bad/name', 'slides', []::varchar[], NULL, NULL, NULL, NULL, NULL))
        t(name, kind, roles, regular_color, emphasis_color, force_caps_off, highlight_bold, scripture_max_lines)""",
    "settled": "SELECT name, kind, roles, CASE WHEN trim(coalesce(regular_color, '')) = '' THEN '#FFFFFF' ELSE regular_color END AS regular_color, CASE WHEN trim(coalesce(emphasis_color, '')) = '' THEN '#FFFF00' ELSE emphasis_color END AS emphasis_color, coalesce(force_caps_off, true) AS force_caps_off, coalesce(highlight_bold, true) AS highlight_bold, CASE WHEN coalesce(scripture_max_lines, 0) <= 0 THEN 5 ELSE scripture_max_lines END AS scripture_max_lines FROM styles",
    "looks": "SELECT * FROM (VALUES ('Deck', 'title', 'u1', 'Title L3'), ('Deck', 'keyword', 'u1', 'Title L3'), ('Deck', 'point', 'u2', 'Points L3'), ('Deck', 'scripture', '', 'Verse L3'), ('Deck', 'backto', 'u4', 'Default'), ('Torn', 'title', 'u5', 'Other')) t(style, role, uuid, look_name)",
    "jobs": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'pdf' ELSE 'style' END AS colors, (doc_id % 4 - 1)::int AS max_lines, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source || ' ' || lang END AS name, CASE WHEN doc_id % 2 = 0 THEN 1440.0 ELSE 0.0 END AS box_width, 50.0 AS box_size, CASE WHEN doc_id % 2 = 0 THEN 'prompts' ELSE 'slides' END AS mode, ['Plain', 'Deck', 'Loud', 'Torn', 'None'][doc_id % 5 + 1] AS style FROM documents",
}


def packed_verses(source: str, most: int, room: float, size: float) -> str:
    """doc_id, pos, part_no, verse: verses of ``source`` (doc_id, pos, verse) cut at sentence ends into as few parts of ``most`` lines as filling gives, under the least cap that gives no more.

    Only stretches of sentences whose words are not too wide for the limit are measured. For
    each cap a walk over the sentences takes as many as fit, one at least.
    """
    ws = "'[\\s\\x{85}\\p{Z}]+'"
    ends = "'[.;?!][\"''”’)\\]]*$'"
    return f"""SELECT doc_id, pos, part_no, verse FROM (WITH
said AS (SELECT row_number() OVER () AS id, doc_id, pos, list_filter(regexp_split_to_array(coalesce(verse, ''), {ws}), lambda w: w <> '') AS w FROM ({source})),
sized AS (SELECT *, {wrapped("array_to_string(w, ' ')", room, size)} AS whole FROM said),
word AS (SELECT id, unnest(range(len(w))) AS i, unnest(w) AS w FROM sized WHERE whole > {most}),
sentence AS (SELECT id, u::int AS u, string_agg(w, ' ' ORDER BY i) AS text FROM (SELECT *, coalesce(sum(regexp_matches(w, {ends})::int) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM word) GROUP BY id, u),
placed AS (SELECT *, sum({units('text')}) OVER (PARTITION BY id ORDER BY u) AS upto, {units('text')} AS own FROM sentence),
texts AS (SELECT id, list(text ORDER BY u) AS l FROM sentence GROUP BY id),
pair AS (SELECT id, u AS a, last + 1 AS b, {wrapped("array_to_string(l[u + 1:last + 1], ' ')", room, size)} AS n FROM (SELECT x.id, x.u, y.u AS last, l FROM placed x JOIN placed y ON y.id = x.id AND y.u >= x.u AND y.upto - x.upto + x.own <= {most * room * 1000 / size} JOIN texts t ON t.id = x.id)),
step AS (SELECT s.id, c AS cap, s.u AS a, coalesce(max(p.b) FILTER (p.n <= c), s.u + 1) AS b FROM sentence s CROSS JOIN range(1, {most + 1}) r(c) LEFT JOIN pair p ON p.id = s.id AND p.a = s.u GROUP BY s.id, c, s.u),
walk AS (WITH RECURSIVE v AS (SELECT id, cap, 0 AS k, a, b FROM step WHERE a = 0 UNION ALL SELECT s.id, s.cap, v.k + 1, s.a, s.b FROM v JOIN step s ON s.id = v.id AND s.cap = v.cap AND s.a = v.b) SELECT * FROM v),
best AS (SELECT id, min(cap) AS cap FROM (SELECT *, max(n) FILTER (cap = {most}) OVER (PARTITION BY id) AS fewest FROM (SELECT id, cap, count(*) AS n FROM walk GROUP BY id, cap)) WHERE n <= fewest GROUP BY id)
SELECT s.doc_id, s.pos, k AS part_no, array_to_string(l[a + 1:b], ' ') AS verse FROM walk JOIN best USING (id, cap) JOIN texts USING (id) JOIN sized s USING (id)
UNION ALL SELECT doc_id, pos, 0, array_to_string(w, ' ') FROM sized WHERE whole <= {most})"""


def _marked_tables() -> dict[str, str]:
    """The glyph chain once more over lines of which some begin with a slide marker, raised digits kept."""
    names = ("geo_lines", "chars", "glyphs", "clean_glyphs", "paints", "fresh", "inked", "colored", "rows_of", "kept_rows", "pended", "broken", "run_glyphs", "runs")
    out = {f"marked_{n}": re.sub(rf"\b(FROM|JOIN) (\(?)({'|'.join(names)})\b", r"\1 \2marked_\3", TABLES[n]) for n in names}
    line = "CASE WHEN (line_no % 20) % 3 = 0 AND doc_id % 3 <> 0 THEN 'SLIDE ' || line_no || ': ' || line ELSE line END"
    out["marked_geo_lines"] = f"SELECT doc_id, page, line_no, text, isize, iy, {units('text')} AS units FROM (SELECT * REPLACE ({line} AS text) FROM ({TABLES['geo_lines'].replace('SELECT doc_id', 'SELECT line, doc_id', 1)}))"
    at = "(seq // 1000000) % 3 = 0 AND seq % 1000000 < 12 AND doc_id % 3 <> 0"
    out["marked_paints"] = out["marked_paints"].replace("SELECT doc_id, page, seq, x, y, CASE seq % 3", f"SELECT doc_id, page, seq, x, y, CASE WHEN {at} THEN [0.5::double] ELSE CASE seq % 3", 1).replace(" END AS comps", " END END AS comps", 1).replace("WHERE seq % 4 <> 3", f"WHERE seq % 4 <> 3 OR ({at})", 1)
    out["marked_kept_rows"] = "SELECT * FROM marked_rows_of"
    out["marked_lines_of"] = "SELECT r.doc_id, r.page, r.line_no, r.text, e.size FROM (SELECT doc_id, page, line_no, string_agg(CASE WHEN run_no > 0 AND space_before THEN ' ' ELSE '' END || text, '' ORDER BY run_no) AS text FROM marked_runs GROUP BY doc_id, page, line_no) r JOIN (SELECT doc_id, page, line_no, max(size) AS size FROM marked_run_glyphs GROUP BY doc_id, page, line_no) e USING (doc_id, page, line_no)"
    out["marked_marks"] = "SELECT *, coalesce(text = 'SLIDE' AND regexp_matches(lead(text) OVER l, '^\\d+:?$'), false) AS m FROM marked_runs WINDOW l AS (PARTITION BY doc_id, page, line_no ORDER BY run_no)"
    out["marked_sections"] = "SELECT * FROM (SELECT *, coalesce(lag(m) OVER (PARTITION BY doc_id, page, line_no ORDER BY run_no), false) AS n, sum(m::int) OVER (PARTITION BY doc_id ORDER BY page, line_no, run_no) AS section FROM marked_marks) WHERE section > 0 AND NOT m AND NOT n"
    out["marked_slide_lines"] = "SELECT doc_id, slide_no, page, line_no, string_agg(CASE WHEN first OR NOT space_before THEN '' ELSE ' ' END || text, '' ORDER BY run_no) AS line FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) AS slide_no, row_number() OVER (PARTITION BY doc_id, section, page, line_no ORDER BY run_no) = 1 AS first FROM marked_sections) GROUP BY doc_id, slide_no, page, line_no"
    return out


TABLES |= _marked_tables()


def sql(body: str) -> str:
    """``body`` after a WITH clause of the tables above that it needs."""
    needed: dict[str, None] = {}

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+\(?(\w+)", text)):
            if word in TABLES and word not in needed:
                need(TABLES[word])
                needed[word] = None

    need(body)
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({TABLES[n]})' for n in needed)} {body}" if needed else body
