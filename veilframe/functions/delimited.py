"""Delimited text to lines of joined cells, as one SQL expression per text."""

from __future__ import annotations

# --- fixed value: how cells are joined --------------------------------------
CELL_JOIN = " | "


def _cell_regex(separator: str) -> str:
    """One cell with what ends it.  A cell that opens with a quote runs to the
    closing quote, doubled quotes inside, or to the end of the text; anything
    after the closing quote belongs to the cell as it is."""
    stop = rf"(?:{separator}|\r\n|\r|\n)"
    rest = rf"[^{separator}\r\n]"
    quoted = rf'"(?:[^"]++|"")*+(?:"{rest}*+{stop}|\z)'
    plain = rf'(?:[^"{separator}\r\n]{rest}*+)?{stop}'
    return f"{quoted}|{plain}"


def _content(cell: str) -> str:
    """A raw cell without its end, its quotes undone."""
    closed = r'^"((?:[^"]++|"")*+)"([\s\S]*)\z'
    bare = f"regexp_replace(c.body, '\\\\A\"', '')"
    return f"""if(startswith(c.body, '"'),
        if(c.body rlike r'{closed}',
            concat(replace(regexp_extract(c.body, r'{closed}', 1), '""', '"'), regexp_extract(c.body, r'{closed}', 2)),
            replace({bare}, '""', '"')),
        c.body)"""


def flattened_sql(text: str, separator: str) -> str:
    """Rows as lines, cells of any length joined by `` | ``.

    ``separator`` is the regex of one character.  Quotes are undone and blank
    rows kept; a line end at the end of the text adds no row.
    """
    regex = _cell_regex(separator)
    # Every cell needs an end: texts without a last line feed get one, which an
    # open quoted cell must give back.
    closed_text = f"if({text} rlike r'[\\r\\n]\\z', {text}, concat({text}, '\\n'))"
    raw = f"regexp_extract_all({closed_text}, r'{regex}', 0)"
    open_cell = r'^"(?:[^"]++|"")*+\z'
    cells = f"""transform({raw}, r -> named_struct(
        'last', r rlike r'([\\r\\n]\\z)|{open_cell}',
        'body', case
            when r rlike r'{open_cell}' then
                if({text} rlike r'[\\r\\n]\\z', r, regexp_replace(r, r'\\n\\z', ''))
            else regexp_replace(r, r'(?:{separator}|\\r\\n|\\r|\\n)\\z', '') end))"""
    joined = f"""array_join(transform({cells}, (c, i) -> concat({_content('c')}, if(c.last, '\\n', '{CELL_JOIN}'))), '')"""
    line_end = r"\n\z"
    return f"if({text} = '', '', regexp_replace({joined}, r'{line_end}', ''))"
