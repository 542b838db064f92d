"""Functions that are used from SQL: table functions for HTML tables and for windows of words, a scalar one for folding. ``register`` puts them into a session."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import _maps

#: A cell that spans more is cut to this, as browsers do.
SPAN = 1000


class _Table:
    """An open table: finished rows, and the grid of cells that rowspans still hold."""

    def __init__(self, ordinal: int):
        self.ordinal, self.rows, self.heads = ordinal, [], []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.shape, self.head, self.held = (1, 1), False, {}

    def open_row(self) -> None:
        self.close_row()
        self.row, self.head = [], False
        self._held()

    def _held(self) -> None:
        """Cells of rows above that reach into this place."""
        while self.row is not None and len(self.row) in self.held:
            place = len(self.row)
            text, left = self.held[place]
            self.row.append(text)
            if left > 1:
                self.held[place] = (text, left - 1)
            else:
                del self.held[place]

    def open_cell(self, head: bool, across: int, down: int) -> None:
        if self.row is None:
            self.open_row()
        self.close_cell()
        self.cell, self.shape, self.head = [], (across, down), self.head or head

    def close_cell(self) -> None:
        if self.cell is None:
            return
        text, (across, down) = " ".join("".join(self.cell).split()), self.shape
        for _ in range(across):
            if down > 1:
                self.held[len(self.row)] = (text, down - 1)
            self.row.append(text)
            if down <= 1 or len(self.row) in self.held:
                self._held()
        self._held()
        self.cell = None

    def close_row(self) -> None:
        self.close_cell()
        if self.row is not None:
            self._held()
            if any(self.row):
                self.rows.append(self.row)
                self.heads.append(self.head)
            self.row = None


class _Reader(HTMLParser):
    """Tables of a text, those inside cells as tables of their own, each in the place where it opens."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.done: list[_Table] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "table":
            if self.open and self.open[-1].cell is not None:
                self.open[-1].cell.append(" ")
            self.open.append(_Table(len(self.open) + len(self.done)))
        elif self.open and tag == "tr":
            self.open[-1].open_row()
        elif self.open and tag in ("td", "th"):
            own = dict(attrs)
            across, down = (min(int(m[0]), SPAN) if (m := re.match(r"\d+", (own.get(k) or "").strip())) and int(m[0]) > 0 else 1 for k in ("colspan", "rowspan"))
            self.open[-1].open_cell(tag == "th", across, down)
        elif self.open and self.open[-1].cell is not None:
            self.open[-1].cell.append(" ")

    def handle_endtag(self, tag) -> None:
        if not self.open:
            return
        if tag == "table":
            self._close()
        elif tag == "tr":
            self.open[-1].close_row()
        elif tag in ("td", "th"):
            self.open[-1].close_cell()
        elif self.open[-1].cell is not None:
            self.open[-1].cell.append(" ")

    def handle_data(self, data) -> None:
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell.append(data)

    def _close(self) -> None:
        table = self.open.pop()
        table.close_row()
        self.done.append(table)

    def tables(self) -> list[_Table]:
        while self.open:
            self._close()
        return sorted(self.done, key=lambda x: x.ordinal)


#: A plain tag: closing, or opening with its attributes.
_TAG = re.compile(r"""<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9-]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'<>=`/&]+))?)*))[ \t\r\n]*>""")
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


def _plain(text: str) -> list[_Table] | None:
    """Tables of a text that is cut at its tags at once; None for texts with any other mark, references, spanning cells,
    elements whose content is not markup or tables in tables, which are HTMLParser's."""
    if "&" in text or "span" in (lower := text.lower()):
        return None
    parts = _TAG.split(text if lower == text else re.sub(r"<[^>]*", lambda m: m[0].lower(), text))
    if any("<" in x for x in parts[::4]) or not _RAW.isdisjoint(parts[1::4]) or not _RAW.isdisjoint(parts[2::4]):
        return None
    done: list[_Table] = []
    table = row = cell = None
    head = False
    # the text before a tag, and the tag; at the end of the text an open table ends
    for data, closed, opened in zip(parts[::4], [*parts[1::4], "table"], [*parts[2::4], None], strict=True):
        if table is None:
            if opened == "table":
                table = _Table(len(done))
            continue
        if cell is not None:
            cell += data
        name = closed or opened
        if name not in ("td", "th", "tr", "table"):
            if cell is not None:
                cell += " "
            continue
        if opened == "table":
            return None
        if cell is not None:
            row.append(" ".join(cell.split()))
            cell = None
        if name in ("tr", "table"):
            if row is not None and any(row):
                table.rows.append(row)
                table.heads.append(head)
            row, head = [] if opened else None, False
            if name == "table":
                done.append(table)
                table = None
        elif opened:
            if row is None:
                row, head = [], False
            cell, head = "", head or name == "th"
    return done


def _read(text: str) -> list[_Table]:
    """All tables of a text, in the order in which they open."""
    if (plain := _plain(text)) is not None:
        return plain
    reader = _Reader()
    reader.feed(text)
    reader.close()
    return reader.tables()


def html_tables(text: str | None) -> Iterator[tuple]:
    """Each table of two rows or more of a text: the header is the first row with a header cell, else the first; rows of
    two cells or more. Spanning cells stand in every place that they cover; a table inside a cell is a table of its own and
    not text of that cell. A table that is never closed ends with the text; null and texts without tables give none."""
    if not text or "<" not in text:
        return
    for table in _read(text):
        kept = [(row, head) for row, head in zip(table.rows, table.heads, strict=True) if len(row) >= 2]
        if len(kept) >= 2:
            at = next((i for i, (_, head) in enumerate(kept) if head), 0)
            yield table.ordinal, kept[at][0], [row for i, (row, _) in enumerate(kept) if i != at]


@F.udtf(returnType="ordinal int, header array<string>, rows array<array<string>>")
class HtmlTables:
    """``html_tables`` as a table function."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from html_tables(text)


@F.udtf(returnType="part int, text string")
class ChunkText:
    """Windows of ``target`` words, ``overlap`` shared, up to the first that reaches the end, as ``documents.chunk_text``."""

    def eval(self, text: str, target: int = 512, overlap: int = 64) -> Iterator[tuple]:
        if target <= 0 or not 0 <= overlap < target:
            raise ValueError("target must be positive and overlap smaller than it")
        words = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
        at = part = 0
        while words and (not part or at + overlap < len(words)):
            yield part, " ".join(words[at : at + target])
            at, part = at + target - overlap, part + 1


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """html_tables and chunk_text as table functions; norm_free as an SQL function, which stays in the JVM."""
    spark.udtf.register("html_tables", HtmlTables)
    spark.udtf.register("chunk_text", ChunkText)
    source, target, _ = _maps("NFD")
    keep = [(a, b) for a, b in zip(source, target, strict=True) if a.lower() == a]
    pairs = _quoted("".join(a for a, _ in keep) + "đ"), _quoted("".join(b for _, b in keep) + "d")
    for name, body in {
        "norm_free": f"regexp_replace(translate(lower(x), {pairs[0]}, {pairs[1]}), '\\\\p{{Mn}}+', '')",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
