"""A word-processor package per document, written with the standard library: same blocks, same bytes.

Paragraphs keep their alignment, heading level, size and weight; list items refer to numbering definitions, one
per list, so that every list counts on its own; a paragraph with runs is written run by run with their styles and
direction; a table block is written from its cells with spans; a graphic leaves a named place. Nothing is dropped silently:
a table without cells keeps an empty one. Each document is one group; its parts are bounded by its pages.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)
_DOC_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="numbering.xml"/></Relationships>'
)
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_ALIGN = {"justify": "both", "center": "center", "right": "right", "left": "left"}
_EPOCH = (1980, 1, 1, 0, 0, 0)


def _clean(text: str) -> str:
    return "".join(c for c in text if c in "\t\n" or ord(c) >= 32 and not 0xD800 <= ord(c) < 0xE000 and c not in "￾￿")


def _given(x) -> bool:
    return x is not None and x == x


def _run(text: str, bold=None, italic=None, size=None, rtl=False) -> str:
    style = ("<w:b/>" if bold is True else "") + ("<w:i/>" if italic is True else "") + (f'<w:sz w:val="{round(size * 2)}"/>' if _given(size) and size else "") + ("<w:rtl/>" if rtl else "")
    body = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(part)}</w:t>' for part in _clean(text).split("\n"))
    return f"<w:r><w:rPr>{style}</w:rPr>{body}</w:r>"


def _paragraph(row, runs: list) -> str:
    style = f'<w:jc w:val="{_ALIGN[row.alignment]}"/>' if row.alignment in _ALIGN else ""
    if row.kind == "heading":
        style = f'<w:outlineLvl w:val="{int(row.level) if _given(row.level) else 0}"/>' + style
    if _given(row.list_id):
        style = f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{int(row.list_id)}"/></w:numPr>' + style
    if runs and "".join(r.text or "" for r in runs) == row.text:
        body = "".join(_run(r.text, r.bold, r.italic, r.size, r.direction == "rtl") for r in runs if r.text)
    else:
        body = _run(row.text, row.bold, None, row.size)
    return f"<w:p><w:pPr>{style}</w:pPr>{body}</w:p>"


def _table(cells: list) -> str:
    """Rows of a table; a cell that spans rows is continued below by empty ones."""
    taken = {(c.row_no, c.col_no): c for c in sorted(cells, key=lambda c: (c.row_no, c.col_no))}
    below: dict[tuple[int, int], int] = {}
    for c in taken.values():
        for k in range(1, max(1, int(c.row_span))):
            below[(c.row_no + k, c.col_no)] = max(1, int(c.col_span))
    rows = []
    for r in sorted({k[0] for k in (*taken, *below)}):
        out = []
        for col in sorted({k[1] for k in (*taken, *below) if k[0] == r}):
            c = taken.get((r, col))
            wide = max(1, int(c.col_span)) if c else below[(r, col)]
            merge = '<w:vMerge w:val="restart"/>' if c and int(c.row_span) > 1 else "" if c else "<w:vMerge/>"
            span = f'<w:gridSpan w:val="{wide}"/>' if wide > 1 else ""
            out.append(f"<w:tc><w:tcPr>{span}{merge}</w:tcPr><w:p>{_run(c.text) if c and isinstance(c.text, str) else ''}</w:p></w:tc>")
        rows.append("<w:tr>" + "".join(out) + "</w:tr>")
    return "<w:tbl><w:tblPr/>" + ("".join(rows) or "<w:tr><w:tc><w:p/></w:tc></w:tr>") + "</w:tbl><w:p/>"


def _numbering(lists: dict[int, str]) -> str:
    """One definition a list, decimal or bullet by its first marker."""
    kind = {k: "decimal" if any(c.isdigit() for c in m) else "upperLetter" if m[:1].isupper() else "lowerLetter" if m[:1].isalpha() else "bullet" for k, m in lists.items()}
    text = {k: "•" if v == "bullet" else "%1" + (lists[k][-1:] if lists[k][-1:] in ".)" else ".") for k, v in kind.items()}
    one = "".join(f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{kind[k]}"/><w:lvlText w:val="{text[k]}"/></w:lvl></w:abstractNum>' for k in sorted(lists))
    two = "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in sorted(lists))
    return f'<?xml version="1.0" encoding="UTF-8"?><w:numbering {_W}>{one}{two}</w:numbering>'


def package(blocks: pd.DataFrame, cells: pd.DataFrame | None = None, runs: pd.DataFrame | None = None) -> bytes:
    """The bytes of a document from its blocks, the cells of its tables (in order of the table blocks of a
    page) and the runs of its paragraphs; page breaks between pages."""
    by_table: dict[int, dict[int, list]] = {}
    for c in cells.itertuples(index=False) if cells is not None else ():
        by_table.setdefault(c.page, {}).setdefault(c.table_no, []).append(c)
    tables = {p: [t[k] for k in sorted(t)] for p, t in by_table.items()}
    by_block: dict[tuple[int, int], list] = {}
    for r in runs.sort_values(["page", "block_no", "run_no"], kind="stable").itertuples(index=False) if runs is not None else ():
        by_block.setdefault((r.page, r.block_no), []).append(r)
    parts, page, lists = [], None, {}
    for row in blocks.sort_values(["page", "block_no"], kind="stable").itertuples(index=False):
        if page is not None and row.page != page:
            parts += [_table(t) for t in tables.pop(page, [])] + ['<w:p><w:r><w:br w:type="page"/></w:r></w:p>']
        page = row.page
        if row.block_type == "table":
            mine = tables.get(page, [])
            parts.append(_table(mine.pop(0) if mine else []))
        elif row.block_type == "graphic":
            parts.append(f"<w:p>{_run(f'[graphic {row.page}.{row.block_no}]')}</w:p>")
        elif isinstance(row.text, str):
            if _given(row.list_id):
                lists.setdefault(int(row.list_id), row.list_marker or "")
            parts.append(_paragraph(row, by_block.get((row.page, row.block_no), [])))
    for p in sorted(tables):
        parts += [_table(t) for t in tables[p]]  # tables that no block announces
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document {_W}><w:body>' + "".join(parts) + "<w:sectPr/></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/_rels/document.xml.rels", _DOC_RELS), ("word/document.xml", xml), ("word/numbering.xml", _numbering(lists))):
            info = zipfile.ZipInfo(name, date_time=_EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, text.encode())
    return out.getvalue()


_BLOCK = ["page", "block_no", "block_type", "text", "kind", "level", "list_id", "list_marker", "alignment", "size", "bold"]
_CELL = ["page", "table_no", "row_no", "col_no", "row_span", "col_span", "text"]
_RUN = ["page", "block_no", "run_no", "text", "bold", "italic", "size", "direction"]


def packages(blocks: DataFrame, cells: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, content and its SHA-256: the parts of a document meet by its key."""
    row = lambda df, cols: df.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("rows"))  # noqa: E731  bounded by a document's pages
    joined = row(blocks, _BLOCK).withColumnRenamed("rows", "b").join(row(cells, _CELL).withColumnRenamed("rows", "c"), "doc_id", "left").join(row(runs, _RUN).withColumnRenamed("rows", "r"), "doc_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows, cols: pd.DataFrame([dict(x) for x in rows] if rows is not None else [], columns=cols)
        for pdf in batches:
            data = [package(frame(b, _BLOCK), frame(c, _CELL), frame(r, _RUN)) for b, c, r in zip(pdf["b"], pdf["c"], pdf["r"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": data, "sha256": [hashlib.sha256(x).hexdigest() for x in data]})

    return joined.mapInPandas(write, "doc_id bigint, content binary, sha256 string")
