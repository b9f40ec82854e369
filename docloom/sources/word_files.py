"""Documents from files: dispatch by suffix, DOCX bodies as text; a PDF decoder is supplied by the caller."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SUFFIXES = (".docx", ".pdf")
#: Parts of style names whose paragraphs are shown as bullets.
BULLET_STYLES = ("list bullet", "list paragraph", "daftar")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _attribute(node: ElementTree.Element | None, path: str) -> str | None:
    found = None if node is None else node.find("/".join(_W + p for p in path.split("/")))
    return None if found is None else found.get(f"{_W}val", "")


def _said(paragraph: ElementTree.Element) -> str:
    runs = (x for run in paragraph.iter(f"{_W}r") for x in run)
    return "".join(x.text or "" if x.tag == f"{_W}t" else _MARKS.get(x.tag, "") for x in runs).strip()


def _table_lines(node: ElementTree.Element) -> Iterator[str]:
    """Rows as non-empty cells joined by bars; a merged cell counts once in each place that it covers."""
    above: list[str] = []
    for row in node.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            at, merge = len(cells), _attribute(cell, "tcPr/vMerge")
            text = "\n".join(map(_said, cell.findall(f"{_W}p"))).strip()
            if merge is not None and merge != "restart" and at < len(above):
                text = above[at]
            cells += [text] * int(_attribute(cell, "tcPr/gridSpan") or 1)
        above = cells
        if any(cells):
            yield " | ".join(filter(None, cells))


def docx_text(content: bytes) -> str:
    """A DOCX body in order, one line per paragraph or table row; empty ones are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style") if "word/styles.xml" in z.namelist() else ()
        names = {s.get(f"{_W}styleId"): (_attribute(s, "name") or "").lower() for s in styles}
    lines: list[str] = []
    for node in () if body is None else body:
        if node.tag == f"{_W}tbl":
            lines += _table_lines(node)
        elif node.tag == f"{_W}p" and (text := _said(node)):
            style = names.get(_attribute(node, "pPr/pStyle"), "")
            lines.append(f"• {text}" if any(b in style for b in BULLET_STYLES) else text)
    return "\n".join(lines)


def read_files(spark: SparkSession, path: str, *, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, suffix, text and error of each file. A file that can't be read has a null text and says why; it stops nothing.

    Each file is decoded by itself on an executor. Files are read one per row, so one file must fit a worker.
    Spark's file scan skips files of no bytes, so these give no row.
    """
    decoders = {".docx": docx_text, ".pdf": pdf_text}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                suffix, text, error = posixpath.splitext(name)[1].lower(), None, None
                decode = decoders.get(suffix)
                if suffix not in SUFFIXES:
                    error = f"unsupported suffix {suffix!r}; one of {', '.join(SUFFIXES)}"
                elif decode is None:
                    error = f"no decoder given for {suffix}"
                else:
                    try:
                        text = decode(bytes(content))
                    except Exception as e:  # a broken file of any kind is reported, not fatal
                        error = f"{type(e).__name__}: {e}"
                out.append((name, suffix, text, error))
            yield pd.DataFrame(out, columns=["path", "suffix", "text", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, suffix string, text string, error string")
