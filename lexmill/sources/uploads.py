"""Uploaded files into text: plain text, Markdown and word-processor documents."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MAX_FILE_BYTES, MAX_PDF_PAGES

# Namespaces and parts of the document format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELATIONSHIPS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BODY, STYLES, BODY_RELATIONS = "word/document.xml", "word/styles.xml", "word/_rels/document.xml.rels"
TEXT_SUFFIXES = ("md", "txt")


#: Bytes that a part of a document may have when it is unpacked.
MAX_PART_BYTES = 256 * 1024 * 1024


class UnsupportedFile(ValueError):
    """A kind of file that can't be read here."""


class _Docx:
    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.files.namelist())
        self.body = self._xml(BODY).find(f"{W}body")
        if self.body is None:
            raise ValueError("the document has no body")
        styles = self._xml(STYLES) if STYLES in names else None
        self.raised: dict[str, bool] = {}
        bases: dict[str, str | None] = {}
        for style in [] if styles is None else styles.iter(f"{W}style"):
            key = style.get(f"{W}styleId")
            align = style.find(f"{W}rPr/{W}vertAlign")
            base = style.find(f"{W}basedOn")
            bases[key] = None if base is None else base.get(f"{W}val")
            if align is not None:
                self.raised[key] = align.get(f"{W}val") == "superscript"
        for key in bases:
            at, seen = key, set()
            while at is not None and at not in self.raised and at not in seen:
                seen.add(at)
                at = bases.get(at)
            self.raised.setdefault(key, self.raised.get(at, False))
        relations = self._xml(BODY_RELATIONS) if BODY_RELATIONS in names else []
        self.targets = {x.get("Id"): x.get("Target", "") for x in relations}

    def _xml(self, name: str) -> ElementTree.Element:
        with self.files.open(name) as part:  # what it says of its size may be wrong
            content = part.read(MAX_PART_BYTES + 1)
        if len(content) > MAX_PART_BYTES:
            raise ValueError(f"{name} has over {MAX_PART_BYTES} bytes")
        return ElementTree.fromstring(content)

    @staticmethod
    def _run(run: ElementTree.Element) -> str:
        marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
        return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in run)

    def _superscript(self, run: ElementTree.Element) -> bool:
        own = run.find(f"{W}rPr/{W}vertAlign")
        style = run.find(f"{W}rPr/{W}rStyle")
        return own is not None and own.get(f"{W}val") == "superscript" or style is not None and self.raised.get(style.get(f"{W}val"), False)

    def paragraph(self, node: ElementTree.Element) -> str:
        """Runs and links in order; a raised number right after a digit is the part after a dot."""
        out = ""
        for x in node:
            if x.tag == f"{W}hyperlink":
                out += "".join(t.text or "" for t in x.iter(f"{W}t"))
            elif x.tag == f"{W}r":
                text = self._run(x)
                out += "." * (out[-1:].isdigit() and text[:1].isdigit() and self._superscript(x)) + text
        return out

    def blocks(self) -> Iterator[str]:
        for node in self.body:
            if node.tag == f"{W}p":
                yield self.paragraph(node)
            elif node.tag == f"{W}tbl":
                cells = (cell for row in node.iter(f"{W}tr") for cell in row.iter(f"{W}tc"))
                yield "\n".join(filter(None, (self.paragraph(p) for cell in cells for p in cell.findall(f"{W}p"))))
            elif node.tag == f"{W}sectPr":
                references = [x for kind in ("headerReference", "footerReference") for x in node.iter(f"{W}{kind}")]
                parts = [self._xml("word/" + self.targets[x.get(f"{R}id")].removeprefix("/word/")) for x in references]
                lines = ("".join(t.text or "" for t in p.iter(f"{W}t")) for part in parts for p in part.iter(f"{W}p"))
                yield "\n".join(filter(None, lines))


def docx_text(content: bytes) -> str:
    """Paragraphs, tables (a line per cell paragraph), headers and footers, in the body's order."""
    return "\n".join(filter(None, _Docx(content).blocks()))


def file_text(name: str, content: bytes) -> str:
    """The text of one file by its suffix; ValueError where it is too large, unreadable or unsupported."""
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"file is larger than {MAX_FILE_BYTES} bytes")
    suffix = name.lower().rpartition(".")[2]
    if suffix in TEXT_SUFFIXES:
        return content.decode("utf-8")
    if suffix == "docx":
        try:
            return docx_text(content)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError, ValueError, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
            raise ValueError(f"not a readable document: {e}") from e  # damaged, encrypted or of another form
    if suffix == "pdf":
        return pdf_text(content)
    raise UnsupportedFile(f"unsupported file type: {suffix}")


def pdf_text(content: bytes) -> str:
    """Page texts, if a PDF library is installed."""
    try:
        import pdfplumber
    except ImportError as e:
        raise UnsupportedFile("reading pdf needs pdfplumber, which is not installed") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        if len(pdf.pages) > MAX_PDF_PAGES:
            raise ValueError(f"more than {MAX_PDF_PAGES} pages")
        return "\n".join(page.extract_text() or "" for page in pdf.pages)


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of the files at a path: (path, text) and (path, reason)."""
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) rows into texts and rejects; too large files are refused before their content is read."""
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    large = files.where(size > MAX_FILE_BYTES).select("path", F.lit("too large").alias("reason"))

    def run(batches):
        for rows in batches:
            out = {"path": [], "text": [], "reason": []}
            for path, content in zip(rows["path"], rows["content"]):
                text = reason = None
                try:
                    text = file_text(path, bytes(content))
                except ValueError as e:
                    reason = str(e)
                for k, v in (("path", path), ("text", text), ("reason", reason)):
                    out[k].append(v)
            yield pd.DataFrame(out)

    read = files.where(size <= MAX_FILE_BYTES).select("path", "content").mapInPandas(run, "path string, text string, reason string")
    return read.where("reason is null").select("path", "text"), read.where("reason is not null").select("path", "reason").unionByName(large)
