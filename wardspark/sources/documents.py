"""Text of binary documents: plain text, PDF, DOCX and legacy DOC, read with Spark's binaryFile source."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS, MOST_BYTES = 80_000, 8 << 20
#: The parts of a DOCX file that hold text, in order of reading.
PARTS = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "word/header1.xml", "word/header2.xml", "word/footer1.xml", "word/footer2.xml")


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _docx(content: bytes, parts: tuple = PARTS) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        xml = "\n".join(z.read(p).decode("utf-8", "replace") for p in parts if p in names)
    xml = re.sub(r"</w:(?:p|tr)>", "\n", xml)
    xml = re.sub(r"<w:tab\s*/>|</w:tc>", "\t", xml)
    text = re.sub(r"<[^>]+>", "", xml)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(entity, char)
    return text


def _docx_body(content: bytes) -> str:
    """Only the body, lines trimmed and without blank ones."""
    lines = (line.strip() for line in _docx(content, PARTS[:1]).split("\n"))
    return "\n".join(line for line in lines if line)


# What a backslash makes of a letter in a PDF string.
PDF_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "(": "(", ")": ")", "\\": "\\"}


def _pdf_literal(value: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1], 8) & 0xFFFF) if m[1] else PDF_ESCAPES.get(m[2], "")

    return re.sub(r"\\(?:([0-7]{1,3})|([\s\S]?))", one, value)


def _pdf_hex(value: str) -> str:
    digits = re.sub(r"\s+", "", value)
    if len(digits) < 4 or len(digits) % 2:
        return ""
    raw = bytes.fromhex(digits)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace")


def _readable(value: str) -> bool:
    bare = value.strip()
    return len(bare) >= 2 and len(re.findall(r"[a-zA-Z0-9.,;:!?@/#$%&()\[\]\s-]", bare)) / len(bare) > 0.65


def _pdf_strings(page: str) -> str:
    """The readable strings of the text blocks of a page, or of all of it if it has none."""

    def strings(part: str) -> list[str]:
        found = [_pdf_literal(m[1:-1]) for m in re.findall(r"\((?:\\.|[^\\)])*\)", part)]
        return [x for x in found + [_pdf_hex(m) for m in re.findall(r"<([0-9a-fA-F\s]{4,})>", part)] if _readable(x)]

    blocks = [x for block in re.findall(r"BT([\s\S]*?)ET", page) for x in strings(block)]
    return " ".join(blocks or strings(page))


def _pdf(content: bytes) -> str:
    """Text of the streams, or of the raw file if that has more. Images are left out; what can't be inflated, too."""
    pages, at = [], 0
    while (start := content.find(b"stream", at)) >= 0 and (stop := content.find(b"endstream", start)) >= 0:
        at = stop + len(b"endstream")
        opens, closes = content.rfind(b"<<", 0, start), content.rfind(b">>", 0, start)
        about = content[opens : closes + 2] if 0 <= opens < closes else b""
        data = re.sub(rb"^(?:\r\n|\r|\n)", b"", content[start + len(b"stream") : stop]).rstrip(b"\r\n")
        if re.search(rb"/FlateDecode\b", about):
            for window in (15, -15):
                try:
                    pages.append(_pdf_strings(zlib.decompressobj(window).decompress(data).decode("latin-1")))
                    break
                except zlib.error:
                    continue
        elif not re.search(rb"/(?:DCT|JPX|CCITTFax)Decode\b", about):
            pages.append(_pdf_strings(data.decode("latin-1")))
    streams, raw = "\n".join(pages), _pdf_strings(content.decode("latin-1"))
    return streams if len(streams) > len(raw) else raw


#: What stands for itself after a backslash, or for a control character.
_ESCAPES = {"n": "\n", "r": "\n", "t": "\t", "b": "\b", "f": "\f"}


def _nested_literal(source: str, start: int) -> tuple[str, int] | None:
    """The string that opens at ``start`` and the place after it; parentheses in it nest. None if it never closes."""
    out, depth, at = [], 1, start + 1
    while at < len(source):
        c = source[at]
        if c == "\\":
            if octal := re.compile(r"[0-7]{1,3}").match(source, at + 1):
                out.append(chr(int(octal[0], 8)))
                at = octal.end()
            else:
                out.append(_ESCAPES.get(source[at + 1 : at + 2], source[at + 1 : at + 2]))
                at += 2
            continue
        depth += (c == "(") - (c == ")")
        if not depth:
            return "".join(out), at + 1
        out.append(c)
        at += 1
    return None


def _hex_text(digits: str) -> str:
    """The text of hexadecimal digits: UTF-16 if it is marked so or a quarter of all bytes are zeros at even places, else UTF-8."""
    bare = re.sub(r"\s+", "", digits)
    if not bare or len(bare) % 2 or not re.fullmatch(r"[0-9a-fA-F]+", bare):
        return ""
    raw = bytes.fromhex(bare)
    marked = raw[:2] == b"\xfe\xff"
    if marked or (len(raw) >= 4 and raw[::2].count(0) >= len(raw) / 4):
        raw = raw[2 * marked :]
        return raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace")
    return raw.decode("latin-1")


def _browser_strings(content: str) -> str:
    """A line for each text block, or for the whole without any: its strings in order, one space between."""
    lines = []
    for block in re.findall(r"BT(.+?)ET", content, re.DOTALL) or [content]:
        found, at = [], 0
        while opened := re.compile(r"\(|<(?!<)").search(block, at):
            at = opened.start() + 1
            if opened[0] == "(":
                if literal := _nested_literal(block, opened.start()):
                    found.append(literal[0])
                    at = literal[1]
            elif (end := block.find(">", at)) >= 0:
                found.append(_hex_text(block[at:end]))
                at = end + 1
        if some := [x for x in map(lines_normalised, found) if x]:
            lines.append(" ".join(some))
    return lines_normalised("\n".join(lines))


def _pdf_browser(content: bytes) -> str:
    """Text of all streams and then of the raw file, a blank line between; streams that can't be inflated are left out."""
    text, at, blocks = content.decode("latin-1"), 0, []
    begins = re.compile(r"<<((?:(?!<<).)*?)>>\s*stream\r?\n?", re.DOTALL)
    while (found := begins.search(text, at)) and (end := text.find("endstream", found.end())) >= 0:
        at, data = end + len("endstream"), content[found.end() : end].rstrip(b"\r\n")
        for window in (15, -15) if "FlateDecode" in found[1] else ():
            try:
                data = zlib.decompressobj(window).decompress(data)
                break
            except zlib.error:
                continue
        else:
            if "FlateDecode" in found[1]:
                continue
        blocks.append(_browser_strings(data.decode("latin-1")))
    return "\n\n".join(x for x in [*blocks, _browser_strings(text)] if x)


def lines_normalised(text: str) -> str:
    """No null characters, no space around line ends, single spaces, at most one blank line."""
    text = text.replace("\0", "").replace("\r", "\n")
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n[ \t]+", "\n", text)
    text = re.sub(r"[ \t]{2,}", " ", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _doc(content: bytes) -> str:
    def runs(text: str) -> str:
        found = re.findall(r"[\t\n\r -~\xa0-￿]{18,}", text)
        return "\n".join(r for r in found if len(re.findall(r"[A-Za-z]", r)) >= 4)

    return max(runs(content.decode("latin-1")), runs(content.decode("utf-16-le", "ignore")), key=len)


def document_text(files: DataFrame, most_chars: int = MOST_CHARS, most_bytes: int = MOST_BYTES, body_only: bool = False, browser: bool = False) -> DataFrame:
    """(path, kind, text, problem) of a binaryFile table; text is at most ``most_chars`` characters.

    Files that can't be read have a null text and say why; larger ones than ``most_bytes`` are not opened. A PDF with
    fewer than 120 characters has its text and the problem 'little_text', as it may be scanned. With ``body_only``
    DOCX files give the lines of their body that are not blank. With ``browser`` PDF files are read as a browser does that
    has no inflater of its own for odd files: nested strings, UTF-16 by its zeros, streams and raw text both.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(extension.isin("docx", "doc", "pdf"), extension).when(extension.isin("txt", "md", "csv", "json", "html"), "text").otherwise("unsupported")
    readers = {"docx": _docx_body if body_only else _docx, "doc": _doc, "pdf": _pdf_browser if browser else _pdf, "text": lambda b: b.decode("utf-8", "replace")}

    @F.pandas_udf("text string, problem string")
    def extract(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for c, k in zip(content, kind, strict=True):
            try:
                text = normalised(readers[k](bytes(c)))[:most_chars]
                out.append((text, "little_text" if k == "pdf" and len(text) < 120 else None))
            except KeyError:
                out.append((None, "unsupported"))
            except (zipfile.BadZipFile, ValueError) as e:
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["text", "problem"])

    sized = files.select("path", kind.alias("kind"), F.when(F.col("length") <= most_bytes, F.col("content")).otherwise(F.lit(b"")).alias("content"), "length")
    read = sized.select("path", "kind", "length", extract("content", "kind").alias("x"))
    return read.select(
        "path", "kind", F.when(F.col("length") <= most_bytes, F.col("x.text")).alias("text"),
        F.when(F.col("length") > most_bytes, "too_large").otherwise(F.col("x.problem")).alias("problem"),
    )


def normalised(text: str) -> str:
    """No null characters, no space at line ends, single spaces, at most one blank line."""
    text = text.replace("\0", "").replace("\r\n", "\n")
    text = re.sub(r"[ \t]+\n", "\n", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return re.sub(r"[ \t]{2,}", " ", text).strip()
