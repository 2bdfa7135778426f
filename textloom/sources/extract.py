"""Text of file contents by format. Text formats are expressions; binary ones one Arrow-batched function."""

from __future__ import annotations

import csv
import email
import html
import html.entities
import io
import re
import zipfile
from email import policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .files import extension_of


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _ended(ref: re.Match) -> str:
    known = ref[0][1] == "#" or ref[0][1:] in html.entities.html5
    return html.unescape(ref[0]) if known else ref[0]


@F.pandas_udf(StringType())
def _decoded_ended(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _ENDED.sub(_ended, t))


def unescape(text: Column, unended: bool = True) -> Column:
    """All character references decoded, named and numeric; texts without any don't leave the JVM's expression.
    Those without their semicolon (a text cut off inside one) are decoded as browsers do, or left as they are."""
    has = text.rlike(r"&(?:#[0-9xX]|[A-Za-z])")
    return F.when(has, (_decoded if unended else _decoded_ended)(F.when(has, text))).otherwise(text)


def plain(content: Column) -> Column:
    """UTF-8, or else ISO 8859-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def html_text(page: Column, unended: bool = True) -> Column:
    """Text nodes, one a line, without scripts, styles and comments; character references decoded (see unescape)."""
    d = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    d = F.regexp_replace(d, r"(?s)</?[A-Za-z!?][^>]*>", "\n")
    lines = F.transform(F.split(unescape(d, unended), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


_PLAIN = r"^(?:STRING|BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _shown(v: Column) -> Column:
    """A JSON value as text; null for objects, arrays and null. Kinds are told by type, not by looks."""
    kind = F.schema_of_variant(v)
    word = F.when(kind == "BOOLEAN", F.initcap(v.cast("string"))).when(kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), v.cast("double").cast("string")).otherwise(v.cast("string"))
    return F.when(kind.rlike(_PLAIN), word)


def json_values(text: Column) -> Column:
    """Top-level strings, numbers and booleans of an object or array, in their order, joined by spaces; nested
    values and nulls are left out. A lone value is itself; what is no JSON is null."""
    whole = F.try_parse_json(text)
    first = F.left(F.ltrim(text), F.lit(1))
    values = F.when(first == "{", F.map_values(F.from_json(text, "map<string,variant>"))).when(first == "[", F.from_json(text, "array<variant>"))
    joined = F.array_join(F.filter(F.transform(values, _shown), lambda v: v.isNotNull()), " ")
    return F.when(whole.isNotNull(), F.when(first.isin("{", "["), joined).otherwise(F.coalesce(_shown(whole), F.lit("None"))))


def jsonl_text(text: Column) -> Column:
    """The `text` of each line's object, or else its values; bad lines are skipped."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    out = F.transform(lines, lambda x: F.coalesce(F.get_json_object(x, "$.text"), json_values(x)))
    return F.array_join(F.filter(out, lambda x: x.isNotNull() & (x != "")), "\n")


def csv_text(text: Column, delimiter: str = ",", rows: int = 100) -> Column:
    """Cells of the first rows, joined by spaces; for texts without quotes an expression, else parsed."""
    first = F.slice(F.split(text, r"\r?\n"), 1, rows)
    simple = F.array_join(F.flatten(F.transform(first, lambda x: F.split(x, re.escape(delimiter)))), " ")
    return F.when(F.contains(text, F.lit('"')), _csv(text, F.lit(delimiter), F.lit(rows))).otherwise(F.trim(simple))


@F.pandas_udf(StringType())
def _csv(text: pd.Series, delimiter: pd.Series, rows: pd.Series) -> pd.Series:
    def one(t, d, n):
        return None if t is None else " ".join(c for r, _ in zip(csv.reader(io.StringIO(t), delimiter=d), range(int(n)), strict=False) for c in r).strip()

    return pd.Series([one(*x) for x in zip(text, delimiter, rows, strict=True)])


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style", "noscript")))

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def strict_html(page: str) -> str:
    p = _Text()
    p.feed(page)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(p.out))


def mail_text(raw: bytes) -> str:
    """Subject, then the plain part, or else the text of the HTML part."""
    m = email.message_from_bytes(raw, policy=policy.default)
    body = m.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = strict_html(text)
    return "\n".join(x for x in (f"Subject: {m['subject']}" if m["subject"] else "", text.strip()) if x)


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _runs(e, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == tag)


def _table(rows, cell: str) -> list[str]:
    return [line for r in rows if (line := " | ".join(t for c in r.iter() if _tag(c) == cell and (t := _runs(c).strip())))]


def docx_text(raw: bytes) -> str:
    """Paragraphs, then table rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    inside = {id(p) for t in body.iter() if _tag(t) == "tbl" for p in t.iter() if _tag(p) == "p"}
    out = [t for p in body.iter() if _tag(p) == "p" and id(p) not in inside and (t := _runs(p).strip())]
    return "\n".join(out + _table((r for r in body.iter() if _tag(r) == "tr"), "tc"))


def pptx_text(raw: bytes) -> str:
    """Paragraphs, tables and notes, slide by slide."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        number = lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0])
        out = []
        for kind in ("slides/slide", "notesSlides/notesSlide"):
            for name in sorted((n for n in z.namelist() if re.fullmatch(rf"ppt/{kind}\d+\.xml", n)), key=number):
                out += [(number(name), t) for p in ElementTree.fromstring(z.read(name)).iter() if _tag(p) == "p" and (t := _runs(p).strip())]
    return "\n".join(t for _, t in sorted(out, key=lambda x: x[0]))


def xlsx_text(raw: bytes) -> str:
    """Each sheet's name in brackets and its rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [_runs(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
        out = []
        for k, name in enumerate(names, 1):
            out.append(f"[{name}]")
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter():
                if _tag(row) != "row":
                    continue
                cells = []
                for c in row:
                    v = next((x.text for x in c if _tag(x) == "v"), None)
                    cells.append(shared[int(v)] if c.get("t") == "s" and v is not None else _runs(c) if c.get("t") == "inlineStr" else v or "")
                if any(cells):
                    out.append(" | ".join(x for x in cells if x))
    return "\n".join(out)


def pdf_text(raw: bytes) -> str:
    try:
        from pdfminer.high_level import extract_text
    except ImportError:
        return ""
    return extract_text(io.BytesIO(raw))


_BINARY = {".eml": mail_text, ".docx": docx_text, ".pptx": pptx_text, ".xlsx": xlsx_text, ".pdf": pdf_text}


@F.pandas_udf(StringType())
def _binary(content: pd.Series, ext: pd.Series) -> pd.Series:
    def one(c, e):
        try:
            return _BINARY[e](bytes(c))
        except Exception:  # a broken file has no text
            return ""

    return pd.Series([one(*x) for x in zip(content, ext, strict=True)])


def extract_text(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with `text`, by extension; files of unknown kinds are plain text."""
    ext, text = F.lower(extension_of(F.col("path"))), plain(F.col("content"))
    out = (
        F.when(ext.isin(*_BINARY), _binary(F.col("content"), ext)).when(ext.isin(".html", ".htm"), html_text(text)).when(ext == ".json", F.coalesce(json_values(text), text))
        .when(ext.isin(".jsonl", ".ndjson"), jsonl_text(text)).when(ext == ".csv", csv_text(text)).when(ext == ".tsv", csv_text(text, "\t")).otherwise(text)
    )
    return files.withColumn("text", out).drop("content")

