"""Chunkers: a text column becomes an array of chunk texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = r"(?m)(?=^#{1,6}\s+.+$|^.+\n[=\-~]{3,}$)"
DEFINITION = r"(?m)(?=^(?:class|def)\s+\w+)"
MARKDOWN = [".md", ".markdown", ".rst", ".adoc", ".org"]
PYTHON = [".py", ".pyi", ".pyw"]


def once(value: Column, f) -> Column:
    """f(value), with the value made once: what stands inside a lambda is else made anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def spans(text: Column, size: int = 220, stride: int = 200) -> Column:
    """Overlapping windows of words; the last one ends with the text."""

    def made(words: Column) -> Column:
        n = F.size(words)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
        each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * stride + 1, size), " "))
        return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))

    return once(words_of(text), made)


def sections(text: Column, border: str, size: int = 220, stride: int = 200) -> Column:
    """Sections that begin at a border; long ones as spans."""
    parts = F.filter(F.transform(F.split(text, border), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.flatten(F.transform(parts, lambda s: F.when(F.size(words_of(s)) <= size, F.array(s)).otherwise(spans(s, size, stride))))


def chunks(text: Column, ext: Column, size: int = 220, stride: int = 200) -> Column:
    """array<struct<chunk_type, chunk, n>>, by the file's extension; blank texts have none. n: how many there are."""
    low = F.lower(ext)
    kind = F.when(low.isin(MARKDOWN) & text.rlike(HEADING), "markdown").when(low.isin(PYTHON) & text.rlike(DEFINITION), "python").otherwise("simple")
    made = F.when(kind == "markdown", sections(text, HEADING, size, stride)).when(kind == "python", sections(text, DEFINITION, size, stride)).otherwise(spans(text, size, stride))
    kept = F.struct(kind.alias("kind"), F.filter(made, lambda c: F.trim(c) != "").alias("parts"))
    return once(kept, lambda k: F.transform(k["parts"], lambda c: F.struct(k["kind"].alias("chunk_type"), c.alias("chunk"), F.size(k["parts"]).alias("n"))))


def explode_chunks(files: DataFrame, ext: Column, size: int = 220, stride: int = 200) -> DataFrame:
    """files (file_uid, file_path, text, ...) -> one row for each chunk, with chunk_id, ord, chunk_type, text, text_hash."""
    out = files.select("file_uid", "file_path", F.posexplode(chunks(F.col("text"), ext, size, stride)).alias("ord", "c"))
    chunk_id = F.when(F.col("c.n") > 1, F.concat_ws("::", "file_uid", "ord")).otherwise(F.col("file_uid"))
    return out.select(chunk_id.alias("chunk_id"), "file_uid", "file_path", "ord", "c.chunk_type", F.col("c.chunk").alias("text"), F.unhex(F.md5("c.chunk")).alias("text_hash"))
