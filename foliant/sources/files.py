"""Files: listing, type by content, text of office documents."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliant.schemas import EXTENSION_ALIASES, MIME_TYPES

BINARY = "path string, modificationTime timestamp, length long, content binary"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ODT = "application/vnd.oasis.opendocument.text"
# First bytes of file types, in hexadecimal.
MAGIC = {"25504446": "application/pdf", "FFD8FF": "image/jpeg", "89504E47": "image/png", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "504B0304": "application/zip"}


def _container(content: Column) -> Column:
    @pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        def kind(b: bytes) -> str:
            try:
                names = set(zipfile.ZipFile(io.BytesIO(b)).namelist())
            except zipfile.BadZipFile:
                return "application/octet-stream"
            return DOCX if "word/document.xml" in names else ODT if "content.xml" in names else "application/zip"

        return content.map(kind, na_action="ignore")

    return run(content)


def sniff(content: Column) -> Column:
    """The type that the first bytes show; zip containers are looked into."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit("application/octet-stream")
    for magic, mime in MAGIC.items():
        kind = F.when(head.startswith(magic), mime if mime != "application/zip" else _container(content)).otherwise(kind)
    return kind


def extension_of(mime: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(m[mime], F.lit(".pdf"))


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = {e: m for m, e in MIME_TYPES.items()} | {a: {e: m for m, e in MIME_TYPES.items()}[e] for a, e in EXTENSION_ALIASES.items()}
    m = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(m[ext], F.lit("application/octet-stream"))


def inbox(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """Files of one folder, oldest first (by modification: creation time is not to be had), with type, md5 and sha512; only supported types."""
    df = spark.read.format("binaryFile").load(path)
    return hashed(df).orderBy("modificationTime", "path").limit(most) if most > 0 else hashed(df)


def single(spark: SparkSession, path: str) -> DataFrame:
    """One file, with its type and hashes; a type that is not supported is an error."""
    df = hashed(spark.read.format("binaryFile").load(path), supported=False)
    if (mime := df.first().mime) not in MIME_TYPES:
        raise ValueError(f"{path}: {mime} is not supported")
    return df


def hashed(df: DataFrame, supported: bool = True) -> DataFrame:
    df = df.withColumn("mime", sniff(F.col("content")))
    df = df.filter(F.col("mime").isin(*MIME_TYPES)) if supported else df
    return df.select("path", "modificationTime", "length", "mime", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"), "content")


def originals(stored: DataFrame, root: str) -> DataFrame:
    """Stored files with the part of the storage they lie in (originals, processed, errors or other)."""
    part = F.regexp_extract(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root.rstrip("/")) + "/([^/]+)/", 1)
    return stored.withColumn("part", F.when(part.isin("originals", "processed", "errors"), part).otherwise("other"))


def stored(spark: SparkSession, root: str, settled_seconds: int, now: Column) -> DataFrame:
    """Files under a storage root that were not written to for some time, without their content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.filter(F.col("modificationTime") < now - F.make_dt_interval(secs=F.lit(settled_seconds))).select("path", "modificationTime", "length")


def zipped(files: DataFrame, group: str, name: str = "name", content: str = "content") -> DataFrame:
    """group, archive: the files of each group (a request's documents) as one zip; names that repeat get a number."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out, taken = io.BytesIO(), set()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(b["name"], b["content"]), key=lambda x: x[0]):
                stem, dot, ext = n.rpartition(".")
                unique, k = n, 2
                while unique in taken:
                    unique, k = f"{stem or ext} ({k}){dot}{ext if stem else ''}", k + 1
                taken.add(unique)
                z.writestr(unique, bytes(c))
        return pd.DataFrame({"group": [b["group"].iloc[0]], "archive": [out.getvalue()]})

    gt = dict(files.dtypes)[group]
    rows = files.select(F.col(group).alias("group"), F.col(name).alias("name"), F.col(content).alias("content")).filter("name is not null and content is not null")
    return rows.groupBy("group").applyInPandas(run, f"group {gt}, archive binary").withColumnRenamed("group", group)


def _paragraphs(xml: bytes, heads: set[str], texts: set[str] | None) -> str:
    lines: list[str] = []
    for p in ElementTree.fromstring(xml).iter():
        if p.tag.rsplit("}", 1)[-1] in heads:
            lines.append("".join((t.text or "") for t in p.iter() if t.tag.rsplit("}", 1)[-1] in texts) if texts else "".join(p.itertext()))
    return "\n".join(lines).strip()


def office_text(content: bytes) -> str | None:
    """The paragraphs of a DOCX or ODT file, one a line; None for anything else or a broken file."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = set(z.namelist())
        if "word/document.xml" in names:
            return _paragraphs(z.read("word/document.xml"), {"p"}, {"t"})
        return _paragraphs(z.read("content.xml"), {"p", "h"}, None) if "content.xml" in names else None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return None


_STREAM = re.compile(rb"<<(?P<dict>[^<>]*(?:<<[^<>]*>>[^<>]*)*)>>\s*stream\r?\n(?P<data>.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?P<s>(?:[^()\\]|\\.)*)\)|<(?P<h>[0-9A-Fa-f\s]*)>|(?P<op>T\*|T[dDmJj]|'|\"|ET)|(?P<n>-?\d+\.?\d*)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _streams(content: bytes) -> list[bytes]:
    """The streams of a PDF, inflated where they are deflated; others and broken ones are left out."""
    out = []
    for m in _STREAM.finditer(content):
        data = m["data"]
        if b"/FlateDecode" in m["dict"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in m["dict"]:
            continue
        out.append(data)
    return out


def pdf_text(content: bytes) -> str | None:
    """The text that a PDF's page streams show, line by line, for fonts in a one-byte Latin encoding; None if there is none (scans, other encodings)."""
    if not content.startswith(b"%PDF"):
        return None
    lines: list[str] = []
    for data in _streams(content):
        if b"BT" not in data or not re.search(rb"T[jJ]", data):
            continue
        now = ""
        for m in _SHOWN.finditer(data):
            if m["s"] is not None:
                raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1].isdigit() else _ESCAPES.get(x[1], x[1]), m["s"], flags=re.S)
                now += raw.decode("cp1252", "replace")
            elif m["h"]:
                digits = re.sub(rb"\s", b"", m["h"])
                now += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
            elif m["op"] in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"', b"ET"):
                if now.strip():
                    lines.append(now.strip())
                now = ""
            elif m["n"] and float(m["n"]) < -200 and now and not now.endswith(" "):
                now += " "  # a wide gap inside an array of strings
    text = "\n".join(lines).replace("\0", "")
    return text or None


def page_count(content: bytes) -> int | None:
    """The pages of a PDF, counted in its objects, or 1 for an image; None for anything else."""
    if content[:3] == b"\xff\xd8\xff" or content[:4] == b"\x89PNG":
        return 1
    if not content.startswith(b"%PDF"):
        return None
    whole = b"\n".join([content, *_streams(content)])
    return len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", whole)) or None


#: Extractors by type; others (scans, other PDF engines) can be set by the caller: a function from bytes to text or None.
EXTRACTORS = {DOCX: office_text, ODT: office_text, "application/pdf": pdf_text}


def extract(df: DataFrame, extractors: dict | None = None) -> DataFrame:
    """df (mime, content) with text: of the extractor for the type, null where there is none (which `unread` tells from a file without text)."""
    ex = EXTRACTORS | (extractors or {})

    @pandas_udf("string")
    def run(mime: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([ex[m](bytes(c)) if m in ex and c is not None else None for m, c in zip(mime, content)], dtype=object)

    return df.withColumn("text", run("mime", "content"))


def unread(df: DataFrame, extractors: dict | None = None) -> DataFrame:
    """The files (mime) for whose type there is no extractor."""
    return df.filter(~F.coalesce(F.col("mime").isin(*EXTRACTORS, *(extractors or {})), F.lit(False)))


def with_pages(df: DataFrame) -> DataFrame:
    """df (content) with the number of pages."""

    @pandas_udf("int")
    def run(content: pd.Series) -> pd.Series:
        return pd.Series([page_count(bytes(c)) if c is not None else None for c in content], dtype="Int32")

    return df.withColumn("page_count", run("content"))
