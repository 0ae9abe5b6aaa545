"""Raw files as a DataFrame, their types, and what PDF and DOCX bytes hold."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.config import MB, Config
from tamis.functions.text import matches
from tamis.operators.bytescan import PART
from tamis.operators.detectors import let

MAX_PART = 10 * MB


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def extension_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".pdf"), "pdf").when(F.lower(path).rlike(r"\.doc[xm]$"), "docx").otherwise("unknown")


def magic_type(content: Column) -> Column:
    return F.when(F.startswith(content, F.expr("x'25504446'")), "pdf").when(F.startswith(content, F.expr("x'504B0304'")), "docx").otherwise("unknown")


def resolved_type(by_name: Column, by_magic: Column) -> Column:
    """What the bytes say wins where they say anything."""
    return F.when(by_magic != "unknown", by_magic).otherwise(by_name)


def is_rejected(length: Column, cfg: Config) -> Column:
    """More than twice the size limit: not even hashed."""
    return length > 2 * cfg.limits.max_mb * MB


def identified(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds file_type, sha256 and rejected."""
    kind = resolved_type(extension_type(F.col("path")), magic_type(F.col("content")))
    return files.withColumns({"file_type": kind, "sha256": F.sha2("content", 256), "rejected": is_rejected(F.col("length"), cfg)})


# ---- PDF: literal strings, information fields and comments of the first bytes -----------------------------------

BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
PDF_FIELDS = ["Title", "Author", "Subject", "Creator", "Producer", "Keywords"]


def _unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")")), F.lit("\\\\"), F.lit("\\"))


def utf8(raw: Column) -> Column:
    """Bytes that stand as characters of the same numbers, read as UTF-8; malformed ones are dropped. A replacement character that
    the bytes hold themselves stays."""
    marked = F.replace(raw, F.lit("\u00ef\u00bf\u00bd"), F.lit("\u00ef\u00a3\u00be"))  # U+FFFD as U+F8FE for the time being
    valid = F.make_valid_utf8(F.encode(marked, "ISO-8859-1").cast("string"))
    return F.when(raw.rlike(r"[\x80-\xFF]"), F.translate(valid, "\uf8fe\ufffd", "\ufffd")).otherwise(raw)


def pdf_columns(raw: Column) -> dict[str, Column]:
    """metadata, text, comments, hex_blobs, embedded_files of the first bytes as characters of the same numbers."""
    field = lambda f: _unescaped(utf8(F.nullif(F.regexp_extract(raw, rf"/{f}\s*\(((?:[^)\\]++|\\.)*+)\)", 1), F.lit(""))))
    pair = lambda f: let(field(f), lambda v: F.when(v.isNotNull(), F.struct(F.lit(f.lower()).alias("key"), v.alias("value"))))
    info = F.array_compact(F.array(*[pair(f) for f in PDF_FIELDS]))
    tags = F.when(F.contains(raw, F.lit("<x:xmpmeta")), matches(raw, r"<dc:[a-zA-Z]++>[^<]++</dc:")).otherwise(F.array().cast("array<string>"))
    xmp = F.transform(tags, lambda t: F.struct(F.lower(F.regexp_extract(t, r"<dc:(\w+)>", 1)).alias("key"), utf8(F.regexp_extract(t, r">([^<]*+)<", 1)).alias("value")))
    # the last value of a key counts
    metadata = let(F.concat(info, xmp), lambda every: F.map_from_entries(F.filter(every, lambda e, k: ~F.exists(F.slice(every, k + 2, F.size(every)), lambda o: o["key"] == e["key"]))))
    strings = F.transform(matches(raw, r"\((?:[^)\\]++|\\.)*+\)"), lambda s: _unescaped(utf8(F.substring(s, F.lit(2), F.length(s) - 2))))
    text = let(F.map_values(metadata), lambda values: F.array_join(F.filter(strings, lambda s: ~F.coalesce(F.array_contains(values, s), F.lit(False))), " "))
    lines = F.transform(matches(raw, r"%[^\r\n]*"), lambda c: F.trim(utf8(F.substring(c, F.lit(2), F.length(c))), F.lit(BLANKS)))
    comments = F.filter(lines, lambda c: (F.length(c) >= 3) & ~c.startswith("PDF-") & (c != "EOF"))
    blobs = F.filter(F.transform(matches(raw, r"<[0-9A-Fa-f \t\n\r]{100,}>"), lambda h: F.regexp_replace(h, r"[<>\s]", "")), lambda h: F.length(h) > 256)
    names = F.when(F.contains(raw, F.lit("/EmbeddedFiles")) | F.contains(raw, F.lit("/Ef")), F.transform(matches(raw, r"/F \([^)]++\)"), lambda m: utf8(F.regexp_extract(m, r"\(([^)]*+)\)", 1)))).otherwise(F.array().cast("array<string>"))
    return {"metadata": metadata, "text": text, "comments": comments, "hex_blobs": blobs, "embedded_files": names}


# ---- DOCX: parts and text of a zip, one file at a time ----------------------------------------------------------

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCX = f"struct<ok:boolean,parts:array<{PART}>,xml:string,text:string,hidden:array<string>,comments:array<string>,metadata:map<string,string>,relations:array<struct<id:string,type:string,target:string>>,hex_blobs:array<string>>"
# The core properties and their names.
CORE = {"title": "title", "subject": "subject", "creator": "creator", "description": "description", "lastModifiedBy": "lastModifiedBy", "category": "category", "contentStatus": "contentStatus"}


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A part's tree; None for missing, oversized or broken parts and for any with a document type."""
    try:
        if z.getinfo(name).file_size > MAX_PART:
            return None
        data = z.read(name)
        return None if b"<!DOCTYPE" in data or b"<!ENTITY" in data else ElementTree.fromstring(data)
    except Exception:
        return None


def read_docx(content: bytes) -> dict:
    """Never fails: ok is False for what is no zip."""
    out: dict = {"ok": False, "parts": [], "xml": None, "text": "", "hidden": [], "comments": [], "metadata": [], "relations": [], "hex_blobs": []}
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = z.infolist()
    except Exception:
        return out
    out["ok"] = True
    for i in infos:
        external = False
        if i.filename.endswith(".rels"):
            try:
                with z.open(i) as f:
                    external = b'TargetMode="External"' in f.read(512 * 1024)
            except Exception:
                external = False
        out["parts"].append({"name": i.filename, "size": i.file_size, "csize": i.compress_size, "external": external})
        inside = i.filename.startswith(("word/embeddings/", "word/media/"))
        if i.file_size < MB and (i.filename.endswith((".bin", ".exe")) or (inside and "ole" in i.filename.lower())):
            try:
                out["hex_blobs"].append(z.read(i)[:4096].hex())
            except Exception:
                pass
    try:
        with z.open("word/document.xml") as f:
            out["xml"] = f.read(MB).decode("utf-8", "replace")
    except Exception:
        pass
    if (root := _xml(z, "word/document.xml")) is not None:
        shown = []
        for run in root.iter(f"{W}r"):
            text = "".join(t.text or "" for t in run.findall(f"{W}t"))
            if text and run.find(f"{W}rPr/{W}vanish") is not None:
                out["hidden"].append(text)
            shown.append(text)
        out["text"] = " ".join(s for s in shown if s)
    if (root := _xml(z, "word/comments.xml")) is not None:
        out["comments"] = [t.text for t in root.iter(f"{W}t") if t.text]
    metadata = {}
    if (root := _xml(z, "docProps/core.xml")) is not None:
        for e in root:
            if (name := e.tag.rpartition("}")[2]) in CORE and e.text:
                metadata[CORE[name]] = e.text
    if (root := _xml(z, "docProps/custom.xml")) is not None:
        for e in root:
            if (name := e.get("name")) and (value := "".join(e.itertext())):
                metadata[name.lower()] = value
    out["metadata"] = list(metadata.items())
    for name in ("word/_rels/document.xml.rels", "_rels/.rels"):
        if (root := _xml(z, name)) is not None:
            out["relations"] += [{"id": e.get("Id"), "type": e.get("Type"), "target": e.get("Target")} for e in root if (e.get("TargetMode") or "").lower() == "external"]
    return out


def docx_column(content: Column) -> Column:
    """Struct of all that is read from a zipped document, in one Arrow UDF; null for null."""
    text = pa.string()
    kind = pa.struct(
        [
            ("ok", pa.bool_()), ("parts", pa.list_(pa.struct([("name", text), ("size", pa.int64()), ("csize", pa.int64()), ("external", pa.bool_())]))), ("xml", text), ("text", text), ("hidden", pa.list_(text)), ("comments", pa.list_(text)),
            ("metadata", pa.map_(text, text)), ("relations", pa.list_(pa.struct([("id", text), ("type", text), ("target", text)]))), ("hex_blobs", pa.list_(text)),
        ]
    )

    @F.arrow_udf(DOCX)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([read_docx(b.as_py()) if b.is_valid else None for b in batch], kind)

    return run(content)
