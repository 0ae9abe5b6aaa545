"""The scan: files or parsed documents in, one report a document out; no stage shuffles, and files are read once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.config import MB, Config
from tamis.functions.text import byte_entropy, latin1
from tamis.operators import bytescan, detectors, plugins
from tamis.operators.detectors import NONE, finding, let, together, when
from tamis.operators.nested import ARRAY_KEYS
from tamis.operators.risk import risk, verdict
from tamis.sources import files as source

PREVIEW = 1000


def preview(text: Column) -> Column:
    return F.when(F.length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit("..."))).otherwise(text)


TEXTS = "array<string>"


def _texts(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(TEXTS))


def typed(metadata: Column, pdf: Column | None = None, docx: Column | None = None) -> dict[str, Column]:
    """Typed columns of a metadata map whose array-holding keys hold JSON, and of the maps that the analyser of the file left."""
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    array = lambda m, k: F.from_json(at(m, k), TEXTS)
    plain = F.map_values(F.map_filter(metadata, lambda k, _: ~k.isin(ARRAY_KEYS + ["has_hidden_tags"])))
    out = {
        "values": F.concat(_texts(plain), _texts(array(metadata, "comments"))),
        "comments": array(metadata, "pdf_comments"),
        "hidden": array(metadata, "hidden_text"),
        "hidden_tags": F.lower(at(metadata, "has_hidden_tags")) == "true",
        "hex_blobs": array(metadata, "hex_blobs"),
        "compression": at(metadata, "compression_ratio").try_cast("double"),
    }
    if docx is not None:
        hidden = F.coalesce(array(docx, "hidden_text"), F.when(at(docx, "hidden_text") != "", F.array(at(docx, "hidden_text"))))
        out["values"] = F.concat(out["values"], _texts(array(docx, "comments")))
        out["comments"] = F.concat(_texts(array(docx, "comments")), _texts(hidden), _texts(out["comments"]))
        out["docx_hidden"] = hidden
    if pdf is not None:
        out["encrypted"] = F.lower(at(pdf, "encrypted_token")) == "true"
        pages = F.coalesce(F.nullif(at(pdf, "page_count").try_cast("double"), F.lit(0.0)), F.lit(1.0))
        out["density"] = at(pdf, "obj_count").try_cast("double") / pages
        out["pages"] = F.json_array_length(F.get_json_object(at(pdf, "docling"), "$.pages"))
    return out


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that the optimiser does not copy into each of the expressions that use it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def reports(df: DataFrame, cfg: Config, *keep: str) -> DataFrame:
    """``keep``, verdict, risk_score, findings, skipped_detectors and content of rows with findings, text and metadata."""
    scored = df.withColumn("risk_score", risk(F.col("findings")))
    return scored.select(*keep, verdict(F.col("risk_score"), cfg.thresholds).alias("verdict"), "risk_score", "findings", F.array().cast(TEXTS).alias("skipped_detectors"), F.struct(preview(F.col("text")).alias("text"), "metadata").alias("content"))


def scan_parsed(df: DataFrame, cfg: Config = Config(), key: str = "parsed_id", table: list[tuple[str, str]] | None = None, own: Iterable[Callable] = (), similarity: Column | None = None) -> DataFrame:
    """Reports of parsed documents (``key``, file_path, file_type, text, metadata and, where there, pdf and docx). Null texts count as empty.

    ``table``: rules; ``own``: further detectors; ``similarity``: the body's highest cosine to the signatures of instructions."""
    maps = [c for c in ("pdf", "docx") if c in df.columns]
    alike = [similarity.alias("_similarity")] if similarity is not None else []
    flat = df.select(key, "file_path", "file_type", F.coalesce("text", F.lit("")).alias("text"), "metadata", *maps, *alike)
    meta = typed(F.col("metadata"), **{c: F.col(c) for c in maps})
    if similarity is not None and cfg.enable_semantic:
        meta["similarity"] = F.col("_similarity")
    found = flat.withColumn("findings", detectors.detect(cfg, F.col("text"), meta, table, own))
    return reports(found, cfg, key, "file_path", "file_type")


def rejects(files: DataFrame, cfg: Config = Config()) -> DataFrame:
    """path, length, reason of the files that are too large to be scanned; their bytes are not read."""
    return files.where(source.is_rejected(F.col("length"), cfg)).select("path", "length", F.concat(F.lit("File size ("), F.col("length").cast("string"), F.lit(" bytes) exceeds hashing limit")).alias("reason"))


def scan_files(files: DataFrame, cfg: Config = Config(), table: list[tuple[str, str]] | None = None, own: Iterable[Callable] = (), engine: plugins.Engine | None = None) -> DataFrame:
    """Reports of raw files (path, length, content): size gate, byte scan, extraction, format checks, detectors and antivirus.

    One pass over the files. Those of more than twice the size limit have no report but a row of ``rejects``. The byte scan
    decides whether a file goes on: a critical finding ends its scan, as does a type that is switched off while its risk is low."""
    limits = cfg.limits
    rows = source.identified(files.where(~source.is_rejected(F.col("length"), cfg)), cfg)
    content, length, kind, path = F.col("content"), F.col("length"), F.col("file_type"), F.col("path")
    fits = length <= limits.max_mb * MB
    nothing, none = F.array().cast(NONE), F.array().cast(TEXTS)
    # a file's parts are read by its name, as its type may come from its bytes alone
    as_pdf, as_docx = fits & (kind == "pdf") & F.lit(cfg.enable_pdf), fits & (kind == "docx") & F.lit(cfg.enable_docx)
    head_bytes = F.substring(content, 1, limits.fast_pdf_token_scan_mb * MB)
    read = rows.select(
        "path", "file_type", "sha256", "length", "content",
        F.when(fits, latin1(F.substring(content, 1, max(10, limits.pdf_bytes_scan_mb) * MB))).alias("_raw"),
        byte_entropy(F.when(as_pdf, head_bytes)).alias("_entropy"), source.docx_column(F.when(as_docx, content)).alias("_d"),
    )
    read = read.withColumn("_head", F.when(as_pdf, F.substring("_raw", 1, limits.fast_pdf_token_scan_mb * MB))).withColumn("_pdf", F.when(as_pdf, F.substring("_raw", 1, limits.pdf_bytes_scan_mb * MB)))
    parts, is_zip = F.col("_d.parts"), F.coalesce(F.col("_d.ok"), F.lit(False))
    fast = [
        bytescan.embedded_bytes(path, F.substring("_raw", 1, 10 * MB)) if cfg.enable_embedded else nothing,
        F.when(as_pdf, bytescan.pdf_fast(F.col("_head"), head_bytes, F.col("_entropy"))).when(is_zip, bytescan.docx_fast(parts, F.col("_d.xml"), cfg)),
        F.when(as_pdf, bytescan.pdf_dos(F.col("_head"))) if cfg.enable_dos else nothing,
        F.when(is_zip, bytescan.docx_dos(parts, cfg)) if cfg.enable_docx_dos else nothing,
    ]
    gated = F.when(fits, F.concat(*[F.coalesce(f, nothing) for f in fast])).otherwise(bytescan.size_gate(length, cfg))
    p = source.pdf_columns(F.col("_pdf"))
    is_pdf_name, is_docx_name = as_pdf & F.lower(path).endswith(".pdf"), is_zip & F.lower(path).endswith(".docx")
    extracted = F.when(is_pdf_name, F.struct(p["text"].alias("text"), p["metadata"].alias("metadata"), p["comments"].alias("comments"), none.alias("hidden"), none.alias("values"), p["hex_blobs"].alias("hex")))
    extracted = extracted.when(is_docx_name, F.struct(F.col("_d.text").alias("text"), F.col("_d.metadata").alias("metadata"), none.alias("comments"), F.col("_d.hidden").alias("hidden"), F.col("_d.comments").alias("values"), F.col("_d.hex_blobs").alias("hex")))
    scanned = once(read, "_fast", gated).withColumn("_stage", F.when(~fits, "size").otherwise(stage_reached(F.col("_fast"), kind, cfg)))
    scanned = once(scanned, "_x", F.when(F.col("_stage") == "deep", extracted))
    active = F.when(as_pdf, bytescan.active_content(F.col("_pdf"))).when(is_zip, bytescan.docx_format(parts, F.col("_d.relations"), cfg)) if cfg.enable_active_content else nothing
    text = F.coalesce(F.col("_x.text"), F.lit(""))
    meta = {
        "values": F.concat(_texts(F.map_values(F.col("_x.metadata"))), _texts(F.col("_x.values"))), "comments": _texts(F.col("_x.comments")),
        "hidden": _texts(F.col("_x.hidden")), "hidden_tags": F.size(_texts(F.col("_x.hidden"))) > 0, "hex_blobs": _texts(F.col("_x.hex")),
    }
    broken = as_docx & ~is_zip
    failed = when(broken, finding("T6_DOS", "MEDIUM", "Parsing failed", "The document is no readable archive.", module="stage.parse"))
    deep = F.concat(failed, F.when(broken, nothing).otherwise(F.concat(F.coalesce(active, nothing), detectors.detect(cfg, text, meta, table, own))))
    if engine is not None:
        scanned = scanned.withColumn("_av", plugins.scanned(engine)(F.col("path"), F.when(F.col("_stage") == "deep", content)))
        deep = F.concat(deep, plugins.antivirus_findings(F.col("_av")))
    full = scanned.withColumn("findings", F.concat("_fast", F.when(F.col("_stage") == "deep", deep).otherwise(nothing)))
    full = full.select("path", "file_type", "sha256", "length", "findings", text.alias("text"), F.coalesce(F.col("_x.metadata"), F.create_map().cast("map<string,string>")).alias("metadata"))
    return reports(full, cfg, "path", "file_type", "sha256", "length")


def stage_reached(fast: Column, kind: Column, cfg: Config) -> Column:
    """stopped (critical finding), deep, or fast only (a disabled format below the trigger)."""
    enabled = F.when(kind == "pdf", F.lit(cfg.enable_pdf)).when(kind == "docx", F.lit(cfg.enable_docx)).otherwise(F.lit(True))
    critical = F.exists(fast, lambda f: F.coalesce(f["severity"] == "CRITICAL", F.lit(False)))
    return F.when(F.coalesce(critical, F.lit(False)), "stopped").when(enabled | (risk(fast) >= cfg.thresholds.deep_scan_trigger), "deep").otherwise("fast")


def as_text(df: DataFrame) -> DataFrame:
    """A few lines of text a report."""
    lines = F.transform("findings", lambda f: F.concat(F.lit("\n- ["), f["severity"], F.lit("] "), f["threat_id"], F.lit(": "), f["title"], F.when(f["explain"] != "", F.concat(F.lit("\n  "), f["explain"])).otherwise("")))
    return df.select(F.concat(F.format_string("Verdict: %s  Risk: %.3f", "verdict", "risk_score"), F.array_join(lines, "")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
