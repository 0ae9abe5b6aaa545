"""Predicates over raw bytes (PDF and other files) and over the parts of zipped documents, as columns array<finding>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.config import MB, Config
from tamis.functions.text import count_of, matches
from tamis.operators.detectors import finding, let, together, when
from tamis.patterns import DOCX_KEYWORDS, DOS_STUB, PDF_ACTIVE_TOKENS, PDF_DELIMITER, PDF_FAST_TOKENS, PDF_HIGH_TOKENS

PART = "struct<name:string,size:bigint,csize:bigint,external:boolean>"


def token_hit(raw: Column, token: str) -> Column:
    """A name token that is followed by a delimiter; the literal test comes first because it is cheap."""
    return F.contains(raw, F.lit(token)) & raw.rlike(token + PDF_DELIMITER)


def say(*parts) -> Column:
    """A sentence of literals and columns."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def pdf_tokens(head: Column) -> Column:
    one = lambda t: when(token_hit(head, t), finding("T3_OBFUSCATION" if t == "/Encrypt" else "T2_ACTIVE_CONTENT", "HIGH" if t in ("/OpenAction", "/Launch", "/Encrypt") else "MEDIUM", f"Suspicious PDF Token found: {t}", f"The file holds the token {t}.", F.struct(F.lit(t).alias("token")), "fast_scan.pdf.tokens"))
    return together(*[one(t) for t in PDF_FAST_TOKENS])


#: How the page count is found.
PAGES_COUNT, ANY_COUNT = r"/Type\s*/Pages\s*/Count\s+(\d+)", r"/Count\s+(\d+)"


def page_count(head: Column) -> Column:
    """The count right behind the page tree's type, else the first count; at least 1, and 1 where there is none."""
    number = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return F.greatest(F.coalesce(F.coalesce(number(PAGES_COUNT), number(ANY_COUNT)).try_cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")), F.lit(1))


STEALTH_MARKS = [("E2808B", "Zero Width Space"), ("E280AE", "Right-to-Left Override")]


def stealth_bytes(content: Column) -> Column:
    return together(*[when(F.contains(content, F.expr(f"x'{h}'")), finding("T3_OBFUSCATION", "HIGH", f"Suspicious Hidden Character ({name})", f"The file holds a {name}, which hides text.", F.struct(F.lit(name).alias("char")), "fast_scan.pdf.stealth")) for h, name in STEALTH_MARKS])


def dense(objects: Column, pages: Column) -> Column:
    return (objects > 25_000) | ((objects > 3000) & (objects / pages > 750))


def object_density(head: Column) -> Column:
    objects, pages = count_of(head, " obj"), page_count(head)
    return together(
        when(dense(objects, pages), finding("T6_DOS", "HIGH", "Suspicious Object Density (DoS)", say(objects, " objects on ", pages, " pages."), F.struct(objects.alias("obj_count"), pages.cast("string").alias("page_count"), (objects / pages).cast("double").alias("density")), "fast_scan.pdf.dos")),
        when(~dense(objects, pages) & (pages > 2000), finding("T6_DOS", "HIGH", "High Page Count (DoS)", say("The page count is ", pages, "."), F.struct(pages.cast("string").alias("page_count")), "fast_scan.pdf.dos")),
    )


def multi_signals(head: Column, entropy: Column) -> Column:
    """The names of the signals of obfuscation in the scanned bytes."""
    name = lambda c, n: F.when(c, F.lit(n))
    return F.array_compact(F.array(name(count_of(head, " obj") >= 1500, "high_obj_count"), name(count_of(head, "/Filter") >= 30, "high_filter_count"), name((entropy >= 7.95) & (F.length(head) >= MB), "high_entropy")))


def pdf_dos(head: Column) -> Column:
    objects = count_of(head, " obj")
    per_kb = objects / (F.length(head) / 1024)
    longest = F.array_max(F.transform(matches(head, r"/Length\s+\d{4,}"), lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("decimal(38,0)")))
    return together(
        when((F.length(head) > 50 * 1024) & (per_kb > 300), finding("T6_DOS", "MEDIUM", "High PDF Object Density (DoS Risk)", say(F.format_number(per_kb, 1), " objects a KB may exhaust a parser."), F.struct(per_kb.alias("density"), objects.alias("obj_count")), "dos_pdf.fast", 0.7)),
        when(longest > 100 * MB, finding("T6_DOS", "HIGH", "Massive PDF Stream Declared", say("A stream of ", longest, " bytes is declared."), F.struct(longest.cast("string").alias("max_stream_size")), "dos_pdf.fast", 0.8)),
    )


def active_content(raw: Column) -> Column:
    """``raw``: the first bytes, as many as the settings say."""
    counts = F.filter(F.array(*[F.struct(F.lit(t).alias("token"), F.when(F.contains(raw, F.lit(t)), F.size(matches(raw, t + PDF_DELIMITER))).otherwise(0).alias("count")) for t in PDF_ACTIVE_TOKENS]), lambda x: x["count"] > 0)
    grave = lambda hits: F.exists(hits, lambda x: x["token"].isin(*PDF_HIGH_TOKENS))
    made = lambda hits: when(F.size(hits) > 0, finding("T2_ACTIVE_CONTENT", F.when(grave(hits), "HIGH").otherwise("MEDIUM"), "PDF contains active-content indicators", "The file holds keys of actions, scripts, embedded files or links.", F.struct(hits.alias("hits"), F.length(raw).alias("bytes_scanned")), "pdf.active_content"))
    return let(counts, made)


def embedded_bytes(path: Column, raw: Column) -> Column:
    """``raw``: the first 10 MB as characters."""
    ole = F.locate("ÐÏ\x11à", raw) - 1
    elf = F.locate("\x7fELF", raw) - 1
    name = F.element_at(F.split(path, "/"), -1)
    benign = F.lower(path).endswith(".elf") | ((elf == 0) & ~F.contains(name, F.lit(".")))
    t, m = "T7_EMBEDDED_PAYLOAD", "embedded_payload.fast"
    return together(
        when(F.lower(path).endswith(".pdf") & (ole >= 0), finding(t, "HIGH", "OLE Object Detected in PDF", "The PDF holds the head of a compound file.", F.struct(ole.alias("offset")), m)),
        when(F.contains(raw, F.lit(DOS_STUB)), finding(t, "CRITICAL", "Embedded PE Executable Detected", "The file holds the stub of a Windows program.", module=m)),
        when((elf >= 0) & ~benign, finding(t, "HIGH", "Embedded ELF Binary Detected", "The file holds the head of an ELF program.", F.struct(elf.alias("offset")), m)),
    )


def pdf_fast(head: Column, head_bytes: Column, entropy: Column) -> Column:
    """Of the first bytes of a PDF: ``head`` as characters, and their entropy."""
    signals = let(multi_signals(head, entropy), lambda s: when(F.size(s) >= 2, finding("T3_OBFUSCATION", "HIGH", "PDF Obfuscation Detected (Multi-Signal)", say("Signals of obfuscation: ", F.array_join(s, ", "), "."), F.struct(s.alias("signals"), count_of(head, " obj").alias("obj_count"), count_of(head, "/Filter").alias("filter_count"), entropy.alias("entropy")), "fast_scan.pdf.obfuscation")))
    return together(pdf_tokens(head), stealth_bytes(head_bytes), object_density(head), signals)


def size_gate(length: Column, cfg: Config) -> Column:
    size = F.struct(F.round(length / MB, 2).alias("size_mb"), F.lit(cfg.limits.max_mb).alias("limit_mb"))
    return when(length > cfg.limits.max_mb * MB, finding("T6_DOS", "HIGH", "File exceeds size limit", say("The file has ", F.format_number(length / MB, 2), f" MB; the limit is {cfg.limits.max_mb} MB."), size, "preflight"))


# ---- parts of zipped documents: columns of sources.files.docx_columns --------------------------------------------


def ratio(size: Column, csize: Column) -> Column:
    return F.when(csize > 0, size / csize).otherwise(0.0)


def docx_fast(parts: Column, xml: Column, cfg: Config) -> Column:
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p["size"])
    packed = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p["csize"])
    odd = F.size(F.filter(parts, lambda p: (ratio(p["size"], p["csize"]) > 500) & (p["size"] > MB)))
    n, limits = F.size(parts), cfg.limits
    structure = "fast_scan.docx.structure"

    def each(keep, t: str, s: str, title: str, explain: str, module: str) -> Column:
        return F.transform(F.filter(parts, keep), lambda p: finding(t, s, title, say(explain, p["name"], "."), F.struct(p["name"].alias("filename"), p["size"].alias("size")), module))

    text = F.substring(F.coalesce(xml, F.lit("")), 1, MB)
    keyword = lambda k: finding("T4_PROMPT_INJECTION", "MEDIUM", "Potential Injection Keyword (Fast Scan)", say("The document holds the words ", k, "."), F.struct(k.alias("keyword")), "fast_scan.docx.keywords")
    words = let(F.lower(text), lambda low: F.transform(F.filter(F.array(*[F.lit(k) for k in DOCX_KEYWORDS]), lambda k: F.contains(low, k)), keyword))
    signs = [(bytes.fromhex(h).decode(), name) for h, name in STEALTH_MARKS]
    stealth = [
        when(F.contains(text, F.lit(sign)), finding(t, s, title.format(name), f"The document holds a {name}, which hides text.", F.struct(F.lit(name).alias("char")), "fast_scan.docx.stealth"))
        for sign, name in signs
        for t, s, title in (("T3_OBFUSCATION", "HIGH", "Suspicious Hidden Character ({})"), ("T4_PROMPT_INJECTION", "MEDIUM", "Potential Obfuscated Injection ({})"))
    ]
    return together(
        when(n > limits.max_docx_parts, finding("T6_DOS", "HIGH", "Too many DOCX parts", say("The file has ", n, f" parts; the limit is {limits.max_docx_parts}."), F.struct(n.alias("part_count"), F.lit(limits.max_docx_parts).alias("limit")), structure)),
        when(total > limits.max_total_uncompressed_mb * MB, finding("T6_DOS", "HIGH", "Total uncompressed size too large", say("The parts have ", total, f" bytes; the limit is {limits.max_total_uncompressed_mb} MB."), F.struct(total.alias("size")), structure)),
        each(lambda p: p["size"] > limits.max_single_part_mb * MB, "T6_DOS", "MEDIUM", "Large individual XML part", "A part is too large: ", structure),
        each(lambda p: p["name"].endswith("vbaProject.bin") | F.contains(p["name"], F.lit("macrosheets")), "T2_ACTIVE_CONTENT", "HIGH", "Macro/VBA Content Found", "A part holds macros: ", "fast_scan.docx.macros"),
        each(lambda p: F.contains(p["name"], F.lit("word/embeddings/")), "T2_ACTIVE_CONTENT", "MEDIUM", "Embedded Object Found", "A part is an embedded object: ", "fast_scan.docx.ole"),
        each(lambda p: p["external"], "T2_ACTIVE_CONTENT", "MEDIUM", "DOCX External Relationship Found", "A part links to external content: ", "fast_scan.docx.rels"),
        words,
        *stealth,
        when((odd >= 2) | ((ratio(total, packed) > limits.max_expansion_ratio) & (total > 10 * MB)), finding("T6_DOS", "HIGH", "Suspicious Compression Ratio", say("The parts grow by ", F.format_number(ratio(total, packed), 1), "."), F.struct(F.round(ratio(total, packed), 2).alias("ratio"), odd.alias("suspicious_parts")), structure)),
    )


def docx_format(parts: Column, relations: Column, cfg: Config) -> Column:
    lower = lambda p: F.lower(p["name"])
    ole = F.filter(parts, lambda p: lower(p).startswith("word/embeddings/") | lower(p).startswith("word/oleobject"))
    size = F.aggregate(ole, F.lit(0).cast("bigint"), lambda s, p: s + p["size"])
    return together(
        when(F.size(relations) > 0, finding("T2_ACTIVE_CONTENT", "MEDIUM", "DOCX contains external relationships (links/resources)", "The document links to content outside of it.", F.struct(relations.alias("relationships")), "docx.external_refs")),
        when(F.size(ole) > 0, finding("T2_ACTIVE_CONTENT", F.when((F.size(ole) > 10) | (size > cfg.limits.max_mb * MB), "HIGH").otherwise("MEDIUM"), "DOCX contains embedded objects (OLE/Package)", "The document holds embedded objects.", F.struct(F.size(ole).alias("objects"), size.alias("bytes")), "docx.ole")),
        when(F.exists(parts, lambda p: p["name"].isin("word/vbaProject.bin", "vbaProject.bin")), finding("T2_ACTIVE_CONTENT", "HIGH", "DOCX contains VBA macro project (vbaProject.bin)", "The document holds macros.", module="docx.macros")),
    )


def docx_dos(parts: Column, cfg: Config) -> Column:
    """Opt-in (``enable_docx_dos``): the structure checks again, with lower confidence, and nested archives."""
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p["size"])
    packed = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p["csize"])
    m, t, limits = "dos_docx.fast", "T6_DOS", cfg.limits
    name = lambda text: lambda p: finding(t, "MEDIUM", text[0], say(text[1], p["name"], "."), F.struct(p["name"].alias("filename")), m, text[2])
    return together(
        when(F.size(parts) > limits.max_docx_parts, finding(t, "HIGH", "Too many DOCX parts (Zip Bomb)", say("The file has ", F.size(parts), " parts."), module=m, confidence=0.9)),
        when(total > limits.max_total_uncompressed_mb * MB, finding(t, "HIGH", "Total uncompressed size too large", say("The parts have ", total, " bytes."), module=m, confidence=0.9)),
        when(ratio(total, packed) > limits.max_expansion_ratio, finding(t, "HIGH", "High Compression Ratio (Zip Bomb)", say("The parts grow by ", F.format_number(ratio(total, packed), 1), "."), module=m, confidence=0.8)),
        F.transform(F.filter(parts, lambda p: p["size"] > limits.max_single_part_mb * MB), name(("Large individual XML part", "A part is too large: ", 0.7))),
        F.transform(F.filter(parts, lambda p: F.lower(p["name"]).rlike(r"\.(zip|docx|xlsx|pptx|jar)$")), name(("Nested Archive Detected", "A part is an archive: ", 0.8))),
    )
