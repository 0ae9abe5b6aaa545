"""Text detectors: each takes columns of a parsed document and gives a column array<finding>; none shuffles, and only entropies,
base64 runs and texts beyond ASCII that need normalising leave the JVM.

A parsed document has text and typed metadata columns; see ``plans.pipeline.typed``. Null texts have no findings.
Titles and modules are fixed values that readers of reports match on.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.config import Config
from tamis.functions.text import MAYBE_STRIPPED, count_chars, entropies_of, matches, strip_stealth
from tamis.patterns import (
    BIDI,
    EICAR,
    METADATA_PROMPTS,
    METADATA_SCRIPT,
    OLE_HEX,
    PERSONAL,
    PLACEHOLDER_HEX,
    PROMPTS,
    SCRIPTS,
    SECRETS,
    WATERMARKS,
    ZERO_WIDTH,
    ZIP_HEX,
)

FINDING = "struct<threat_id:string,severity:string,title:string,explain:string,evidence:string,location:string,module:string,confidence:double,weight:double>"
NONE = f"array<{FINDING}>"


def finding(threat: str, severity, title, explain, evidence: Column | None = None, module: str = "", confidence: float = 1.0) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = [F.lit(threat), col(severity), col(title), col(explain), F.to_json(evidence) if evidence is not None else F.lit(None), F.lit(None), F.lit(module), F.lit(confidence), F.lit(0.0)]
    return F.struct(*[v.alias(n) for v, n in zip(values, [x.split(":")[0] for x in FINDING[7:-1].split(",")])]).cast(FINDING)


def when(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(F.array().cast(NONE))


def together(*parts: Column) -> Column:
    return F.flatten(F.array(*parts)) if parts else F.array().cast(NONE)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, as a lambda variable."""
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?iU)" + pattern), F.lit(False))


def literals(pattern: str) -> list[str]:
    """Lower-case texts of which a match of the pattern holds at least one: its longest fixed part or group of alternatives."""
    p = re.sub(r"\([^()]*\)\?|:\?|\\s\*|\[A-Z\]\+", "\0", pattern.replace(r"\b", ""))
    parts = [x for x in re.split(r"(\([^()]*\))|\0", p) if x]
    plain = [re.sub(r"\\(.)", r"\1", x) for x in parts]
    # a group and what stands right after it belong together
    options = [[a + (plain[k + 1] if k + 1 < len(plain) and plain[k + 1][0] != "(" else "") for a in x[1:-1].split("|")] if x[0] == "(" else [x] for k, x in enumerate(plain)]
    return [x.lower() for x in max(options, key=lambda o: min(map(len, o)))]


GATES = [literals(p) for _, p, _ in PROMPTS]


def gate(lower: Column, k: int) -> Column:
    """Whether a lower-cased text can match the k-th pattern at all."""
    found = F.contains(lower, F.lit(GATES[k][0]))
    for x in GATES[k][1:]:
        found = found | F.contains(lower, F.lit(x))
    return found


def beginnings(pattern: str) -> list[str]:
    """Lower-case texts with one of which every match of the pattern begins."""
    p = pattern.replace(r"\b", "")
    head, group, rest = re.fullmatch(r"((?:\\.|[^()\\:?*\[])*)(\([^()]*\))?(.*)", p, re.S).groups()
    head = re.sub(r"\\(.)", r"\1", head)
    return [(head + a).lower() for a in group[1:-1].split("|")] if group and not rest.startswith("?") else [head.lower()]


def _tree(words: list[str]) -> str:
    """A pattern of all words in which equal beginnings are tried once."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    return "(?:" + "|".join(re.escape(h) + _tree([w[1:] for w in words if w[0] == h]) for h in heads) + ")"


#: Some pattern's beginning, over lower-cased texts.
ANY_BEGINNING = r"(?<![\p{L}\p{Nd}_])" + _tree([b for _, p, _ in PROMPTS for b in beginnings(p)])
MATCH = "array<struct<w:double,ord:int,category:string,match:string>>"


def prompt_matches(text: Column) -> Column:
    """array<struct<w, ord, category, match>> of the patterns found, heaviest first (w: the weight, negative). Only patterns whose fixed part is in the text are tried."""

    def tried(lower: Column) -> Column:
        one = lambda k, c, p, w: F.when(gate(lower, k) & has(text, p), F.struct(F.lit(-w).alias("w"), F.lit(k).alias("ord"), F.lit(c).alias("category"), F.substring(F.regexp_extract(text, "(?iU)" + p, 0), 1, 50).alias("match")))
        return F.when(lower.rlike(ANY_BEGINNING), F.array_sort(F.array_compact(F.array(*[one(k, *x) for k, x in enumerate(PROMPTS)])))).otherwise(F.array().cast(MATCH))

    return let(F.lower(text), tried)


def prompt_score(text: Column) -> Column:
    return F.coalesce(-F.aggregate(prompt_matches(text), F.lit(0.0), lambda s, m: s + m["w"]), F.lit(0.0))


def prompt_severity(score: Column) -> Column:
    return F.when(score >= 6, "CRITICAL").when(score >= 2, "HIGH")


SIMILAR = 0.75  # a cosine above it to a signature adds SIMILAR_WEIGHT to the score
SIMILAR_WEIGHT = 2.0


def prompt_injection(text: Column, suffix: str = "", similarity: Column | None = None) -> Column:
    """Over a cleaned text. Scores of at least 2 are findings; the five heaviest matches are evidence. ``similarity``: the
    highest cosine of the text's first and last 1000 characters to the signatures, by whatever encoder."""

    def scored(found: Column) -> Column:
        if similarity is not None:
            alike = F.array(F.struct(F.lit(-SIMILAR_WEIGHT).alias("w"), F.lit(len(PROMPTS)).alias("ord"), F.lit("semantic").alias("category"), F.format_string("Max similarity %.2f", similarity).alias("match")))
            found = F.array_sort(F.concat(found, F.when(similarity > SIMILAR, alike.cast(MATCH)).otherwise(F.array().cast(MATCH))))

        def judged(found: Column) -> Column:
            top = F.transform(F.slice(found, 1, 5), lambda m: F.struct(m["category"].alias("category"), m["match"].alias("match"), (-m["w"]).alias("weight")))

            def made(score: Column) -> Column:
                shown = F.format_number(score, 1)
                title = F.concat(F.lit("Prompt Injection Detected (Score: "), shown, F.lit(")" + suffix))
                explain = F.concat(F.lit("Several indicators add up to "), shown, F.lit(", at least 2.0."))
                return when(score >= 2, finding("T4_PROMPT_INJECTION", prompt_severity(score), title, explain, F.struct(score.alias("score"), F.size(found).alias("match_count"), top.alias("top_matches")), "detectors.prompt_injection_v2"))

            return F.when(F.size(found) > 0, let(-F.aggregate(found, F.lit(0.0), lambda s, m: s + m["w"]), made)).otherwise(F.array().cast(NONE))

        return let(found.cast(MATCH), judged)

    return F.coalesce(let(prompt_matches(text), scored), F.array().cast(NONE))


def nfkc_all(texts: Column) -> Column:
    """Each text of an array normalised (NFKC)."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([row and [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in row] for row in batch.to_pylist()], pa.list_(pa.string()))

    return run(texts)


def decoded(runs: Column) -> Column:
    """What each base64 run of an array says in UTF-8, malformed bytes dropped, normalised (NFKC) and without stealth
    characters and controls."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        def text(r: str) -> str | None:
            try:
                return unicodedata.normalize("NFKC", base64.b64decode(r).decode("utf-8", "ignore"))
            except ValueError:
                return None

        return pa.array([row and [r and text(r) for r in row] for row in batch.to_pylist()], pa.list_(pa.string()))

    return F.transform(run(runs), strip_stealth)


def prompt_injection_all(text: Column, others: Column, similarity: Column | None = None) -> Column:
    """The body and each further text (comments, hidden text) on its own, and what their base64 runs decode to. Each is normalised (NFKC)
    and without stealth characters. ``similarity`` is the body's."""
    nothing = F.array().cast(NONE)
    kept = lambda texts: F.filter(texts, lambda t: F.coalesce(F.length(t) > 0, F.lit(False)))
    every = F.concat(F.array(F.coalesce(text, F.lit(""))), kept(F.coalesce(others, F.array().cast("array<string>"))))
    wide = nfkc_all(F.transform(every, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), t)))  # only these go to a worker
    clean = F.zip_with(every, wide, lambda t, n: strip_stealth(F.coalesce(n, t)))
    alike = lambda t, k: F.when((k == 0) & (F.length(t) > 0), similarity)
    scan = (lambda t, k: prompt_injection(t, similarity=alike(t, k))) if similarity is not None else (lambda t, k: prompt_injection(t))
    plain = F.coalesce(F.flatten(F.transform(clean, scan)), nothing)
    none = F.array().cast("array<string>")
    runs = F.flatten(F.transform(clean, lambda t: F.when(long_run(t, 80), F.regexp_extract_all(t, F.lit(r"(?:[A-Za-z0-9+/]{4}){20,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"), F.lit(0))).otherwise(none)))
    inner = F.flatten(F.transform(F.filter(decoded(runs), lambda t: F.coalesce(F.length(t) > 10, F.lit(False))), lambda t: prompt_injection(t, " (Base64 Decoded)")))
    return F.concat(plain, inner)


def long_run(text: Column, n: int) -> Column:
    """Whether a text holds so many characters of base64 in a row. The pattern only runs where so many characters stand without a blank."""
    piece = F.exists(F.split(text, " "), lambda w: F.length(w) >= n)
    return F.coalesce(piece & text.rlike(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{n}}}"), F.lit(False))


def stuffing_tokens(text: Column) -> Column:
    """Lower-cased alphabetic tokens of at least three letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(?<![^\s\x1c-\x1f])\p{L}{3,}+(?![^\s\x1c-\x1f])"), F.lit(0))


def top_token(tokens: Column) -> Column:
    """struct<n, token> of the commonest token, the earliest of equals; sorts inside the row instead of shuffling."""
    ranked = F.array_sort(F.transform(tokens, lambda t, k: F.struct(t.alias("t"), k.alias("k"))))

    def step(s: Column, x: Column) -> Column:
        same = x["t"] == s["last"]
        run, first = F.when(same, s["run"] + 1).otherwise(F.lit(1)), F.when(same, s["first"]).otherwise(x["k"])
        best = F.greatest(s["best"], F.struct(run.alias("n"), (-first).alias("at"), x["t"].alias("token")))
        return F.struct(x["t"].alias("last"), run.alias("run"), first.alias("first"), best.alias("best"))

    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("first"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit("").alias("token")).alias("best"))
    return F.aggregate(ranked, zero, step, lambda s: F.struct(s["best"]["n"].alias("n"), s["best"]["token"].alias("token")))


def keyword_stuffing(text: Column) -> Column:
    def judged(tokens: Column) -> Column:
        def made(best: Column) -> Column:
            ratio = best["n"] / F.size(tokens)
            return when(ratio > 0.08, finding("T5_RANKING_MANIPULATION", "MEDIUM", "Possible keyword stuffing", "One word makes up an unusual share of the text.", F.struct(best["token"].alias("top_token"), best["n"].alias("freq"), ratio.alias("ratio")), "detectors.ranking_manipulation"))

        return F.when(F.size(tokens) >= 200, let(top_token(tokens), made)).otherwise(F.array().cast(NONE))

    # 200 tokens of three letters and the blanks between them
    return F.when(F.length(text) >= 799, let(stuffing_tokens(text), judged)).otherwise(F.array().cast(NONE))


REPEATED = r"(?U)(\b\w+\s+)\1{10,}"


def ats_manipulation(text: Column, hidden: Column, hidden_tags: Column, docx_hidden: Column | None = None) -> Column:
    """``docx_hidden``: the hidden text that the analyser of the file found, besides that of the metadata."""
    joined = F.array_join(F.coalesce(hidden, F.array().cast("array<string>")), " ")
    t, m = "T9_ATS_MANIPULATION", "ats_manipulation"
    parts = [
        when(F.coalesce(text.rlike(REPEATED), F.lit(False)), finding(t, "HIGH", "Repeated Keywords Sequence", "One word stands more than ten times in a row.", module=m, confidence=0.9)),
        when(F.length(F.trim(joined)) > 0, finding(t, "HIGH", "Hidden Text Detected", "The metadata hold text that is not shown.", F.struct(F.length(joined).alias("length")), m, 0.95)),
        when(F.coalesce(hidden_tags, F.lit(False)), finding(t, "MEDIUM", "Hidden Text Tags Detected", "Runs are marked as not shown.", F.struct(F.lit("w:vanish").alias("tag")), m, 0.9)),
    ]
    if docx_hidden is not None:
        n = F.length(F.array_join(docx_hidden, " "))
        parts.append(when(F.coalesce(n > 0, F.lit(False)), finding(t, "MEDIUM", "Hidden Text Detected", "The document holds text that is marked as hidden.", F.struct(n.alias("length")), m, 0.9)))
    return together(*parts)


def base64_blocks(text: Column) -> Column:
    return F.filter(matches(text, r"[A-Za-z0-9+/]{1024,}={0,2}"), lambda b: ~b.startswith("data:image") & ~b.startswith("data:font"))


def entropies(strings: Column) -> Column:
    """array<double>: the Shannon entropy of each string of an array, counted for a whole batch at once."""

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        counts = pa.compute.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(entropies_of(flat.to_pylist()), pa.float64()))

    return run(strings)


def hex_blocks(text: Column) -> Column:
    ok = lambda b: ~F.upper(F.substring(b, 1, 8)).isin(OLE_HEX, ZIP_HEX, PLACEHOLDER_HEX)
    return F.filter(matches(text, r"(?:[0-9a-fA-F]{2}){256,}"), ok)


def embedded_payload(text: Column, hex_blobs: Column) -> Column:
    long = F.when(long_run(text, 512), text)  # no block is in other texts
    blocks = base64_blocks(long)
    dense = F.filter(F.arrays_zip(blocks.alias("b"), entropies(blocks).alias("h")), lambda x: x["h"] >= 4.5)
    base64 = F.try_element_at(dense, F.lit(1))["b"]
    blob = F.try_element_at(F.filter(F.coalesce(hex_blobs, F.array().cast("array<string>")), lambda b: (F.length(b) > 1024) & ~F.upper(F.substring(b, 1, 8)).isin(OLE_HEX, PLACEHOLDER_HEX)), F.lit(1))
    run = F.try_element_at(hex_blocks(long), F.lit(1))
    t, m = "T7_EMBEDDED_PAYLOAD", "embedded_payload"
    size = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.length(c).alias("length"))
    return together(
        when(base64.isNotNull(), finding(t, "HIGH", "Large Base64 Block Detected", "A dense base64 block of more than 1 KB may hide a payload.", size("base64", base64), m, 0.9)),
        when(blob.isNotNull(), finding(t, "HIGH", "Large Hex Blob Detected in PDF", "The file holds a very long hexadecimal string.", size("hex_blob", blob), m, 0.9)),
        when(run.isNotNull(), finding(t, "HIGH", "Large Hex Blob Detected", "The text holds a hexadecimal string of more than 256 bytes.", size("hex", run), m, 0.8)),
        scripts(text),
    )


#: What a match of each pattern of SCRIPTS holds in lower case.
SCRIPT_SIGNS = ["eval", "powershell", "cmd.exe"]


def scripts(text: Column) -> Column:
    t, m = "T7_EMBEDDED_PAYLOAD", "embedded_payload"
    made = lambda title: finding(t, "CRITICAL", f"Suspicious Script/Command: {title}", f"A pattern of running scripts or commands: {title}.", module=m, confidence=0.95)
    return let(F.lower(text), lambda low: together(*[when(F.coalesce(F.contains(low, F.lit(sign)) & text.rlike("(?iUd)" + p), F.lit(False)), made(title)) for (p, title), sign in zip(SCRIPTS, SCRIPT_SIGNS)]))


def metadata_injection(values: Column) -> Column:
    """Over all metadata values and comments."""
    t, m = "T8_METADATA_INJECTION", "metadata_injection"

    def one(v: Column) -> Column:
        first = F.coalesce(*[F.when(has(v, p), F.lit(p)) for p in METADATA_PROMPTS])
        return together(
            when(F.length(v) > 5000, finding(t, "HIGH", "Excessive Metadata/Comment Length", "A metadata field or comment is longer than 5000 characters.", F.struct(F.length(v).alias("length"), F.substring(v, 1, 50).alias("snippet")), m, 0.8)),
            when(has(v, METADATA_SCRIPT), finding(t, "CRITICAL", "Script Injection in Metadata", "A metadata field or comment holds script tags or event handlers.", F.struct(F.substring(v, 1, 100).alias("snippet")), m)),
            when(first.isNotNull(), finding(t, "HIGH", "Prompt Injection in Metadata", "A metadata field or comment holds instructions to a model.", F.struct(F.substring(v, 1, 100).alias("snippet"), first.alias("pattern")), m, 0.9)),
        )

    return F.flatten(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(F.length(v) > 0, F.lit(False))), one))


def rules(text: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """The antivirus test signature, or else each rule (name, pattern) that matches."""
    test = F.contains(text, F.lit(EICAR))
    found = together(*[when(has(text, p), finding("T1_MALWARE", "CRITICAL", f"YARA Rule Match (Text): {name}", f"The text matches the rule {name}.", F.struct(F.lit(name).alias("rule")), "yara.text")) for name, p in table or []])
    signature = finding("T1_MALWARE", "CRITICAL", "Malware Signature Detected (EICAR)", "The text holds the test signature of antivirus programs.", F.struct(F.lit("EICAR-STANDARD-ANTIVIRUS-TEST-FILE").alias("signature")), "yara")
    return F.when(test, F.array(signature)).otherwise(F.coalesce(found, F.array().cast(NONE)))


#: Every number of the personal patterns holds a match of this.
NUMBER_LIKE = r"\d{3}\)?[-. ]?\d{2,3}[-. ]?\d{4}"


def personal_counts(text: Column) -> Column:
    """array<struct<type, n, examples>> of the kinds found."""
    none = F.array().cast("array<string>")

    def counted(numbers: Column) -> Column:
        maybe = lambda kind: F.contains(text, F.lit("@")) if kind == "Email Address" else numbers
        one = lambda p, kind: let(F.when(maybe(kind), matches(text, p)).otherwise(none), lambda m: F.struct(F.lit(kind).alias("type"), F.size(m).alias("n"), F.slice(m, 1, 3).alias("examples")))
        return F.filter(F.array(*[one(p, kind) for p, kind in PERSONAL]), lambda x: x["n"] > 0)

    return let(F.coalesce(text.rlike(NUMBER_LIKE), F.lit(False)), counted)


def personal_severity(counts: Column) -> Column:
    grave = F.exists(counts, lambda x: x["type"].isin("US SSN", "Credit Card Number"))
    many = F.exists(counts, lambda x: (x["type"] == "Email Address") & (x["n"] > 10))
    return F.when(grave, "HIGH").when(many, "MEDIUM").otherwise("INFO")


def personal(text: Column) -> Column:
    return let(personal_counts(text), lambda counts: when(F.size(counts) > 0, finding("T2_ACTIVE_CONTENT", personal_severity(counts), "Personally Identifiable Information (PII) Detected", "The text holds what looks like personal data.", F.struct(counts.alias("matches")), "detectors.pii")))


def hidden_text(hidden: Column, allow_watermarks: bool = True) -> Column:
    kept = F.array_distinct(F.filter(F.coalesce(hidden, F.array().cast("array<string>")), lambda h: F.coalesce(F.trim(h) != "", F.lit(False))))
    if allow_watermarks:
        kept = F.filter(kept, lambda h: ~h.rlike("(?i)" + "|".join(WATERMARKS)))
    return F.transform(F.filter(kept, lambda h: F.length(h) > 50), lambda h: finding("T3_OBFUSCATION", "HIGH", "Hidden Text Detected", "A long text is marked as not shown.", F.struct(F.length(h).alias("length"), F.substring(h, 1, 100).alias("snippet")), "hidden_text", 0.9))


def obfuscation_signals(text: Column, compression: Column | None = None, density: Column | None = None, alone: bool = True) -> Column:
    """The names of the signals found. Unless ``alone``, the entropy of chunks is only taken where there is another signal, as one is no finding."""
    name = lambda c, n: F.when(c, F.lit(n))
    counted = F.array(name(count_chars(text, ZERO_WIDTH) >= 25, "high_zero_width"), name(count_chars(text, BIDI) >= 2, "high_bidi"))
    marks = F.when(text.rlike(MAYBE_STRIPPED), F.array_compact(counted)).otherwise(F.array().cast("array<string>"))
    of_file = F.array_compact(F.array(name(compression > 100 if compression is not None else F.lit(False), "compression_anomaly"), name(density > 1000 if density is not None else F.lit(False), "high_object_density")))
    wanted = F.lit(True) if alone else (F.size(of_file) > 0) | (F.size(marks) > 0)
    starts = F.when((F.length(text) > 0) & wanted, F.sequence(F.lit(1), F.length(text), F.lit(500))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda k: F.substring(text, k, F.lit(500)))
    high = F.size(F.filter(entropies(F.filter(chunks, lambda c: F.length(c) >= 50)), lambda h: h > 5.5))
    entropy = F.array_compact(F.array(name((high >= 2) | (high / F.nullif(F.ceil(F.length(text) / 500), F.lit(0)) > 0.3), "high_entropy")))
    return F.concat(marks, entropy, of_file)


def obfuscation(text: Column, encrypted: Column | None = None, **more: Column) -> Column:
    """Two signals make a finding; the token of an encrypted file is one by itself and ends the check. Empty texts have none."""
    signals = obfuscation_signals(text, alone=False, **more)
    explain = lambda s: F.concat(F.lit("Signals of obfuscation: "), F.array_join(s, ", "), F.lit("."))
    several = let(signals, lambda s: when(F.size(s) >= 2, finding("T3_OBFUSCATION", "HIGH", "Obfuscation Detected (Multi-Signal)", explain(s), F.struct(s.alias("signals"), F.size(s).alias("count")), "text_obfuscation")))
    if encrypted is not None:
        token = finding("T3_OBFUSCATION", "HIGH", "Found /Encrypt Token", "The file holds the token of encrypted files.", F.struct(F.lit("/Encrypt").alias("token")), "text_obfuscation")
        several = F.when(F.coalesce(encrypted, F.lit(False)), F.array(token)).otherwise(several)
    return F.when(F.length(text) > 0, several).otherwise(F.array().cast(NONE))


def excessive_pages(pages: Column, cfg: Config) -> Column:
    """Of the page count that a rich parser found."""
    return when(F.coalesce(pages > cfg.limits.max_pages, F.lit(False)), finding("T6_DOS", "HIGH", "PDF has excessive page count", F.concat(F.lit("The parser found "), pages.cast("string"), F.lit(f" pages; the limit is {cfg.limits.max_pages}.")), F.struct(pages.alias("page_count"), F.lit(cfg.limits.max_pages).alias("limit")), "dos_pdf"))


def mixed_scripts(text: Column) -> Column:
    """Words that mix Latin letters with Cyrillic or Greek ones."""
    return F.array_distinct(F.filter(matches(text, r"[0-9A-Za-z_\x{370}-\x{4FF}]+"), lambda w: w.rlike("[A-Za-z]") & w.rlike(r"[\x{370}-\x{4FF}]")))


def secrets(text: Column) -> Column:
    one = lambda p, kind: F.struct(F.lit(kind).alias("type"), F.size(matches(text, p)).alias("n"))
    counts = F.filter(F.array(*[one(p, kind) for p, kind in SECRETS]), lambda x: x["n"] > 0)
    return when(F.size(counts) > 0, finding("T2_ACTIVE_CONTENT", "HIGH", "Secrets Detected", "The text holds keys or tokens.", F.struct(counts.alias("matches")), "detectors.secrets"))


def detect(config: Config, text: Column, meta: dict[str, Column], table: list[tuple[str, str]] | None = None, own: Iterable[Callable] = ()) -> Column:
    """All enabled detectors over a document, in their fixed order. ``meta``: values, comments (further texts for the instruction bank), hidden,
    hidden_tags, hex_blobs and, where known, docx_hidden, pages, encrypted, compression, density, similarity. ``table``: rules as (name,
    pattern). ``own``: further detectors, called with text, meta and config (``plugins.Detector``)."""
    parts = []
    if config.enable_embedded:
        parts.append(embedded_payload(text, meta["hex_blobs"]))
    if config.enable_dos and "pages" in meta:
        parts.append(excessive_pages(meta["pages"], config))
    if config.enable_metadata:
        parts.append(metadata_injection(meta["values"]))
    if config.enable_ats:
        parts.append(ats_manipulation(text, meta["hidden"], meta["hidden_tags"], meta.get("docx_hidden")))
    if config.enable_prompt_injection:
        parts.append(prompt_injection_all(text, meta["comments"], meta.get("similarity")))
    if config.enable_ranking_abuse:
        parts.append(keyword_stuffing(text))
    if config.enable_rules:
        parts.append(rules(text, table))
    if config.enable_pii:
        parts.append(personal(text))
    if config.enable_hidden_text:
        parts.append(hidden_text(F.concat(F.coalesce(meta["hidden"], F.array().cast("array<string>")), F.coalesce(meta["docx_hidden"], F.array().cast("array<string>"))) if "docx_hidden" in meta else meta["hidden"], config.allow_watermarks))
    if config.enable_obfuscation:
        parts.append(obfuscation(text, **{k: meta[k] for k in ("encrypted", "compression", "density") if k in meta}))
    if config.enable_secrets:
        parts.append(secrets(text))
    parts += [detector(text, meta, config).cast(NONE) for detector in own]
    return F.concat(*[F.coalesce(p, F.array().cast(NONE)) for p in parts]) if parts else F.array().cast(NONE)
