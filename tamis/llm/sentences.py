r"""Problem 9: sentences of subtitle texts in every language and script, all in SQL expressions.

The text is taken apart into lines. Runs of cue numbers, time lines, headers and line ends become one private-use character
that tells their length; in other lines, markup, speaker labels and dialogue dashes become a filler, and the ends of adverts
brackets of their own. Over the joined lines the ends of sound descriptions and song lines become such brackets, and dots
of decimals, addresses, initials and abbreviations, and ellipses inside a sentence, a placeholder. One tokenising
pattern then covers the masked text with blanks, such units, and sentences (quotations are atoms, each script has its
terminators, Thai ends at blanks). Starts are prefix sums of the tokens' lengths. All loops of the pattern are possessive,
so it runs in linear time and without recursion. Sentence texts are restored from the placeholders; those of texts that hold
private-use characters themselves, from the source.

Results: null, empty and wordless texts have no sentences; start_char counts code points from 0; what lies between
sentences belongs to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILL, ADLINE, DOT, OPEN, CLOSE = "\ue001", "\ue002", "\ue000", "\ue010", "\ue011"
#: One of these stands for a run of 1 to 255 characters of cue numbers, time lines, headers and line ends.
RUNS = "".join(chr(0xE101 + k) for k in range(255))
RUN = f"{RUNS[0]}-{RUNS[-1]}"
OWN = r"[\ue000-\ue1ff]"  # such characters of a text itself
SKIP = rf"\s{FILL}{RUN}\ufeff"
# Abbreviations that never end a sentence, that do so only before a capital, and that only stand before numbers.
NEVER = "Mr Mrs Ms Dr Prof Gen St Sgt Capt Col Lt Rev Hon Jr vs cf ca bzw usw vgl ggf evtl Hr Fr Frl Str Mio Mrd Tsd Sr Sra Srta Dra Dres Ud Uds ej av avda pág núm Mme Mlle Mgr г-н г-жа ул пл просп млн млрд тыс руб стр гл им см проф акад κ κα Δρ αρ σελ डॉ श्री श्रीमती पं د أ م".split()
SOMETIMES = "etc Inc Ltd Corp Co Bros approx dept est".split()
BEFORE_NUMBER = "No Nos Nr Vol Fig Figs Art Abs Bd Kap Ch Sec p pp vol fig no nr núm nº n°".split()
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
TIME_LINE = r"[O0-9][O0-9:.,]{5,}+[ \t]*+-{1,2}>[^\r\n]*+"
JUNK = rf"(?:[ \t\ufeff]|ï»¿|Ôªø|\ufffd|\?|Ã¯Â»Â¿)*+(?:\d++[ \t]*+|(?:WEBVTT|NOTE|STYLE|REGION)(?![^\s])[^\r\n]*+|{TIME_LINE})(?m:$)"
#: A run of junk lines, or another line, each with the line ends and blank lines after it.
LINES = rf"(?:(?m:^){JUNK}(?:[ \t]*+[\r\n]++)*+)++|[\r\n]++|[^\r\n]++(?:[\r\n]++(?:[ \t]++[\r\n]++)*+)?"
CAPITAL_NEXT = rf"[{SKIP}]*+(?:[\p{{Lu}}¿¡\"«“„{OPEN}]|\z)"
# What marks a line as an advert or a credit.
DOMAINS = "example test invalid com net org info tv io".split()
CREDITS = "subtitles subtitled synced corrected captions captioned ripped translated encoded resynced".split()


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


CREDIT = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in CREDITS)
ADVERT = rf"[.<*☆★🎬b](?:(?<=[\p{{L}}\d]\.)(?=(?:{_any(DOMAINS)})\b)|(?<=<)(?=\|endoftext\|>)|(?<=\*)(?=\*\*)|(?<=[☆★🎬])|(?<=(?:{CREDIT}) b)(?=y ))"
BLANK_START = rf"\A[ \t{FILL}\ufeff]*+"
UNFINISHED = rf"\A[^\r\n{OPEN}{ADLINE}]*+(?<=[^\r\n.!?…。！？।؟{OPEN}{FILL}{RUN}\s][ \t]{{0,2}})(?:\r\n|\r|\n)\z"
MARKUP = r"(?:[<{](?:(?<=<)(?=/?[A-Za-z][^<>\r\n]*+>)|(?<=\{)(?=\\[^{}\r\n]*+\}))|\G(?!\A)(?<![>}])[^\r\n])"
LABEL = rf"(?:\A(?=[ \t{FILL}\ufeff]*+(?:[-–—‐](?!>)[ ]?)?(?:\p{{Lu}}[\p{{Lu}}\p{{M}}\d'’.\-]++(?: \p{{Lu}}[\p{{Lu}}\p{{M}}\d'’.\-]*+)?:\s|[\p{{Lo}}\p{{Lm}}\p{{M}}]{{2,}}+[:：](?![ ]?«)))|\G(?!\A)(?<![:：]))[^\r\n]"
ADVERT_BEGIN = (rf"({BLANK_START})[^\s{FILL}{RUN}{OPEN}{CLOSE}]", rf"$1{OPEN}")
#: (pattern, replacement) in order over the whole text; each keeps the length, and begins with what few places can begin.
ADVERT_END = (rf"\A([^\r\n]*)[^\s{FILL}]([ \t{FILL}]*+)[\r\n]?", rf"$1{CLOSE}$2{ADLINE}")
MASKS = [
    (
        rf"[♪♫#\[(（［【*](?:(?<=(?:^|[\s{FILL}{RUN}])[♪♫#])([ ][^♪♫#\r\n{OPEN}]++)[♪♫#]|(?<=[\[(（［【])([^\[\]()（）［］【】{OPEN}{CLOSE}]++)[\])）］】]|(?<=\*)([^*\r\n{OPEN}{CLOSE}]++)\*)",
        rf"{OPEN}$1$2$3{CLOSE}",
    ),
    (
        rf"\.(?:(?<=\d\.)(?=\d| (?:{_any(MONTHS)})\b)|(?<=[\p{{L}}\d]\.)(?=\p{{L}}{{2}})|(?<=(?<![\p{{L}}\p{{M}}\d.])\p{{L}}\.)(?!\p{{L}}\.)|(?<=(?<![\p{{L}}\p{{M}}\d])(?:{_any(NEVER)})\.)(?!\.)"
        rf"|(?<=(?<![\p{{L}}\p{{M}}\d])(?:{_any(BEFORE_NUMBER)})\.)(?=[{SKIP}]*+\d)|(?<=(?<![\p{{L}}\p{{M}}])(?:{_any(SOMETIMES)}|(?:\p{{L}}\.){{1,3}}\p{{L}})\.)(?!{CAPITAL_NEXT})"
        rf"|(?:(?=[.…])|(?<=[.…]\.))(?=[.…]*+(?!{CAPITAL_NEXT})))",
        DOT,
    ),
]
THAI = r"\u0e01-\u0e3a\u0e40-\u0e5b"
#: A straight quotation mark opens a quotation before a character and not after a letter, and closes it after a character and not before a letter.
QUOTE = rf'(?<![\p{{L}}\p{{N}}])"(?=[^{SKIP}])[^"{OPEN}]++(?<=[^{SKIP}])"(?![\p{{L}}\p{{N}}])|«[^«»{OPEN}]++»|' + "|".join(rf"{a}(?=[^{SKIP}])[^{a}{b}{OPEN}]++[{b}]" for a, b in [("“", "”"), ("「", "」"), ("『", "』"), ("„", "“”")])
LAST_DOT = rf"\.(?=[{SKIP}\"”»’')\]」』{OPEN}]|\z)"
ASKS = r"[;;](?<=[Ͱ-Ͽἀ-῿»].)"
LAST_DOTS = rf"…(?=[.…]*+{CAPITAL_NEXT})"
BODY = rf"(?:(?!(?<=[{THAI}])[{SKIP}])[^{OPEN}{THAI}.!?…。！？।؟;;\"«“„「『]++|(?<![{SKIP}])[{THAI}]++|{QUOTE}|\.(?![{SKIP}\"”»’')\]」』{OPEN}]|\z)|(?!{ASKS})[;;]|(?!{LAST_DOTS})…|[\"«“„「『])"
ENDS = rf"(?:[!?。！？।؟]|{LAST_DOT}|\.(?=[.!?…])|{ASKS}|…)"
#: Each token takes the blanks after it; what holds no letter and no number is no sentence.
TOKEN = rf"(?s)[{SKIP}]++|(?:{OPEN}[^{CLOSE}]*+{CLOSE}|(?:[{THAI}]++{BODY}*+|{BODY}++)(?:{ENDS}++[\"”»’')\]」』]*+)?|[^{SKIP}])[{SKIP}]*+"
FOLD = 256  # tokens whose starts are added up in one fold


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _adverts(lines: Column) -> Column:
    """Brackets before the first and after the last character of adverts, with up to two unfinished lines of the cue before."""
    here = lambda k: F.coalesce(F.get(lines, k), F.lit(""))
    ends = lambda k: here(k).contains(ADLINE)
    leads = lambda k: here(k).rlike(UNFINISHED) & here(k + 1).rlike(rf"\A[^\s{FILL}{RUN}]") & ~ends(k)
    alone = lambda k: ~((k > 0) & leads(k - 1))
    begins = lambda k: (ends(k) & alone(k)) | (ends(k + 1) & leads(k) & alone(k)) | (ends(k + 2) & leads(k) & leads(k + 1))
    near = lambda k: ends(k) | ends(k + 1) | ends(k + 2)
    begun = lambda x: F.regexp_replace(x, F.lit(ADVERT_BEGIN[0]), F.lit(ADVERT_BEGIN[1]))
    mark = lambda x, k: F.when(near(k), F.replace(F.when(begins(k), begun(x)).otherwise(x), F.lit(ADLINE), F.lit("\n"))).otherwise(x)
    return F.when(F.exists(lines, lambda x: x.contains(ADLINE)), F.transform(lines, mark)).otherwise(lines)


def _lines(lines: Column) -> Column:
    """Lines, and runs of junk lines, with their fillers. Patterns are tried only on lines that hold their signs."""
    n = lambda x: F.length(x) - 1
    run = lambda x: F.concat(F.repeat(F.lit(RUNS[-1]), F.floor(n(x) / 255).cast("int")), F.substring(F.lit(RUNS), F.pmod(n(x), F.lit(255)) + 1, F.lit(1)))
    steps = [
        lambda x: F.when(x.rlike(rf"\A(?:{JUNK}|[\r\n])"), run(x)).when(x.contains("<") | x.contains("{"), F.regexp_replace(x, F.lit(MARKUP), F.lit(FILL))).otherwise(x),
        lambda x: F.when(x.contains(":") | x.contains("："), F.regexp_replace(x, F.lit(LABEL), F.lit(FILL))).otherwise(x),
        lambda x: F.when(x.rlike(rf"{BLANK_START}[-–—‐](?!>)"), F.regexp_replace(x, F.lit(rf"({BLANK_START})[-–—‐]"), F.lit(f"$1{FILL}"))).otherwise(x),
        lambda x: F.when(x.rlike(ADVERT), F.regexp_replace(x, F.lit(ADVERT_END[0]), F.lit(ADVERT_END[1]))).otherwise(x),
    ]
    for step in steps:
        lines = F.transform(lines, step)
    return let(lines, _adverts)


def masked(text: Column) -> Column:
    """The text with fillers and placeholders. Runs of junk lines and line ends are a character each (see ``extra``)."""
    own = F.when(text.rlike(OWN), F.regexp_replace(text, OWN, "\ufffc")).otherwise(text)
    mask = F.array_join(_lines(F.regexp_extract_all(own, F.lit(LINES), F.lit(0))), "")
    for pattern, replacement in MASKS:
        mask = F.regexp_replace(mask, F.lit(pattern), F.lit(replacement))
    return mask


def width(token: Column) -> Column:
    """Characters of the text that a piece of the masked text stands for."""
    runs = F.regexp_extract_all(token, F.lit(f"[{RUN}]"), F.lit(0))
    return F.length(token) + F.when(token.rlike(f"[{RUN}]"), F.aggregate(runs, F.lit(0), lambda s, c: s + F.ascii(c) - 0xE101)).otherwise(0)


def spans(mask: Column) -> Column:
    """array<struct<start, token>> of the sentences of a masked text. Starts are prefix sums, in folds of FOLD tokens."""
    is_sentence = lambda t: t.rlike(rf"[\p{{L}}\p{{N}}{OPEN}]")
    tokens = F.regexp_extract_all(mask, F.lit(TOKEN), F.lit(0))
    sized = F.transform(tokens, lambda t: F.struct(t.alias("t"), width(t).alias("n")))
    spot = "struct<start:int,token:string>"
    add = lambda s, x: F.struct(
        (s["at"] + x["n"]).alias("at"), F.when(is_sentence(x["t"]), F.array_append(s["found"], F.struct(s["at"].alias("start"), x["t"].alias("token")))).otherwise(s["found"]).alias("found")
    )
    parts = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda k: F.slice(all_, k * FOLD + 1, FOLD))
    inside = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spot}>").alias("found")), add)
    folded = lambda all_: F.transform(parts(all_), inside)
    join = lambda s, f: F.struct(
        (s["at"] + f["at"]).alias("at"), F.array_append(s["found"], F.transform(f["found"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["token"].alias("token")))).alias("found")
    )
    many = lambda all_: F.aggregate(folded(all_), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{spot}>>").alias("found")), join, lambda s: F.flatten(s["found"]))
    return let(sized, lambda all_: F.when(F.size(all_) > FOLD, many(all_)).when(F.size(all_) > 0, inside(all_)["found"]))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, sentence_no, start_char, n_chars, sentence (markup and time lines inside it taken out, blanks joined)."""
    flat = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_text"), F.col(text).rlike(OWN).alias("_own"), spans(masked(F.col(text))).alias("_spans"))
    found = flat.select(key, "_text", "_own", F.posexplode(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), F.regexp_replace(s["token"], rf"[{SKIP}]+$", "").alias("token")))).alias("sentence_no", "_s"))
    n, start, token = width(F.col("_s.token")), F.col("_s.start"), F.col("_s.token")
    whole = F.when(token.startswith(OPEN), F.concat(F.substring("_text", start + 1, F.lit(1)), F.substring(token, F.lit(2), F.length(token) - 2), F.substring("_text", start + n, F.lit(1)))).otherwise(token)
    restored = F.regexp_replace(F.translate(whole, DOT + FILL, "."), f"[{RUN}]+", " ")
    # texts with private-use characters of their own: what is no filler comes from the text itself
    kept = F.regexp_extract_all(token, F.lit(f"[{FILL}{RUN}]+|[^{FILL}{RUN}]+"), F.lit(0))
    take = lambda s, x: F.struct((s["at"] + width(x)).alias("at"), F.concat(s["out"], F.when(x.rlike(f"[{FILL}{RUN}]"), F.when(x.rlike(f"[{RUN}]"), " ").otherwise("")).otherwise(F.substring(F.col("_text"), s["at"] + 1, F.length(x)))).alias("out"))
    own = F.aggregate(kept, F.struct(start.alias("at"), F.lit("").alias("out")), take, lambda s: s["out"])
    sentence = F.when(F.col("_own"), own).otherwise(restored)
    return found.select(key, "sentence_no", start.alias("start_char"), n.alias("n_chars"), F.trim(F.regexp_replace(sentence, r"\s+", " ")).alias("sentence"))


def found(df: DataFrame) -> DataFrame:
    flat = df.where("text is not null").select("doc_id", spans(masked(F.col("text"))).alias("_s"))
    return flat.select("doc_id", F.explode(F.transform("_s", lambda s: s["start"])).alias("start_char"))
