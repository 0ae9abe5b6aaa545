"""Registered queries of the text operators: queries() and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.session import load


def p1_found(spark, sf_dir):
    from tamis.llm import pii

    return pii.found(load(spark, sf_dir, "parsed_document"), load(spark, sf_dir, "name_list"))


def p1_redacted(spark, sf_dir):
    from tamis.llm import pii

    return pii.redacted(load(spark, sf_dir, "parsed_document"), load(spark, sf_dir, "name_list"))


def p2_found(spark, sf_dir):
    from tamis.llm import repetition

    return repetition.found(load(spark, sf_dir, "parsed_document"))


def p2_share(spark, sf_dir):
    from tamis.llm import repetition

    return repetition.repetition(load(spark, sf_dir, "parsed_document")).select("parsed_id", "n_words", F.round("share", 6).alias("share"))


def p2_score(spark, sf_dir):
    """The trees' estimate of the share, beside the share."""
    from tamis.llm import repetition

    return repetition.repetition(load(spark, sf_dir, "parsed_document")).select("parsed_id", F.round("score", 4).alias("score"), F.round("share", 6).alias("share"))


def p3_found(spark, sf_dir):
    from tamis.llm import mojibake

    return mojibake.found(load(spark, sf_dir, "parsed_document"))


def p3_restored(spark, sf_dir):
    from tamis.llm import mojibake

    return mojibake.affected(load(spark, sf_dir, "parsed_document")).select("parsed_id", "field", "restored", F.array_join("chains", ",").alias("chains"), "complete")


def p4_found(spark, sf_dir):
    from tamis.llm import chunking

    return chunking.found(load(spark, sf_dir, "parsed_document"))


def p4_pieces(spark, sf_dir):
    from tamis.llm import chunking

    return chunking.split_texts(load(spark, sf_dir, "parsed_document"))


def p4_files(spark, sf_dir):
    """The texts written one after the other into a few large files of the shared folder, and these files cut in ranges."""
    import uuid

    from tamis.functions.session import checkpoint_dir
    from tamis.llm import chunking

    folder = f"{checkpoint_dir(spark)}/p4-files-{uuid.uuid4()}"
    load(spark, sf_dir, "parsed_document").where("text is not null").select("text").write.option("lineSep", "\n\n").text(folder)
    pieces = chunking.split_files(spark, folder)
    return pieces.withColumn("path", F.substring_index("path", "/", -1)).withColumn("path", F.regexp_extract("path", r"part-\d+", 0))


def p5_found(spark, sf_dir):
    from tamis.llm import neardup

    return neardup.found(load(spark, sf_dir, "parsed_document"))


def p5_groups(spark, sf_dir):
    from tamis.llm import neardup

    return neardup.NearDuplicates(load(spark, sf_dir, "parsed_document"), t=0.6, width=3).groups().withColumnRenamed("id", "parsed_id")


def p7_ids(spark, sf_dir):
    from tamis.llm import bpe

    return load(spark, sf_dir, "documents").select("doc_id", bpe.token_ids(spark, F.col("text")).alias("ids"))


def p8_mix(spark, sf_dir):
    from tamis.llm import mixing

    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark, sf_dir):
    from tamis.llm import mixing

    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))[1]


def p8_temperature(spark, sf_dir):
    """Token shares with the exponent that keeps every source of the targets within its repeats."""
    from tamis.llm import mixing

    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"), use_targets=False)[1]


def p9_found(spark, sf_dir):
    from tamis.llm import sentences

    return sentences.found(load(spark, sf_dir, "documents"))


def p9_sentences(spark, sf_dir):
    from tamis.llm import sentences

    return sentences.sentences(load(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[1 : f.__name__.index("_")]))}


_PUNCTUATION = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDS = "SELECT parsed_id, list_filter(regexp_split_to_array(translate(lower(text), {}', ''), '[ \\t\\r\\n]+'), lambda w: w <> '') AS w FROM parsed_document WHERE text IS NOT NULL"
_SHARE = f"""WITH x AS ({_WORDS.format(_PUNCTUATION + "0123456789")}), g AS (SELECT parsed_id, i, w[i : i + 5] AS g FROM (SELECT parsed_id, w, unnest(range(1, len(w) - 4)) AS i FROM x)),
r AS (SELECT parsed_id, i FROM (SELECT parsed_id, i, row_number() OVER (PARTITION BY parsed_id, g ORDER BY i) AS k FROM g) WHERE k > 1),
c AS (SELECT parsed_id, count(DISTINCT i + o.o) AS n FROM r, (SELECT unnest(range(6)) AS o) o GROUP BY 1)
SELECT p.parsed_id, coalesce(len(x.w), 0)::INT AS n_words, coalesce(round(c.n / len(x.w), 6), 0.0)::DOUBLE AS share FROM (SELECT parsed_id FROM parsed_document) p LEFT JOIN x USING (parsed_id) LEFT JOIN c USING (parsed_id)"""

ORACLE: dict[str, str] = {
    "p2_share": _SHARE,
    "p2_found": f"SELECT DISTINCT parsed_id FROM ({_SHARE}) WHERE n_words >= 30 AND share >= 0.4",
    "p4_found": "SELECT DISTINCT parsed_id FROM parsed_document WHERE length(text) > 4000",
    "p5_found": f"""WITH x AS ({_WORDS.format(_PUNCTUATION)}), s AS (SELECT DISTINCT parsed_id, w[i : i + 2] AS g FROM (SELECT parsed_id, w, unnest(range(1, len(w) - 1)) AS i FROM x WHERE len(w) >= 20)),
n AS (SELECT parsed_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.parsed_id AS a, b.parsed_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.parsed_id < b.parsed_id GROUP BY 1, 2)
SELECT p.a AS parsed_id_a, p.b AS parsed_id_b FROM p JOIN n x ON p.a = x.parsed_id JOIN n y ON p.b = y.parsed_id WHERE c / (x.n + y.n - c) >= 0.6""",
}
