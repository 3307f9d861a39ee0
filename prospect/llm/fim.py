"""Fill-in-middle: texts cut into prefix, middle and suffix at line ends, and put in another order.

Relational units: a text's lines are exploded with their ordinals; a running sum
over them tells where each ends; requests for two cuts a document are joined by
ordinal; their offsets, gathered per document, give the three parts by
``substring``. The texts are dealt out once, by document, and lines, sums and
requests stay where their document is, so nothing else is shuffled.

Where to cut, and in which order, follows from the id and a seed: h1 to h4 are the
first four groups of eight digits of the hexadecimal SHA-256 of ``seed:id``.

Edge cases: a null text is empty; an empty text, and one that has a marker in it,
stay plain; a very long line or text is cut like any other; a null id counts as an
empty one; repeated rows are cut alike, and come as often as they came; empty tables
give no rows. Columns besides ``doc_id`` and ``text`` are ignored by ``transform``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A unit: a line with its end, or what follows the last one.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 7, 100, 50


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def dealt(docs: DataFrame) -> DataFrame:
    """(_id, _text, _key) of each row, dealt out by a digest of id and text.

    Rows that agree in both are cut alike, so they need no number of their own,
    and a task that runs again deals its rows out as before.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("\n"), "_text"), 256))
    return rows.withColumn("_key", F.coalesce(key, F.lit(b""))).repartition("_key")  # never null, so that joins need no filter


def ends(rows: DataFrame) -> DataFrame:
    """(_key, unit, end): where each unit ends, in code points, units numbered from 1.

    Of repeated rows each unit comes as often as the row. Such ties share a place in
    the sum, which counts each copy: ``cuts`` divides by them.
    """
    units = rows.select("_key", "_id", F.posexplode(F.regexp_extract_all("_text", F.lit(UNIT), 0)).alias("unit", "match"))
    text = Window.partitionBy("_key", "_id").orderBy("unit").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return units.select("_key", (F.col("unit") + 1).cast("long").alias("unit"), F.sum(F.char_length("match").cast("long")).over(text).alias("end"))


def requests(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(_asked, n, copies, first, second): the ordinals of the units that end the prefix and the middle of each text."""
    each = rows.groupBy("_key", "_id").agg(F.first(F.regexp_count("_text", F.lit(UNIT))).cast("long").alias("n"), F.count("*").alias("copies"))
    h1, h2, _, _ = draws(F.col("_id"), seed)
    units = F.col("n") + 1
    return each.select(F.col("_key").alias("_asked"), "n", "copies", F.least(h1 % units, h2 % units).alias("first"), F.greatest(h1 % units, h2 % units).alias("second"))


def cuts(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(_asked, n, prefix_end, middle_end): the two offsets of each text."""
    asked, found = requests(rows, seed), ends(rows)
    # equal by document, which both are dealt out by; ordinals are compared where they meet
    met = asked.join(found, (F.col("_asked") == F.col("_key")) & F.col("unit").isin(F.col("first"), F.col("second")), "left")

    def offset(which):
        return F.coalesce((F.max(F.when(F.col("unit") == F.col(which), F.col("end"))) / F.first("copies")).cast("long"), F.lit(0).cast("long"))

    return met.groupBy("_asked").agg(F.first("n").alias("n"), offset("first").alias("prefix_end"), offset("second").alias("middle_end"))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of every row."""
    rows = dealt(docs)
    _, _, h3, h4 = draws(F.col("_id"), seed)
    text = F.col("_text")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    cut = rows.join(cuts(rows, seed).hint("shuffle_hash"), F.col("_key") == F.col("_asked")).select("_id", "_text", "n", "prefix_end", "middle_end", form.alias("form"))
    start, middle = F.col("prefix_end").cast("int"), (F.col("middle_end") - F.col("prefix_end")).cast("int")
    head, mid, tail = text.substr(F.lit(1), start), text.substr(start + 1, middle), text.substr(F.col("middle_end").cast("int") + 1, F.char_length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), mid))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), mid))
        .otherwise(text)
    )
    moved = F.col("form") != "plain"
    return cut.select(
        F.col("_id").alias("doc_id"), text.alias("text"), "n", "form",
        F.when(moved, F.col("prefix_end")).alias("prefix_chars"), F.when(moved, F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts, between the markers, in their old order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """The rows of ``transform`` with digests in place of texts."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
