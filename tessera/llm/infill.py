"""Fill-in-middle transformation: texts are cut at two of their units' ends, and the pieces are put in another order.

Where a cut lies is found relationally. A text's matches are exploded with their positions, a block of ``BLOCK`` units
a match, so that a text makes few rows whatever its units are; running sums of the blocks' lengths and units over a
document say where each block begins; a cut asked for by the ordinal of a unit joins the block that has it; and what is
found is brought together for each document, where the last few units are counted off inside the block, and the text is
cut by ``substring``. Only lengths travel until then; texts move once, to meet their cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Patterns of units that tile every text: each code point; words with the white space before them; lines with their end.
CODE_POINT, WORD, LINE = r"(?s:.)", r"(?:\s*+\S++|\s++)", r"(?:[^\n]*+\n|[^\n]++)"
#: Units in a block.
BLOCK = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def has_marker(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def fill_in_middle(docs: DataFrame, cuts: Callable[[Column], tuple[Column, Column]], form: Column, unit: str = CODE_POINT, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n`` (units of the text), ``form``, ``prefix_chars``, ``middle_chars`` (code points, null if plain) and ``output``.

    ``cuts`` gives, from a column with the number of units, after how many of them the two cuts are, in any order; they are
    held between zero and that number, null being zero; they may use no column but ``doc_id``. ``form`` says ``psm`` or ``spm`` for
    each document; null or anything else is ``plain``, as are empty texts and those that hold a marker. ``unit`` is a pattern
    that, matched from left to right, must leave nothing of a text out, else the query fails.

    A null text is empty. Documents with the same id, null or not, are rows of their own; rows that are alike in id and text
    get the same cuts. Columns of ``docs`` that have the name of an added one are replaced. An empty table gives no rows.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in (*added, text)]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(doc_id).alias("_id"), form.alias("_form"))
    whole = whole.withColumns({"_h": F.xxhash64("_id", "_text"), "_g": F.xxhash64(F.lit(0x5EED), "_id", "_text")})
    key = ["_h", "_g"]

    parts = whole.filter("_text <> ''").select("_id", *key, F.length("_text").alias("_size"), F.regexp_extract_all("_text", F.lit(f"(?:{unit}){{1,{block}}}"), F.lit(0)).alias("_parts"))
    rows = parts.select("_id", *key, "_size", (F.size("_parts") - 1).alias("_last"), F.posexplode_outer("_parts").alias("_block", "_part"))
    rows = rows.withColumns({"_block": F.coalesce("_block", F.lit(0)), "_part": F.coalesce("_part", F.lit(""))})
    # all blocks but a text's last are full
    units = F.when(F.col("_block") < F.col("_last"), F.lit(block)).otherwise(F.regexp_count("_part", F.lit(unit)))
    # copies of a row are one from here on
    sizes = rows.select("_id", *key, "_size", "_block", F.length("_part").alias("_chars"), units.alias("_units")).groupBy("_id", *key, "_size", "_block").agg(F.max("_chars").cast("long").alias("_chars"), F.max("_units").cast("long").alias("_units"))
    doc = W.partitionBy("_id", *key, "_size")
    before = doc.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.select("_id", *key, "_block", "_chars", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_from"), F.sum("_units").over(doc).alias("n"), F.sum("_chars").over(doc).alias("_covered"), "_size")
    placed = placed.withColumn("n", F.when(F.col("_covered") == F.col("_size"), F.col("n")).otherwise(F.raise_error(F.lit(f"the unit {unit} leaves a part of a text out")).cast("long")))
    placed = written(placed.drop("_covered", "_size"))

    first, second = (F.least(F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0)), F.col("n")) for c in cuts(F.col("n")))
    asked = placed.filter("_block = 0").withColumn(doc_id, F.col("_id")).select(*key, "n", F.posexplode(F.array(F.least(first, second), F.greatest(first, second))).alias("_which", "_ordinal"))
    asked = asked.select(*key, "n", "_which", F.expr(f"cast(greatest(_ordinal - 1, 0) div {block} as int)").alias("_block"), (F.col("_ordinal") - F.expr(f"greatest(_ordinal - 1, 0) div {block}") * block).alias("_rest"))
    found = asked.join(placed.select(*key, "_block", "_from", "_chars"), [*key, "_block"])
    at = F.struct("_from", "_chars", "_rest")
    offsets = found.groupBy(*key).agg(F.max("n").alias("n"), F.max(F.when(F.col("_which") == 0, at)).alias("_a"), F.max(F.when(F.col("_which") == 1, at)).alias("_b"))

    def place(at: str) -> Column:
        """Code points before a cut: those of earlier blocks, and of the units before it in its own."""
        inside = F.slice(F.regexp_extract_all(F.substring(F.col("_text"), (F.col(f"{at}._from") + 1).cast("int"), F.col(f"{at}._chars").cast("int")), F.lit(unit), F.lit(0)), F.lit(1), F.col(f"{at}._rest").cast("int"))
        return F.col(f"{at}._from") + F.aggregate(inside, F.lit(0).cast("long"), lambda total, u: total + F.length(u))

    wanted = F.when((F.col("_text") == "") | has_marker(F.col("_text")) | ~F.coalesce(F.col("_form").isin(PSM, SPM), F.lit(False)), PLAIN).otherwise(F.col("_form"))
    met = whole.join(offsets, key, "left").withColumn("form", wanted)
    met = met.withColumns({"_p": place("_a"), "_q": place("_b")})
    prefix, middle, suffix = F.substring("_text", F.lit(1), F.col("_p").cast("int")), F.substring("_text", (F.col("_p") + 1).cast("int"), (F.col("_q") - F.col("_p")).cast("int")), F.substring("_text", (F.col("_q") + 1).cast("int"), F.length("_text"))
    plain = F.col("form") == PLAIN
    output = F.when(plain, F.col("_text")).when(F.col("form") == PSM, F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return met.select(
        *(F.col("_row").getField(c).alias(c) for c in kept), F.coalesce("n", F.lit(0)).alias("n"), "form", F.when(~plain, F.col("_p")).alias("prefix_chars"), F.when(~plain, F.col("_q") - F.col("_p")).alias("middle_chars"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No piece holds a marker, and none begins inside a marker, so each is found where it is."""
    head, middle = F.split(output, MIDDLE, 2)[0], F.get(F.split(output, MIDDLE, 2), F.lit(1))
    cut = F.split(head, F.when(form == PSM, F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), 2)
    one, two = F.substring(cut[0], F.lit(len(PREFIX) + 1), F.length(head)), F.get(cut, F.lit(1))
    return F.when(form == PSM, F.concat(one, middle, two)).when(form == SPM, F.concat(two, middle, one)).otherwise(output)
