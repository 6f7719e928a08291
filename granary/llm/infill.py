"""Fill-in-middle transformation, told with relations.

The units of a text (words with the white space before them, and white space at the end)
are exploded with their ordinals; a running sum of their lengths, in a window over the
text, gives where each ends; the two cuts that a document asks for are joined by ordinal;
their offsets are gathered again for each document, which is then cut by substring.

Texts that stay plain need no units beyond their count and take no part in this. The
others are dealt once, by a key of 128 bits over id and text: units, window, join and
aggregate all keep that dealing, so no unit is ever shuffled. Copies under several ids
have a key each. Equal rows share one, so it also has the number of the part of the scan
that they stand in: repeats are cut once a part and spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the decimal id; a null id has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def cut_offsets(rows: DataFrame) -> DataFrame:
    """Rows (k1, k2, n, lo, hi, text, ...), dealt by (k1, k2): columns from_lo and from_hi added, the code points in the first lo and hi units."""
    keys = ["k1", "k2"]
    asked = rows.dropDuplicates([*keys, "doc_id"])  # with the id, all branches read the one exchange
    lengths = asked.select(*keys, F.posexplode(F.transform(units(F.col("text")), F.length)).alias("pos", "length"))
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = lengths.select(*keys, (F.col("pos") + 1).alias("ordinal"), F.sum("length").over(so_far).alias("end"))
    cuts = asked.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "lo", "hi")
    at_cut = (F.col("ordinal") == F.col("lo")) | (F.col("ordinal") == F.col("hi"))
    met = ends.join(cuts, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & at_cut)
    offsets = met.groupBy(*keys).agg(*[F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))).alias(f"from_{c}") for c in ("lo", "hi")])
    found = rows.join(offsets, keys, "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("from_lo", "from_hi")})  # no unit before the cut, no row


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of ``docs``.

    n counts units. Prefix and middle end after whole units, drawn from the seed and the
    id; ``percent`` of the documents are cut, ``spm_percent`` of those with the suffix
    first. Texts that are empty or hold a mark stay plain. Lengths are in code points,
    null where plain.

    A null text counts as empty. Rows with a null id all draw alike, and are cut each by
    its own text. Repeated rows come out each. Extra columns are ignored. An empty table
    gives an empty result. Units have no bound in length or number; those of one text are
    summed in one task.
    """
    kind = docs.schema[id_col].dataType
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("text"))
    h = draws(F.col("doc_id"), seed)
    plain = (F.col("text") == "") | F.greatest(*[F.instr("text", m) for m in MARKS]).cast("boolean") | (h[2] % 100 >= percent)
    none = F.lit(None).cast("long")
    left = rows.where(plain).select("doc_id", F.size(units(F.col("text"))).cast("long").alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    part = F.spark_partition_id()
    keyed = rows.where(~plain).select("doc_id", "text", F.xxhash64("doc_id", part, "text").alias("k1"), F.xxhash64("text", F.lit(1), part, "doc_id").alias("k2"))
    dealt = keyed.repartition("k1", "k2")
    dealt = dealt.withColumn("n", F.size(units(F.col("text"))).cast("long"))
    first, second = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    cut = cut_offsets(dealt.withColumns({"lo": F.least(first, second), "hi": F.greatest(first, second)}))
    a, b = F.col("from_lo"), F.col("from_hi")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    spm = h[3] % 100 < spm_percent
    output = F.when(spm, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    form = F.when(spm, F.lit("spm")).otherwise(F.lit("psm"))
    moved = cut.select(F.col("doc_id").cast(kind), "n", form.alias("form"), a.cast("long").alias("prefix_chars"), (b - a).cast("long").alias("middle_chars"), output.alias("output"))
    return left.union(moved)


def restore(output: Column, form: Column) -> Column:
    """The text behind an output, read at its marks alone."""
    part = F.split(output, "<[PSM]>", -1)
    at = [F.get(part, k) for k in (1, 2, 3)]
    return F.when(form == "plain", output).when(form == "psm", F.concat(at[0], at[2], at[1])).otherwise(F.concat(at[1], at[2], at[0]))


def op11_infill(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    restored = F.sha2(restore(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce("text", '') AS txt, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce("text", ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN txt = '' OR contains(txt, '<P>') OR contains(txt, '<S>') OR contains(txt, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle,
    array_to_string(units[hi + 1:], '') AS suffix FROM formed
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN txt WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(txt) AS restored_sha256
FROM made
"""
