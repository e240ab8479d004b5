"""Winnowed document fingerprints (operator 8), DataFrame functions only.

A text is lower-cased and cut into words at white space; each word is hashed, ``k`` neighbouring
hashes are rolled into a gram, and of each window of ``w`` grams the smallest is kept, the rightmost
of equals. Any run of ``w + k - 1`` equal words in two texts is sure to give a common gram. A kept
gram is one long: 37 bits of hash above 26 bits that count positions down, so the smallest long is
the smallest hash at its rightmost place, and the place can be read back.

Texts with fewer than ``k`` words have one gram of all their words; texts without words have an
empty fingerprint. A null text is an empty text. Rows with a null id are left out: they have no
place in the order of ids. Of rows that repeat an id the smallest text counts. Two empty
fingerprints are alike (1), an empty and another are not (0). A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.llm.workspace import partitions

PLACE_BITS = 26
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Rows of a range of ids, on average; ranges are windows of their own.
RANGE_ROWS = 4000


def grams(text: Column, k: int = 3) -> Column:
    """Hash and place of each gram as one long, in order."""
    hashes = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), lambda x: F.xxhash64(x))

    def pack(h: Column, i: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit((1 << 37) - 1)), PLACE_BITS).bitwiseOR(F.greatest(F.lit(LAST_PLACE) - i, F.lit(0)).cast("long"))

    def of(a: Column) -> Column:
        full = F.transform(F.slice(a, 1, F.greatest(F.size(a) - (k - 1), F.lit(0))), lambda x, i: pack(F.xxhash64(*(F.get(a, i + j) for j in range(k))), i))
        return F.when(F.size(a) >= k, full).when(F.size(a) > 0, F.array(pack(F.xxhash64(F.array_join(F.transform(a, lambda x: x.cast("string")), " ")), F.lit(0)))).otherwise(F.array().cast("array<long>"))

    return _let(hashes, of)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnow(text: Column, k: int = 3, w: int = 4) -> Column:
    """The kept grams of a text, in order of their first window."""

    def of(g: Column) -> Column:
        windows = F.transform(F.slice(g, 1, F.greatest(F.size(g) - (w - 1), F.lit(0))), lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, w))))
        return F.when(F.size(g) >= w, F.array_distinct(windows)).when(F.size(g) > 0, F.array(F.array_min(g))).otherwise(g)

    return _let(grams(text, k), of)


def gram_hash(kept: Column) -> Column:
    return F.transform(kept, lambda x: F.shiftright(x, PLACE_BITS))


def fingerprint_text(kept: Column) -> Column:
    """``hash@place`` of each kept gram, separated by spaces."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, PLACE_BITS))), F.lit("@"), (F.lit(LAST_PLACE) - x.bitwiseAND(F.lit(LAST_PLACE))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' hashes."""
    both = F.size(F.array_intersect(gram_hash(a), gram_hash(b)))
    either = F.size(F.array_union(gram_hash(a), gram_hash(b)))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document and the text that follows it in ascending order of ids, the first after the last.

    Ids are cut into ranges at percentiles; each range is a window, and the first document of a
    range is sent to the range before it as well.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    stats = rows.agg(F.count(F.lit(1)).alias("n")).first()
    ranges = max(64, min(100_000, stats["n"] // RANGE_ROWS * 4))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    # at most as many numbers as there are ranges; the search is a binary one in the JVM
    bounds = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    if cuts:
        low, step = F.lit(0), 1 << (len(cuts).bit_length() - 1)
        while step:
            low = low + F.when(F.coalesce(F.get(bounds, low + step - 1) <= F.col("doc_id"), F.lit(False)), step).otherwise(0)
            step >>= 1
            rows = rows.withColumn("part", low)
            low = F.col("part")
    else:
        rows = rows.withColumn("part", F.lit(0))
    # a row for each range
    first = rows.groupBy("part").agg(F.min("doc_id").alias("first")).withColumn("one", F.lit(1))
    order = Window.partitionBy("one").orderBy("part")
    last = F.max("part").over(Window.partitionBy("one"))
    sent = first.select(F.col("first").alias("doc_id"), F.coalesce(F.lag("part").over(order), last).alias("to"))
    sent = sent.groupBy("doc_id").agg(F.max("to").alias("to"))
    both = rows.join(F.broadcast(sent), "doc_id", "left").select(
        "doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("part", F.lit(False).alias("tail")))).otherwise(F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(F.col("to").alias("part"), F.lit(True).alias("tail"))))).alias("p")
    )
    dealt = both.select("doc_id", "text", "p.part", "p.tail").repartition(partitions(spark), "part")
    return dealt


def fingerprint_documents(df: DataFrame, k: int = 3, w: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of edited ones, whose last quarter is the next document's beginning.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    dealt = with_next(df, id_col, text_col).withColumn("kept", winnow(F.col("text"), k, w))
    order = Window.partitionBy("part").orderBy("tail", "doc_id", "text")
    same = F.lag("doc_id").over(order)
    once = dealt.withColumn("again", F.coalesce((same == F.col("doc_id")) & ~F.col("tail"), F.lit(False))).filter(~F.col("again"))
    # a tail that repeats the range's only document still follows it
    nexts = once.select("doc_id", "text", "kept", "tail", F.lead("text").over(order).alias("next_text"), F.lead("kept").over(order).alias("next_kept")).filter(~F.col("tail"))
    n = F.length("text")
    edited = nexts.select(
        "doc_id", "kept", F.coalesce("next_kept", "kept").alias("next_kept"), n.alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring(F.coalesce("next_text", "text"), F.lit(1), F.floor(n / 4).cast("int"))).alias("edited"),
    )
    both = edited.select("doc_id", "kept", "next_kept", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), winnow(F.col("edited"), k, w).alias("edited_kept"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("kept")).alias("fingerprint"), fingerprint_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )
