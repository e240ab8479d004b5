"""Timed tokens and subtitle blocks with their translations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalis.functions.arrays import interpolate_rounded
from vocalis.functions.text import collapse_spaces

#: Fixed value: where the last block ends.
LAST_END = 10000.0


def timed_tokens(text: Column, start: Column, end: Column) -> Column:
    """Structs (token, ts): the words of a text spread over its time, and a space at its end."""
    words = F.split(text, " ")
    times = interpolate_rounded(F.bround(start, 3), F.bround(end, 3), F.size(words))
    return F.concat(F.zip_with(words, times, lambda w, t: F.struct(w.alias("token"), t.alias("ts"))), F.array(F.struct(F.lit(" ").alias("token"), end.alias("ts"))))


def number_blocks(tokens: DataFrame, key: str, order: list[str], token: str, most: int = 50) -> DataFrame:
    """``block`` of each token, from 0: a block ends with the token that brings it over ``most`` characters.

    An ordered fold: a key's tokens pass through one task as a stream, of which one count is held. A null token has no characters.
    """
    rows = tokens.repartition(key).sortWithinPartitions(key, *order)
    at, what = tokens.columns.index(key), tokens.columns.index(token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        chars = block = 0
        for batch in batches:
            blocks = []
            for k, word in zip(batch.column(at).to_pylist(), batch.column(what).to_pylist(), strict=True):
                if current != (k,):
                    current, chars, block = (k,), 0, 0
                blocks.append(block)
                chars += len(word or "")
                if chars > most:
                    chars, block = 0, block + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int32())], names=[*batch.schema.names, "block"])

    return rows.mapInArrow(run, rows.withColumn("block", F.lit(0)).schema)


def subtitle_blocks(tokens: DataFrame, translated: DataFrame, key: str, most: int = 50) -> DataFrame:
    """``key, block, start, end, text, translation`` from two tables of ``key, pos, token, ts`` in order of pos.

    A block lasts until the next one begins; translated tokens belong to the block in whose time they are.
    """
    joined = lambda c: collapse_spaces(F.array_join(F.transform(F.array_sort(c), lambda x: x["token"]), " "))
    numbered = number_blocks(tokens.select(key, "pos", "token", "ts"), key, ["pos"], "token", most)
    blocks = numbered.groupBy(key, "block").agg(F.min_by("ts", "pos").alias("start"), joined(F.collect_list(F.struct("pos", "token"))).alias("text"))
    blocks = blocks.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("block")), F.lit(LAST_END)))
    # of blocks that begin together all but the last are empty, so the last one seen at a token's time is its block
    starts = blocks.select(key, F.col("start").alias("ts"), F.lit(0).alias("kind"), "block", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("token"))
    words = translated.select(key, "ts", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("block"), F.col("pos").cast("long").alias("pos"), "token")
    seen = F.last("block", ignorenulls=True).over(Window.partitionBy(key).orderBy("ts", "kind", "block").rowsBetween(Window.unboundedPreceding, 0))
    placed = starts.unionByName(words).withColumn("block", seen).filter(f"kind = 1 and block is not null and ts < {LAST_END}")
    texts = placed.groupBy(key, "block").agg(joined(F.collect_list(F.struct("pos", "token"))).alias("translation"))
    return blocks.join(texts, [key, "block"], "left").select(key, "block", "start", "end", "text", F.coalesce("translation", F.lit("")).alias("translation"))
