"""Headline queries, timed; prints one line of JSON."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from vocalis.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["lm_vocab_topk", "ngram_counts", "char_vocab", "clean_en", "punctcap_labels", "seg_merge_gap", "seg_expand_merge_label", "seg_merge_short", "label_transfer", "chunk_overlap", "int16_roundtrip", "ctc_greedy", "cer_by_lang", "clf_report", "der_overlap", "sw_align", "vad_segments"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["label_histogram"](spark, SF).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
