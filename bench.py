"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then timed (best of ``$BENCH_RUNS``), its whole result written to nowhere. The
sixteen search workloads of the published baseline are run against a stored index, whose build is timed the same way.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "search_filter_newest", "search_text_bm25", "search_text_default_fields", "search_text_date", "search_text_label", "search_text_mime_family", "search_phrase", "search_address_tokens",
    "search_attachment_with", "search_attachment_without", "index_postings", "index_rows", "snapshot_diff_actions", "record_inventory", "claim_orphan_classification", "recovery_plan", "interval_overlap_semi",
    "corpus_stats", "dedup_economics", "nearest_rank_by_group", "mime_messages", "dsn_classify", "html_text", "html_evidence_signals", "cas_reconstruct", "feed_last_run_wins", "contiguous_ids", "segment_bins",
]


def workloads() -> dict:
    from lettermill.operators.search import SearchRequest
    from lettermill.plans.views import START_MS

    day = 86_400_000
    window = {"date_from": START_MS + 100 * day, "date_to": START_MS + 1600 * day}
    text = {"text": "body:the"}
    return {
        "text_frequent": SearchRequest(**text), "text_rare": SearchRequest(text="body:apache"), "date_selective": SearchRequest(**window), "attachment": SearchRequest(attachment="with"),
        "without_attachment": SearchRequest(attachment="without"), "mime_image": SearchRequest(mime="image/*"), "mime_pdf": SearchRequest(mime="application/pdf"), "label_starred": SearchRequest(labels=("STARRED",)),
        "label_work": SearchRequest(labels=("fr",)), "sender_frequent": SearchRequest(sender="src0@mail.example"), "sender_fragment": SearchRequest(sender="mail"), "text_date": SearchRequest(**text, **window),
        "text_attachment": SearchRequest(**text, attachment="with"), "text_mime": SearchRequest(**text, mime="application/pdf"), "text_label": SearchRequest(**text, labels=("STARRED",)), "no_result": SearchRequest(text="body:zzzzneverthere"),
    }


def main() -> None:
    from lettermill.operators.fulltext_index import FulltextIndex
    from lettermill.operators.stored_index import StoredIndex
    from lettermill.plans import registry
    from lettermill.plans.views import messages
    from lettermill.session import local_session

    spark = local_session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}

    def best(run) -> float:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        return round(min(times[1:]), 4)

    for name in HEADLINE:
        seconds[name] = best(lambda name=name: queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    docs = messages(spark, FOLDER, all_cores=True)
    folder = tempfile.mkdtemp(prefix="lettermill-bench-")
    seconds["index_build"] = best(lambda: StoredIndex.write(docs, folder))
    messages_per_second = round(docs.count() / seconds["index_build"])
    index = StoredIndex(spark, folder)
    words = tempfile.mkdtemp(prefix="lettermill-bench-")
    seconds["fulltext_build"] = best(lambda: FulltextIndex.write(docs, words))
    fulltext = FulltextIndex(spark, words)
    for name, text in {"phrase": 'body: "apache license"', "prefix": "apach*", "near": "NEAR(apache version, 3)", "and": "license AND apache"}.items():
        seconds[f"fulltext_{name}"] = best(lambda text=text: fulltext.search(text).collect())
    seconds["workloads_as_one_job"] = best(lambda: index.search_all(workloads()).collect())
    for name, request in workloads().items():
        seconds[f"workload_{name}"] = best(lambda request=request: index.search(request).collect())
    shutil.rmtree(folder)
    shutil.rmtree(words)
    sf = re.search(r"sf([0-9.]+)", FOLDER)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None, "index_build_messages_per_second": messages_per_second}))
    spark.stop()


if __name__ == "__main__":
    main()
