"""Headline queries, one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofloom.catalog import queries  # noqa: E402
from proofloom.catalog.views import latin_elements, table, zh_elements  # noqa: E402
from proofloom.operators import detectors as D  # noqa: E402
from proofloom.plans import qa  # noqa: E402
from proofloom.session import configure, local_session  # noqa: E402
from proofloom.sources.lexicon import builtin_lexicon  # noqa: E402

HEADLINE = [
    "D1_qa_report", "I13_number_format", "I19_timeline", "C4_citation_ref_join", "A8_segment_html_qa", "D20_admin_token_daily",
    "E23_redeem_codes", "K7_plan_audit", "D22_chunk_hash", "E18_quota_admission", "C18_near_dup_issues", "E16_pack_chunks", "A5_segment_markdown",
    "E12_structure_classify", "I26_xref_issues", "D12_xref_summary", "C5_adoptable_refs", "G1_merge_reports",
]


def run(df) -> None:
    """Compute every row and column without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


class Times(dict):
    """Seconds per query; progress goes to stderr."""

    def __setitem__(self, name: str, seconds: float) -> None:
        print(name, seconds, file=sys.stderr, flush=True)
        super().__setitem__(name, seconds)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = configure(local_session(int(os.environ.get("BENCH_CPUS", "8"))))
    run(table(spark, sf, "region"))
    all_queries, times = queries(), Times()
    rules = list(D.TEXT_RULES.values())
    # Every element rule in one pass: over the documents, and over the Chinese lines.
    times["text_rules_documents"] = timed(lambda: run(D.detect(latin_elements(spark, sf), *rules)))
    zh = zh_elements(spark, sf).persist()
    times["elements_zh"] = timed(zh.count)
    times["text_rules_zh"] = timed(lambda: run(D.detect(zh, *rules)))
    times["typo_and_format_check_zh"] = timed(lambda: run(qa.check(zh, ("typo", "format"), builtin_lexicon(spark))))
    lines = zh.selectExpr("sum(length(content)) AS n").first().n
    zh.unpersist()
    for name in HEADLINE:
        times[name] = timed(lambda: run(all_queries[name](spark, sf)))
    docs = table(spark, sf, "documents").selectExpr("sum(length(text)) AS n").first().n
    rate = {"documents": round(docs / times["text_rules_documents"]), "zh_rules": round(lines / times["text_rules_zh"]), "zh_typo_and_format": round(lines / times["typo_and_format_check_zh"])}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "chars_per_sec": rate}))


if __name__ == "__main__":
    main()
