"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
tables and the local cores. Every query runs whole; its rows go to a sink that
discards them. `--sql` adds the seconds the check SQL takes in DuckDB.
"""

from __future__ import annotations

import json
import os
import sys
import time

from evalweave.plans import all_oracle_sql, all_queries
from evalweave.session import get_session

HEADLINES = (
    "pass_at_n",
    "slot_stats",
    "sample_records",
    "substitute_statement",
    "merge_rank_outputs",
    "src_mixture",
    "first_turn",
    "split_fraction",
    "vocabulary",
    "tokens_via_vocab",
    "pack_sequences",
    "pack_sequences_global",
    "pad_batch",
    "mask_noise",
    "weight_cart",
    "mc_loglik",
    "remaining_edits",
    "token_confidence",
    "reveal_dynamic",
    "reward_math",
    "reward_code",
    "group_advantage",
    "gen_metrics_ratios",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus, int(cpus) if cpus.isdigit() else 8, "16g")
    queries = all_queries()
    queries["src_all_configs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "--sql" in sys.argv:
        out["sql"] = sql_times(sf_dir)
    print(json.dumps(out))


def sql_times(sf_dir: str) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    sql, out = all_oracle_sql(), {}
    for name in HEADLINES:
        start = time.perf_counter()
        con.execute(sql[name]).fetchall()
        out[name] = round(time.perf_counter() - start, 3)
    return out


if __name__ == "__main__":
    main()
