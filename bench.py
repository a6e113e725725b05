"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tickloom.plans import catalog
from tickloom.session import session

NAMES = (
    "g01_time_bars", "g05_volume_bars", "g08_dollar_bars", "w01_cumulative_sum", "w02_upsample", "f07_interpolate",
    "j03_asof", "j10_first_touch", "l01_triple_barrier", "l11_purged_folds", "t04_bands", "x17_drawdown",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    run = catalog.queries()
    times: dict[str, float] = {}
    for name in NAMES:
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.time()
            run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
