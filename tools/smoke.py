"""Run every query on one scale factor and list errors and times.

usage: python tools/smoke.py sf_dir [name-prefix ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tapeloom.plans.catalog import QUERIES  # noqa: E402
from tapeloom.session import local_session  # noqa: E402


def main() -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, fn in QUERIES.items():
        if sys.argv[2:] and not any(name.startswith(w) for w in sys.argv[2:]):
            continue
        t0 = time.time()
        try:
            fn(spark, sys.argv[1]).write.format("noop").mode("overwrite").save()
            print(f"{time.time() - t0:6.1f} {name}", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:300]!r}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
