"""Command line form of the comparison: ``python tests/check.py sf0.01 [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from isoreach.registry import load  # noqa: E402
from isoreach.session import local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    entries = load()
    wanted = [n for n in entries if any(n.startswith(a) for a in sys.argv[2:])] or list(entries)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in wanted:
        item, start = entries[name], time.time()
        try:
            df = item.run(spark, sf_dir)
            if item.sql is None:
                result = f"rows only: {df.count()}"
            else:
                diff = difference(df, con, item.sql)
                result = "ok" if diff is None else "DIFF " + diff
        except Exception:
            result = "ERROR " + traceback.format_exc()[-900:]
        bad += result.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {result[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
