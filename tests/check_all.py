"""Check every registered query against its SQL: ``python tests/check_all.py SF_DIR [name part...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from spanloom.session import build_session  # noqa: E402


def main(sf_dir: str, parts: list[str]) -> int:
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        begun = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                verdict = difference(df, con, sqls[name]) or "ok"
            else:
                verdict = f"ok (no SQL, {df.count()} rows)"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad += not verdict.startswith("ok")
        print(f"{name:28s} {time.time() - begun:6.2f}s  {verdict}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
