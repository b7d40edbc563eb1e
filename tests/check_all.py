"""Compare every query with its SQL: ``python tests/check_all.py SF_DIR [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as E  # noqa: E402
from codegauge.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(sf_dir, names):
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = E.queries(), E.oracle_sql()
    con = connect(sf_dir)
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            ok, note = compare(df, con, sql[name]) if name in sql else (True, f"{len(df.collect())} rows, no SQL")
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
