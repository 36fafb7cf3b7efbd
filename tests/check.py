"""Run registered queries against their SQL: python -m tests.check [--shuffle] [sf] [name ...].

``--shuffle`` switches broadcasting off, so every size check takes its large-data branch.
"""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as registered
from tests.oracle import connect, difference
from tradewell.session import local_session


def main(scale: str = "0.01", *names: str) -> int:
    folder = f"/root/testdata/sf{scale}"
    spark, connection = local_session(8), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    if "--shuffle" in sys.argv:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    queries, sql = registered.queries(), registered.oracle_sql()
    wrong = 0
    for name in names or queries:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            problem = difference(connection, frame, sql[name]) if name in sql else f"no sql, {frame.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:1200]
            if "-v" in sys.argv:
                traceback.print_exc()
        wrong += problem is not None and not problem.startswith("no sql")
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(main(*[a for a in sys.argv[1:] if not a.startswith("-")]))
