"""Compare this package's queries with their SQL: python tests/llm/check.py [sf] [name ...]"""

import os
import sys
import time

_TESTS = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [os.path.dirname(_TESTS), _TESTS]

import oracle  # noqa: E402

from eventfold.llm import registry  # noqa: E402
from eventfold.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = next((a for a in args if a.startswith("0.")), "0.001")
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle.connect(sf_dir)
    for name in [a for a in args if not a.startswith("0.")] or list(registry.SQL):
        t = time.time()
        diff = oracle.compare(spark, con, registry.RUNS[name], registry.SQL[name], sf_dir)
        print("ok" if diff is None else "DIFF", name, f"{time.time() - t:.1f}s", diff or "", flush=True)


main()
