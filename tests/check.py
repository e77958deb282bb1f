"""Compare registered queries with their SQL: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

_TESTS = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(_TESTS), _TESTS]

import importlib

import oracle
from eventfold import registry
from eventfold.session import build_session


def main():
    args = sys.argv[1:]
    mods = [a[1:] for a in args if a.startswith("+")]
    sf = next((a for a in args if a.startswith("0.")), "0.01")
    names = [a for a in args if not a.startswith(("0.", "+"))]
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if mods:
        for m in mods:
            importlib.import_module(f"eventfold.registry.{m}")
    else:
        registry.load_all()
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle.connect(sf_dir)
    bad = 0
    for name in names or list(registry.RUNS):
        t = time.time()
        try:
            if name in registry.SQL:
                diff = oracle.compare(spark, con, registry.RUNS[name], registry.SQL[name], sf_dir)
                word = "ok" if diff is None else "DIFF"
            else:
                n = registry.RUNS[name](spark, sf_dir).count()
                diff, word = (None, f"rows={n}") if n else ("no rows", "DIFF")
        except Exception as e:  # noqa: BLE001
            diff, word = f"{type(e).__name__}: {str(e)[:1500]}", "FAIL"
        bad += diff is not None
        print(f"{word:6} {name} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)


main()
