"""Print the formatted physical plan of catalogue queries.

Usage: python tools/show_plans.py [sf_dir] name [name ...]
Shows PushedFilters / ReadSchema of the scans, join strategies chosen by
AQE, WindowGroupLimit (partial top-k) and exchanges.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans import load_all  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, _ = load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    for name in args or ["lines_first_dim"]:
        print(f"===== {name} =====")
        queries[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
