"""Print the physical plan tree (and scan details) of registered queries."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginscope.plans import QUERIES  # noqa: E402
from marginscope.session import get_spark  # noqa: E402


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark("local[8]", 8)
    for n in names:
        txt = formatted(QUERIES[n](spark, sf_dir))
        tree = txt.split("\n\n\n")[0]
        print(f"===== {n}")
        print(tree)
        for m in re.finditer(r"\(\d+\) Scan parquet.*?ReadSchema: [^\n]*", txt, re.S):
            block = m.group(0)
            pf = re.search(r"PushedFilters: ([^\n]*)", block)
            rs = re.search(r"ReadSchema: ([^\n]*)", block)
            print("   scan:", (pf.group(1) if pf else "-"), "|", rs.group(1))
        for m in re.finditer(r"Arguments: (SinglePartition[^\n]*|hashpartitioning[^\n]*|rangepartitioning[^\n]*)", txt):
            print("   exchange:", m.group(1)[:140])


if __name__ == "__main__":
    main()
