"""``python -m evidencelake list`` and ``python -m evidencelake run NAME TABLES [--out PATH] [--limit N]``."""

from __future__ import annotations

import argparse

from evidencelake import plans, session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evidencelake", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("list", help="names of queries, * where SQL checks them")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(plans.QUERIES))
    run.add_argument("tables")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    if a.verb == "list":
        print("\n".join(f"{'*' if n in plans.ORACLE else ' '} {n}" for n in sorted(plans.QUERIES)))
        return 0
    df = plans.QUERIES[a.name](session.build(), a.tables)
    if a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
