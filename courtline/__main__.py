"""Command line: the start-up build and the dashboard data, as Spark jobs.

  python -m courtline build  --data DIR --out DIR [--skip-failed] [--set-aside] [--multi-line]
  python -m courtline stints --out DIR --dest DIR [--team NAME]
  python -m courtline scout  --out DIR --dest DIR
  python -m courtline coach  --out DIR --dest DIR --team NAME

``build`` loads the JSON sources (typed, key-checked) into Parquet under
``--out/tables`` and writes the derived tables under ``--out/derived``.  The
other commands write their result as JSON Lines to ``--dest``.
"""

from __future__ import annotations

import argparse
import os

from courtline.plans import build, serving
from courtline.session import build_session
from courtline.sources import ingest


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="courtline")
    ap.add_argument("command", choices=["build", "stints", "scout", "coach"])
    ap.add_argument("--data")
    ap.add_argument("--out", required=True)
    ap.add_argument("--dest")
    ap.add_argument("--team")
    ap.add_argument("--skip-failed", action="store_true")
    ap.add_argument("--set-aside", action="store_true", help="store bad records apart instead of failing")
    ap.add_argument("--multi-line", action="store_true", help="each JSON file is one document")
    ap.add_argument("--master")
    ap.add_argument("--cluster", action="store_true")
    args = ap.parse_args(argv)

    spark = build_session(args.master, cluster=args.cluster)
    tables_dir = os.path.join(args.out, "tables")
    derived_dir = os.path.join(args.out, "derived")
    if args.command == "build":
        frames, status = ingest.load_tables(spark, args.data, out_dir=tables_dir,
                                            skip_failed=args.skip_failed,
                                            multi_line=args.multi_line, set_aside=args.set_aside)
        status.show(truncate=False)
        for name, path in build.build_all(spark, frames, derived_dir).items():
            print(name, path)
        return
    team = ingest.stored_rows(spark, tables_dir, "team")
    games = ingest.stored_rows(spark, tables_dir, "game_schedule")
    summary = os.path.join(derived_dir, "final_summary")
    if args.command == "stints":
        result = serving.stint_data(spark, summary, args.team)
    elif args.command == "scout":
        result = serving.scout_schedule(team, games)
    else:
        if not args.team:
            ap.error("coach needs --team")
        result = serving.coach_schedule(team, games, args.team)
    serving.write_json(result, args.dest)


if __name__ == "__main__":
    main()
