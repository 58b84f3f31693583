"""Check the expected values of FIXTURES.md section 3 on a folder of seed JSON files.

    python tools/seed_check.py <folder with team.json, game_schedule.json, ...>

The seed files are not part of this repository; point the tool at a copy.
Loads them with courtline's typed ingest (a missing lineup file is reported
and replaced by an empty table) and prints PASS/FAIL per expected value.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> int:
    from pyspark.sql import functions as F

    from courtline.operators import density
    from courtline.plans import schedule
    from courtline.session import build_session
    from courtline.sources import ingest

    spark = build_session("local[4]", 4)
    frames, status = ingest.load_tables(spark, sys.argv[1], skip_failed=True)
    status.show(truncate=60)
    team, games = frames["team"], frames["game_schedule"]
    checks: list[tuple[str, object, object]] = []

    st = schedule.team_standings(team, games)
    tot = st.agg(F.sum("games_played"), F.sum("wins"), F.sum("losses")).first()
    checks.append(("standings rows", st.count(), 62))
    checks.append(("standings totals", tuple(tot), (462, 231, 231)))
    idle = st.where("games_played = 0")
    checks.append(("teams without games", idle.count(), 32))
    checks.append(("their rank / percentage",
                   sorted({(r.rank_games_played, r.win_percentage) for r in idle.collect()}), [(31, None)]))
    top = [(r.teamid, r.games_played, r.wins, r.losses, r.win_percentage)
           for r in schedule.standings_report(st).limit(3).collect()]
    checks.append(("top three", top, [(1610612752, 16, 14, 2, 0.88), (1610612739, 13, 11, 2, 0.85),
                                      (1610612746, 15, 12, 3, 0.8)]))
    pct = {r.teamname: r.win_percentage for r in st.collect()}
    checks.append(("0.625 rounds up / 3-13", (pct.get("Utah Jazz"), pct.get("Charlotte Hornets")), (0.63, 0.19)))

    home = schedule.back_to_back(team, games, "home")
    checks.append(("home back-to-backs", sorted(tuple(r) for r in home.groupBy("home_b2b_count").count().collect()),
                   [(1, 10), (2, 10)]))
    away_all = density.consecutive_day_count(
        density.dates_per_key(games.select(F.col("away_id").alias("k"), "game_date"), "k", "game_date"),
        "k", "n").join(team.select(F.col("teamid").alias("k")), "k")
    checks.append(("away back-to-backs before the limit",
                   sorted(tuple(r) for r in away_all.groupBy("n").count().collect()), [(1, 15), (2, 7)]))
    rest = [(r.team_id, r.rest_days, str(r.last_game_date), str(r.next_game_date))
            for r in schedule.longest_rest(team, games).collect()]
    checks.append(("longest rest", rest, [(1610612744, 9, "2024-01-15", "2024-01-24")]))
    q5 = schedule.games_in_window(team, games)
    checks.append(("3-in-4 teams", q5.count(), 29))
    checks.append(("3-in-4 leaders", [(r.team_id, r.num_3_in_4s) for r in q5.limit(5).collect()],
                   [(1610612760, 8), (1610612745, 6), (1610612754, 6), (1610612757, 6), (1610612759, 6)]))

    d = schedule.schedule_difficulty(team, games)
    checks.append(("difficulty range", tuple(d.agg(F.min("difficulty"), F.max("difficulty")).first()), (-19, 18)))
    checks.append(("difficulty of games 1-3",
                   [r.difficulty for r in d.where("game_id in (1, 2, 3)").orderBy("game_id").collect()], [15, 4, -12]))
    colours = {r.color: r["count"] for r in d.groupBy("color").count().collect()}
    checks.append(("colour buckets", colours, {"purple": 20, "red": 42, "#d4af37": 63, "#228b22": 54, "#006400": 52}))
    coach_name = team.where("teamid = 1610612746").first().teamname
    coach = schedule.calendar(schedule.opponent_difficulty(team, games, coach_name))
    checks.append(("coach sequence", [r.difficulty for r in coach.collect()],
                   [-4, 6, 1, -1, 6, -5, 1, 3, 5, -6, -1, -5, 6, 9, -9]))
    res = {r.result: r["count"] for r in schedule.game_results(team, games).groupBy("result").count().collect()}
    checks.append(("game results", res, {"win": 231, "loss": 231}))
    rec = schedule.team_records(team, games)
    checks.append(("records", (rec.count(),) + tuple(rec.agg(F.sum("total_wins"), F.sum("total_losses")).first()),
                   (30, 231, 231)))

    failed = 0
    for label, got, want in checks:
        ok = got == want
        failed += not ok
        print(f"{'PASS' if ok else 'FAIL'}  {label}: {got}" + ("" if ok else f"  (expected {want})"))
    print(f"{len(checks) - failed}/{len(checks)} passed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
