"""The stored ranking against one made from scratch."""

import datetime
import random

from conftest import rows_of
from skilltide.operators.rank import ranked
from skilltide.plans.standings import FIGURES, Standings

COLUMNS = ["user_id", "login", "full_name", "avg_grade", "updated_by_analyzer", "total_lines_of_code"]


def row(rng, user):
    day = datetime.datetime(2024, 1, rng.randint(1, 3), 0, 0, 0, rng.randint(0, 2))
    return (user, f"u{user}", None, rng.choice([0.1, 1 / 3, 0.5, 2 / 3]), day, rng.randint(0, 3))


def frame(table, rows):
    return table(FIGURES, *rows)


def same(standings, table, rows):
    want = ranked(frame(table, rows)).select(*COLUMNS, "rank")
    assert rows_of(standings.rows().select(*COLUMNS, "rank")) == rows_of(want)
    assert all(e["rows"] <= 2 * standings.range_rows for e in standings.ranges)


def test_many_batches_equal_one_ranking(spark, table, tmp_path):
    """Users come, go and move; ranges grow, split and become empty."""
    rng = random.Random(4)
    people = {u: row(rng, u) for u in range(60)}
    standings = Standings(spark, str(tmp_path / "s"), range_rows=12)
    standings.build(frame(table, people.values()))
    same(standings, table, people.values())
    for step in range(4):
        users = rng.sample(sorted(people), 6) + [1000 + 100 * step + i for i in range(18)]
        old = [people[u] for u in users if u in people]
        if step == 2:  # everybody of one place goes
            old = [r for r in people.values() if r[3] == 0.5]
            users = [r[0] for r in old]
        new = {} if step == 2 else {u: row(rng, u) for u in users if rng.random() < 0.9}
        standings.update(frame(table, old), frame(table, list(new.values())))
        people = {u: r for u, r in people.items() if u not in {r[0] for r in old}} | new
        same(standings, table, people.values())


def test_ranges_without_movement_are_left_alone(spark, table, tmp_path):
    people = [(u, f"u{u}", None, u / 100, datetime.datetime(2024, 1, 1), 1) for u in range(100)]
    standings = Standings(spark, str(tmp_path / "s"), range_rows=10)
    standings.build(frame(table, people))
    before = [e["folder"] for e in standings.ranges]
    moved = (50, "u50", None, 0.505, datetime.datetime(2024, 1, 1), 1)
    standings.update(frame(table, [people[50]]), frame(table, [moved]))
    after = [e["folder"] for e in standings.ranges]
    assert len(after) == len(before) and sum(a != b for a, b in zip(before, after)) == 1
    standings.update(frame(table, [moved]), frame(table, [moved]))
    assert [e["folder"] for e in standings.ranges] == after
    same(standings, table, [*people[:50], moved, *people[51:]])


def test_pages_read_their_ranges_only(spark, table, tmp_path):
    people = [(u, f"u{u}", None, u / 100, datetime.datetime(2024, 1, 1), 1) for u in range(95)]
    standings = Standings(spark, str(tmp_path / "s"), range_rows=10)
    standings.build(frame(table, people))
    best = [u for u in range(94, -1, -1)]
    for page in (1, 2, 7, 13, 14):
        got = standings.page(page, 7)
        assert [r["user_id"] for r in got.collect()] == best[(page - 1) * 7:page * 7]
        assert len({f.rpartition("/part-")[0] for f in got.inputFiles() if "_range=" in f}) <= 2
    assert standings.page(15, 7).count() == 0


def test_nobody(spark, table, tmp_path):
    standings = Standings(spark, str(tmp_path / "s"))
    assert standings.rows().count() == 0 and standings.page(1).count() == 0
    standings.build(frame(table, []))
    one = frame(table, [(1, "a", "b", 0.5, datetime.datetime(2024, 1, 1), 3)])
    standings.update(one.limit(0), one)
    assert [r["rank"] for r in standings.rows().collect()] == [1]
    standings.update(one, one.limit(0))
    assert standings.rows().count() == 0
    standings.update(one.limit(0), one)
    assert standings.rows().count() == 1
