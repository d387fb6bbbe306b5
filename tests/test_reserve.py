"""Reserve overlaps against every pair of a lineage and an epoch."""

import datetime as dt
import random

from refspark.operators import reserve
from refspark.plans import reserve_plans


def test_overlap_counts_every_epoch(spark):
    rng = random.Random(7)
    day = lambda: dt.date(2001, 1, 1) + dt.timedelta(rng.randrange(500))
    span = lambda: rng.choice([(a := day(), a + dt.timedelta(rng.randrange(-3, 60))), (None, day())])
    lineages = [(i, *span()) for i in range(60)]
    epochs = [(str(i), *span()) for i in range(40)]
    frame = lambda rows, k: spark.createDataFrame([(*r, ["a"], None) for r in rows], f"{k}, start date, end date, domains array<string>, datasets array<string>")
    for some in (epochs, epochs[:0]):
        got = {r.lineage: (r.shares_day, r.n_day_epochs) for r in reserve.reserve_overlap(frame(lineages, "lineage int"), frame(some, "epoch_id string"), "lineage").collect()}
        ok = lambda s, e: s is not None and e is not None and s <= e
        want = {i: sum(ok(s, e) and ok(a, b) and s <= b and a <= e for _, a, b in some) for i, s, e in lineages}
        assert got == {i: (n > 0, n) for i, n in want.items()}


def test_overlap_reads_the_epochs_of_the_whole_year():
    """the query took only epochs that start after June."""
    assert "month(start)" not in reserve_plans.SQL["b11_reserve_overlap"]
