"""Registered calibrations run over the operators' whole grid and all iterations."""

from tideloom.operators import calibrate as cal
from tideloom.plans import common, q_stats, registry

SF = "/root/testdata/sf0.001"


def test_registered_grid_and_iterations_are_the_defaults(spark):
    grid = registry.QUERIES["m2_garch_grid"](spark, SF).select("alpha", "beta").distinct().collect()
    want = {(round(a / 100, 2), round(b / 100, 2)) for a in range(1, 16) for b in range(80, 99) if a + b < 100}
    assert {(round(r["alpha"], 4), round(r["beta"], 4)) for r in grid} == want
    got = registry.QUERIES["m8_em_rulers"](spark, SF).collect()
    assert sorted(got) == sorted(common.rounded(cal.fit_rulers_em(q_stats.obs(spark, SF), 0.01, 30)).collect())
