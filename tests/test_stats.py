import itertools
import math

import numpy as np

from twinlens.functions import stats
from twinlens.operators.reduction import plan_deletions
from twinlens.operators.thresholds import derive_seeds, judge, split_in_a


def test_chi2_tail_at_critical_points():
    for dof, x in {1: 3.841459, 2: 5.991465, 3: 7.814728, 7: 14.06714}.items():
        assert abs(stats.chi2_tail(x, dof) - 0.05) < 1e-6
    assert stats.chi2_tail(0, 3) == 1.0 and stats.chi2_tail(math.inf, 3) == 0.0


def test_exact_ks_by_enumeration():
    for m, n in ((3, 4), (4, 4), (5, 2)):
        counts, total = {}, 0
        for at in itertools.combinations(range(m + n), m):
            first = np.isin(np.arange(m + n), at)
            d = np.abs(np.cumsum(first) / m - np.cumsum(~first) / n).max()
            counts[round(d, 9)] = counts.get(round(d, 9), 0) + 1
            total += 1
        for d in counts:
            want = sum(c for v, c in counts.items() if v >= d - 1e-9) / total
            assert abs(stats.ks_tail_exact(d, m, n) - want) < 1e-9


def test_ks_limit():
    assert abs(stats.kolmogorov_tail(1.3581) - 0.05) < 1e-4
    assert abs(stats.ks_tail_exact(0.1, 900, 900) - stats.kolmogorov_tail(0.1 * math.sqrt(450))) < 0.01


def test_ks_is_exact_up_to_its_bound():
    for m, n in ((3000, 2500), (10_000, 9_999), (10_000, 2)):
        d = 1.36 * math.sqrt((m + n) / (m * n)) if n > 2 else 0.75
        assert stats.ks_tail(d, m, n) == stats.ks_tail_exact(d, m, n) != stats.kolmogorov_tail(d * math.sqrt(m * n / (m + n)))
    assert stats.ks_tail(0.02, 10_001, 10_000) == stats.kolmogorov_tail(0.02 * math.sqrt(10_001 * 10_000 / 20_001))


def test_normal_threshold():
    t = stats.normal_threshold(0.2, 1000, 0.95)
    assert abs(t["threshold"] - (0.2 + 1.6448536 * math.sqrt(0.16 / 1000))) < 1e-6 and t["normal_approximation_reliable"]
    assert stats.normal_threshold(0.0, 10, 0.95)["threshold"] == 0.0
    assert abs(stats.size_corrected(0.5) - 0.75) < 1e-12


def test_planner_hits_the_ratio_or_moves_towards_it():
    r = np.random.default_rng(1)
    for _ in range(300):
        c1, c0, ct = (int(x) for x in r.integers(0, 200, 3))
        n = c1 + c0 + ct
        target = int(r.integers(0, n + 1))
        risk = float(r.random())
        p = plan_deletions(c1, c0, ct, target, risk)
        gone = p["delete_flagged"] + p["delete_plain"] + p["delete_ties"]
        assert gone == n - target and p["delete_flagged"] <= c1 and p["delete_plain"] <= c0 and p["delete_ties"] <= ct
        if p["feasible"] and gone > p["delete_ties"]:
            assert c1 - p["delete_flagged"] == p["target_flagged"]


def test_planner_infeasible():
    p = plan_deletions(216, 75, 0, 200, 0.95)
    assert not p["feasible"] or p["delete_plain"] >= 0
    p = plan_deletions(216, 75, 0, 200, 0.2)
    assert (p["delete_flagged"], p["delete_plain"]) == (91, 0)


def test_splits_and_seeds():
    seeds = derive_seeds(42, 5)
    assert seeds == derive_seeds(42, 5) and len(set(seeds)) == 5
    a = split_in_a(11, seeds[0])
    assert a.sum() == 5 and (a == split_in_a(11, seeds[0])).all()


def test_judge():
    assert judge("single_out_risk", 0.2, {"threshold": 0.2})["passed"] is True
    assert judge("pmse", 0.2, {"threshold": 0.2})["passed"] is False
    assert judge("pmse", None, {"threshold": 0.2})["passed"] is None
    assert judge("pmse", 0.2, None)["passed"] is None
    out = judge("pmse", 0.1, {"threshold": 0.2, "threshold_source": "simulation", "parameters": {"model": "decision_tree"}}, {"model": "logistic_regression"})
    assert "model differs" in out["judge_warnings"][0]
