"""The limit on rules leaves one whole fit, not a cut of one."""

from compsight.llm import quality_classifier as Q


def test_a_larger_penalty_replaces_a_cut_of_rules():
    sizes = [0.002 * (i + 1) for i in range(200)]
    asked = []

    def fit(penalty):
        asked.append(penalty)
        return [max(0.0, x - 10 * penalty) for x in sizes], 100 * penalty

    coefficients, intercept = Q.sparse_enough(fit)
    assert 0 < sum(v != 0 for v in coefficients) <= Q.MAX_RULES
    assert (coefficients, intercept) == fit(asked[-1])
    assert asked[0] == Q.LASSO and all(sum(v != 0 for v in fit(p)[0]) > Q.MAX_RULES for p in asked[:-2])
