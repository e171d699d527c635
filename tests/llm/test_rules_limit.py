"""The limit of op6 is the quantile that its method names."""

import math

from codexa.llm import rules


def test_one_clean_row_in_a_thousand_is_beyond_the_limit():
    # chi-square with four degrees of freedom: P(X > x) = exp(-x / 2) (1 + x / 2)
    beyond = lambda x: math.exp(-x / 2) * (1 + x / 2)
    assert abs(beyond(rules.MEDIAN) - 0.5) < 1e-4 and abs(beyond(rules.CUTOFF) - 0.001) < 1e-6
