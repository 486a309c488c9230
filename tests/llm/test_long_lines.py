import pytest

from loomline.llm.residue import COVERAGE, coverage, fit, units

PROSE = "Rework the queue of talnu so that the oldest batch goes first and nothing waits for more than one turn of the clock"
PARTS = ["{{ commit_message }}", "Please enable JavaScript and reload this page", "[insert your summary here]", "Lorem ipsum dolor sit amet"]


@pytest.fixture(scope="module")
def most():
    models = fit()
    return lambda text: coverage(models, [u.text for u in units(text)]).max()


@pytest.mark.parametrize("part", PARTS)
def test_residue_in_a_long_line(most, part):
    assert most(f"{PROSE}. {part}. Closes #12.") >= COVERAGE
    assert most(f"{PROSE}, {part}, and the cache of garpu keeps its order when the batch is long.") >= COVERAGE


def test_long_prose(most):
    assert most(f"{PROSE}, and the cache of garpu keeps its order; nothing else changes: see #12. Documents in (<|endoftext|>), too.") < COVERAGE
