import random

import pytest

from blockwalk.llm.shipping import ship


@pytest.fixture(autouse=True)
def _code_on_executors(spark):
    ship(spark)


@pytest.fixture
def words():
    """A generator of invented texts."""
    rng = random.Random(11)
    syllables = ["an", "er", "on", "th", "in", "re", "ed", "ti", "ou", "st", "nd", "ha", "le", "sh"]

    def text(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    text.rng = rng
    return text
