import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
WORDS = "the sun and old river stone little window garden letter paper winter morning table silver road bird story water night".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))
