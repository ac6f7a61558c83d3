"""Invented prose for tests."""

WORDS = "the red fox ran over a hill and saw many birds near old trees by some quiet river where boats lay still".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
