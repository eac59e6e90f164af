"""Novel strings near sensitive words: copies, letters alone, and both sides of the word."""

import random
import string

from lakesieve.llm import secrets


def found(text):
    return [text[a:b] for a, _, b, _ in secrets.novel_spans(text, secrets.base_spans(text), secrets.Novelty())]


def test_copies_letters_and_sides():
    rng = random.Random(4)
    mixed = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    letters = "".join(rng.choices(string.ascii_letters, k=40))
    assert found(f"the credential {mixed} and again {mixed}.") == [mixed, mixed]
    assert found(f"the credential {mixed} {'word ' * 46}{mixed} credential") == [mixed, mixed]  # a copy that the context cuts
    assert found(f"the credential {letters} is") == [letters]
    assert found(f"{mixed} is the credential") == [mixed]
    assert found(f"the credential{' ' * 250}{mixed} is") == [mixed]  # begins in the last characters of the context
    assert found(f"the credential{' ' * 256}{mixed} is") == found(f"{mixed}{' ' * 256}credential") == []
    assert found(f"credential={mixed}") == [f"={mixed}"]
    assert found("the credential " + "x" * 5 + "antidisestablishment" + " ANTIDISESTABLISHMENT") == []
