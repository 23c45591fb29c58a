"""Texts with one value of each wanted kind, made from what its rule asks for; words, order and values come from a seed."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from veilframe.functions.rules import COMMON_PERSONS, ORG_GENERIC_ENDINGS

FILLER = ("lamp", "under", "rain", "nine", "cups", "moss", "then", "slow", "wire", "tilt")


def _digits(rng: random.Random, count: int) -> str:
    return "".join(rng.choice(string.digits) for _ in range(count))


def _letters(rng: random.Random, count: int) -> str:
    return "".join(rng.choice(string.ascii_lowercase) for _ in range(count))


def _day(rng: random.Random) -> str:
    return f"{rng.randint(1900, 2099)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"


MAKERS = {
    "PERSON": lambda rng: rng.choice(COMMON_PERSONS),
    "ORG": lambda rng: _letters(rng, 3).capitalize() + _digits(rng, 2) + rng.choice(ORG_GENERIC_ENDINGS),
    "PHONE": lambda rng: f"1{rng.randint(3, 9)}{_digits(rng, 9)}",
    "EMAIL": lambda rng: f"{_letters(rng, 5)}@{_letters(rng, 4)}.example",
    "ID_CARD": lambda rng: _digits(rng, 6) + _day(rng) + _digits(rng, 4),
    "MONEY": lambda rng: f"¥{rng.randint(100_001, 999_999)}元",
    "CONTRACT_ID": lambda rng: f"{rng.choice(('XS', 'CDA', 'SO'))}-{_digits(rng, 4)}-{_digits(rng, 3)}",
    "CUSTOMER": lambda rng: f"CUST-{_digits(rng, 4)}-{_digits(rng, 4)}",
    "SAMPLE_ID": lambda rng: f"SAMPLE-{_day(rng)}-{rng.choice('BCDE')}{_digits(rng, 2)}",
    "PROJECT": lambda rng: f"{_letters(rng, 4).capitalize()}-{_letters(rng, 3)}-{_digits(rng, 3)}",
    "API_KEY": lambda rng: "sk-" + _letters(rng, 30),
    "USCC": lambda rng: "".join(rng.choice(string.ascii_uppercase) for _ in range(18)),
}


@dataclass(frozen=True)
class Made:
    kinds: tuple[str, ...]
    values: tuple[str, ...]
    fillers: tuple[str, ...]

    @property
    def text(self) -> str:
        return self.shown(*self.values)

    def shown(self, *values: str) -> str:
        """The text with other values in the places."""
        return " ".join(word for pair in zip(self.fillers, values, strict=True) for word in pair) + " ;"

    def value(self, kind: str) -> str:
        return self.values[self.kinds.index(kind)]


def made(kinds: tuple[str, ...], seed: int) -> Made:
    rng = random.Random(seed)
    order = rng.sample(kinds, len(kinds))
    return Made(tuple(order), tuple(MAKERS[kind](rng) for kind in order), tuple(rng.choice(FILLER) for _ in order))


def one(kind: str, seed: int = 0) -> str:
    return made((kind,), seed).values[0]
