"""Shapes, sign policies and search options."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from ranklake.errors import OptionError, ShapeError

#: Coordinates at or above this size are refused.
LIMIT = 1e16
MOST_DIM = 65_535
SIGN_BITS, SIGN_MULTIPLE = 2, 64
LEAST_CANDIDATES, CANDIDATES_PER_HIT = 256, 32


class SignPolicy(Enum):
    DISABLED = "disabled"
    OPTIONAL = "optional"
    REQUIRED = "required"

    @staticmethod
    def of(value: SignPolicy | str) -> SignPolicy:
        try:
            return value if isinstance(value, SignPolicy) else SignPolicy(value.lower())
        except ValueError:
            raise OptionError(f"unknown sign policy {value!r}") from None


class SignLoad(Enum):
    REQUIRE_IF_SUPPORTED = "require_if_supported"
    REQUIRE = "require"
    ANY = "any"
    FORBID = "forbid"


def required_multiple(bits: int) -> int:
    """What a dimension must be a multiple of: whole bytes of codes, and bins of one size."""
    if bits not in (1, 2, 4):
        raise ShapeError(f"bits must be 1, 2 or 4, not {bits!r}")
    return {1: 8, 2: 4, 4: 16}[bits]


def compatible(dim: int, bits: int) -> bool:
    """Whether vectors of this dimension can be encoded."""
    return bits in (1, 2, 4) and 2 <= dim <= MOST_DIM and dim % required_multiple(bits) == 0


def check_shape(dim: int, bits: int) -> None:
    multiple = required_multiple(bits)
    if isinstance(dim, bool) or not isinstance(dim, int) or not 2 <= dim <= MOST_DIM:
        raise ShapeError(f"dim must be in 2..{MOST_DIM}, not {dim!r}")
    if dim % multiple:
        raise ShapeError(f"dim {dim} is no multiple of {multiple}, which bits={bits} needs")


def sign_required_multiple() -> int:
    return SIGN_MULTIPLE


def sign_compatible(dim: int, bits: int) -> bool:
    """Whether an index of this shape can have sign bits."""
    return compatible(dim, bits) and bits == SIGN_BITS and dim % SIGN_MULTIPLE == 0


def resolve_sign(dim: int, bits: int, policy: SignPolicy | str) -> bool:
    """Whether sign bits are built; an error if they are required of a shape that can't have them."""
    policy = SignPolicy.of(policy)
    if policy is SignPolicy.REQUIRED and not sign_compatible(dim, bits):
        raise ShapeError(f"sign bits need bits={SIGN_BITS} and a multiple of {SIGN_MULTIPLE}, not dim={dim}, bits={bits}")
    return policy is not SignPolicy.DISABLED and sign_compatible(dim, bits)


def resolve_bits(bits: int | None = None, bit_width: int | None = None) -> int:
    """bits, or its other name; both only if they agree."""
    if bits is not None and bit_width is not None and bits != bit_width:
        raise OptionError("bits and bit_width differ")
    value = bits if bits is not None else bit_width if bit_width is not None else 2
    required_multiple(value)
    return value


class Mode(Enum):
    AUTO = "auto"
    EXACT = "exact"
    TWO_STAGE = "two_stage"


@dataclass(frozen=True)
class TwoStage:
    """How many candidates the first stage keeps: a fixed number, or so many for each hit, and limits."""

    fixed: int | None = None
    least: int = LEAST_CANDIDATES
    per_hit: int = CANDIDATES_PER_HIT
    most: int | None = None

    def candidates(self, k: int, n: int) -> int:
        if k <= 0 or n <= 0:
            return 0
        m = self.fixed if self.fixed is not None else max(self.least, self.per_hit * k)
        if self.most is not None:
            m = min(m, self.most)
        return min(max(m, 0), n)


@dataclass(frozen=True)
class SearchOptions:
    mode: Mode = Mode.AUTO
    two_stage: TwoStage = TwoStage()

    @staticmethod
    def exact() -> SearchOptions:
        return SearchOptions(Mode.EXACT)

    @staticmethod
    def sign_two_stage(two_stage: TwoStage | None = None) -> SearchOptions:
        return SearchOptions(Mode.TWO_STAGE, two_stage or TwoStage())
