"""Worlds and multiresolution analyses: small, immutable, built on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

MACHINE_PREC = 1e-15
AXES = ("lx", "ly", "lz")
COORDS = ("x", "y", "z")
KEY = ["n", *AXES]
TREE_KEY = ["tree_id", *KEY]


@dataclass(frozen=True)
class World:
    """Boxes of side 2^-scale (in units of sf) from corner on, counts of them in each dimension."""

    dim: int
    scale: int = 0
    corner: tuple[int, ...] = ()
    boxes: tuple[int, ...] = ()
    sf: tuple[float, ...] = ()
    periodic: tuple[bool, ...] = ()

    def __post_init__(self) -> None:
        for name, default in (("corner", 0), ("boxes", 1), ("sf", 1.0), ("periodic", False)):
            value = getattr(self, name) or (default,) * self.dim
            if len(value) != self.dim:
                raise ValueError(f"{name} needs {self.dim} entries")
            object.__setattr__(self, name, tuple(value))
        if not 1 <= self.dim <= 3 or min(self.boxes) < 1 or min(self.sf) <= 0:
            raise ValueError("a world has 1 to 3 dimensions, at least one box and positive scaling factors")

    @property
    def unit(self) -> float:
        """Side of a root box, in units of sf."""
        return 2.0**-self.scale

    @property
    def volume_factor(self) -> float:
        out = 1.0
        for s in self.sf:
            out *= s
        return out

    def lower(self, d: int) -> float:
        return self.sf[d] * self.unit * self.corner[d]

    def upper(self, d: int) -> float:
        return self.sf[d] * self.unit * (self.corner[d] + self.boxes[d])

    @property
    def count(self) -> int:
        out = 1
        for b in self.boxes:
            out *= b
        return out

    def max_distance(self) -> float:
        """Length of the diagonal."""
        return sum((self.upper(d) - self.lower(d)) ** 2 for d in range(self.dim)) ** 0.5

    def min_distance(self, epsilon: float, max_scale: int) -> float:
        """Smallest distance that matters at this precision on the finest grid."""
        return (epsilon * 2.0**-max_scale) ** 0.5


def cube(dim: int, half: int, two_sided: bool = True) -> World:
    """[-L, L]^dim with L a power of two, or [0, L]^dim."""
    scale = -(half.bit_length() - 1)
    if 1 << -scale != half:
        raise ValueError("the side is a power of two")
    return World(dim, scale, (-1 if two_sided else 0,) * dim, (2 if two_sided else 1,) * dim)


@dataclass(frozen=True)
class MRA:
    """A world, a scaling basis ("legendre" or "interpolating") of order k, and the deepest scale below the roots."""

    world: World
    k: int
    basis: str = "interpolating"
    max_depth: int = 30
    name: str = field(default="default", compare=False)

    def __post_init__(self) -> None:
        if self.basis not in ("legendre", "interpolating") or not 0 <= self.k <= 40:
            raise ValueError("the basis is legendre or interpolating, its order 0 to 40")

    @property
    def dim(self) -> int:
        return self.world.dim

    @property
    def size(self) -> int:
        """Functions in one block."""
        return (self.k + 1) ** self.dim

    @property
    def blocks(self) -> int:
        return 1 << self.dim

    @property
    def max_scale(self) -> int:
        return self.world.scale + self.max_depth

    def check(self, other: MRA) -> None:
        if self != other:
            raise ValueError("functions of different multiresolution analyses cannot be combined")
