"""Groups of different sizes in one Arrow batch: flat arrays and where each group starts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Ragged:
    """The members of a batch's groups side by side: `size` and `start` of each group, `of` and `place` of each member, and the members' columns."""

    size: np.ndarray
    start: np.ndarray
    of: np.ndarray
    place: np.ndarray
    members: pa.StructArray

    @classmethod
    def of_lists(cls, lists: pa.Array) -> Ragged:
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        return cls(size, start, of, np.arange(len(of)) - start[of], lists.flatten())

    def column(self, name: str) -> pa.Array:
        """A member column without nulls that its struct's own validity might bring in."""
        return self.members.field(name) if self.members.offset == 0 and len(self.members.field(name)) == len(self.members) else pc.struct_field(self.members, name)

    def numbers(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)

    def vectors(self, name: str, width: int) -> np.ndarray:
        """A column of arrays that all have `width` numbers; null numbers are not numbers."""
        return self.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)

    def padded(self, values: np.ndarray, most: int, fill=0.0) -> np.ndarray:
        """(group, place, ..): members side by side, `fill` where a group has fewer than `most`."""
        out = np.full((len(self.size), most, *values.shape[1:]), fill, values.dtype)
        out[self.of, self.place] = values
        return out

    def lists(self, values: list, wanted: np.ndarray) -> list[list | None]:
        """The members' values by group; None for groups that aren't wanted."""
        return [values[s : s + n] if w else None for s, n, w in zip(self.start.tolist(), self.size.tolist(), wanted.tolist(), strict=True)]


class Reasons:
    """The first gate that each group fails."""

    def __init__(self, groups: int):
        self.text = np.full(groups, None, object)

    def need(self, ok: np.ndarray, reason: str) -> None:
        self.text[~ok & self.open] = reason

    @property
    def open(self) -> np.ndarray:
        return np.array([t is None for t in self.text], bool)
