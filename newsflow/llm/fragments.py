"""Two tokenizations of one text, aligned piecewise: fragments of byte ranges and their composition.

A fragment holds what a byte range tells: the tokens of both sides that end in it. Tokens up to the first place where both sides
end are its open prefix, as the group may begin further left; those behind the last such place are its open
suffix; between them are closed groups. `compose` joins neighbours: the left suffix and the right prefix make a
closed group, or stay open where a side has no common end. Composition is associative and `EMPTY` is neutral, so that
ranges can be cut anywhere and joined in any tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_NONE = np.zeros(0, np.int64)


@dataclass
class Tokens:
    """Tokens of both sides in order, with the offset behind each."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_end: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_end: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def within(self, low: int, high: int) -> Tokens:
        """Those that end behind ``low`` and not behind ``high``."""
        i, j = np.searchsorted(self.a_end, [low, high], "right")
        k, m = np.searchsorted(self.b_end, [low, high], "right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.b[k:m], self.b_end[k:m])

    def dump(self) -> bytes:
        return np.concatenate([[len(self.a)], *self.parts()]).astype("<i8").tobytes()

    @staticmethod
    def load(raw: bytes) -> Tokens:
        all_ = np.frombuffer(raw, "<i8")
        n = int(all_[0])
        m = (len(all_) - 1 - 2 * n) // 2
        return Tokens(*np.split(all_[1:], np.cumsum([n, n, m])))


def links(t: Tokens) -> np.ndarray:
    """A id << 32 | B id of every pair of tokens that overlap, in text order. Both sides begin and end together.

    Between two neighbouring ends of any side lies one token of each side, and every overlapping pair shares one such stretch.
    """
    ends = np.union1d(t.a_end, t.b_end)
    return (t.a[np.searchsorted(t.a_end, ends)] << 32) | t.b[np.searchsorted(t.b_end, ends)]


def group_texts(t: Tokens) -> tuple[np.ndarray, list[str]]:
    """Common ends, and ``a1,a2|b1`` of the group before each."""
    common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
    a, b = list(map(str, t.a.tolist())), list(map(str, t.b.tolist()))
    out, i, k = [], 0, 0
    for j, m in zip(np.searchsorted(t.a_end, common, "right").tolist(), np.searchsorted(t.b_end, common, "right").tolist()):
        out.append(",".join(a[i:j]) + "|" + ",".join(b[k:m]))
        i, k = j, m
    return common, out


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often they occur."""
    if times is None:
        return np.unique(keys, return_counts=True)
    values, at = np.unique(keys, return_inverse=True)
    return values, np.bincount(at, times, len(values)).astype(np.int64)


@dataclass
class Closed:
    """Whole groups: their texts, counts, and link pairs with multiplicity."""

    groups: str = ""
    n_groups: int = 0
    n_a: int = 0
    n_b: int = 0
    keys: np.ndarray = field(default_factory=lambda: _NONE)
    times: np.ndarray = field(default_factory=lambda: _NONE)

    @staticmethod
    def of(t: Tokens) -> Closed:
        if not len(t.a):
            return Closed()
        texts = group_texts(t)[1]
        return Closed(";".join(texts), len(texts), len(t.a), len(t.b), *counted(links(t)))

    @staticmethod
    def joined(parts: list[Closed]) -> Closed:
        """Parts in text order as one."""
        parts = [p for p in parts if p.n_groups]
        if len(parts) < 2:
            return parts[0] if parts else Closed()
        keys, times = counted(np.concatenate([p.keys for p in parts]), np.concatenate([p.times for p in parts]))
        return Closed(";".join(p.groups for p in parts), *(sum(getattr(p, k) for p in parts) for k in ("n_groups", "n_a", "n_b")), keys, times)


@dataclass
class Fragment:
    """``cut``: both sides end together somewhere in the range. If not, all its tokens are in the prefix."""

    cut: bool = False
    prefix: Tokens = field(default_factory=Tokens)
    closed: Closed = field(default_factory=Closed)
    suffix: Tokens = field(default_factory=Tokens)

    @staticmethod
    def of(t: Tokens) -> Fragment:
        common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
        if not len(common):
            return Fragment(False, t)
        first, last = int(common[0]), int(common[-1])
        far = max(int(t.a_end[-1]), int(t.b_end[-1]))
        return Fragment(True, t.within(-1, first), Closed.of(t.within(first, last)), t.within(last, far))


EMPTY = Fragment()


def composed(row: list[Fragment]) -> Fragment:
    """Neighbouring fragments, from left to right, as one."""
    cut, prefix, closed, open_ = False, Tokens(), [], Tokens()
    for f in row:
        if not f.cut:
            if cut:
                open_ = open_ + f.prefix
            else:
                prefix = prefix + f.prefix
        elif not cut:
            cut, prefix, open_ = True, prefix + f.prefix, f.suffix
            closed.append(f.closed)
        else:
            closed += [Closed.of(open_ + f.prefix), f.closed]
            open_ = f.suffix
    return Fragment(cut, prefix, Closed.joined(closed), open_)


def compose(left: Fragment, right: Fragment) -> Fragment:
    return composed([left, right])


def finished(whole: Fragment) -> Closed:
    """All groups of a text whose fragment begins where it does: its prefix is a group, too."""
    return Closed.joined([Closed.of(whole.prefix), whole.closed])
