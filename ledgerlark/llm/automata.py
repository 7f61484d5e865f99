"""Counting units of texts by automata whose chunks are scanned independently of each other.

A chunk is scanned from every state at once. What it gives is a function from its entry state to its exit state and, for each entry
state, the number of units that it reports. Two neighbouring chunks compose to the same kind of thing, and composing is associative, so
entry states and counts before each chunk come from a prefix scan in any order, within a task or over chunks from many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that one lane of a scan takes; lanes are stepped through side by side.
LANE = 512
#: A symbol that changes nothing and reports nothing, after the 256 bytes.
NOTHING = 256


@dataclass(frozen=True)
class Automaton:
    """``following[state, byte]`` and whether a unit is reported there; state 0 is where a text starts.

    A unit is reported with its last byte or, with ``at_start``, with its first.
    """

    following: np.ndarray
    reports: np.ndarray
    at_start: bool = False

    @property
    def states(self) -> int:
        return len(self.following)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Both tables laid flat with a column for NOTHING; states are held as the places of their rows."""
        same = np.arange(self.states)[:, None]
        after = np.hstack([self.following, same]).astype(np.int32) * (NOTHING + 1)
        return after.ravel(), np.hstack([self.reports, np.zeros_like(same)]).astype(np.int32).ravel()


def code_points() -> Automaton:
    """Units are the code points of UTF-8; a state is the number of bytes that the one begun still needs."""
    following, reports = np.zeros((4, 256), int), np.zeros((4, 256), bool)
    need = np.zeros(256, int)
    need[0xC0:0xE0], need[0xE0:0xF0], need[0xF0:] = 1, 2, 3
    following[0], reports[0] = need, need == 0
    for k in (1, 2, 3):
        following[k], reports[k] = k - 1, k == 1
    return Automaton(following, reports)


def words() -> Automaton:
    """Units are runs of anything but ASCII spaces, with what stands between them and the next."""
    space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    return Automaton(np.stack([~space, ~space]).astype(int), np.stack([~space, np.zeros(256, bool)]), at_start=True)


def lines() -> Automaton:
    """Units are lines with their line feed."""
    feed = np.arange(256) == 10
    return Automaton(np.stack([~feed, ~feed]).astype(int), np.stack([np.ones(256, bool), np.zeros(256, bool)]), at_start=True)


def marker_finder(markers: tuple[str, ...]) -> Automaton:
    """Reports each occurrence of a marker (which may overlap); a state is the longest suffix read that begins a marker."""
    spelt = [m.encode() for m in markers]
    begun = sorted({m[:k] for m in spelt for k in range(len(m))}, key=len)
    place = {p: i for i, p in enumerate(begun)}
    following, reports = np.zeros((len(begun), 256), int), np.zeros((len(begun), 256), bool)
    for p in begun:
        for b in range(256):
            read = p + bytes([b])
            reports[place[p], b] = any(read.endswith(m) for m in spelt)
            following[place[p], b] = next(place[read[k:]] for k in range(len(read) + 1) if read[k:] in place)
    return Automaton(following, reports)


def lanes_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of lanes of each text, one at least, and where each text's lanes start."""
    counts = np.maximum(1, -(-sizes // LANE))
    return counts, np.concatenate([[0], np.cumsum(counts)])


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Row j holds byte j of each lane, or NOTHING after its end."""
    width = int((ends - starts).max(initial=0))
    at = starts[None, :] + np.arange(width)[:, None]
    found = np.full(at.shape, NOTHING, np.int32)
    inside = at < ends[None, :]
    found[inside] = data[at[inside]]
    return found


def scan(automaton: Automaton, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lane and entry state, the exit state and the number of reports: two arrays [lanes, states]."""
    after, reports = automaton.tables()
    state = np.repeat(np.arange(automaton.states, dtype=np.int32)[:, None] * (NOTHING + 1), lanes.shape[1], axis=1)
    count = np.zeros(state.shape, np.int32)
    for row in lanes:
        at = state + row
        count += reports[at]
        state = after[at]
    return (state // (NOTHING + 1)).T.copy(), count.T.astype(np.int64)


def compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What ``first`` and then ``second`` do, row by row."""
    (exits, counts), (next_exits, next_counts) = first, second
    return np.take_along_axis(next_exits, exits, 1), counts + np.take_along_axis(next_counts, exits, 1)


def up_to_each(exits: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the chunks of a text up to and with each one do together; ``place`` is the chunk's place in its text."""
    exits, counts, reach = exits.copy(), counts.copy(), 1
    while reach <= place.max(initial=0):
        later = np.flatnonzero(place >= reach)
        exits[later], counts[later] = compose((exits[later - reach], counts[later - reach]), (exits[later], counts[later]))
        reach *= 2
    return exits, counts


def prefixes(exits: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry state and reports before each chunk, if its text is entered in state 0."""
    exits, counts = up_to_each(exits, counts, place)
    entry, before = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    later = np.flatnonzero(place > 0)
    entry[later], before[later] = exits[later - 1, 0], counts[later - 1, 0]
    return entry, before


def find_reports(automaton: Automaton, lanes: np.ndarray, entry: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many bytes of each lane come before the cut at its ``rank``-th report; each lane has as many."""
    after, reports = automaton.tables()
    state, left = entry.astype(np.int32) * (NOTHING + 1), rank.copy()
    found = np.zeros(len(entry), np.int64)
    for j, row in enumerate(lanes):
        at = state + row
        hit = reports[at]
        left -= hit
        found[(left == 0) & (hit > 0)] = j + (not automaton.at_start)
        state = after[at]
    return found


class Texts:
    """Some byte strings, scanned by one automaton."""

    def __init__(self, automaton: Automaton, texts: list[bytes]) -> None:
        self.automaton = automaton
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        counts, self.firsts = lanes_of(self.sizes)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.place = np.arange(len(self.owner)) - self.firsts[self.owner]
        self.lane_starts = starts[self.owner] + self.place * LANE
        self.lane_ends = np.minimum(self.lane_starts + LANE, starts[self.owner + 1])
        self.exits, self.counts = scan(automaton, symbols(self.data, self.lane_starts, self.lane_ends))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of each text for every entry state."""
        exits, counts = up_to_each(self.exits, self.counts, self.place)
        last = self.firsts[1:] - 1
        return exits[last], counts[last]

    def totals(self) -> np.ndarray:
        """Units of each text."""
        return self.whole()[1][:, 0] if len(self.sizes) else np.zeros(0, np.int64)

    def cuts(self, after: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
        """Byte offsets of the cuts after ``after`` units of each text: 0 before the first and its size after the last.

        With ``entry``, a text is entered in that state, and ``after`` is the rank of a report that it has.
        """
        exits, counts = self.exits, self.counts
        if entry is not None:
            exits, counts = exits.copy(), counts.copy()
            heads = self.firsts[:-1]
            exits[heads] = np.take_along_axis(exits[heads], entry[:, None].astype(np.int64), 1)
            counts[heads] = np.take_along_axis(counts[heads], entry[:, None].astype(np.int64), 1)
        state, before = prefixes(exits, counts, self.place)
        if entry is not None:
            state[self.firsts[:-1]] = entry
        out = np.zeros(len(self.sizes), np.int64)
        if entry is None:
            total = self.totals()
            out[after >= total] = self.sizes[after >= total]
            wanted = np.flatnonzero((after > 0) & (after < total))
            rank = after + 1 if self.automaton.at_start else after
        else:
            wanted, rank = np.arange(len(self.sizes)), after
        if len(wanted):
            # Counts before the lanes of a text ascend; spread apart, those of all texts do.
            spread = int(before.max()) + int(rank.max()) + 2
            lane = np.searchsorted(before + self.owner * spread, rank[wanted] + wanted * spread) - 1
            piece = symbols(self.data, self.lane_starts[lane], self.lane_ends[lane])
            inner = find_reports(self.automaton, piece, state[lane], rank[wanted] - before[lane])
            out[wanted] = self.place[lane] * LANE + inner
        return out
