"""The fixed linear congruential generator, its seeds, and what is drawn from it."""

from __future__ import annotations

# Multiplier, increment, and the seeds' constants.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407
ORDER_SEED, TIMING_SEED, SHUFFLE_SEED = 0x4F524445524E554C, 0x0054494D494E4701, 0x5245465241494E01
REALIZATION_STRIDE, SIDE_STRIDE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
M64 = (1 << 64) - 1


class Lcg:
    def __init__(self, seed: int, odd: bool = True):
        self.state = (seed | 1 if odd else seed) & M64

    def below(self, bound: int) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) & M64
        return (self.state >> 33) % bound if bound else 0

    def shuffle(self, items: list) -> list:
        """In place, from the last position down."""
        for i in range(len(items) - 1, 0, -1):
            j = self.below(i + 1)
            items[i], items[j] = items[j], items[i]
        return items


def null_seed(realization: int, side: int) -> int:
    return ORDER_SEED ^ (realization * REALIZATION_STRIDE & M64) ^ (side * SIDE_STRIDE & M64)


def order_null(marks: list, seed: int = ORDER_SEED) -> list:
    """Marks in a random order; gaps stay where they are."""
    return Lcg(seed).shuffle(list(marks))


def timing_null(gaps: list[int]) -> list[int]:
    """Gaps (all but the first) in a random order."""
    return gaps[:1] + Lcg(TIMING_SEED).shuffle(list(gaps[1:]))


def _coded(marks: list) -> tuple[list, list[int]]:
    states = list(dict.fromkeys(marks))
    place = {m: i for i, m in enumerate(states)}
    return states, [place[m] for m in marks]


def doublet_null(marks: list, seed: int, attempts: int = 200) -> list:
    """A random sequence with exactly the same pairs: an Eulerian trail.

    A last edge is drawn for each state but the final one; when following these
    leads every state to the final one, the other edges are shuffled and the
    trail is walked.  Without success in the attempts the marks stay as they are."""
    if len(marks) < 3:
        return list(marks)
    states, path = _coded(marks)
    edges: list[list[int]] = [[] for _ in states]
    for a, b in zip(path, path[1:], strict=False):
        edges[a].append(b)
    end, draw = path[-1], Lcg(seed)
    for _ in range(attempts):
        last = {v: draw.below(len(e)) for v, e in enumerate(edges) if v != end and e}
        if not all(_leads(v, last, edges, end) for v in last):
            continue
        left = []
        for v, own in enumerate(edges):
            rest = list(own)
            final = [rest.pop(last[v])] if v in last else []
            left.append(iter(draw.shuffle(rest) + final))
        walk = [path[0]]
        while (step := next(left[walk[-1]], None)) is not None:
            walk.append(step)
        if len(walk) == len(path):
            return [states[v] for v in walk]
    return list(marks)


def _leads(v: int, last: dict[int, int], edges: list[list[int]], end: int) -> bool:
    for _ in range(len(edges) + 1):
        if v == end:
            return True
        if v not in last:
            return False
        v = edges[v][last[v]]
    return v == end


def markov_null(marks: list, seed: int) -> tuple[list, int]:
    """A walk of the fitted chain, and how often it had to draw from all marks."""
    if len(marks) < 2:
        return list(marks), 0
    states, path = _coded(marks)
    after: list[list[int]] = [[] for _ in states]
    for a, b in zip(path, path[1:], strict=False):
        after[a].append(b)
    draw, walk, fell = Lcg(seed), [path[0]], 0
    for _ in path[1:]:
        choices = after[walk[-1]]
        fell += not choices
        choices = choices or path
        walk.append(choices[draw.below(len(choices))])
    return [states[v] for v in walk], fell


def corpus_seed(replicate: int, session: int) -> int:
    """A seed for each replicate of each session of a corpus, by splitmix."""
    z = REALIZATION_STRIDE ^ (replicate * 0xBF58476D1CE4E5B9 & M64) ^ (session * 0x94D049BB133111EB & M64)
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M64
    z = (z ^ z >> 27) * 0x94D049BB133111EB & M64
    return z ^ z >> 31
