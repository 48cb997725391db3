"""Made sequences whose answer is known: pairs without, and with, a figure planted in both."""

from __future__ import annotations

from .lcg import Lcg

# Weights of the twelve symbols, the figures, where they are planted, lengths and seeds.
WEIGHTS = (22, 18, 14, 11, 9, 7, 6, 5, 4, 2, 1, 1)
FIGURE = (3, 7, 1, 9, 3, 0, 5, 2, 7, 1, 4, 6)
SITES = ((10, 60, 120), (8, 40, 70))
SEEDS = (0x0E6A71BE00000001, 0x0E6A71BE00000002)
LENGTHS = (160, 90)
# Fixed values of the first-order pair: which six symbols may follow each one, the first symbol, the
# figure (all its steps are allowed), after which places it is planted, and the seeds.
STEPS = (1, 2, 4, 5, 7, 9)
WALK_FIGURE = (3, 4, 8, 9, 1, 5, 6, 10, 11, 0, 7, 2)
WALK_AFTER = ((20, 100), (10, 55))
WALK_SEEDS = (0x000D0B1E00000001, 0x000D0B1E00000002)
SHORTEST_GAP, GAP_RANGE = 500, 4500


def mark(symbol: int) -> str:
    return f"v2:tool_requested/synthetic-{symbol:02d}"


def followers(symbol: int) -> list[int]:
    """The same six steps from every symbol, around the circle of twelve."""
    return [(symbol + step) % 12 for step in STEPS]


def drawn(draw: Lcg, symbols: list[int]) -> int:
    """One of the symbols, each as often as it weighs."""
    left = draw.below(sum(WEIGHTS[s] for s in symbols))
    for s in symbols:
        left -= WEIGHTS[s]
        if left < 0:
            return s
    return symbols[-1]


def _gaps(draw: Lcg, n: int) -> list[int]:
    return [-1, *[SHORTEST_GAP + draw.below(GAP_RANGE) for _ in range(n)][1:]]


def independent(side: int, planted: bool) -> tuple[list[str], list[int]]:
    """Marks and gaps of one side: symbols drawn one by one, the figure over them where it is planted."""
    draw, n = Lcg(SEEDS[side]), LENGTHS[side]
    symbols = [drawn(draw, list(range(12))) for _ in range(n)]
    for site in SITES[side] if planted else ():
        symbols[site : site + len(FIGURE)] = FIGURE
    return [mark(s) for s in symbols], _gaps(draw, n)


def walk(side: int, planted: bool) -> tuple[list[str], list[int]]:
    """Marks and gaps of one side: a walk over the allowed steps; the figure is
    planted at the first place from each site on where both of its ends keep to them."""
    n, draw = LENGTHS[side], Lcg(WALK_SEEDS[side])
    path = [0]
    while len(path) < n:
        path.append(drawn(draw, followers(path[-1])))
    k, held = len(WALK_FIGURE), []
    for site in WALK_AFTER[side] if planted else ():
        fits = lambda p: path[p] == WALK_FIGURE[0] and path[p + k] in followers(WALK_FIGURE[-1]) and all(abs(p - q) >= k for q in held)
        if (at := next((p for p in range(site, n - k) if fits(p)), None)) is not None:
            path[at : at + k] = WALK_FIGURE
            held.append(at)
    return [mark(s) for s in path], _gaps(Lcg(WALK_SEEDS[side]), n)


#: name -> (session, marks, gaps) of both sides.
CONTROLS = {
    f"{kind}{name} control": tuple((f"{kind}{name}-{'ab'[side]}", *make(side, name == "positive")) for side in (0, 1))
    for kind, make in (("", independent), ("first-order ", walk))
    for name in ("negative", "positive")
}
