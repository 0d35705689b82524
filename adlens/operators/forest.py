"""Regression forests of one series, in numpy.

All trees grow together, one depth level at a time, so the work per level is a few array operations
whatever the number of trees; short series grow together. Targets are counted in whole steps above their lowest value, so sums
are exact and do not depend on their order; draws and ties come from a generator of whole-number
arithmetic. Any engine that follows the same rules grows the same trees to the last bit.
"""

from __future__ import annotations

import datetime
from typing import NamedTuple

import numpy as np

#: The generator: modulus, factor, addend, rounds; factors of the numbers a value is made from.
MODULUS, FACTOR, ADDEND, ROUNDS = 2**31 - 1, 48_271, 12_345, 3
TREE, PLACE, FEATURE = 7_919, 104_729, 32_452_843
#: The largest value of a target has so many bits of steps.
BITS = 35


class Nodes(NamedTuple):
    """All nodes, level by level, the roots of all trees first.

    ``path`` is 1 for a root and 2n, 2n + 1 for the children of n; ``feature`` is -1 in a leaf;
    ``left`` is the place of the left child, the right one stands behind it.
    """

    tree: np.ndarray
    path: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray


def scrambled(x: np.ndarray) -> np.ndarray:
    """Whole numbers below ``MODULUS`` to others that look random."""
    x = np.asarray(x, np.int64) % MODULUS
    for _ in range(ROUNDS):
        x = (x * x % MODULUS * FACTOR + ADDEND) % MODULUS
    return x


def bootstrap_counts(rows: int, trees: int, seed: int) -> np.ndarray:
    """How often each tree draws each row, shape (trees, rows)."""
    draws = scrambled(np.arange(trees)[:, None] * TREE + np.arange(rows) * PLACE + seed) % rows
    counts = np.zeros((trees, rows), dtype=np.float64)
    np.add.at(counts, (np.arange(trees)[:, None], draws), 1.0)
    return counts


def tie_order(tree: np.ndarray, path: np.ndarray, feature: int, seed: int) -> np.ndarray:
    """A fixed number for each (tree, node, feature): of equal cuts the largest wins."""
    return scrambled(tree * TREE + path * PLACE + feature * FEATURE + seed)


def in_steps(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets as whole steps above their lowest value, those lowest values, and steps per unit."""
    low = targets.min(axis=0)
    above = targets - low
    most = above.max(axis=0)
    exponent = np.where(most > 0, BITS - 1 - np.floor(np.log2(np.where(most > 0, most, 1.0))), 0.0)
    per_unit = np.exp2(exponent)
    return np.rint(above * per_unit), low, per_unit


def _running(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each of ``bounds``."""
    sums = np.empty(len(values))
    for a, b in zip(bounds, bounds[1:]):
        np.cumsum(values[a:b], out=sums[a:b])
    return sums


def _best_cut(x, node, weight, mass, starts, rank, heads_of):
    """Best threshold of one feature for every node.

    ``mass`` is the sum over the draws of an entry; ``rank`` lists the entries in order of the
    feature; ``heads_of`` are the first nodes of the targets, whose sums never mix. Returns per node the score of the best
    cut (-inf where the feature is constant) and its threshold, the lowest of equal ones.
    """
    order = rank[np.argsort(node[rank], kind="stable")]
    xs, ns = x[order], node[order]
    bounds = np.append(starts[heads_of], len(order))
    w = _running(weight[order], bounds)
    s = _running(mass[order], bounds)
    ends = np.append(starts[1:], len(order)) - 1
    w_before = np.concatenate(([0.0], w[ends[:-1]]))
    s_before = np.concatenate(([0.0], s[ends[:-1]]))
    w_before[heads_of] = s_before[heads_of] = 0.0
    w_all, s_all = w[ends] - w_before, s[ends] - s_before
    at = np.flatnonzero((ns[1:] == ns[:-1]) & (xs[1:] > xs[:-1]))
    where = ns[at]
    left_w, left_s = w[at] - w_before[where], s[at] - s_before[where]
    right_w, right_s = w_all[where] - left_w, s_all[where] - left_s
    score = left_s * left_s / left_w + right_s * right_s / right_w
    best = np.full(len(starts), -np.inf)
    threshold = np.full(len(starts), np.nan)
    if len(at):
        heads = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        best[where[heads]] = np.maximum.reduceat(score, heads)
        back = at[score == best[where]][::-1]
        threshold[ns[back]] = (xs[back] + xs[back + 1]) / 2.0
    return best, threshold


def grow(
    features: np.ndarray, targets: np.ndarray, counts: np.ndarray, depth: int, seed: int
) -> Nodes:
    """The trees of all targets; those of the first target come first.

    ``targets`` has one column per forest, ``counts`` the draws of rows that all forests share.
    With three dimensions (trees, rows, forests) a row stands for several with equal features, and
    ``targets`` holds the sums over the draws of each tree.
    Trees split on the largest drop in squared error over all features, equal features by
    ``tie_order``, until a node is pure, has a single distinct row, or ``depth`` is reached.
    """
    per_forest, wide = len(counts), targets.shape[-1]
    tree, row = np.nonzero(np.tile(counts, (wide, 1)))
    weight = counts[tree % per_forest, row]
    x = features[row].astype(np.float64)
    of = tree // per_forest
    if targets.ndim == 2:
        steps, low_of, per_unit = in_steps(targets)
        y = steps[row, of]
        mass = weight * y
    else:
        _, low_of, per_unit = in_steps(targets[counts > 0] / counts[counts > 0][:, None])
        mass = np.rint((targets[tree % per_forest, row, of] - weight * low_of[of]) * per_unit[of])
        y = mass / weight
    trees = wide * per_forest
    # A feature that is the same in all rows (the holiday flag of most months) cannot split.
    useful = np.flatnonzero(features.min(axis=0) < features.max(axis=0))
    ranks = [(f, np.argsort(x[:, f], kind="stable")) for f in useful]
    node = tree.astype(np.int64)
    alive = np.ones(len(node), dtype=bool)
    nodes = trees
    of_tree, path = np.arange(trees), np.ones(trees, dtype=np.int64)
    found, begin = [], 0
    for level in range(depth + 1):
        w = np.bincount(node[alive], weight[alive], nodes)
        s = np.bincount(node[alive], mass[alive], nodes)
        target = of_tree // per_forest
        value = low_of[target] + s / w / per_unit[target]
        low = np.full(nodes, np.inf)
        high = np.full(nodes, -np.inf)
        np.minimum.at(low, node[alive], y[alive])
        np.maximum.at(high, node[alive], y[alive])
        best = np.full(nodes, -np.inf)
        feature = np.full(nodes, -1)
        threshold = np.full(nodes, np.nan)
        if level < depth:
            # Pure nodes are done; only the entries of the others are sorted.
            open_node = high > low
            at = np.flatnonzero(alive & open_node[node])
            filled = np.bincount(node[at], minlength=nodes)
            present = np.flatnonzero(filled)
            starts = np.concatenate(([0], np.cumsum(filled[present])[:-1]))
            # Small numbers are sorted by digits, which is faster.
            small = np.uint16 if len(present) <= 65536 else np.int64
            compact = (np.cumsum(filled > 0) - 1)[node[at]].astype(small)
            position = np.full(len(node), -1)
            position[at] = np.arange(len(at))
            heads_of = np.unique(target[present], return_index=True)[1]
            won = np.full(len(present), -1)
            for f, rank in ranks if len(present) else ():
                tie = tie_order(of_tree[present] % per_forest, path[present], int(f), seed)
                live = position[rank]
                live = live[live >= 0]
                score, cut = _best_cut(x[at, f], compact, weight[at], mass[at], starts, live, heads_of)
                old = best[present]
                equal = np.isfinite(score) & (score == old) & (tie > won)
                take = np.flatnonzero((score > old) | equal)
                best[present[take]] = score[take]
                threshold[present[take]] = cut[take]
                feature[present[take]] = f
                won[take] = tie[take]
        splits = feature >= 0
        child = np.cumsum(splits) - 1
        left = np.where(splits, begin + nodes + 2 * child, -1)
        found.append(Nodes(of_tree, path, feature, threshold, left, value))
        if not splits.any():
            break
        alive &= splits[node]
        went = np.flatnonzero(alive)
        right = x[went, feature[node[went]]] > threshold[node[went]]
        node[went] = 2 * child[node[went]] + right
        node[~alive] = 0
        begin += nodes
        nodes = 2 * int(splits.sum())
        of_tree = np.repeat(of_tree[splits], 2)
        path = np.repeat(2 * path[splits], 2) + np.tile([0, 1], nodes // 2)
    return Nodes(*map(np.concatenate, zip(*found)))


class Draws:
    """Draws and ties of forests over many series: a series of as many rows draws the same places."""

    def __init__(self, trees: int, depth: int, seed: int) -> None:
        self.trees, self.depth, self.seed = trees, depth, seed
        self._entries: dict = {}
        self._ties: dict = {}

    def entries(self, rows: int, wide: int) -> tuple[np.ndarray, ...]:
        """Tree, target, row and draws of what the trees of ``wide`` targets draw from ``rows`` rows."""
        if (rows, wide) not in self._entries:
            counts = bootstrap_counts(rows, self.trees, self.seed)
            tree, row = np.nonzero(counts)
            target = np.repeat(np.arange(wide), len(tree))
            self._entries[rows, wide] = (
                np.tile(tree, wide) + target * self.trees, target, np.tile(row, wide),
                np.tile(counts[tree, row], wide),
            )
        return self._entries[rows, wide]

    def ties(self, tree: np.ndarray, path: np.ndarray, feature: int) -> np.ndarray:
        """``tie_order``, looked up where a table of all nodes is small."""
        if self.trees << self.depth > 1 << 16:
            return tie_order(tree, path, feature, self.seed)
        if feature not in self._ties:
            all_trees, all_paths = np.arange(self.trees)[:, None], np.arange(1 << self.depth)
            self._ties[feature] = tie_order(all_trees, all_paths, feature, self.seed)
        return self._ties[feature][tree, path]


def _ranked_alike(features: np.ndarray, of_row: np.ndarray) -> list[tuple[np.ndarray, bool, list[int]]]:
    """Features by the order they put the rows of each series in: ranks, whether rows lie in that
    order already, and the features. Inside a month, say, day and day of month cut alike."""
    found: list[tuple[np.ndarray, bool, list[int]]] = []
    first = np.concatenate(([True], of_row[1:] != of_row[:-1]))
    for f in range(features.shape[1]):
        x = features[:, f]
        order = np.lexsort((x, of_row))
        steps = np.concatenate(([False], x[order][1:] != x[order][:-1])) & ~first
        if not steps.any():
            continue  # the same in all rows of each series: it cannot split
        climbed = np.cumsum(steps)
        rank = np.empty(len(x), np.int64)
        rank[order] = climbed - np.repeat(climbed[first], np.diff(np.append(np.flatnonzero(first), len(x))))
        alike = next((group for known, _, group in found if np.array_equal(known, rank)), None)
        if alike is None:
            found.append((rank, bool((first[1:] | (rank[1:] >= rank[:-1])).all()), [f]))
        else:
            alike.append(f)
    return found


def grow_many(series: list[tuple[np.ndarray, np.ndarray]], draws: Draws) -> Nodes:
    """The trees of several short series, as (series, target, tree), those that ``grow`` would grow.

    ``series`` are features and targets. Entries lie in order of their node; running sums go over
    all of them and are whole numbers below 2**53 while rows x trees x targets stay below 2**18.
    """
    trees, wide = draws.trees, series[0][1].shape[1]
    sizes = np.array([len(targets) for _, targets in series])
    features = np.concatenate([known for known, _ in series]).astype(np.float64)
    ranked = _ranked_alike(features, np.repeat(np.arange(len(series)), sizes))
    parts, lows, units, begin = [], [], [], 0
    for i, (_, targets) in enumerate(series):
        steps, low, per_unit = in_steps(targets)
        tree, target, row, weight = draws.entries(len(targets), wide)
        parts.append((tree + i * wide * trees, row + begin, weight, steps[row, target]))
        lows.append(low)
        units.append(per_unit)
        begin += len(targets)
    low_of, per_unit = np.concatenate(lows), np.concatenate(units)
    tree, row, weight, y = map(np.concatenate, zip(*parts))
    drawn = np.empty(len(row), np.complex128)  # one array for two sums: of draws and of targets
    drawn.real, drawn.imag = weight, weight * y
    size = np.bincount(tree)
    of_tree, path = np.arange(len(size)), np.ones(len(size), dtype=np.int64)
    found, begin = [], 0
    for level in range(draws.depth + 1):
        first = np.cumsum(size) - size
        total = np.add.reduceat(drawn, first)
        forest = of_tree // trees
        value = low_of[forest] + total.imag / total.real / per_unit[forest]
        feature = np.full(len(size), -1)
        threshold = np.full(len(size), np.nan)
        if level < draws.depth:
            # Pure nodes are done; only the entries of the others go on.
            mixed = np.maximum.reduceat(y, first) > np.minimum.reduceat(y, first)
            kept = np.flatnonzero(np.repeat(mixed, size))
            row, y, drawn, size = row.take(kept), y.take(kept), drawn.take(kept), size[mixed]
            feature[mixed], threshold[mixed] = _best_cuts(
                features, ranked, row, drawn, size, total[mixed], of_tree[mixed] % trees,
                path[mixed], draws,
            )
        splits = feature >= 0
        child = np.cumsum(splits) - 1
        left = np.where(splits, begin + len(splits) + 2 * child, -1)
        found.append(Nodes(of_tree, path, feature, threshold, left, value))
        if not splits.any():
            break
        if len(size) > child[-1] + 1:
            kept = np.flatnonzero(np.repeat(splits[mixed], size))
            row, y, drawn, size = row.take(kept), y.take(kept), drawn.take(kept), size[splits[mixed]]
        # Small numbers are sorted by digits, which is faster.
        small = np.uint16 if 2 * len(size) <= 65536 else np.int64
        x = features.ravel().take(row * features.shape[1] + np.repeat(feature[splits], size))
        node = np.repeat(np.arange(0, 2 * len(size), 2, dtype=small), size)
        node += x > np.repeat(threshold[splits], size)
        order = np.argsort(node, kind="stable")
        row, y, drawn, size = row.take(order), y.take(order), drawn.take(order), np.bincount(node)
        begin += len(splits)
        of_tree = np.repeat(of_tree[splits], 2)
        path = np.repeat(2 * path[splits], 2) + np.tile([0, 1], int(splits.sum()))
    return Nodes(*map(np.concatenate, zip(*found)))


def _best_cuts(features, ranked, row, drawn, size, total, tree, path, draws):
    """Feature (-1 where nothing cuts) and threshold of the best cut of every node, the lowest of
    equal thresholds; entries lie in order of their node, and of row inside it."""
    feature, threshold = np.full(len(size), -1), np.full(len(size), np.nan)
    if not len(size):
        return feature, threshold
    best, won = np.full(len(size), -np.inf), np.full(len(size), -1)
    node = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    inside = np.append(node[1:] == node[:-1], False)
    # Sums before and of the node of each entry: whole numbers, the same in any order.
    before, of_node = np.repeat(np.cumsum(total) - total, size), np.repeat(total, size)
    for rank, lies_so, group in ranked:
        rows, x, sums = row, rank.take(row), drawn
        if not lies_so:
            order = np.argsort(node * (int(rank.max()) + 1) + x, kind="stable")
            rows, x, sums = row.take(order), x.take(order), drawn.take(order)
        cuts = inside.copy()
        cuts[:-1] &= x[1:] > x[:-1]
        left = np.cumsum(sums)
        left -= before
        right = of_node - left
        left_w, left_s, right_w, right_s = left.real, left.imag, right.real, right.imag
        with np.errstate(divide="ignore", invalid="ignore"):  # behind the last entry of a node
            score = left_s * left_s / left_w + right_s * right_s / right_w
        score[~cuts] = -np.inf
        top = np.maximum.reduceat(score, first)
        hits = np.flatnonzero(score == np.repeat(top, size))
        of_hit = node.take(hits)
        place = hits[np.concatenate(([True], of_hit[1:] != of_hit[:-1]))]
        low, high = rows.take(place), rows.take(place + 1, mode="clip")
        for f in group:
            tie = draws.ties(tree, path, f)
            take = np.flatnonzero((top > best) | ((top == best) & (top > -np.inf) & (tie > won)))
            best[take], won[take], feature[take] = top[take], tie[take], f
            threshold[take] = (features[low[take], f] + features[high[take], f]) / 2.0
    return feature, threshold


def future_points(last: int, horizon: int, holidays: frozenset) -> tuple[list, np.ndarray]:
    """The dates after day number ``last`` and their features."""
    dates = [datetime.date.fromordinal(last + i) for i in range(1, horizon + 1)]
    points = [[d.toordinal(), d.weekday(), d.day, d.month, int((d.month, d.day) in holidays)] for d in dates]
    return dates, np.array(points, np.float64)


def predict(nodes: Nodes, points: np.ndarray, trees: int, blocks: int = 1) -> np.ndarray:
    """Prediction of every tree for every row of ``points``, shape (trees, rows).

    With several ``blocks`` trees and points are as many equal parts, and each meets its own part.
    """
    rows = len(points) // blocks
    at = np.repeat(np.arange(trees), rows)
    row = np.arange(len(points)).reshape(blocks, 1, rows).repeat(trees // blocks, axis=1).ravel()
    walking = np.flatnonzero(nodes.feature[at] >= 0)
    while len(walking):
        here = at[walking]
        right = points[row[walking], nodes.feature[here]] > nodes.threshold[here]
        at[walking] = nodes.left[here] + right
        walking = walking[nodes.feature[at[walking]] >= 0]
    return nodes.value[at].reshape(trees, rows)


def grow_all(
    features: np.ndarray, targets: np.ndarray, trees: int, depth: int, seed: int,
    at_once: int = 200_000,
) -> list[Nodes]:
    """Forests of all columns of ``targets`` on the same draws of rows, as one or several tables.

    Short series grow all forests in one go; above ``at_once`` tree rows one after the other,
    which needs less memory. Sums and ties of one target never depend on the others, so both ways
    give the same numbers to the last bit.
    """
    counts = bootstrap_counts(len(features), trees, seed)
    wide = targets.shape[1]
    if counts.size * wide > at_once:
        return [grow(features, targets[:, [t]], counts, depth, seed) for t in range(wide)]
    return [grow(features, targets, counts, depth, seed)]


def forests(
    features: np.ndarray, targets: np.ndarray, future: np.ndarray, trees: int, depth: int,
    seed: int, at_once: int = 200_000,
) -> list[np.ndarray]:
    """Predictions (trees, future rows) of one forest per column of ``targets``."""
    future = future.astype(np.float64)
    grown = grow_all(features, targets, trees, depth, seed, at_once)
    per_table = trees * targets.shape[1] // len(grown)
    predictions = [predict(nodes, future, per_table) for nodes in grown]
    return np.split(np.concatenate(predictions), targets.shape[1])


def grow_several(
    series: list[tuple[np.ndarray, np.ndarray]], draws: Draws, at_once: int = 200_000
) -> list[Nodes]:
    """The trees of short series as one table; a series above ``at_once`` tree rows comes alone."""
    (known, values), *others = series
    if not others and values.size * draws.trees > at_once:
        return grow_all(known, values, draws.trees, draws.depth, draws.seed, at_once)
    return [grow_many(series, draws)]


def forests_of_many(
    series: list[tuple[np.ndarray, np.ndarray]], futures: list[np.ndarray], draws: Draws
) -> list[np.ndarray]:
    """Per target the predictions (trees, future rows of all series) for as many future rows each."""
    wide, per_series = series[0][1].shape[1], len(futures[0])
    points = np.concatenate(futures).astype(np.float64)
    grown = grow_several(series, draws)
    per_table = len(series) * wide * draws.trees // len(grown)
    made = [predict(nodes, points, per_table, len(series)) for nodes in grown]
    cells = np.concatenate(made).reshape(len(series), wide, draws.trees, per_series)
    return [cells[:, t].swapaxes(0, 1).reshape(draws.trees, -1) for t in range(wide)]


def by_tree(nodes: Nodes) -> tuple[Nodes, np.ndarray]:
    """The nodes in order of tree and path, children counted from their root, and where trees begin."""
    order = np.lexsort((nodes.path, nodes.tree))
    tree = nodes.tree[order]
    starts = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    left = np.where(nodes.left >= 0, place[np.maximum(nodes.left, 0)], -1)
    return Nodes(*(column[order] for column in nodes._replace(left=left))), starts
