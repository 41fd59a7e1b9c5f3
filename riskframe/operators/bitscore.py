"""Ensembles laid out for whole batches: every split as a bit mask over the leaves of its tree.

A value falls into an interval between the thresholds of its feature. Per block of trees and per feature, a table
holds for each interval (and for a missing value) which leaves of each tree remain possible. Taking one table row per
feature and joining them bit by bit leaves one bit per tree: the leaf. No tree is walked, the cost per row is one
pass over (features x trees) words that stay in cache, and no limit on leaves or depth applies.
"""

from __future__ import annotations

import numpy as np

TREES_PER_BLOCK = 64
LEAVES_PER_BLOCK = 128
ROWS_PER_TILE = 256
BRANCH_BITS = 8  # features on the path and splits inside of a branch that is tabulated
ATTRIBUTED_ROWS = 4096
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, np.int64)
with np.errstate(over="ignore"):
    _PLACE[((np.uint64(1) << np.arange(64, dtype=np.uint64)) * _DE_BRUIJN) >> np.uint64(58)] = np.arange(64)


def leaves_in_order(tree) -> tuple[list[int], dict[int, tuple[int, int, int]]]:
    """Leaf node ids from left to right, and per split the leaf range as (first, first of the right side, end)."""
    order, spans, work = [], {}, [(0, False)]
    while work:
        at, done = work.pop()
        node = tree[at]
        if node.is_leaf:
            spans[at] = (len(order), len(order), len(order) + 1)
            order.append(at)
        elif done:
            spans[at] = (spans[node.left][0], spans[node.right][0], spans[node.right][2])
        else:
            work += [(at, True), (node.right, False), (node.left, False)]
    return order, {i: s for i, s in spans.items() if not tree[i].is_leaf}


class Intervals:
    """Thresholds per feature, and the interval numbers of a batch; missing values get the last number."""

    def __init__(self, trees, features: list[str]):
        self.index = {f: i for i, f in enumerate(features)}
        found: list[set] = [set() for _ in features]
        for tree in trees:
            for node in tree.values():
                if not node.is_leaf:
                    found[self.index[node.feature]].add(node.threshold)
        self.thresholds = [np.array(sorted(x)) for x in found]

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, t in enumerate(self.thresholds):
            v = x[:, k]
            out.append(np.where(np.isnan(v), len(t) + 1, np.searchsorted(t, v, "left")))
        return out

    def local(self, feature: int, used: np.ndarray) -> np.ndarray:
        """From interval numbers to those among the used thresholds only."""
        n = len(self.thresholds[feature])
        return np.append(np.searchsorted(used, np.arange(n + 1), "left"), len(used) + 1)


class Leaves:
    """The leaf of every tree for every row of a batch."""

    def __init__(self, trees, features: list[str]):
        self.intervals = Intervals(trees, features)
        self.blocks = [self._block(trees[i:i + TREES_PER_BLOCK]) for i in range(0, len(trees), TREES_PER_BLOCK)]

    def _block(self, trees):
        ordered = [leaves_in_order(t) for t in trees]
        words = max(1, -(-max(len(o) for o, _ in ordered) // 64))
        splits: dict[int, list] = {}
        for at, (tree, (_, spans)) in enumerate(zip(trees, ordered)):
            for i, span in spans.items():
                node = tree[i]
                f = self.intervals.index[node.feature]
                splits.setdefault(f, []).append((at, int(np.searchsorted(self.intervals.thresholds[f], node.threshold)), bool(node.missing_left), span))
        full = np.zeros((len(trees), words), np.uint64)
        for at, (order, _) in enumerate(ordered):
            full[at] = _words((1 << len(order)) - 1, words)
        tables = []
        for f, found in sorted(splits.items()):
            used = np.array(sorted({k for _, k, _, _ in found}))
            table = np.full((len(used) + 2, len(trees), words), _ONES)
            for at, k, missing_left, (a, b, c) in found:
                not_right, not_left = ~_words((1 << c) - (1 << b), words), ~_words((1 << b) - (1 << a), words)
                place = int(np.searchsorted(used, k))
                table[:place + 1, at] &= not_right
                table[place + 1:-1, at] &= not_left
                table[-1, at] &= not_right if missing_left else not_left
            tables.append((f, self.intervals.local(f, used), table))
        longest = max(len(o) for o, _ in ordered)
        nodes = np.zeros((len(trees), longest), np.int64)
        for at, (order, _) in enumerate(ordered):
            nodes[at, :len(order)] = order
        return full, tables, nodes, np.arange(len(trees)) * longest

    def masks(self, block, numbers) -> np.ndarray:
        full, tables, _, _ = block
        rows = len(numbers[0]) if numbers else 0
        kept = np.broadcast_to(full, (rows, *full.shape)).copy()
        taken = np.empty_like(kept)
        for f, local, table in tables:
            np.take(table, local[numbers[f]], axis=0, out=taken, mode="clip")
            kept &= taken
        return kept

    @staticmethod
    def numbers(kept: np.ndarray) -> np.ndarray:
        """The place of the one bit of each tree."""
        places = _PLACE[((kept * _DE_BRUIJN) >> np.uint64(58)).astype(np.int64)]
        if kept.shape[2] == 1:
            return places[:, :, 0]
        return np.where(kept != 0, places + 64 * np.arange(kept.shape[2]), 0).sum(axis=2)

    def tiles(self, x: np.ndarray):
        """(rows, block number, block, leaf numbers) of a batch."""
        for start in range(0, len(x), ROWS_PER_TILE):
            rows = slice(start, start + ROWS_PER_TILE)
            numbers = self.intervals.of(x[rows])
            for n, block in enumerate(self.blocks):
                yield rows, n, block, self.numbers(self.masks(block, numbers))


def _words(bits: int, words: int) -> np.ndarray:
    return np.array([(bits >> (64 * w)) & 0xFFFFFFFFFFFFFFFF for w in range(words)], np.uint64)


class Scorer(Leaves):
    def __init__(self, trees, features: list[str], baseline: float):
        super().__init__(trees, features)
        self.baseline, self.values = baseline, []
        for n, (_, _, nodes, _) in enumerate(self.blocks):
            block = trees[n * TREES_PER_BLOCK:(n + 1) * TREES_PER_BLOCK]
            self.values.append(np.array([[t[i].value if t[i].is_leaf else 0.0 for i in row] for t, row in zip(block, nodes.tolist())]).ravel())

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), float(self.baseline))
        for rows, n, block, leaves in self.tiles(x):
            total[rows] += self.values[n][leaves + block[3]].sum(axis=1)
        return total

    def prefixes(self, x: np.ndarray) -> np.ndarray:
        """[row, k]: the score by the first k + 1 trees."""
        parts = [np.zeros((len(x), len(b[3]))) for b in self.blocks]
        for rows, n, block, leaves in self.tiles(x):
            parts[n][rows] = self.values[n][leaves + block[3]]
        return float(self.baseline) + np.cumsum(np.concatenate(parts, axis=1), axis=1)

    def raw_with_donors(self, x: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """[row, 0]: the score; [row, 1 + k]: the score with feature k from the donor. Masks of the features before
        and after k are joined once each; a leaf is looked up anew only in the trees whose leaf the donor's value rules out."""
        out = np.full((len(x), 1 + x.shape[1]), float(self.baseline))
        for start in range(0, len(x), ROWS_PER_TILE // 4):
            rows = slice(start, start + ROWS_PER_TILE // 4)
            own, other = self.intervals.of(x[rows]), self.intervals.of(donor[rows])
            for n, block in enumerate(self.blocks):
                full, tables, _, base = block
                size = len(x[rows])
                masks = [table.take(local[own[f]], axis=0) for f, local, table in tables]
                after = [np.broadcast_to(full, (size, *full.shape)).copy()]
                for mask in reversed(masks):
                    after.append(after[-1] & mask)
                leaf = after[-1]  # one bit per tree
                of_tree = self.values[n][self.numbers(leaf) + base]
                out[rows] += of_tree.sum(axis=1)[:, None]
                before = after[0]
                for k, (f, local, table) in enumerate(tables):
                    given = table.take(local[other[f]], axis=0)
                    kept = leaf & given
                    at = np.flatnonzero((kept if kept.shape[2] == 1 else kept.any(axis=2)).ravel() == 0)
                    if len(at):
                        row, tree = np.divmod(at, len(base))
                        rest = before.reshape(-1, full.shape[1])[at]
                        rest &= after[len(tables) - 1 - k].reshape(-1, full.shape[1])[at]
                        rest &= given.reshape(-1, full.shape[1])[at]
                        found = self.values[n][self.numbers(rest[:, None, :])[:, 0] + base[tree]]
                        out[rows, 1 + f] += np.bincount(row, found - of_tree.ravel()[at], size)
                    before = before & masks[k]
        return out


class Attributions:
    """Contributions of every feature.

    A tree is cut into branches. What a branch adds depends only on one bit for each feature on the path to it (whether the row
    passes all of that path's tests on it) and one for each split inside, so it is tabulated over these bits: the
    Shapley values of its leaves, summed, for each feature. A batch makes the bits of every split once, and each branch
    is one look-up per feature for all rows together, in a table that stays in cache. A leaf with too many features on its path for
    a table is weighted on its own.
    """

    def __init__(self, trees, features: list[str], bits: int = BRANCH_BITS):
        self.intervals = Intervals(trees, features)
        self.n, self.trees, self.large, self.splits = len(features), [], [], []
        by_length: dict[int, list] = {}
        for tree in trees:
            splits = [i for i, node in tree.items() if not node.is_leaf]
            place = {i: k for k, i in enumerate(splits)}
            self.splits.append(place)
            inner = dict.fromkeys(tree, 0)
            for i in _below(tree):
                if not tree[i].is_leaf:
                    inner[i] = 1 + inner[tree[i].left] + inner[tree[i].right]
            branches, work = [], [(0, {})]
            while work:
                at, path = work.pop()
                if len(path) + inner[at] <= bits:
                    if path or inner[at]:
                        branches.append(self._branch(tree, at, path, place, by_length))
                elif tree[at].is_leaf:
                    self.large.append(self._large(tree[at], path))
                else:
                    work += [(child, self._longer(tree, at, child, path)) for child in (tree[at].left, tree[at].right)]
            tests = [(self.intervals.index[tree[i].feature], self._place(tree[i]), bool(tree[i].missing_left)) for i in splits]
            self.trees.append((tests, branches))
        self._tabulate(by_length)

    def _place(self, node) -> int:
        return int(np.searchsorted(self.intervals.thresholds[self.intervals.index[node.feature]], node.threshold))

    def _longer(self, tree, at: int, child: int, path: dict) -> dict:
        """A path with the split that leads to the child: per feature its tests as (node, left) and its share of the cover."""
        node = tree[at]
        f = self.intervals.index[node.feature]
        tests, share = path.get(f, ((), 1.0))
        return {**path, f: ((*tests, (at, child == node.left)), share * (tree[child].cover / node.cover if node.cover else 0.0))}

    def _branch(self, tree, top: int, above: dict, place: dict, by_length: dict):
        """(tests of each bit, features, table still empty); its leaves are filed by their number of features."""
        bits = [tuple((place[i], left) for i, left in tests) for tests, _ in above.values()]
        need = {f: ((k, True),) for k, f in enumerate(above)}
        leaves, work = [], [(top, above, need)]
        while work:
            at, path, wanted = work.pop()
            node = tree[at]
            if node.is_leaf:
                leaves.append((node.value, path, wanted))
                continue
            f, bit = self.intervals.index[node.feature], len(bits)
            bits.append(((place[at], True),))
            for child in (node.left, node.right):
                work.append((child, self._longer(tree, at, child, path), {**wanted, f: (*wanted.get(f, ()), (bit, child == node.left))}))
        owners = sorted({f for _, path, _ in leaves for f in path})
        table = np.zeros((len(owners), 1 << len(bits)))
        for value, path, wanted in leaves:
            order = list(path)
            entry = ([path[f][1] for f in order], value, [wanted[f] for f in order], [owners.index(f) for f in order], table)
            by_length.setdefault(len(order), []).append(entry)
        return bits, owners, table

    def _tabulate(self, by_length: dict) -> None:
        columns: dict[int, np.ndarray] = {}
        for entries in by_length.values():
            for start in range(0, len(entries), LEAVES_PER_BLOCK):
                part = entries[start:start + LEAVES_PER_BLOCK]
                values = shapley_table(np.array([e[0] for e in part]), np.array([e[1] for e in part]))
                for (_, _, wanted, owners, table), value in zip(part, values):
                    size = table.shape[1]
                    if size not in columns:
                        columns[size] = (np.arange(size) >> np.arange(max(1, size.bit_length() - 1))[:, None]) & 1
                    mask = np.zeros(size, np.int64)
                    for k, tests in enumerate(wanted):
                        ok = np.ones(size, bool)
                        for bit, left in tests:
                            ok &= columns[size][bit] == left
                        mask |= ok.astype(np.int64) << k
                    table[owners] += value[mask].T

    def _large(self, leaf, path: dict):
        return path, np.array([share for _, share in path.values()]), leaf.value, len(self.trees)

    def of(self, x: np.ndarray) -> np.ndarray:
        phi = np.zeros((self.n, len(x)))
        for start in range(0, len(x), ATTRIBUTED_ROWS):
            rows = slice(start, start + ATTRIBUTED_ROWS)
            self._add(phi[:, rows], x[rows])
        return phi.T

    def _add(self, phi: np.ndarray, x: np.ndarray) -> None:
        count = phi.shape[1]
        low, high = [], []  # interval numbers with missing values before all, and after all
        for k, numbers in enumerate(self.intervals.of(x)):
            kind = np.int16 if len(self.intervals.thresholds[k]) < 32_000 else np.int32
            high.append(numbers.astype(kind))
            low.append(np.where(np.isnan(x[:, k]), kind(-1), high[-1]))
        found, pattern, at = np.empty(count), np.empty(count, np.uint16), np.empty(count, np.intp)
        large = {}
        for leaf in self.large:
            large.setdefault(leaf[3], []).append(leaf)
        for number, (tests, branches) in enumerate(self.trees):
            left = [(low if missing_left else high)[f] <= place for f, place, missing_left in tests]
            right = [~a for a in left]
            for bits, owners, table in branches:
                pattern[:] = 0
                for bit in reversed(bits):
                    pattern += pattern
                    split, is_left = bit[0]
                    passed = left[split] if is_left else right[split]
                    for split, is_left in bit[1:]:
                        passed = passed & (left[split] if is_left else right[split])
                    pattern |= passed
                at[:] = pattern
                for f, values in zip(owners, table):
                    np.take(values, at, out=found, mode="clip")
                    phi[f] += found
            for path, share, value, _ in large.get(number, ()):
                place = self.splits[number]
                agree = np.ones((count, len(path)))
                for k, (steps, _) in enumerate(path.values()):
                    for i, is_left in steps:
                        agree[:, k] *= (left if is_left else right)[place[i]]
                for k, f in enumerate(path):
                    phi[f] += value * (agree[:, k] - share[k]) * _others(agree, share[None], k)


def _below(tree) -> list[int]:
    """Nodes with every child before its parent."""
    order, work = [], [0]
    while work:
        at = work.pop()
        order.append(at)
        if not tree[at].is_leaf:
            work += [tree[at].left, tree[at].right]
    return order[::-1]


def shapley_table(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """[leaf, mask, k]: the attribution of feature k of a leaf when exactly the features in the mask agree.

    A coalition is worth the leaf value times, per feature, agreement (inside) or its share (outside).
    """
    n, d = share.shape
    agree = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    out = np.empty((n, 1 << d, d))
    for k in range(d):
        out[:, :, k] = value[:, None] * (agree[None, :, k] - share[:, None, k]) * _others(agree, share[:, None, :], k)
    return out


def _others(agree: np.ndarray, share: np.ndarray, k: int) -> np.ndarray:
    """The weighted sum over all coalitions of the other features: coefficients of prod (share + agree t) by size.

    Axes of ``agree`` and ``share`` before the last are matched as numpy does.
    """
    d = agree.shape[-1]
    sizes = [np.ones(np.broadcast_shapes(agree.shape[:-1], share.shape[:-1]))]
    for j in range(d):
        if j != k:
            a, s = agree[..., j], share[..., j]
            sizes = [s * sizes[0], *[s * high + a * low for low, high in zip(sizes, sizes[1:])], a * sizes[-1]]
    total, w = 0.0, 1.0 / d
    for size, coefficient in enumerate(sizes):  # size! (d - size - 1)! / d!
        total = total + w * coefficient
        w *= (size + 1) / (d - size - 1) if size + 1 < d else 0.0
    return total
