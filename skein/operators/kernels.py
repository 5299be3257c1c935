"""NumPy kernels for groups of bounded size: assignment, matching, Ward trees, silhouettes, spectra, diffusion."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Largest groups that the dense kernels take: points of a Ward tree, nodes of a dense diffusion.
WARD_POINTS, DENSE_NODES = 20_000, 5_000


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest one-to-one assignment of the smaller side (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assignment(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        short, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, low, end, column = row, 0.0, -1, -1
        visited = [row]
        while end < 0:
            slack = low + cost[i] - u[i] - v
            better = ~done & (slack < short)
            short[better] = slack[better]
            prev[better] = column
            column = int(np.argmin(np.where(done, np.inf, short)))
            low = short[column]
            done[column] = True
            if owner[column] < 0:
                end = column
            else:
                i = int(owner[column])
                visited.append(i)
        u[row] += low
        for i in visited[1:]:
            u[i] += low - short[np.flatnonzero(owner == i)[0]]
        v[done] += short[done] - low
        while True:  # the path is turned round
            before = prev[end]
            owner[end] = owner[before] if before >= 0 else row
            if before < 0:
                break
            end = before
    cols = np.flatnonzero(owner >= 0)
    rows = owner[cols]
    order = np.argsort(rows)
    return rows[order], cols[order]


def best_weight(weight: np.ndarray) -> float:
    """Largest total weight of a one-to-one assignment."""
    if not weight.size:
        return 0.0
    rows, cols = assignment(-weight.astype(float))
    return float(weight[rows, cols].sum())


def matching_size(links: list[list[int]]) -> int:
    """Size of a maximum matching; ``links``: for each left node its right nodes (phases of shortest paths)."""
    left: list[int] = [-1] * len(links)
    right: dict[int, int] = {}
    while True:
        level = {i: 0 for i, x in enumerate(left) if x < 0}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            for j in links[i]:
                k = right.get(j, -1)
                if k < 0:
                    found = True
                elif k not in level:
                    level[k] = level[i] + 1
                    queue.append(k)
        if not found:
            return sum(x >= 0 for x in left)
        for start in [i for i, x in enumerate(left) if x < 0]:
            stack, path = [(start, iter(links[start]))], []
            while stack:
                i, rest = stack[-1]
                j = next(rest, None)
                if j is None:
                    level.pop(i, None)
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                k = right.get(j, -1)
                if k < 0:
                    for a, b in [*path, (i, j)]:
                        left[a], right[b] = b, a
                    break
                if level.get(k, -1) == level.get(i, -2) + 1:
                    path.append((i, j))
                    stack.append((k, iter(links[k])))


def most_moves(sizes: np.ndarray) -> int:
    """Largest possible cost of the move-and-join distance to a partition with these cluster sizes."""
    r = 0
    for b in sorted(sizes.tolist()):
        r += r < b
    return int(sum(sizes)) - r


def mojo_cost(table: np.ndarray) -> int:
    """Moves and joins that turn the rows' partition into the columns' (contingency ``table``).

    Objects outside their row's best columns move; rows beyond a largest matching of rows to best columns are joined.
    """
    best = table.max(1)
    links = [np.flatnonzero(row == top).tolist() for row, top in zip(table, best, strict=True)]
    return int(table.sum() - best.sum()) + len(table) - matching_size(links)


def mojofm(table: np.ndarray) -> float:
    """Move-and-join similarity in percent, rounded half to even at two decimals."""
    cost, most = mojo_cost(table), most_moves(table.sum(0))
    if most == 0:
        return 0.0 if table.sum() <= 1 else 100.0 if cost == 0 else 0.0
    return round((1 - cost / most) * 10_000) / 100


def a2a(table: np.ndarray, added: int = 0, removed: int = 0) -> float:
    """Architecture similarity in percent: clusters and entities that must be added, removed or moved."""
    p, g = table.shape
    n = int(table.sum())
    moves = n - best_weight(table)
    cost = abs(p - g) + 2 * added + 2 * removed + moves
    whole = p + g + 2 * (n + removed) + 2 * (n + added)
    return (1 - cost / whole) * 100 if whole else 0.0


def adjusted_rand(table: np.ndarray) -> float:
    pairs = lambda x: float((x * (x - 1) // 2).sum())
    t = table.astype(object)
    both, a, b, n = pairs(t), pairs(t.sum(1)), pairs(t.sum(0)), t.sum()
    if n < 2:
        return 1.0
    expected = a * b / (n * (n - 1) / 2)
    top = (a + b) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def coverage(table: np.ndarray, threshold: float) -> float:
    """Percent of the rows' clusters that share the threshold with some column's cluster."""
    if not table.size:
        return 0.0
    a, b = table.sum(1), table.sum(0)
    return float(100 * np.mean((table / np.maximum(a[:, None], b[None])).max(1) >= (threshold / 100 if threshold > 1 else threshold)))


def ward_tree(x: np.ndarray) -> np.ndarray:
    """Merges of Ward's method as rows ``(node, node, height)``, by height; nodes from ``n`` on are merges.

    Nearest-neighbour chains with the squared-distance update; ties go to the smaller node.
    """
    n = len(x)
    if n > WARD_POINTS:
        raise ValueError(f"{n} points; a Ward tree takes {WARD_POINTS} at most, sample first")
    x = x.astype(float)
    size, centre, alive = np.ones(n), x.copy(), np.ones(n, bool)
    name, merges, chain = np.arange(n), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        d = ((centre - centre[i]) ** 2).sum(1) * (size * size[i] / (size + size[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            chain = chain[:-2]
            a, b = min(i, j), max(i, j)
            merges.append((name[a], name[b], float(np.sqrt(2 * d[j])), len(merges)))
            centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            name[a] = n + len(merges) - 1
        else:
            chain.append(j)
    order = sorted(range(len(merges)), key=lambda k: (merges[k][2], k))
    place = {n + k: n + i for i, k in enumerate(order)}
    return np.array([(place.get(merges[k][0], merges[k][0]), place.get(merges[k][1], merges[k][1]), merges[k][2]) for k in order], float).reshape(-1, 3)


def cut_tree(tree: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels ``0..k-1``, by first point, of the ``k`` clusters of a tree."""
    parent = list(range(n + len(tree)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (a, b, _) in enumerate(tree[: max(0, n - max(1, k))]):
        parent[find(int(a))] = parent[find(int(b))] = n + step
    roots = [find(i) for i in range(n)]
    number: dict[int, int] = {}
    return np.array([number.setdefault(r, len(number)) for r in roots])


def silhouette(x: np.ndarray, labels: np.ndarray, block: int = 512) -> float:
    """Mean silhouette with Euclidean distances; points alone in their cluster count 0."""
    values, lab = np.unique(labels, return_inverse=True)
    size, k, n = np.bincount(lab), len(values), len(x)
    if k < 2:
        return -1.0
    x = x.astype(float)
    square, member, out = (x**2).sum(1), np.eye(k)[lab], np.zeros(n)
    for at in range(0, n, block):
        part = slice(at, min(n, at + block))
        d = np.sqrt(np.maximum(square[part, None] + square[None] - 2 * x[part] @ x.T, 0))
        d[np.arange(d.shape[0]), np.arange(at, at + d.shape[0])] = 0
        sums, own = d @ member, lab[part]
        rows = np.arange(len(own))
        a = sums[rows, own] / np.maximum(size[own] - 1, 1)
        other = sums / size
        other[rows, own] = np.inf
        b = other.min(1)
        out[part] = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(out.mean())


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several runs from distance-weighted starts."""
    rng, x = np.random.default_rng(seed), x.astype(float)
    square, best = (x**2).sum(1), (None, np.inf)
    for _ in range(starts):
        centre = x[[rng.integers(len(x))]]
        near = np.full(len(x), np.inf)
        for _ in range(k - 1):
            near = np.minimum(near, ((x - centre[-1]) ** 2).sum(1))
            total = near.sum()
            pick = rng.integers(len(x)) if total <= 0 else np.searchsorted(np.cumsum(near), rng.random() * total)
            centre = np.vstack([centre, x[min(int(pick), len(x) - 1)]])
        label = None
        for _ in range(rounds):
            d = square[:, None] - 2 * x @ centre.T + (centre**2).sum(1)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            count = np.bincount(label, minlength=k)
            sums = np.zeros_like(centre)
            np.add.at(sums, label, x)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
        inertia = float(np.maximum(d[np.arange(len(x)), label], 0).sum())
        if inertia < best[1]:
            best = (label, inertia)
    return best


class Neighbours:
    """Neighbour lists of undirected edges, each node its own neighbour, as one array of nodes and the places where lists begin."""

    def __init__(self, starts: np.ndarray, nodes: np.ndarray) -> None:
        self.starts, self.nodes = starts, nodes
        self.degree = np.diff(starts).astype(float)

    @classmethod
    def of(cls, n: int, src: np.ndarray, dst: np.ndarray) -> Neighbours:
        """From directed edges, both directions given, without loops."""
        src, dst = (np.concatenate([x, np.arange(n)]).astype(np.int32) for x in (src, dst))
        return cls(np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[np.argsort(src, kind="stable")])

    def spread(self, nodes: np.ndarray, values: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Add each value to ``out`` at all neighbours of its node, so many lists at a time; the nodes that got any."""
        size, got = np.diff(self.starts)[nodes], []
        ends = np.cumsum(size)
        at = 0
        while at < len(nodes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCT, "right")))
            n = size[at:to]
            place = np.arange(n.sum()) + np.repeat(self.starts[nodes[at:to]] - (np.cumsum(n) - n), n)
            hit = self.nodes[place]
            if len(hit) > len(out) // 8:
                out += np.bincount(hit, np.repeat(values[at:to], n), len(out))
            else:
                np.add.at(out, hit, np.repeat(values[at:to], n))
            got.append(hit)
            at = to
        return np.unique(np.concatenate(got)) if sum(map(len, got)) < len(out) // 4 else np.flatnonzero(out)


def ppr_row(a: Neighbours, source: int, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and values of ``rounds`` of ``p <- alpha e + (1 - alpha) T p`` from one source; T is normalised on both sides."""
    half = 1 / np.sqrt(a.degree)
    nodes, p = np.array([source]), np.ones(1)
    for _ in range(rounds):
        out = np.zeros(len(a.degree))
        nodes = a.spread(nodes, p * half[nodes], out)
        p = (1 - alpha) * out[nodes] * half[nodes]
        p[np.searchsorted(nodes, source)] += alpha  # it is its own neighbour, so it is among them
    return nodes, p


def push_row(a: Neighbours, source: int, alpha: float, eps: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and values of PageRank from one source by pushes: in a round, of all residuals of ``eps`` times the degree or more."""
    p, r, reached = np.zeros(len(a.degree)), np.zeros(len(a.degree)), np.array([source])
    r[source] = 1
    for _ in range(rounds):
        go = reached[r[reached] >= eps * a.degree[reached]]
        if not len(go):
            nodes = np.flatnonzero(p)
            return nodes, p[nodes]
        moved = r[go]
        p[go] += alpha * moved
        r[go] = 0
        reached = a.spread(go, (1 - alpha) * moved / a.degree[go], r)
    raise RuntimeError(f"pushes did not settle in {rounds} rounds")


def largest(nodes: np.ndarray, p: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` largest values and their nodes; ties, at nine decimals, go to the smaller node."""
    near = np.round(p, 9)
    if len(near) > keep:
        part = near >= np.partition(near, len(near) - keep)[len(near) - keep]
        nodes, p, near = nodes[part], p[part], near[part]
    top = np.lexsort((nodes, -near))[:keep]
    return nodes[top], p[top]


def normal_adjacency(n: int, src: np.ndarray, dst: np.ndarray, loop: float = 0.0) -> np.ndarray:
    """Dense symmetric-normalised adjacency of undirected edges, with loops of a weight."""
    if n > DENSE_NODES:
        raise ValueError(f"{n} nodes; dense kernels take {DENSE_NODES} at most")
    a = np.zeros((n, n))
    a[src, dst] = a[dst, src] = 1
    a[np.arange(n), np.arange(n)] = loop
    d = a.sum(1)
    s = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
    return a * s[:, None] * s[None]


#: Terms of a sparse product that are held at once.
PRODUCT = 1 << 22


class SparseAdjacency:
    """Symmetric-normalised adjacency of undirected edges, with loops of a weight, as a product with blocks of columns."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, loop: float = 0.0) -> None:
        pair = np.unique(np.stack([np.concatenate([src, dst]), np.concatenate([dst, src])]), axis=1)
        pair = pair[:, pair[0] != pair[1]]
        d = np.bincount(pair[0], minlength=n) + loop
        s = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
        self.n, self.col, self.weight, self.diagonal = n, pair[1], s[pair[0]] * s[pair[1]], loop * s * s
        self.rows, self.starts = np.unique(pair[0], return_index=True)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = self.diagonal[:, None] * x
        ends = np.append(self.starts, len(self.col))
        at = 0
        while at < len(self.rows):  # rows whose edges fit the room, so a product never holds a term for each edge
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PRODUCT // max(1, x.shape[1]), "right")) - 1)
            part = slice(int(ends[at]), int(ends[to]))
            out[self.rows[at:to]] += np.add.reduceat(self.weight[part, None] * x[self.col[part]], self.starts[at:to] - ends[at], axis=0)
            at = to
        return out


def top_eigenvectors(a: SparseAdjacency, k: int, depth: int = 8, rounds: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """Eigenvectors of the ``k`` largest eigenvalues by block Krylov spaces, begun again from their best vectors.

    Ends when every residual is below ``tolerance``; raises if that takes more than ``rounds`` spaces.
    """
    x = np.random.default_rng(5).standard_normal((a.n, min(a.n, k + 8)))
    for _ in range(rounds):
        x = np.linalg.qr(x)[0]
        basis = [x]
        while len(basis) < depth and (len(basis) + 1) * x.shape[1] <= a.n:
            y = a @ basis[-1]
            for _ in range(2):
                for b in basis:
                    y -= b @ (b.T @ y)
            basis.append(np.linalg.qr(y)[0])
        q = np.linalg.qr(np.hstack(basis))[0]
        value, vector = np.linalg.eigh(q.T @ (a @ q))
        x = q @ vector[:, ::-1][:, : x.shape[1]]
        top = x[:, :k]
        if np.abs(a @ top - top * value[::-1][:k]).max(initial=0) < tolerance:
            return top
    raise RuntimeError(f"eigenvectors did not settle in {rounds} rounds")


def laplacian_features(n: int, src: np.ndarray, dst: np.ndarray, k: int) -> np.ndarray:
    """``k`` eigenvectors of the normalised Laplacian after the first, signs set by the largest entry.

    Dense up to ``DENSE_NODES`` nodes, by iteration beyond; both give the same vectors where eigenvalues differ.
    """
    if n <= DENSE_NODES:
        vector = np.linalg.eigh(np.eye(n) - normal_adjacency(n, src, dst))[1]
    else:
        vector = top_eigenvectors(SparseAdjacency(n, src, dst), k + 1)
    out = np.zeros((n, k))
    take = vector[:, 1 : k + 1]
    if take.size:
        take = take * np.sign(take[np.abs(take).argmax(0), np.arange(take.shape[1])])
    out[:, : take.shape[1]] = take
    return out


def _diffused(a: SparseAdjacency, cols: np.ndarray, kind: str, alpha: float) -> np.ndarray:
    """Columns ``cols`` of the diffusion matrix: conjugate gradients for PageRank, the power series for heat."""
    e = np.zeros((a.n, len(cols)))
    e[cols, np.arange(len(cols))] = 1
    if kind == "heat":
        out, term = e.copy(), e
        for t in range(1, 500):
            term = (a @ term) * (alpha / t)
            out += term
            if np.abs(term).max() < 1e-15:
                break
        return out * np.exp(-alpha)
    x, r = np.zeros_like(e), alpha * e
    p, now = r.copy(), (r * r).sum(0)
    for _ in range(1000):
        if now.max() < 1e-26:
            return x
        q = p - (1 - alpha) * (a @ p)
        step = now / np.maximum((p * q).sum(0), 1e-300)
        x += step * p
        r -= step * q
        was, now = now, (r * r).sum(0)
        p = r + (now / np.maximum(was, 1e-300)) * p
    raise RuntimeError("diffusion did not settle")


def diffusion(n: int, src: np.ndarray, dst: np.ndarray, kind: str, alpha: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``src, dst, weight`` of personalised PageRank or heat diffusion, the ``keep`` largest of each column.

    Self loops of weight 1 and symmetric normalisation before; columns sum to 1 after. Ties go to the smaller id. Dense
    up to ``DENSE_NODES`` nodes, in blocks of columns beyond, to the same values.
    """
    if kind not in ("ppr", "heat"):
        raise ValueError(f"unknown diffusion {kind!r}")
    if n <= DENSE_NODES:
        value, vector = np.linalg.eigh(normal_adjacency(n, src, dst, 1.0))
        f = alpha / (1 - (1 - alpha) * value) if kind == "ppr" else np.exp(alpha * (value - 1))
        blocks = [(vector * f) @ vector.T]
    else:
        a = SparseAdjacency(n, src, dst, 1.0)
        blocks = (_diffused(a, np.arange(at, min(n, at + 128)), kind, alpha) for at in range(0, n, 128))
    out, first = [], 0
    for s in blocks:
        out.append(kept_of_columns(s, np.arange(first, first + s.shape[1]), keep))
        first += s.shape[1]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def kept_of_columns(s: np.ndarray, cols: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` largest entries of columns of a diffusion matrix as ``src, dst, weight``, by column and row."""
    s = np.round(s, 12)
    top = np.argsort(-s, axis=0, kind="stable")[: min(keep, len(s))]
    weight = np.take_along_axis(s, top, 0)
    weight = weight / weight.sum(0)
    cols = np.broadcast_to(cols, top.shape)
    order = np.lexsort((top.T.ravel(), cols.T.ravel()))
    return top.T.ravel()[order], cols.T.ravel()[order], weight.T.ravel()[order]


def diffusion_columns(a: SparseAdjacency, cols: np.ndarray, kind: str, alpha: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of :func:`diffusion` that lie in the columns ``cols``; ``a`` has loops of weight 1."""
    return kept_of_columns(_diffused(a, cols, kind, alpha), cols, keep)
