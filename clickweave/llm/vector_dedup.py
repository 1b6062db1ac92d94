"""Near-duplicate vectors: a small-world graph per shard, searched by the vectors near it; all others are compared.

Vectors are normalised in double precision; equal ones become one class. Classes lie in cells by their
nearest centre; the centres are fitted on a documented, bounded sample (``SAMPLE`` rows a cell, at most
``SAMPLE_BYTES``), every class is dealt. A class asks its own cell and all others whose centres are at most
a gap farther from it. A link is found if either end asks the other's cell: the end that asks counts it for
the other, too, where that one doesn't ask. The gap is the larger one of two that are measured:

* ``RECALL`` of the links (of all, and on average over queries) of ``AUDITED`` classes, which are compared
  with all classes, would be found with it;
* ``TURNED`` of the links to vectors beside the rows of the sample, at a cosine between ``least`` and 1.

The gap decides only how a link is found. Of the other cells, those that can't hold a link are ruled out by
proof: the part of the sphere that is nearer to their centre than to the own one lies farther off than
``least``. All that remain are compared, by products of blocks of vectors, so no cell is left out.

A cell of more than ``shard_size`` classes (a large group of near copies) is dealt to several shards by a
hash, and who asks the cell asks all of them. A shard is a hierarchical navigable small-world graph:
every vector belongs to the lowest layer, ever fewer to the layers above. Vectors are inserted in random
order; each is linked to those near ones among the vectors before it that are nearer to it than to
one another, so early vectors keep links between groups, and from its nearest one always. A query is a
greedy descent through the upper layers, then a beam over the lowest one; in its own shard it also starts
at its own row. A query whose beam is full of links is searched again with a wider one, so links are not
cut off by the beam either.

The beam is widened until two audits find ``RECALL`` of the links (of all links, and on
average over the audited queries), and neither counts queries without links:

* of a shard, once: ``ROWS_AUDITED`` of its rows, every second one turned away to a cosine
  between ``least`` and 1, are searched like vectors of other shards, without a row to start
  at. All of them have a link there, the row itself, however many shards there are;
* of every batch of queries in a shard: those of a sample that have links there, and up to
  ``LINKED_AUDITED`` of those for which the search has found any, are compared with all rows.

At the width of the shard the search is exhaustive, so the audits always end. They are samples:
links of queries that were not audited can still be missing, up to about 1 - ``RECALL``.

Links are verified by cosine in double precision. They are counted per query and shard, the
query itself is left out; sent on is only a spanning forest of the links of a task, never all
pairs.

Work of the search grows with the vectors and the cells that each asks; centres are at most ``MOST_CELLS``. The
comparison grows with the square of the vectors as far as no proof rules cells out.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths link with nothing either. Equal
vectors (also repeated rows) link with each other. Null ids belong to a component whose
smallest id they never are; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import Union, connected_components, materialise

LEAST_COSINE = 0.9
SHARD_SIZE = 16_384
#: A cell has about this share of a shard's rows; there are at most so many cells.
CELL_SHARE = 4
MOST_CELLS = 4_096
#: Rows of the sample for a cell, and bytes of all; steps of fitting the centres.
SAMPLE = 64
SAMPLE_BYTES = 32_000_000
STEPS = 8
#: Classes compared with all others, share of links beside rows that the gap must not lose, bins of the gap.
AUDITED = 2_048
TURNED = 0.95
BIN = 0.01
#: Queries of a task, about.
QUERIES = 16_384
#: A block of compared vectors has twice the rows of a shard, at most so many bytes.
BLOCK_BYTES = 10_000_000
NEIGHBOURS = 12
#: Nearest rows among which neighbours are chosen.
CANDIDATES = 48
BEAM = 32
BATCH = 512
RECALL = 0.999
#: Audited rows of a shard, queries of a batch taken as they come, and queries of a batch with links.
ROWS_AUDITED = 512
AUDIT = 16
LINKED_AUDITED = 64
#: A beam this many times as wide as the rows it follows at once.
WIDE = 8


def _apart(near: np.ndarray, to: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (nearest first, ``near`` to the row) are kept: nearer to the row than to any kept before."""
    kept = np.zeros(near.shape, bool)
    for i in range(near.shape[1]):
        blocked = (kept & (to[:, i] >= near[:, i, None])).any(axis=1)
        kept[:, i] = np.isfinite(near[:, i]) & ~blocked & (kept.sum(axis=1) < most)
    return kept


def _few_apart(near: np.ndarray, c: np.ndarray, most: int) -> list[int]:
    """``_apart`` for one row with many candidates ``c``; places left over go to the nearest others."""
    kept: list[int] = []
    open_ = np.ones(len(near), bool)
    while open_.any() and len(kept) < most:
        i = int(open_.argmax())
        kept.append(i)
        open_[i] = False
        open_ &= c @ c[i] < near
    rest = [i for i in range(len(near)) if i not in set(kept)] if len(kept) < most else []
    return kept + rest[: most - len(kept)]


class Graph:
    """Layers of neighbour lists over the rows of ``x`` (unit vectors), inserted in random order, in batches."""

    def __init__(self, x: np.ndarray, seed: int = 0) -> None:
        self.x, n = x, len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 4)
        order = rng.permutation(n)
        # Layers from the top down, each with its members and their neighbour lists.
        self.layers: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]] = []
        for layer in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= layer)
            if len(members):
                self.layers.append((members, self._linked(members, np.argsort(np.argsort(order[members])))))

    def _linked(self, members: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the neighbour lists and the lists (rows of ``members``); ``turn`` is the order of insertion.

        A row is linked to the nearest of the rows before it that lie apart from each other, and
        they to it, so early rows of a group keep links to other groups. Full lists are chosen anew, but
        the link to a row from the nearest one before it stays: all rows can be reached."""
        n = len(members)
        rows = np.argsort(turn)
        x = self.x[members[rows]]
        own: list[np.ndarray] = []
        back: list[list[int]] = [[] for _ in range(n)]
        first: list[list[int]] = [[] for _ in range(n)]
        for i in range(0, n, BATCH):
            stop = min(i + BATCH, n)
            s = x[i:stop] @ x[:stop].T
            s[:, i:][np.triu_indices(stop - i)] = -np.inf
            k = min(CANDIDATES, stop)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(s, near, axis=1)
            sort = np.argsort(-score, axis=1, kind="stable")
            near, score = np.take_along_axis(near, sort, axis=1), np.take_along_axis(score, sort, axis=1)
            c = x[near]
            kept = _apart(score, c @ c.transpose(0, 2, 1), NEIGHBOURS)
            for a, (hits, keep) in enumerate(zip(near, kept, strict=True), i):
                own.append(hits[keep])
                for b in own[-1].tolist():
                    back[b].append(a)
                if a:
                    first[own[-1][0]].append(a)
        lists = []
        for a in range(n):
            both = np.concatenate([own[a], np.array(back[a], np.int64)])
            if len(both) > 2 * NEIGHBOURS:
                score = x[both] @ x[a]
                sort = np.argsort(-score, kind="stable")
                both = both[sort][_few_apart(score[sort], x[both[sort]], 2 * NEIGHBOURS)]
                both = np.union1d(both, first[a])
            lists.append(both.astype(np.int64))
        at = np.empty(n, np.int64)
        at[rows] = np.arange(n)
        ends = np.cumsum([0, *[len(lists[a]) for a in at.tolist()]])
        return ends, rows[np.concatenate([lists[a] for a in at.tolist()])].astype(np.int32)

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> np.ndarray:
        """Rows of the ``beam`` best vectors met for each query (one again where there are fewer).

        ``own`` is a row of the shard for each query to start at besides, -1 for none."""
        entry = np.full((len(q), 1), self.layers[0][0][0])
        for depth, (members, links) in enumerate(self.layers):
            if own is not None and depth + 1 == len(self.layers):
                # The lowest layer holds all rows.
                entry = np.column_stack([np.where(own < 0, entry[:, 0], own), entry])
            at = np.searchsorted(members, entry)
            entry = members[self._walk(q, members, links, at, 4 if depth + 1 < len(self.layers) else beam)]
        return entry

    def _walk(self, q: np.ndarray, members: np.ndarray, links: tuple[np.ndarray, np.ndarray], entry: np.ndarray, beam: int) -> np.ndarray:
        n, rows = len(members), np.arange(len(q))
        beam = min(beam, n)
        x, (ends, lists) = self.x if n == len(self.x) else self.x[members], links
        if beam == n:
            return np.broadcast_to(np.arange(n), (len(q), n))
        at_once = max(1, beam // WIDE)
        # The place in its step at which a query met a row; -1 where it has not.
        met = np.full(len(q) * n, -1, np.int32)
        best = np.full((len(q), beam), -1)
        score = np.full((len(q), beam), -np.inf)
        open_ = np.zeros((len(q), beam), bool)

        def meet(query: np.ndarray, row: np.ndarray) -> np.ndarray:
            """Marks (query, row) pairs; true for one of equal ones, and only for new ones."""
            place = query * n + row
            new = met[place] < 0
            number = np.arange(1, len(place) + 1, dtype=np.int32)
            met[place[new]] = number[new]
            return new & (met[place] == number)

        first = entry[:, :beam]
        width = first.shape[1]
        new = meet(np.repeat(rows, width), first.ravel()).reshape(first.shape)
        best[:, :width] = first
        score[:, :width] = np.where(new, np.einsum("qd,qkd->qk", q, x[first]), -np.inf)
        open_[:, :width] = new
        while True:
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return np.where(np.isfinite(score), best, first[:, :1])
            # The best open rows of each beam are followed together.
            ahead = np.where(open_[live], score[live], -np.inf)
            pick = np.argpartition(-ahead, at_once - 1, axis=1)[:, :at_once]
            side = np.arange(len(live))[:, None]
            chosen = open_[live[:, None], pick]
            open_[live[:, None], pick] = False
            a, step = np.nonzero(chosen)
            followed = best[live[a], pick[a, step]]
            count = ends[followed + 1] - ends[followed]
            stop = np.cumsum(count)
            b = lists[np.arange(stop[-1]) + np.repeat(ends[followed] - stop + count, count)]
            a = np.repeat(a, count)
            new = meet(live[a], b)
            a, b = a[new], b[new]
            # What each query has met, side by side.
            count = np.bincount(a, minlength=len(live))
            column = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            near = np.full((len(live), max(1, int(count.max()))), -1)
            s = np.full(near.shape, -np.inf)
            near[a, column] = b
            s[a, column] = np.einsum("id,id->i", q[live[a]], x[b])
            all_s = np.concatenate([score[live], s], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            score[live] = all_s[side, top]
            best[live] = np.concatenate([best[live], near], axis=1)[side, top]
            open_[live] = np.concatenate([open_[live], np.isfinite(s)], axis=1)[side, top]


def _found(graph: Graph, q: np.ndarray, least: float, beam: int, own: np.ndarray) -> list[np.ndarray]:
    """Rows within ``least`` of each query that the search finds, the query's own row left out."""
    n, links, rows = len(graph.x), [np.empty(0, int)] * len(q), np.arange(len(q))
    while len(rows):
        for r, h in zip(rows.tolist(), graph.search(q[rows], beam, own[rows]), strict=True):
            h = np.unique(h)
            links[r] = h[(graph.x[h] @ q[r] >= least) & (h != own[r])]
        # A beam that links fill to more than a half may have cut some off.
        rows = np.array([r for r in rows.tolist() if 2 * len(links[r]) >= beam and beam < n], int)
        beam *= 4
    return links


def _truth(graph: Graph, q: np.ndarray, least: float, own: np.ndarray) -> list[np.ndarray]:
    """Rows within ``least`` of each query, by comparing it with all rows."""
    hits = [np.flatnonzero(row >= least) for row in q @ graph.x.T]
    return [h[h != o] for h, o in zip(hits, own.tolist(), strict=True)]


def recall(truth: list[np.ndarray], found: list[np.ndarray]) -> float:
    """Share of the links found: of all, or on average over queries with links, whichever is less."""
    pairs = [(len(t), len(np.intersect1d(t, f))) for t, f in zip(truth, found, strict=True) if len(t)]
    if not pairs:
        return 1.0
    return min(sum(f for _, f in pairs) / sum(t for t, _ in pairs), sum(f / t for t, f in pairs) / len(pairs))


def _beside(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Rows turned away to a cosine between ``least`` and 1: a part of a random direction at right angles to each."""
    side = rng.normal(size=x.shape)
    side -= np.einsum("id,id->i", side, x)[:, None] * x
    size = np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(min(least, 1.0), 1.0, size=size.shape)
    return np.where(size > 1e-9, c * x + np.sqrt(1 - c * c) * side / np.maximum(size, 1e-9), x)


def settled_beam(graph: Graph, least: float, beam: int = BEAM) -> int:
    """The beam with which rows of the shard, and vectors beside them, find their links from afar."""
    x, n = graph.x, len(graph.x)
    rng = np.random.default_rng(1)
    rows = np.sort(rng.choice(n, min(ROWS_AUDITED, n), replace=False))
    q = x[rows].copy()
    q[1::2] = _beside(q[1::2], least, rng)
    none = np.full(len(q), -1)
    truth = _truth(graph, q, least, none)
    while beam < n and recall(truth, _found(graph, q, least, beam, none)) < RECALL:
        beam *= 2
    return beam


def links_of(
    graph: Graph, q: np.ndarray, least: float, beam: int = BEAM, own: np.ndarray | None = None
) -> tuple[list[np.ndarray], int]:
    """Rows of the shard within ``least`` of each query, without its ``own``; the beam that the audit settled on."""
    n, own = len(graph.x), np.full(len(q), -1) if own is None else own
    sample = np.unique(np.linspace(0, len(q) - 1, AUDIT).astype(int))
    while True:
        links = _found(graph, q, least, beam, own)
        if beam >= n:
            return links, beam
        linked = np.array([r for r, h in enumerate(links) if len(h)], int)
        if len(linked) > LINKED_AUDITED:
            linked = linked[np.linspace(0, len(linked) - 1, LINKED_AUDITED).astype(int)]
        audit = np.union1d(sample, linked)
        if recall(_truth(graph, q[audit], least, own[audit]), [links[r] for r in audit.tolist()]) >= RECALL:
            return links, beam
        beam *= 2


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def centres_of(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit vectors in whose middle the rows of a sample lie, at most ``cells``."""
    centres = x[np.random.default_rng(2).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(STEPS):
        near = np.concatenate([(x[i : i + BATCH] @ centres.T).argmax(axis=1) for i in range(0, len(x), BATCH)])
        order = np.argsort(near, kind="stable")
        held, start = np.unique(near[order], return_index=True)
        middle = np.add.reduceat(x[order], start, axis=0)
        size = np.linalg.norm(middle, axis=1)
        centres = centres.copy()
        centres[held[size > 0]] = middle[size > 0] / size[size > 0, None]
    return centres


def gaps_of_links(to_a: np.ndarray, to_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The gaps with which either end of links (``a``, ``b``) asks the other's cell; cosines of the rows to all centres."""
    home_a, home_b = to_a.argmax(axis=1)[a], to_b.argmax(axis=1)[b]
    return np.minimum(to_a[a, home_a] - to_a[a, home_b], to_b[b, home_b] - to_b[b, home_a])


def _fit_cells(least: float) -> Callable:
    """The centres of the vectors of one length and the gap that vectors beside the sample's rows need."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows.sort_values("v")["v"])
        centres = centres_of(x, int(rows["cells"].iloc[0]))
        some = x[:: max(1, len(x) // AUDITED)]
        each, beside = np.arange(len(some)), _beside(some, least, np.random.default_rng(3))
        needed = gaps_of_links(some @ centres.T, beside @ centres.T, each, each)
        return pd.DataFrame([{"size": int(key[0]), "centres": centres.tobytes(), "gap": float(np.quantile(needed, TURNED))}])

    return run


Centres = dict[int, np.ndarray]  # of each length of vectors with more than one cell, in bytes


def _needed_gaps(centres: Centres, queries: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> Callable:
    """Per query, how many of its links need which gap, in steps of ``BIN``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosines = {size: q @ centres[size].T for size, (_, q) in queries.items()}
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len)):
                if size not in queries:
                    continue
                ids, q = queries[size]
                x, own = _matrix(rows["v"]), rows["class_id"].to_numpy()
                for i in range(0, len(x), BATCH):
                    part = x[i : i + BATCH]
                    a, b = np.nonzero((q @ part.T >= least) & (ids[:, None] != own[i : i + BATCH]))
                    if len(a):
                        steps = np.ceil(gaps_of_links(cosines[size], part @ centres[size].T, a, b) / BIN).astype(int)
                        found = pd.DataFrame({"size": size, "query": ids[a], "step": steps})
                        yield found.groupby(["size", "query", "step"]).size().rename("links").reset_index()

    return run


def gap_for(needed: pd.DataFrame) -> float:
    """The least gap that finds ``RECALL`` of the links, of all and on average over queries."""
    if needed.empty:
        return 0.0
    links = needed.pivot_table(index="query", columns="step", values="links", aggfunc="sum", fill_value=0)
    links = links[sorted(links.columns)]
    upto, total = links.cumsum(axis=1), links.sum(axis=1)
    enough = (upto.sum() / total.sum() >= RECALL) & (upto.div(total, axis=0).mean() >= RECALL - 1e-12)
    return float(enough.idxmax()) * BIN


def may_link(s: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Which cells may hold links of rows with the cosines ``s`` to all centres; of all others it is certain that they hold none.

    A cell's rows are at least as near to its centre as to the row's own one. The nearest point of that half
    of the sphere is farther off than ``least`` where the row lies farther than that beyond its border."""
    if least < 0:
        return np.ones(s.shape, bool)
    own, size = centres[s.argmax(axis=1)], (centres * centres).sum(axis=1)
    apart = np.sqrt(np.maximum((own * own).sum(axis=1)[:, None] + size - 2 * own @ centres.T, 0.0))
    # More than what rounding changes.
    return s >= s.max(axis=1, keepdims=True) - np.sqrt(max(0.0, 1 - least * least)) * apart - 1e-6


def _ask(centres: Centres, gaps: dict[int, float], least: float) -> Callable:
    """Every class with its cell, the cells it asks, its own among them, and the others that may hold links of it."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby(batch["v"].map(len)):
                for i in range(0, len(rows), BATCH):
                    part = rows.iloc[i : i + BATCH]
                    home, asked, far = np.zeros(len(part), int), [[0]] * len(part), [[]] * len(part)
                    if size in centres:
                        s = _matrix(part["v"]) @ centres[size].T
                        home = s.argmax(axis=1)
                        near, may = s >= s.max(axis=1, keepdims=True) - gaps[size], may_link(s, centres[size], least)
                        asked = [np.flatnonzero(n).tolist() for n in near & may]
                        far = [np.flatnonzero(n).tolist() for n in may & ~near]
                    yield part.assign(size=size, home=home, asked=asked, far=far)

    return run


GRAPHS = "size int, cell int, part int, graph binary"


def _build_shard(least: float) -> Callable:
    """The graph of a shard and its beam with the ids, numbers of copies and asked cells of its classes, as one row."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class_id")
        graph = Graph(_matrix(rows["v"]))
        asked = [np.asarray(a, np.int32) for a in rows["asked"]]
        stored = pickle.dumps(
            (rows["class_id"].to_numpy(), rows["n"].to_numpy(), asked, graph, settled_beam(graph, least))
        )
        return pd.DataFrame([dict(zip(("size", "cell", "part"), map(int, key), strict=True)) | {"graph": stored}])

    return run


def _search_shard(least: float) -> Callable:
    """All queries of a block against one shard."""

    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(queries):
            ids, copies, asked, graph, beam = pickle.loads(shard["graph"].iloc[0])
            local, names = Union(), ids.tolist()
            q, qid, home = _matrix(queries["v"]), queries["class_id"].to_numpy(), queries["home"].to_numpy()
            n_q = queries["n"].to_numpy()
            at = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
            own = np.where(ids[at] == qid, at, -1)
            # Links that rows of the shard don't find themselves: they don't ask the query's cell.
            back = np.zeros(len(ids), np.int64)
            asks = {(j, int(c)) for j, a in enumerate(asked) for c in a}
            for i in range(0, len(q), BATCH):
                part = slice(i, i + BATCH)
                found, _ = links_of(graph, q[part], least, beam, own[part])
                for c, o, h, m, hits in zip(
                    qid[part].tolist(), own[part].tolist(), home[part].tolist(), n_q[part].tolist(), found, strict=True
                ):
                    # Of its own class, a row has the other copies as links.
                    n = int(copies[hits].sum()) + (int(copies[o]) - 1 if o >= 0 else 0)
                    out.append((c, n, None))
                    for j in hits.tolist():
                        local.join(c, names[j])
                        if (j, h) not in asks:
                            back[j] += m
            out += [(names[j], int(back[j]), None) for j in np.flatnonzero(back).tolist()]
            # Of the links, a spanning forest goes on: a row for each class.
            out += [(c, 0, root) for c in list(local.parent) if (root := local.root(c)) != c]
        return pd.DataFrame(out, columns=["class_id", "n_links", "root"]).astype({"root": "Int64"})

    return run


Blocks = dict[int, tuple[np.ndarray, np.ndarray, int]]  # of each length: a cell's rows, rows of the cells before, rows of a block


def _partners(blocks: Blocks) -> Callable:
    """Every class with its block and those that it is compared with: all in which its ``far`` cells lie."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby("size"):
                held, before, most = blocks[int(size)]
                first, last = before // most, (before + held - 1) // most
                for i in range(0, len(rows), BATCH):
                    part = rows.iloc[i : i + BATCH]
                    home, each = part["home"].to_numpy(), part["far"].map(len).to_numpy()
                    row, cell = np.repeat(np.arange(len(part)), each), np.concatenate(part["far"].tolist()).astype(int)
                    row, cell = row[cell < len(held)], cell[cell < len(held)]
                    row, cell = row[held[cell] > 0], cell[held[cell] > 0]
                    block = (before[home] + part["place"].to_numpy() % held[home]) // most
                    # Blocks between the first and the last one of a cell.
                    met = np.zeros((len(part), int(last.max()) + 2), int)
                    np.add.at(met, (row, first[cell]), 1)
                    np.add.at(met, (row, last[cell] + 1), -1)
                    yield part.assign(block=block, other=[np.flatnonzero(m).tolist() for m in met.cumsum(axis=1) > 0]).drop(
                        columns=["far", "place"]
                    )

    return run


def pairs_within(q: np.ndarray, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within ``least``: single precision rules out, double precision decides. ``x`` may be ``q``: each pair once."""
    # A sum of products of unit vectors is off by less than this.
    low = np.float32(least - (q.shape[1] + 8) * 2.0**-23)
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    for i in range(0, len(q), BATCH):
        for j in range(i if q is x else 0, len(x), 4 * BATCH):
            near = q32[i : i + BATCH] @ x32[j : j + 4 * BATCH].T >= low
            if near.any():
                a, b = np.flatnonzero(near.any(axis=1)) + i, np.flatnonzero(near.any(axis=0)) + j
                row, column = np.nonzero(q[a] @ x[b].T >= least)
                a, b = a[row], b[column]
                yield (a[a < b], b[a < b]) if q is x else (a, b)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (a row of the component, its own label) after links of ``a`` and ``b``."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    return label


def _compare(least: float) -> Callable:
    """The links between the rows of two blocks, or of one, without those that the search of a shard has met."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "class_id"])
        x, ids, copies, home = _matrix(rows["v"]), rows["class_id"].to_numpy(), rows["n"].to_numpy(), rows["home"].to_numpy()
        # Rows and the cells that they ask, as one sorted number each.
        most = 1 + max(int(a.max()) for a in rows["asked"])
        asked = np.repeat(np.arange(len(rows)), rows["asked"].map(len)) * most + np.concatenate(rows["asked"].tolist())
        asked.sort()

        def asks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            wanted = np.where(home[b] < most, a * most + home[b], -1)
            return asked[np.minimum(np.searchsorted(asked, wanted), len(asked) - 1)] == wanted

        split = int((rows["block"] == key[1]).sum())
        second = x if key[1] == key[2] else x[split:]
        first, skipped = (x, 0) if second is x else (x[:split], split)
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for a, b in pairs_within(first, second, least):
            b = b + skipped
            new = ~asks(a, b) & ~asks(b, a)
            a, b = a[new], b[new]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = joined(label, a, b)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(rows))))
        out = pd.DataFrame({"class_id": ids[some], "n_links": links[some], "root": pd.array(ids[label[some]], "Int64")})
        return out.assign(root=out["root"].mask(out["root"] == out["class_id"]))

    return run


def _far_links(asking: DataFrame, layout: DataFrame, least: float, shard_size: int) -> DataFrame | None:
    """``class_id``, ``n_links``, ``root`` of the links that lie in ``far`` cells; blocks of near cells meet in pairs."""
    cells = layout.groupBy("size").agg(F.collect_list(F.struct("cell", "rows")).alias("cells"))
    blocks: Blocks = {}
    for r in cells.filter(F.size("cells") > 1).collect():
        held = np.zeros(1 + max(c.cell for c in r.cells), np.int64)
        for c in r.cells:
            held[c.cell] = c.rows
        blocks[r.size] = held, np.cumsum(held) - held, max(1, min(2 * shard_size, BLOCK_BYTES // r.size))
    if not blocks:
        return None
    counts = [-(-int(held.sum()) // most) for held, _, most in blocks.values()]
    tasks = min(2_000, 2 * sum(n * (n + 1) for n in counts) + 8)
    far = asking.filter(F.size("far") > 0).withColumn("place", F.pmod(F.xxhash64("v", F.lit(4)), F.lit(1 << 40)))
    far = far.mapInPandas(_partners(blocks), "class_id bigint, v binary, n bigint, size int, home int, asked array<int>, block int, other array<int>")
    far = far.withColumn("other", F.explode("other")).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    keys = ["size", "low", "high"]
    far = far.drop("other").repartition(tasks, *keys).groupBy(*keys)
    return far.applyInPandas(_compare(least), "class_id bigint, n_links bigint, root bigint")


def _normal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null where a vector links with nothing."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.empty(0)
            size = np.sqrt((x * x).sum()) if len(x) and np.isfinite(x).all() else 0.0
            out.append((x / size).tobytes() if size > 0 and np.isfinite(size) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])


def _asking(classes: DataFrame, least: float, cell_rows: int) -> DataFrame:
    """``class_id``, ``v``, ``n``, ``size``, ``home``, ``asked``, ``far``: every class with its cell, the cells it asks, others with links."""
    spark = classes.sparkSession
    sized = classes.withColumn("size", F.length("v"))
    # Only lengths with more vectors than one cell has are divided.
    many = sized.groupBy("size").agg(F.count("*").alias("rows")).filter(F.col("rows") > cell_rows).collect()
    centres, gaps = {}, {}
    if many:
        cells = {r.size: min(MOST_CELLS, -(-r.rows // cell_rows)) for r in many}
        share = {r.size: min(1.0, min(max(4_096, SAMPLE * cells[r.size]), SAMPLE_BYTES // r.size) / r.rows) for r in many}
        audit = {r.size: min(1.0, AUDITED / r.rows) for r in many}
        shares = spark.createDataFrame(
            [(s, cells[s], int(share[s] * (1 << 30)), int(audit[s] * (1 << 30))) for s in cells],
            "size int, cells int, share bigint, audit bigint",
        )
        drawn = lambda seed: F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30))
        divided = sized.join(F.broadcast(shares), "size")
        fitted = divided.filter(drawn(2) < F.col("share")).select("size", "cells", "v").groupBy("size")
        for r in fitted.applyInPandas(_fit_cells(least), "size int, centres binary, gap double").collect():
            centres[r.size] = np.frombuffer(r.centres, np.float64).reshape(-1, r.size // 8)
            gaps[r.size] = r.gap
        picked = divided.filter(drawn(3) < F.col("audit")).select("size", "class_id", "v").toPandas()
        queries = {
            int(size): (rows["class_id"].to_numpy(), _matrix(rows["v"])) for size, rows in picked.groupby("size") if size in centres
        }
        needed = classes.mapInPandas(_needed_gaps(centres, queries, least), "size int, query bigint, step int, links bigint")
        needed = needed.groupBy("size", "query", "step").agg(F.sum("links").alias("links")).toPandas()
        for size, rows in needed.groupby("size"):
            gaps[int(size)] = max(gaps[int(size)], gap_for(rows))
    asked = classes.select("class_id", "v", "n").mapInPandas(
        _ask(centres, gaps, least), "class_id bigint, v binary, n bigint, size int, home int, asked array<int>, far array<int>"
    )
    return materialise(asked, "vector-cells")


def near_duplicates(
    vectors: DataFrame, least: float = LEAST_COSINE, shard_size: int = SHARD_SIZE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per row ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = materialise(rows.mapInArrow(_normal, "vec_id bigint, v binary"), "unit-vectors")
    grouped = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialise(grouped.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    asking = _asking(classes, least, max(1, shard_size // CELL_SHARE))
    # A cell has as many shards as its rows need, and as many blocks of queries.
    cells = asking.select("size", "home", F.explode("asked").alias("cell")).groupBy("size", "cell")
    cells = cells.agg(F.count("*").alias("queries"), F.count_if(F.col("home") == F.col("cell")).alias("rows"))
    layout = materialise(
        cells.select(
            "size", "cell", "rows", F.ceil(F.col("rows") / shard_size).cast("int").alias("parts"),
            F.ceil(F.col("queries") / QUERIES).cast("int").alias("blocks"),
        ),
        "vector-layout",
    )
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Groups are few and heavy, so adaptive execution must not join them by size.
    tasks = min(2_000, 4 * layout.count() + 8)
    homes = asking.withColumn("cell", F.col("home")).join(F.broadcast(layout), ["size", "cell"])
    homes = homes.select("class_id", "v", "n", "asked", "size", "cell", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    # A graph is built once; every block of queries of a cell meets every shard of it.
    keys = ["size", "cell", "part"]
    shards = homes.repartition(tasks, *keys).groupBy(*keys).applyInPandas(_build_shard(least), GRAPHS)
    indexed = materialise(shards, "vector-graphs").join(F.broadcast(layout), ["size", "cell"]).select(*keys, "graph", each("blocks").alias("block"))
    queries = asking.select("class_id", "v", "n", "size", "home", F.explode("asked").alias("cell")).join(F.broadcast(layout), ["size", "cell"])
    block = F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    queries = queries.select("class_id", "v", "n", "size", "home", "cell", block, each("parts").alias("part"))
    keys = [*keys, "block"]
    sides = [side.repartition(tasks, *keys).groupBy(*keys) for side in (indexed, queries)]
    found = sides[0].cogroup(sides[1]).applyInPandas(_search_shard(least), "class_id bigint, n_links bigint, root bigint")
    if (far := _far_links(asking, layout, least, shard_size)) is not None:
        found = found.unionByName(far)
    found = materialise(found, "vector-links")
    counts = found.groupBy("class_id").agg(F.sum("n_links").alias("n_links"))
    edges = found.select(F.col("class_id").alias("a"), F.col("root").alias("b")).filter("b is not null")
    roots = connected_components(edges).select(F.col("node").alias("class_id"), "component")
    rooted = classes.join(roots, "class_id", "left").withColumn("root", F.coalesce("component", "class_id"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").join(counts, "class_id").select("v", "n_links", "component_id")
    joined = rows.join(materialise(labels, "vector-labels"), "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
