"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Texts become ids with an end id; longer ones than a sequence are cut, the first piece
being the remainder, so that all others fill a sequence of their own. What is left to
pack are pieces shorter than a sequence, one per document at most.

They are dealt evenly to groups of about ``GROUP`` pieces. Every group is evolved on
several islands, a task each: a solution is a set of sequences; crossover injects whole
well-filled sequences of one parent into the other, removes sequences that hold a piece
twice, and puts the displaced pieces back by best fit; fitness is Falkenauer's mean squared
fill. After each epoch the islands' best solutions are sent to the next island of the same group.
A group that reaches its lower bound (total length, rounded up) is finished and costs no
further generation. Sequences that a group leaves open (less than ``OPEN`` full) are opened
and their pieces dealt and evolved again with those of the other groups, until one group
is enough for what is open, or a round has left no fewer groups than it was given.

Defined results: a null or empty text is the end id alone. Repeated rows and null ids are
packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import pickle
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import materialise
from clickweave.llm.tokens import ROWS, encoder

LENGTH = 1024
GROUP = 4_000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
OPEN = 0.97

PIECES = "item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES = pa.schema(
    [("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
     ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def _pieces(tokenizer: str, end_id: int, length: int) -> Callable:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        item = TaskContext.get().partitionId() << 40
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = []
            texts = encode.encode_all(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids += end
                n = len(ids) // 4
                stops = list(range(n, 0, -length))[::-1]
                for k, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
                    rows.append((item, doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    item += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES
            )

    return cut


Solution = list[list[int]]  # places of pieces, by sequence


def best_fit(sizes: list[int], places: Iterable[int], bins: Solution, length: int) -> Solution:
    """Puts pieces, longest first, where they leave the least room."""
    rooms = sorted((length - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(places, key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = length, len(bins)
            bins.append([])
        bins[k].append(i)
        bisect.insort(rooms, (room - sizes[i], k))
    return bins


def fitness(sizes: list[int], bins: Solution, length: int) -> tuple[int, float]:
    """Fewer sequences first, then the mean squared fill."""
    fills = np.array([sum(sizes[i] for i in b) for b in bins], float) / length
    return -len(bins), float((fills**2).mean()) if len(bins) else 0.0


def crossover(sizes: list[int], a: Solution, b: Solution, length: int, rng: np.random.Generator) -> Solution:
    """Well-filled sequences of ``a`` go whole into ``b``; what they displace is fitted again."""
    fills = np.array([sum(sizes[i] for i in x) for x in a], float)
    chosen = np.argsort(-fills + rng.random(len(a)) * 0.02 * length)[: max(1, len(a) // 2)]
    injected = [list(a[k]) for k in chosen]
    held = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in b:
        if held.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in held]
    return best_fit(sizes, displaced, injected + kept, length)


def mutated(sizes: list[int], bins: Solution, length: int, rng: np.random.Generator) -> Solution:
    """A few sequences, the emptiest first, are opened and their pieces fitted again."""
    fills = np.array([sum(sizes[i] for i in x) for x in bins], float)
    order = np.argsort(fills + rng.random(len(bins)) * 0.05 * length)
    opened = set(order[: max(2, len(bins) // 20)].tolist())
    loose = [i for k in opened for i in bins[k]]
    return best_fit(sizes, loose, [list(x) for k, x in enumerate(bins) if k not in opened], length)


def evolve(sizes: list[int], population: list[Solution], length: int, generations: int, seed: int) -> list[Solution]:
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // length)
    rate = lambda s: fitness(sizes, s, length)
    if not population:
        population = [best_fit(sizes, range(len(sizes)), [], length)]
    while len(population) < POPULATION and len(population[0]) > bound:
        population.append(mutated(sizes, population[-1], length, rng))
    for _ in range(generations):
        population.sort(key=rate, reverse=True)
        if len(population[0]) <= bound:
            break
        child = crossover(sizes, population[0], population[rng.integers(1, len(population))], length, rng)
        population[-1] = mutated(sizes, child, length, rng)
    return sorted(population, key=rate, reverse=True)


def _epoch(length: int, generations: int, epoch: int) -> Callable:
    """One epoch of one island: its pieces, its population, the migrants that came."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group, island = (int(x) for x in key)
        rows = rows.iloc[0]
        sizes = np.frombuffer(rows["sizes"], np.int32).tolist()
        population = pickle.loads(rows["population"]) if rows["population"] else []
        if rows["migrant"]:
            population = (population + [pickle.loads(rows["migrant"])])[-POPULATION - 1 :]
        evolved = evolve(sizes, population, length, generations, hash((group, island, epoch)) & 0xFFFF)
        score = fitness(sizes, evolved[0], length)
        done = len(evolved[0]) <= -(-sum(sizes) // length)
        return pd.DataFrame(
            [{"grp": group, "island": island, "sizes": rows["sizes"], "items": rows["items"],
              "population": pickle.dumps(evolved), "elite": pickle.dumps(evolved[0]),
              "n": -score[0], "fill": score[1], "done": done}]
        )

    return run


_STATE = (
    "grp bigint, island int, sizes binary, items binary, population binary, elite binary, n bigint, fill double, done boolean"
)


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("item")
    return pd.DataFrame(
        [{"grp": int(key[0]), "sizes": rows["length"].to_numpy(np.int32).tobytes(),
          "items": rows["item"].to_numpy(np.int64).tobytes()}]
    )


def _unpack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in rows:
        for r in part.itertuples():
            sizes, items = np.frombuffer(r.sizes, np.int32), np.frombuffer(r.items, np.int64)
            out = []
            for k, places in enumerate(pickle.loads(r.elite)):
                offset = 0
                for i in places:
                    out.append((int(items[i]), int(r.grp), k, offset, int(sizes[i])))
                    offset += int(sizes[i])
            frame = pd.DataFrame(out, columns=["item", "grp", "bin", "offset", "length"])
            frame["fill"] = frame.groupby("bin")["length"].transform("sum")
            yield frame


def _evolved(items: DataFrame, groups: int, length: int, round_no: int) -> DataFrame:
    """``item``, ``grp``, ``bin``, ``offset``, ``length``, ``fill`` of the best solution of each group."""
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(groups)))
    gathered = dealt.groupBy("grp").applyInPandas(_gather, "grp bigint, sizes binary, items binary")
    none = F.lit(None).cast("binary")
    state = gathered.select(
        "*", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        none.alias("population"), none.alias("migrant"),
    )
    for epoch in range(EPOCHS):
        evolved = state.groupBy("grp", "island").applyInPandas(_epoch(length, GENERATIONS, epoch), _STATE)
        evolved = materialise(evolved, f"islands-{round_no}-{epoch}")
        if epoch + 1 < EPOCHS:
            # Elites go round the ring of their group's islands.
            elites = evolved.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
            state = evolved.drop("elite", "n", "fill", "done").join(elites, ["grp", "island"])
    order = F.struct("n", -F.col("fill"), "island")
    best = evolved.groupBy("grp").agg(F.min_by(F.struct("sizes", "items", "elite"), order).alias("b")).select("grp", "b.*")
    return best.mapInPandas(_unpack, "item bigint, grp bigint, bin bigint, offset bigint, length bigint, fill bigint")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, end_id, length), PIECES), "pieces")
    full = pieces.filter(F.col("length") == length)
    placed = full.select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left, round_no, before = pieces.filter(F.col("length") < length).select("item", "length"), 0, None
    while n := left.count():
        groups = max(1, -(-n // GROUP))
        found = materialise(_evolved(left, groups, length, round_no), f"packed-{round_no}")
        last = groups == 1 or (before is not None and groups >= before)
        before = groups
        closed = found if last else found.filter(F.col("fill") >= OPEN * length)
        # Numbers of rounds, groups and sequences side by side.
        number = F.lit(round_no << 60) + F.shiftleft(F.col("grp"), 20) + F.col("bin")
        placed = placed.unionByName(closed.select("item", number.alias("sequence_id"), "offset"))
        if last:
            break
        left, round_no = found.filter(F.col("fill") < OPEN * length).select("item", "length"), round_no + 1
    return pieces.join(placed, "item").drop("item")
