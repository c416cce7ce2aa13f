"""Problem 9: fill containers of fixed capacity with texts of varying length.

Lengths are counted into a histogram, which has at most ``capacity`` entries
however many texts there are. Patterns of few documents whose length classes
fill a container are enumerated, their repeat counts fitted to the histogram
by non-negative least squares and rounded, and what is left over is packed by
best fit, still on the histogram. The plan says which ranks among the texts of
one length go where; texts only learn their rank and look it up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.tokenizer import TOKENIZER_DIR, encoder
from siltstone.session import spread, stage
from siltstone.sources.tables import table

CAPACITY = 2048
#: Length classes of the patterns; a pattern has at most MAX_DOCS texts.
CLASSES, MAX_DOCS = 128, 3
SALTS = 64


def nnls(a: np.ndarray, b: np.ndarray, max_rounds: int = 2000) -> np.ndarray:
    """Non-negative x that minimises ``|a x - b|``, by active sets."""
    gram, rhs = a.T @ a, a.T @ b
    ridge = 1e-10 * max(float(gram.diagonal().max()), 1e-30)
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(max_rounds):
        slope = rhs - gram @ x
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(np.abs(rhs).max())):
            break
        active[k] = True
        while True:
            idx = np.flatnonzero(active)
            z = np.linalg.solve(gram[np.ix_(idx, idx)] + ridge * np.eye(len(idx)), rhs[idx])
            if (z > 1e-12).all():
                x[:] = 0
                x[idx] = z
                break
            bad = z <= 1e-12
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - z[bad], 1e-300))
            x[idx] += step * (z - x[idx])
            gone = idx[bad & (x[idx] <= 1e-12)]
            if not len(gone):
                gone = idx[bad][:1]
            x[gone] = 0
            active[gone] = False
    return x


def patterns(classes: int, max_docs: int) -> list[tuple[int, ...]]:
    """Descending class tuples whose sizes fill a container of ``classes`` units exactly."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int, top: int) -> None:
        if left <= top:
            out.append((*prefix, left))
        if len(prefix) + 1 < max_docs:
            for c in range(min(top, left - 1), 0, -1):
                if (max_docs - len(prefix)) * c >= left:
                    grow((*prefix, c), left - c, c)

    grow((), classes, classes)
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """``(length, rank, n, bin)``: texts ``rank..rank+n-1`` of a length go to bins ``bin..bin+n-1``.

    Works on lengths and counts alone, so its size follows the number of
    different lengths, not of texts.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    segments: list[tuple[int, int, int, int]] = []
    bins = 0
    #: remaining space -> [first bin, number of bins] runs that are still open
    open_runs: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def put(length: int, n: int, first: int) -> None:
        segments.append((length, int(taken[length]), n, first))
        taken[length] += n

    def seat(lengths: list[tuple[int, int]], runs: list[tuple[int, int, int]]) -> None:
        """Lay a stretch of lengths along equally long runs of bins."""
        runs = [list(r) for r in runs]
        k = 0
        for length, n in lengths:
            while n:
                first, size, space = runs[k]
                m = min(n, size)
                put(length, m, first)
                done.append((first, m, space - length))
                runs[k][0] += m
                runs[k][1] -= m
                n -= m
                k += runs[k][1] == 0

    unit = max(1, capacity // CLASSES)
    classes = capacity // unit
    of = lambda length: -(-length // unit)
    members: list[list[int]] = [[] for _ in range(classes + 1)]
    for length in range(capacity, 0, -1):
        if count[length] and of(length) <= classes:
            members[of(length)].append(length)
    have = np.array([sum(int(count[x]) for x in m) for m in members], float)
    shapes = patterns(classes, MAX_DOCS)
    used = [s for s in shapes if all(have[c] for c in s)]
    if used:
        a = np.zeros((classes + 1, len(used)))
        for j, s in enumerate(used):
            for c in s:
                a[c, j] += 1
        weight = 1 / np.sqrt(np.maximum(have, 1))[:, None]
        fit = nnls(a * weight, have * weight[:, 0])
        left = have.astype(np.int64)
        order = sorted(np.flatnonzero(fit > 0.5), key=lambda j: (-fit[j], used[j]))
        for j in order:
            need = a[:, j].astype(np.int64)
            n = min(int(round(fit[j])), *(int(left[c] // need[c]) for c in set(used[j])))
            if n <= 0:
                continue
            left -= need * n
            runs = [(bins, n, capacity)]
            bins += n
            for c in used[j]:
                stretch, want = [], n
                for length in members[c]:
                    m = min(want, int(count[length] - taken[length]))
                    if m:
                        stretch.append((length, m))
                        want -= m
                    if not want:
                        break
                done: list[tuple[int, int, int]] = []
                seat(stretch, runs)
                runs = done
            for first, n_bins, space in runs:
                if space:
                    open_runs[space].append([first, n_bins])
    for length in range(capacity, 0, -1):  # best fit, longest first
        n = int(count[length] - taken[length])
        space = length
        while n:
            while space <= capacity and not open_runs[space]:
                space += 1
            if space > capacity:
                put(length, n, bins)
                if capacity > length:
                    # several of one length share a bin: open full rows of bins instead of one bin each
                    segments.pop()
                    taken[length] -= n
                    per = capacity // length
                    rows = -(-n // per)
                    first = bins
                    bins += rows
                    for row in range(per):
                        m = min(rows, n - row * rows)
                        if m <= 0:
                            open_runs[capacity - row * length].append([first, rows])
                            break
                        put(length, m, first)
                        if m < rows:
                            open_runs[capacity - row * length].append([first + m, rows - m])
                            open_runs[capacity - (row + 1) * length].append([first, m])
                            break
                    else:
                        if capacity - per * length:
                            open_runs[capacity - per * length].append([first, rows])
                else:
                    bins += n
                break
            run = open_runs[space][-1]
            m = min(n, run[1])
            put(length, m, run[0])
            if space > length:
                open_runs[space - length].append([run[0], m])
            run[0] += m
            run[1] -= m
            if not run[1]:
                open_runs[space].pop()
            n -= m
    return segments


def measure(docs: DataFrame, capacity: int, name: str, folder: str) -> DataFrame:
    """``doc_id, piece_no, n_tokens``: texts above the capacity give full pieces and a rest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            ids, no, size = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, k = enc.count(text), 0
                while n > capacity:
                    ids.append(doc_id), no.append(k), size.append(capacity)
                    n -= capacity
                    k += 1
                ids.append(doc_id), no.append(k), size.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(size, pa.int32())],
                names=["doc_id", "piece_no", "n_tokens"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(count, "doc_id long, piece_no int, n_tokens int")


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece_no, n_tokens) with their ``bin_id``.

    Items of no tokens need no container; their bin is NULL. The histogram
    that reaches the driver has at most ``capacity`` rows, the plan that goes
    back grows with it. Ranks within a length come from ``SALTS`` separate
    windows per length, so one frequent length does not end in one task.
    """
    spark = items.sparkSession
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int"))
    salted = stage(salted, "pack-items")
    parts = salted.where("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    parts = stage(parts, "pack-counts")
    histogram = {r.n_tokens: r.n for r in parts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    by_length = Window.partitionBy("n_tokens").orderBy("salt")
    offsets = parts.withColumn("offset", F.sum("n").over(by_length) - F.col("n")).drop("n")  # capacity * SALTS rows at most
    ranked = (
        salted.where("n_tokens > 0")
        .withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")) - 1)
        .join(offsets, ["n_tokens", "salt"])
        .select("doc_id", "piece_no", "n_tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    )
    order = sorted(plan)
    lengths = np.array([p[0] for p in order], np.int64)
    starts = np.array([p[1] for p in order], np.int64)
    firsts = np.array([p[3] for p in order], np.int64)
    keys = lengths * (1 << 48) + starts
    shared = spark.sparkContext.broadcast((keys, starts, firsts))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, firsts = shared.value
        for batch in batches:
            length = batch.column(2).to_numpy().astype(np.int64)
            rank = batch.column(3).to_numpy()
            k = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(firsts[k] + rank - starts[k])], names=["doc_id", "piece_no", "n_tokens", "bin_id"]
            )

    schema = "doc_id long, piece_no int, n_tokens int, bin_id long"
    none = salted.where("n_tokens = 0").select("doc_id", "piece_no", "n_tokens", F.lit(None).cast("long").alias("bin_id"))
    return (ranked.mapInArrow(look_up, schema) if plan else ranked.withColumnRenamed("rank", "bin_id")).unionByName(none)


def pack_corpus(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Containers of ``capacity`` tokens for all texts: ``doc_id, piece_no, n_tokens, bin_id``.

    Every row comes out: a text of at most ``capacity`` tokens as one item,
    a larger one as full containers and a rest. NULL and empty texts have 0
    tokens and a NULL bin. Repeated rows are items of their own. Other columns
    are not read.
    """
    return pack_items(measure(docs, capacity, name, folder), capacity)


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of space used."""
    packed = pack_corpus(table(spark, sf_dir, "documents")).where("bin_id is not null")
    return packed.agg(
        F.count_distinct("bin_id").alias("n_bins"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / (F.count_distinct("bin_id") * F.lit(CAPACITY))).alias("fill"),
    )


QUERIES = {"p9_packing": p9_packing, "p9_fill": p9_fill}
ORACLES: dict[str, str] = {}
