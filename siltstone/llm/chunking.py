"""Problem 1: split oversized items at natural boundaries, content-defined.

A rolling hash over 32 characters marks landmarks. A cut goes to the natural
boundary nearest to the first landmark past the minimum size, so where a cut
falls depends only on the text around it: an edit moves the cuts beside it and
leaves the pieces further on as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import table

LIMIT, OVERLAP, MIN_SIZE = 4000, 200, 1200
WINDOW_LOG2 = 5
LANDMARK_MASK = np.uint64((1 << 9) - 1)
#: How far a landmark may be from a blank line or a new top-level block to snap to it.
REACH = 600


def landmarks(codes: np.ndarray) -> np.ndarray:
    """Positions before which a window of 32 characters hashes to a landmark."""
    mul = np.uint64(0x9E3779B97F4A7C15)
    h = (codes.astype(np.uint64) + np.uint64(1)) * mul
    h ^= h >> np.uint64(29)
    step, base = 1, 0x100000001B3
    for _ in range(WINDOW_LOG2):  # doubles the window: H2k[i] = Hk[i] + B^k * Hk[i-k]
        h[step:] = h[step:] + np.uint64(base) * h[:-step]
        base = base * base % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(31)
    h *= mul
    h ^= h >> np.uint64(33)
    hit = np.flatnonzero((h & LANDMARK_MASK) == 0) + 1
    return hit[hit >= step]


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Positions to cut before, strongest kind first: block, line, sentence, word."""
    n = len(codes)
    lines = np.flatnonzero(codes == 10) + 1
    lines = lines[lines < n]
    first = codes[lines]
    unindented = ~np.isin(first, [32, 9, 10, 13, 41, 93, 125])
    before = codes[np.maximum(lines - 2, 0)]
    blank = (before == 10) | ((before == 13) & (codes[np.maximum(lines - 3, 0)] == 10))
    space = np.flatnonzero(np.isin(codes, [32, 9, 10, 13, 0x3000])) + 1
    space = space[space < n]
    stop = np.flatnonzero(np.isin(codes, [0x3002, 0xFF01, 0xFF1F])) + 1
    ended = space[np.isin(codes[np.maximum(space - 2, 0)], [33, 46, 59, 63, 125])]
    return [lines[blank | unindented], lines, np.union1d(ended, stop[stop < n]), space]


def _nearest(at: int, places: np.ndarray, low: int, high: int) -> int | None:
    a, b = np.searchsorted(places, [low, high + 1])
    if a == b:
        return None
    k = np.searchsorted(places[a:b], at) + a
    near = [int(places[i]) for i in (k - 1, k) if a <= i < b]
    return min(near, key=lambda p: (abs(p - at), p))


def _whole(codes: np.ndarray, at: int, low: int) -> int:
    """Step back so that neither a line end of two characters nor a combined character is split."""
    while at > low and (
        (codes[at] == 10 and codes[at - 1] == 13)
        or 0x300 <= codes[at] <= 0x36F
        or codes[at] in (0x200D, 0xFE0F)
        or codes[at - 1] == 0x200D
    ):
        at -= 1
    return at


def cut_points(codes: np.ndarray, max_size: int, min_size: int) -> list[int]:
    """Ascending inner cuts; between neighbours lie at most ``max_size`` characters."""
    marks, kinds, cuts, at = landmarks(codes), boundaries(codes), [], 0
    while len(codes) - at > max_size:
        low, high = at + min_size, at + max_size
        k = np.searchsorted(marks, low)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        cut = _nearest(mark, kinds[0], max(low, mark - REACH), min(high, mark + REACH))
        for kind in kinds[1:]:
            if cut is None:
                cut = _nearest(mark, kind, low, high)
        at = _whole(codes, mark, low) if cut is None else cut
        cuts.append(at)
    return cuts


def _overlap_start(codes: np.ndarray, kinds: list[np.ndarray], cut: int, overlap: int) -> int:
    for kind in (kinds[1], kinds[3]):
        k = np.searchsorted(kind, cut - overlap)
        if k < len(kind) and kind[k] < cut:
            return int(kind[k])
    return _whole(codes, cut - overlap, max(0, cut - 2 * overlap)) if overlap else cut


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, min_size: int = MIN_SIZE) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``; joined without the overlaps they are the text."""
    if len(text) <= limit:
        return [(0, len(text))]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = cut_points(codes, limit - overlap, min(min_size, limit - overlap))
    kinds = boundaries(codes)
    starts = [0] + [max(_overlap_start(codes, kinds, c, overlap), c - overlap) for c in cuts]
    return list(zip(starts, [*cuts, len(text)]))


PIECES = "chunk_id long, piece_no int, n_pieces int, text string, start_line int, end_line int, symbol string"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, min_size: int = MIN_SIZE) -> DataFrame:
    """Pieces of every chunk: ``chunk_id, piece_no, n_pieces, text, start_line, end_line, symbol``.

    A text of at most ``limit`` characters is its own single piece and never
    leaves the JVM; NULL and empty texts likewise. Longer ones are cut; each
    piece has at most ``limit`` characters, its first up to ``overlap`` ones
    repeat the end of the piece before. Lines count from the chunk's
    ``start_line``; where that is NULL, so are the pieces' lines. Rows that
    repeat are cut alike and all kept; other columns are not read.
    """
    cols = ["chunk_id", "text", "start_line", "end_line", "symbol"]
    rows = chunks.select(*cols)
    long = F.coalesce(F.length("text") > limit, F.lit(False))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cid, text, start, symbol in zip(pdf.chunk_id, pdf.text, pdf.start_line, pdf.symbol):
                parts = split_text(text, limit, overlap, min_size)
                first = None if pd.isna(start) else int(start)
                done = lines = 0
                for i, (a, b) in enumerate(parts):
                    lines += text.count("\n", done, a)
                    done = a
                    last = lines + text.count("\n", a, b - 1)
                    out.append(
                        (cid, i, len(parts), text[a:b], *((None, None) if first is None else (first + lines, first + last)), symbol)
                    )
            frame = pd.DataFrame(out, columns=["chunk_id", "piece_no", "n_pieces", "text", "start_line", "end_line", "symbol"])
            yield frame.astype({"chunk_id": "Int64", "piece_no": "int32", "n_pieces": "int32", "start_line": "Int32", "end_line": "Int32"})

    whole = rows.where(~long).select(
        "chunk_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), "text", "start_line", "end_line", "symbol"
    )
    return rows.where(long).mapInPandas(cut, PIECES).unionByName(whole)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that come out in more than one piece."""
    pieces = split_oversized(table(spark, sf_dir, "chunks"))
    return pieces.where("n_pieces > 1 and piece_no = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLES = {"p1_found": "SELECT chunk_id FROM chunks WHERE length(text) > 4000"}
