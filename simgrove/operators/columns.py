"""Text from the places of its pieces on a page, one column at a time.

A piece (a glyph or a word, as the source gives them) has doc_id, page, page_height, x_start, x_end, y (from the top, all
in points) and text. A page is one task's work; its pieces are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in points: what separates two segments of a row, what a row's pieces may differ in height, how far the
#: boundaries of scattered rows may lie apart; then the rows of two segments that make columns, and those in one run.
COLUMN_GAP = 12.0
ROW_HEIGHT = 3.0
BOUNDARY_SPREAD = 50.0
LEAST_ROWS = 3
LEAST_RUN = 3
#: Points from which a space stands between two pieces of a row.
WORD_GAP = 1.0


def rows_of(y: np.ndarray) -> np.ndarray:
    """The row of each height (ascending): a row begins at the first piece more than ROW_HEIGHT below the last one's begin."""
    row, at, n = np.zeros(len(y), int), 0, 0
    while at < len(y):
        end = int(np.searchsorted(y, y[at] + ROW_HEIGHT, "right"))
        row[at:end] = n
        at, n = end, n + 1
    return row


def layout(pieces: pd.DataFrame) -> tuple[float, float] | None:
    """(top of the body, boundary) of a page in two columns, None of any other.

    Rows of exactly two segments speak for columns: at least LEAST_ROWS of them, that follow each other without another
    row between or agree on where the boundary lies."""
    p = pieces.sort_values(["y", "x_start"], kind="stable")
    pairs, run, longest = [], 0, 0
    for _, row in p.groupby(rows_of(p["y"].to_numpy()), sort=True):
        row = row.sort_values("x_start", kind="stable")
        start, reach = row["x_start"].to_numpy(), np.maximum.accumulate(row["x_end"].to_numpy())
        cuts = np.flatnonzero(start[1:] - reach[:-1] >= COLUMN_GAP)
        run = run + 1 if len(cuts) == 1 else 0
        longest = max(longest, run)
        if len(cuts) == 1:
            pairs.append((row["y"].min(), reach[cuts[0]], start[cuts[0] + 1]))
    if len(pairs) < LEAST_ROWS:
        return None
    top, left, right = np.array(pairs, float).T
    between = (left + right) / 2
    if longest < LEAST_RUN and between.max() - between.min() > BOUNDARY_SPREAD:
        return None
    if right.min() - left.max() < COLUMN_GAP or top.min() >= pieces["page_height"].max():
        return None
    return float(top.min()), float((left.max() + right.min()) / 2)


def _lines(p: pd.DataFrame) -> str:
    """A block's pieces by row and place, a line a row."""
    p = p.sort_values(["y", "x_start"], kind="stable")
    text = ""
    for _, row in p.groupby(rows_of(p["y"].to_numpy()), sort=True):
        row = row.sort_values("x_start", kind="stable")
        apart = row["x_start"].to_numpy()[1:] - row["x_end"].to_numpy()[:-1] >= WORD_GAP
        words = row["text"].tolist()
        text += words[0] + "".join(" " * bool(gap) + w for gap, w in zip(apart, words[1:], strict=True)) + "\n"
    return text


def page_texts(pieces: DataFrame) -> DataFrame:
    """(doc_id, page, columns, text): what stands above the body, then the left and the right column; a page in one
    column row by row. Pieces that are null or blank, or without a place, don't count; a page of such alone has no row."""
    kind = dict(pieces.dtypes)["doc_id"]

    def read(key, p):
        found = layout(p)
        if found is None:
            blocks = [p]
        else:
            top, boundary = found
            body, first = p["y"] >= top, p["x_start"] < boundary
            blocks = [p[~body], p[body & first], p[body & ~first]]
        return pd.DataFrame({"doc_id": [key[0]], "page": [key[1]], "columns": [1 if found is None else 2], "text": ["".join(_lines(b) for b in blocks if len(b))]})

    places = ["page_height", "x_start", "x_end", "y"]
    seen = pieces.select("doc_id", F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in places], "text").where(F.col("text").rlike(r"\S")).na.drop(subset=places)
    return seen.groupBy("doc_id", "page").applyInPandas(read, f"doc_id {kind}, page int, columns int, text string")


def document_texts(pieces: DataFrame) -> DataFrame:
    """(doc_id, text): a document's pages one behind the other."""
    pages = page_texts(pieces).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return pages.select("doc_id", F.array_join(F.col("pages.text"), "").alias("text"))
