"""Lexical scores of many chunks against many queries, through an inverted index of the queries' tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class QueryIndex:
    """For each token, the queries that hold it. Only chunk tokens that some query holds cost anything, and only for the queries that hold them."""

    def __init__(self, tokens: list[list[str]]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        flat = pa.array([t for q in tokens for t in q], pa.string())
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(tokens)), self.sizes)
        order = np.argsort(at, kind="stable")
        self.postings = owner[order]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.vocabulary)))]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    def scores(self, known: np.ndarray, chunk: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(chunks, queries): three quarters recall and one quarter precision of distinct tokens, 0 where none is shared.

        known: vocabulary numbers of tokens, chunk: the chunks that hold them, lengths: distinct tokens of each chunk.
        """
        n = self.cuts[known + 1] - self.cuts[known]
        at = np.repeat(self.cuts[known] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(np.repeat(chunk, n) * len(self) + self.postings[at], minlength=len(lengths) * len(self)).reshape(len(lengths), len(self)).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(both > 0, 0.75 * both / np.maximum(self.sizes, 1) + 0.25 * both / np.maximum(lengths, 1)[:, None], 0.0)

    def best_rows(self, rows: pa.ListArray, best: np.ndarray, chunks: int, slack: float = 0.0):
        """(row, query, score and chunk number of its best chunks) of the rows that may be among the best of a query, with
        the last two flat, their counts a row, and the first chunk of each given row.

        rows: for each row a list of chunks, each a list of distinct tokens. best: (keep, queries), the largest row scores of each query so far, which
        is brought up to date. Rows with a best score of at least the least of these, less `slack`, are returned, ties included; so no row that
        belongs to the best of all is left out, whatever breaks the ties. Callers pass slices of rows, as the scores of all of them are held.
        """
        inner = rows.flatten()
        number = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        lengths = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        places = pc.index_in(inner.flatten(), value_set=self.vocabulary)
        held = np.flatnonzero(~pc.is_null(places).to_numpy(zero_copy_only=False))
        code = pc.fill_null(places, 0).to_numpy(zero_copy_only=False)[held].astype(np.int64)
        s = self.scores(code, np.repeat(np.arange(len(lengths)), lengths)[held], lengths)
        top = np.zeros((len(rows), len(self)))
        full = np.flatnonzero(number[1:] > number[:-1])
        if len(full):
            top[full] = np.maximum.reduceat(s, number[full], axis=0)
        both = np.concatenate([best, top])
        best[:] = np.partition(both, len(both) - len(best), axis=0)[len(both) - len(best) :]
        row, query = np.nonzero((top > 0) & (top >= best.min(axis=0) - slack))
        score, chunk, count = [], [], np.zeros(len(row), np.int64)
        for i, (r, q) in enumerate(zip(row.tolist(), query.tolist())):
            own = s[number[r] : number[r + 1], q]
            order = np.argsort(-own, kind="stable")[:chunks]
            order = order[own[order] > 0]
            count[i] = len(order)
            score.append(own[order])
            chunk.append(order)
        none = [np.zeros(0)]
        return row, query, np.concatenate(score or none), np.concatenate(chunk or none).astype(np.int64), count, number
