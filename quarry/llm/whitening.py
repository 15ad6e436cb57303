"""Embedding whitening from a Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers x = floor(256 * c). The fit list holds each distinct x once; X is
its matrix with the mean taken off every row. The bidiagonalisation builds orthonormal
right vectors v_j and left vectors u_j with X V = U B, B upper bidiagonal, by alternating
products that Spark runs over the rows of the fit list:

    X v_j      less what lies along u_1 .. u_(j-1), is alpha_j u_j
    X^T u_j    less what lies along v_1 .. v_j,     is beta_j v_(j+1)

Both sides are reorthogonalised in full. A left vector is as long as the fit list, so no
one holds it: it is kept as the short y_j with u_j = X y_j, and tasks make their part of it
anew from their rows. A step is two passes over the rows; each returns a few hundred sums, added
up by Spark per position, whatever the number of rows. The driver holds V, the y_j and B
(at most dimension x dimension). The SVD of the small B gives singular values and right vectors;
steps go on until the residuals of the leading components and of one more are at the level
of rounding, or the space is exhausted. When a step finds nothing new (a
left or right vector vanishes, as with equal eigenvalues), it goes on from another direction.

Components are unit vectors with their largest entry positive, by falling eigenvalue
s**2 / n. Rows are projected on them and divided by the deviation s / sqrt(n).

Defined results: rows whose vector is null or holds null or non-finite entries, or entries whose
256-fold is beyond a long, take no part; shorter vectors count as padded with zeros;
repeated rows and ids each have their rows. Directions without variance (an eigenvalue
under 1e-12 of the largest) have no component: a table of one vector, or none, gives no rows.
A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import read, staged

K, SCALE = 4, 256
#: Residual of a component, over the largest singular value, at which it stands.
CONVERGED = 1e-14
#: Share of the largest eigenvalue below which a direction has no variance.
NO_VARIANCE = 1e-12
#: Rows that a task multiplies at once.
ROWS = 8192


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * c) as packed longs without closing zeros; only the vectors that take part."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, c in zip(batch.column("id"), batch.column("c").to_pylist()):
                if c is None or any(e is None for e in c):
                    continue
                x = np.floor(scale * np.asarray(c, np.float64))
                if (np.abs(x) < 2.0**63).all():  # NaN and the infinities are not
                    ids.append(i.as_py())
                    x = x.astype(np.int64)
                    out.append(x[: len(x) - int(np.argmax(x[::-1] != 0)) if x.any() else 0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(out, pa.binary())], names=["id", "x"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("c")).mapInArrow(floor, f"id {id_type}, x binary")


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Whole numbers, one row per vector, padded with zeros."""
    return np.frombuffer(b"".join(r.ljust(8 * width, b"\0") for r in rows), np.int64).reshape(len(rows), width)


def _sums(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], width: int, size: int) -> np.ndarray:
    """The sum of `work` (of a fixed size) over the rows, in slices of at most ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                total += work(matrix(batch.column("x").slice(i, ROWS).to_pylist(), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    parts = rows.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in parts.collect():  # `size` rows
        out[r["place"]] = r["value"]
    return out


class Fit:
    """The distinct vectors, their number and exact sums, and products with the centred matrix."""

    def __init__(self, rows: DataFrame):
        self.rows = staged(rows.select("x").distinct())
        size = self.rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("x")), F.lit(0)).alias("bytes")).first()
        self.n, self.width = size["n"], size["bytes"] // 8
        self.total = self._totals()

    def _totals(self) -> list[int]:
        width = self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * width
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    x = matrix(batch.column("x").slice(i, ROWS).to_pylist(), width)
                    low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)  # neither overflows
                    total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["place", "value"])

        parts = self.rows.mapInArrow(add, "place int, value string")
        sums = parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        return [int(r["value"]) for r in sorted(sums, key=lambda r: r["place"])]

    def product(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over slices X of the centred rows of `of(X)`, flattened."""
        mean = self.mean()
        return _sums(self.rows, lambda x: of(x - mean).ravel(), self.width, size)

    def mean(self) -> np.ndarray:
        return np.array([t / self.n for t in self.total])


class Bidiagonal:
    """Golub-Kahan-Lanczos steps: V, Y (with U = X Y), and the diagonals alpha and beta of B."""

    def __init__(self, fit: Fit, seed: int = 0):
        self.fit, self.random = fit, np.random.default_rng(seed)
        d = fit.width
        self.v, self.y, self.alpha, self.beta = np.zeros((d, 0)), np.zeros((d, 0)), [], []

    def off(self, w: np.ndarray) -> np.ndarray:
        """w less what lies along V, twice for full orthogonality."""
        for _ in range(2):
            w = w - self.v @ (self.v.T @ w)
        return w

    def fresh(self) -> np.ndarray:
        w = self.off(self.random.standard_normal(self.fit.width))
        return w / np.linalg.norm(w)

    def left(self, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """(U^T X y, |X y|**2, X^T X y) from one pass; tasks make their parts of U and of X y from their rows."""
        basis, j, d = self.y, self.y.shape[1], self.fit.width

        def of(x: np.ndarray) -> np.ndarray:
            w = x @ y
            return np.concatenate(((x @ basis).T @ w, [w @ w], x.T @ w))

        out = self.fit.product(of, j + 1 + d)
        return out[:j], float(out[j]), out[j + 1 :]

    def step(self) -> None:
        v = self.next if self.v.shape[1] else self.fresh()
        along, _, _ = self.left(v)
        y = v - self.y @ along
        along, square, back = self.left(y)  # what rounding left along U, the length, and X^T of it
        y = y - self.y @ along
        right_of_u = self.v * np.array(self.alpha)  # X^T U = V B^T
        if self.beta:
            after = np.column_stack([self.v[:, 1:], v])
            right_of_u = right_of_u + after * np.array(self.beta)
        back = back - right_of_u @ along
        alpha = np.sqrt(max(0.0, square - float(along @ along)))
        self.v = np.column_stack([self.v, v])
        scale = max([alpha, *self.alpha, *self.beta])
        if alpha <= 1e-13 * scale or not alpha:  # X v lies in the span of U: no new left vector
            alpha, z = 0.0, np.zeros_like(v)
            self.y = np.column_stack([self.y, np.zeros_like(v)])
        else:
            self.y = np.column_stack([self.y, y / alpha])
            z = self.off(back / alpha)
        beta = float(np.linalg.norm(z))
        self.alpha.append(alpha)
        if beta <= 1e-13 * scale or not beta:
            beta, self.next = 0.0, self.fresh() if self.v.shape[1] < self.fit.width else z
        else:
            self.next = z / beta
        self.beta.append(beta)

    def svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors as columns, and the residuals of the triplets."""
        b = np.diag(self.alpha) + np.diag(self.beta[:-1], 1)
        p, s, qt = np.linalg.svd(b)
        return s, self.v @ qt.T, np.abs(self.beta[-1] * p[-1])


def components(fit: Fit, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of the fit list's covariance: the k largest, without those of no variance."""
    if fit.n < 2 or not fit.width:
        return np.zeros(0), np.zeros((fit.width, 0))
    steps = Bidiagonal(fit)
    while steps.v.shape[1] < fit.width:
        steps.step()
        s, right, residual = steps.svd()
        if len(s) > k and (residual[: k + 1] <= CONVERGED * s[0]).all() and steps.beta[-1]:
            break
    values, right = s[:k] ** 2 / fit.n, right[:, :k]
    some = values > NO_VARIANCE * values[0] if values[0] else np.zeros(len(values), bool)
    values, right = values[some], right[:, some]
    right = right / np.linalg.norm(right, axis=0)
    return values, right * np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])])


def whiten(vectors: DataFrame, id_col: str, vector_col: str, k: int = K, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = staged(whole(vectors, id_col, vector_col, scale))
    fit = Fit(rows)
    values, right = components(fit, k)
    id_type = vectors.schema[id_col].dataType.simpleString()
    m, n, width, total = len(values), fit.n, fit.width, fit.total
    explained, identity_error = np.zeros(0), 0.0
    if m:
        onto = right / np.sqrt(values)

        def check(x: np.ndarray) -> np.ndarray:
            z = x @ onto
            return np.concatenate(((z.T @ z).ravel(), z.sum(0), [np.square(x).sum()]))

        sums = fit.product(check, m * m + m + 1)
        mean = sums[m * m : -1] / n
        identity_error = float(np.abs(sums[: m * m].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
        explained = values / (sums[-1] / n)
    reach = max([abs(t) for t in total], default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows if m else 0, ROWS):
                part = batch.slice(i, ROWS)
                x = matrix(part.column("x").to_pylist(), width)
                far = float(np.abs(x.astype(np.float64)).max(initial=0.0)) * n + reach
                if far * far * width < 2.0**62:
                    off = n * x - np.array(total, np.int64)
                    deviation = np.square(off).sum(1).tolist()
                else:  # beyond longs: whole numbers of any size
                    off = n * x.astype(object) - np.array(total, object)
                    deviation = [d if d < 2**63 else None for d in (off * off).sum(1)]
                white = (off.astype(np.float64) / n) @ onto
                ids = part.column("id").take(pa.array(np.repeat(np.arange(len(x)), m)))
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * m, n)),
                    pa.array([d for d in deviation for _ in range(m)], pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * m, identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(project, f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_embedding_whitening": op12_embedding_whitening}
