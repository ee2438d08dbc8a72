"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Entries become integers x, so the scatter M = n * sum(x x') - S S' (n squared times the
covariance) is an integer matrix, summed exactly. Its characteristic polynomial is found
modulo many primes, by reduction to Hessenberg form, and put together by Chinese
remaindering; the primes are tasks of one Spark job. All its roots are real, so Descartes'
rule counts the roots above a point exactly: bisection on integers isolates them, and signs
refine each until its neighbours are 2**64 times farther off than its error. A component is
inverse iteration with that shift: elimination with full pivoting in fixed point leaves as
many vanishing pivots as the root has multiplicity, and solving for them gives the null
space of M - e. The components are tasks of a second job.

The driver holds integers of d x d entries, residues, roots and components, never rows; the
cost there grows with the dimension d alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on count as infinite.
LARGEST = 2.0**500
#: Bits between a root's error and its distance from other roots, and beyond those of the elimination.
MARGIN = 64
_DIGIT, _LIMB = 20, 40


@dataclass(frozen=True)
class Model:
    """n vectors of `size` entries with sums S of x; components as columns, by falling eigenvalue."""

    n: int
    size: int
    sums: tuple[int, ...]
    roots: tuple[float, ...]  # square roots of the scatter's eigenvalues
    explained: tuple[float, ...]
    components: np.ndarray


# --- integers from vectors


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and without null, infinite or undefined entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def steps(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE c) of all entries, a row for each vector; Python integers where 64 bits don't hold them."""
    flat = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE).reshape(-1, size)
    if flat.size and np.abs(flat).max() >= 2.0**62:
        return np.array([[int(c) for c in row] for row in flat.tolist()], object)
    return flat.astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """Exact sums of x_i x_j as Python integers: digits of 20 bits multiply exactly as doubles, 4096 rows at a time."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), 4096):
        rest, digits = x[at : at + 4096], []
        while int(np.abs(rest).max()) >= 1 << _DIGIT:
            digits.append((rest & ((1 << _DIGIT) - 1)).astype(np.float64))
            rest = rest >> _DIGIT
        digits.append(rest.astype(np.float64))
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << _DIGIT * (i + j))
    return total


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in base 2**40, the last digit with its sign."""
    place = 0
    while not -(1 << _LIMB) <= value < 1 << _LIMB:
        yield place, value & ((1 << _LIMB) - 1)
        value, place = value >> _LIMB, place + 1
    yield place, value


def scatter(vectors: DataFrame, vector: str, size: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and M of vectors with `size` entries each; a task sends a few rows for each pair of dimensions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            if len(batch):
                x = steps(batch.column(0), size)
                n, s, q = n + len(x), s + x.astype(object).sum(axis=0), q + products(x)
        if n:
            sums = [(-2, 0, n), *((-1, i, int(v)) for i, v in enumerate(s)), *((i, j, int(q[i, j])) for i in range(size) for j in range(i, size))]
            rows = [(i, j, place, digit) for i, j, v in sums for place, digit in limbs(v)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "place", "digit"])

    parts = vectors.select(vector).mapInArrow(partial, "i int, j int, place int, digit long")
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).collect():
        sums[r.i, r.j] = sums.get((r.i, r.j), 0) + (r.digit << _LIMB * r.place)
    n, s = sums[-2, 0], [sums[-1, j] for j in range(size)]
    m = [[n * sums[min(i, j), max(i, j)] - s[i] * s[j] for j in range(size)] for i in range(size)]
    return n, [v + n * OFFSET for v in s], m


# --- the characteristic polynomial


def is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3 x 10**9."""
    bases = (2, 3, 5, 7)
    if p < 2 or any(p % b == 0 for b in bases):
        return p in bases
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all((x := pow(b, odd, p)) in (1, p - 1) or any(pow(x, 2**k, p) == p - 1 for k in range(1, twos)) for b in bases)


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31, as many as give a product of more than `bits` bits."""
    out, p = [], (1 << 31) - 1
    while 30 * len(out) <= bits:
        if is_prime(p):
            out.append(p)
        p -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to `a` modulo the prime p, zero below its first subdiagonal."""
    a = a.copy()
    for k in range(len(a) - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        a[[k + 1, pivot]] = a[[pivot, k + 1]]
        a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        times = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - times[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * times % p).sum(axis=1)) % p
    return a


def residues(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - M) modulo p, the constant first."""
    h, d = hessenberg(np.array([[v % p for v in row] for row in m], np.int64), p), len(m)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        column, chain = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):  # entries of the column times the subdiagonals between them and row k
            column[i] = int(h[i, k]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else chain
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (column[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d].tolist()


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - M), the constant first, of a symmetric M without negative roots.

    By the means of its roots a coefficient is at most C(d, k) (trace / d)**k, which gives the number of primes.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    chosen = primes(max((math.comb(d, k) * (trace // d + 1) ** k).bit_length() for k in range(d + 1)) + 2)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [residues(m, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "c"])

    rows = spread(spark, [(p,) for p in chosen], "p long").mapInArrow(solved, "p long, c array<long>").collect()
    whole, total = math.prod(chosen), [0] * (d + 1)
    for p, found in rows:
        weight = whole // p * pow(whole // p % p, -1, p)
        total = [t + r * weight for t, r in zip(total, found, strict=True)]
    return [t - whole if 2 * t > whole else t for t in (t % whole for t in total)]


def spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Small tasks dealt evenly over the cluster's cores."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, min(len(rows), spark.sparkContext.defaultParallelism))), schema)


# --- its roots


def above(c: list[int], at: int, bits: int) -> int:
    """How many roots of a real-rooted polynomial exceed at / 2**bits: the sign changes after a Taylor shift."""
    d = len(c) - 1
    a = [v << bits * (d - i) for i, v in enumerate(c)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            a[j] += at * a[j + 1]
    signs = [v > 0 for v in a if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def sign(c: list[int], at: int, bits: int) -> int:
    """The sign of a polynomial at at / 2**bits."""
    value = 0
    for k, v in enumerate(reversed(c)):
        value = value * at + (v << bits * k)
    return (value > 0) - (value < 0)


def isolated(c: list[int], most: int) -> list[tuple[int, int, int]]:
    """Intervals (low, high] / 2**bits with one root each, falling, of the `most` largest positive roots; all are simple."""
    d, out = len(c) - 1, []
    if d < 1:
        return out
    top = 1
    while above(c, top, 0):
        top *= 2
    todo = [(0, top, 0, above(c, 0, 0))]
    while todo and len(out) < most:
        low, high, bits, inside = todo.pop()
        if inside == 1:
            out.append((low, high, bits))
        elif inside:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            right = above(c, middle, bits) - above(c, high, bits)
            todo += [(low, middle, bits, inside - right), (middle, high, bits, right)]
    return out


def refined(c: list[int], low: int, high: int, bits: int, wanted: int) -> tuple[int, int, int]:
    """The interval narrowed to (high - 1, high] / 2**wanted, by signs."""
    end = sign(c, high, bits)
    while high - low > 1 or bits < wanted:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        here = sign(c, middle, bits) if end else 1  # with no sign at the end, the end is the root
        if here == end or here == 0:
            high, end = middle, here
        else:
            low = middle
    return low, high, bits


def _primitive(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a = a[:-1]
    g = math.gcd(*a) if a else 1
    return [v // (-g if a[-1] < 0 else g) for v in a]


def _remainder(a: list[int], b: list[int]) -> list[int]:
    while len(a) >= len(b):
        g = math.gcd(a[-1], b[-1])
        lead, a = a[-1] // g, [v * (b[-1] // g) for v in a]
        for i, v in enumerate(b, len(a) - len(b)):
            a[i] -= v * lead
        a = a[:-1]
    return _primitive(a)


def _divisor(a: list[int], b: list[int]) -> list[int]:
    while b:
        a, b = b, _remainder(a, b)
    return a


def _quotient(a: list[int], b: list[int]) -> list[int]:
    a, out = a[:], [0] * (len(a) - len(b) + 1)
    for i in range(len(out) - 1, -1, -1):
        out[i] = a[i + len(b) - 1] // b[-1]
        for j, v in enumerate(b, i):
            a[j] -= out[i] * v
    return out


def _slope(a: list[int]) -> list[int]:
    return [i * v for i, v in enumerate(a)][1:]


def simple_modulo(c: list[int], p: int) -> bool:
    """Whether a monic polynomial has no multiple root modulo p; then it has none at all."""
    a, b = [v % p for v in c], [v % p for v in _slope(c)]
    while True:
        while b and not b[-1]:
            b.pop()
        if not b:
            return len(a) == 1
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            lead = a[-1] * inverse % p
            for i, v in enumerate(b, len(a) - len(b)):
                a[i] = (a[i] - lead * v) % p
            a.pop()
        a, b = b, a


def simple_factors(c: list[int]) -> list[tuple[list[int], int]]:
    """(factor, multiplicity): factors without multiple roots, by Yun's rule."""
    if any(simple_modulo(c, p) for p in primes(60)):
        return [(c, 1)]
    a = _primitive(c)
    rest = _divisor(a, _primitive(_slope(a)))
    a, out, times = _quotient(a, rest), [], 1
    while len(a) > 1:
        shared = _divisor(a, rest)
        alone = _quotient(a, shared)
        if len(alone) > 1:
            out.append((alone, times))
        a, rest, times = shared, _quotient(rest, shared), times + 1
    return out


def eigenvalues(c: list[int], most: int) -> tuple[list[tuple[int, int]], int]:
    """[(value * 2**bits rounded up, multiplicity)] by falling value, and bits (even), until `most` positive ones are there.

    One root more is refined with them, and all until neighbours differ by 2**MARGIN.
    """
    while len(c) > 1 and not c[0]:  # roots at zero
        c = c[1:]
    found = [(factor, *r, times) for factor, times in simple_factors(c) for r in isolated(factor, most + 1)] if len(c) > 1 else []
    bits = max((r[3] + r[3] % 2 for r in found), default=0) + 2 * MARGIN
    while True:
        found = [(factor, *refined(factor, low, high, at, bits), times) for factor, low, high, at, times in found]
        found.sort(key=lambda r: -r[2])
        if all(a[2] - b[2] >> MARGIN for a, b in zip(found, found[1:], strict=False)):
            break
        bits += 2 * MARGIN
    out: list[tuple[int, int]] = []
    for r in found:
        if sum(times for _, times in out) < most:
            out.append((r[2], r[4]))
    return out, bits


# --- components


def null_space(m: list[list[int]], value: int, bits: int, times: int) -> np.ndarray:
    """Orthonormal columns that M maps to value / 2**bits times themselves; `times` of them."""
    d, scale = len(m), bits + MARGIN
    a = np.array([[v << scale for v in row] for row in m], object).reshape(d, d)
    a[np.arange(d), np.arange(d)] -= value << MARGIN
    names = np.arange(d)
    for k in range(d - times):
        i, j = divmod(int(np.argmax(np.abs(a[k:, k:]))), d - k)
        a[[k, k + i]] = a[[k + i, k]]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        names[[k, k + j]] = names[[k + j, k]]
        share = np.array([(v << scale) // a[k, k] for v in a[k + 1 :, k]], object)
        a[k + 1 :, k:] -= (share[:, None] * a[k, k:]) >> scale
    vectors: list[np.ndarray] = []
    for free in range(d - times, d):
        x = np.zeros(d, object)
        x[free] = 1 << scale
        for k in range(d - times - 1, -1, -1):
            x[k] = -int((a[k, k + 1 :] * x[k + 1 :]).sum()) // a[k, k]
        for v in vectors:  # unit vectors at the same scale
            x = x - ((v * (int((x * v).sum()) >> scale)) >> scale)
        length = math.isqrt(int((x * x).sum()))
        vectors.append(np.array([(int(v) << scale) // length for v in x], object))
    out = np.zeros((d, times))
    for k, v in enumerate(vectors):
        out[names, k] = [int(c) / (1 << scale) for c in v]
        out[:, k] *= np.sign(out[np.argmax(np.abs(out[:, k])), k])
    return out


def fit(vectors: DataFrame, *, vector: str = "embedding", most: int = 32) -> Model:
    """The components of all usable vectors, up to `most`, those without variance left out.

    Vectors that are null, empty or hold null or non-finite entries (2**500 counts as infinite)
    take no part, nor do those of another length than the commonest (ties: the longest).
    Repeated rows count as often as they stand there. An empty table gives a model of nothing.
    A multiple eigenvalue gets an orthonormal basis of its space, the same for all rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vector).alias("_v")).where(usable(F.col("_v")))
    sizes = rows.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return Model(0, 0, (), (), (), np.zeros((0, 0)))
    size = sizes["size"]
    n, sums, m = scatter(rows.where(F.size("_v") == size), "_v", size)
    values, bits = eigenvalues(characteristic(spark, m), most)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth, value, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([nth]), pa.array([null_space(m, int(value), bits, times).T.ravel().tolist()], pa.list_(pa.float64()))], ["nth", "vectors"])

    tasks = [(k, str(v), t) for k, (v, t) in enumerate(values)]
    got = spread(spark, tasks, "nth long, value string, times int").mapInArrow(solved, "nth long, vectors array<double>").collect() if tasks else []
    columns = [np.array(r.vectors).reshape(-1, size) for r in sorted(got)]
    components = np.concatenate([*columns, np.zeros((0, size))])[:most].T
    repeated = [v for v, times in values for _ in range(times)][:most]
    trace = sum(m[i][i] for i in range(size))
    roots = tuple(math.isqrt(v << 2 * MARGIN) / (1 << MARGIN + bits // 2) for v in repeated)
    return Model(n, size, tuple(sums), roots, tuple(v / (trace << bits) for v in repeated), components)


def _centred(model: Model, vectors: pa.Array) -> np.ndarray:
    """n x - S, exactly."""
    x = steps(vectors, model.size)
    s = np.array([v - model.n * OFFSET for v in model.sums], object)
    largest = max([int(np.abs(x).max()) if x.size else 0, 1]) * model.n + max(map(abs, s.tolist()), default=0)
    return (x.astype(object) * model.n - s) if largest >= 1 << 62 else x * model.n - s.astype(np.int64)


def whitened(model: Model, vector: Column) -> Column:
    """struct<deviation: long, whitened: array<double>> of a usable vector of the model's length.

    deviation is the exact sum of (n x - S)**2, or null where 64 bits don't hold it.
    """

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def mapped(vectors: pa.Array) -> pa.Array:
        y = _centred(model, vectors)
        fits = y.dtype != object and (not y.size or float(np.abs(y).max()) ** 2 * model.size < 2.0**62)
        deviation = (y * y).sum(axis=1).tolist() if fits else [v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(axis=1)]
        w = y.astype(np.float64) @ model.components / np.array(model.roots)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
        return pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], ["deviation", "whitened"])

    return mapped(vector)


def identity_error(rows: DataFrame, column: str, model: Model) -> float:
    """The largest absolute entry of the covariance of `column` (divisor n) less the identity; 0 without components."""
    k = len(model.roots)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += np.vstack((w.T @ w, w.sum(axis=0)))
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    if not k:
        return 0.0
    sums = np.zeros((k + 1, k))
    for r in rows.select(column).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = r.v
    mean = sums[k] / model.n
    return float(np.abs(sums[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def transform(vectors: DataFrame, model: Model, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Null and repeated keys stay; other columns don't matter. Vectors the model leaves out give no rows.
    """
    kept = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).where(usable(F.col("_v")) & (F.size("_v") == model.size))
    if not model.roots:
        kept = kept.where(F.lit(False))
    rows = kept.select("_key", whitened(model, F.col("_v")).alias("_w"))
    error = identity_error(rows.select(F.col("_w.whitened").alias("w")), "w", model)
    shares = F.array(*[F.lit(v) for v in model.explained]) if model.explained else F.array(F.lit(0.0))
    long = rows.select("_key", F.col("_w.deviation").alias("deviation"), F.posexplode("_w.whitened").alias("_at", "whitened"))
    return long.select(F.col("_key").alias(key), (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
