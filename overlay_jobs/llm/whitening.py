"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Vectors become whole numbers, x = floor(256 c). The scatter n * sum(x x') - S S' of the distinct vectors, which is n^2 times their
covariance, is a matrix of whole numbers, summed exactly by Spark. Its characteristic polynomial is found modulo many primes, each by a
reduction to Hessenberg form in a task of its own, and put together by Chinese remainders. All its roots are real, so the changes
of sign of its coefficients around a point count the roots above that point exactly: bisection isolates the largest ones to
hundreds of bits. A component is the null space of the matrix less its root, by inverse iteration in fixed point with as many
bits. Only sums over dimensions reach the driver; vectors are whitened where they lie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlay_jobs.session import settle

#: Bits to which roots are told apart, relative to the largest: closer ones count as one root with several components.
BITS = 256
#: Whole numbers are summed in three limbs of so many bits.
LIMB = 62
PRIME_TOP = 1 << 31


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of long integers; shorter vectors end in zeros."""
    out = np.zeros((len(column), dim), np.int64)
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)] = np.asarray(column.flatten())
    return out


def _products(x: np.ndarray) -> np.ndarray:
    """x' x exactly, as Python's whole numbers: in doubles, a stretch of rows at a time, while no sum can pass 2^53."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    rows = (1 << 53) // (most * most)
    if not rows:
        own = x.astype(object)
        return own.T @ own
    total = np.zeros((x.shape[1],) * 2, object)
    for k in range(0, len(x), min(rows, 1 << 16)):
        some = x[k : k + min(rows, 1 << 16)].astype(float)
        total += (some.T @ some).astype(np.int64).astype(object)
    return total


def _limbs(v: int) -> tuple[int, int, int]:
    return v >> 2 * LIMB, (v >> LIMB) & ((1 << LIMB) - 1), v & ((1 << LIMB) - 1)


def scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums per dimension and n * sum(x x') - S S' of the vectors in column x, exactly."""
    upper = [(i, j) for i in range(dim) for j in range(i, dim)]

    def partial(batches):  # noqa: ANN001, ANN202
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            x = _vectors(b.column(0), dim)
            n += len(x)
            sums += x.astype(object).sum(axis=0) if len(x) else 0
            products += _products(x)
        rows = [(-1, -1, n), *((-1, i, v) for i, v in enumerate(sums)), *((i, j, products[i, j]) for i, j in upper)]
        parts = [(i, j, *_limbs(int(v))) for i, j, v in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*parts)], ["i", "j", "a", "b", "c"])

    some = fit.select("x").mapInArrow(partial, "i long, j long, a long, b long, c long")
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "abc"]
    total = {(r["i"], r["j"]): (int(r["a"]) << 2 * LIMB) + (int(r["b"]) << LIMB) + int(r["c"]) for r in some.groupBy("i", "j").agg(*sums).collect()}
    n, s = total.get((-1, -1), 0), [total.get((-1, i), 0) for i in range(dim)]
    matrix = np.zeros((dim, dim), object)
    for i, j in upper:
        matrix[i, j] = matrix[j, i] = n * total.get((i, j), 0) - s[i] * s[j]
    return n, s, matrix


def _is_prime(n: int) -> bool:
    """Exact below 2^64."""
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % p == 0 for p in small):
        return n in small
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in small:
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below PRIME_TOP whose product has more than so many bits."""
    out, size, p = [], 0.0, PRIME_TOP - 1
    while size <= bits + 1:
        if _is_prime(p):
            out.append(p)
            size += math.log2(p)
        p -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo a prime below 2^31, the constant first, through Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        at = k + below[0]
        if at != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # row k: the polynomial of the leading k rows and columns
    poly[0, 0] = 1
    for k in range(1, d + 1):
        weight, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weight[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d].tolist()


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:  # noqa: ANN001
    """Coefficients of det(t - matrix) for a symmetric matrix of whole numbers, the constant first. Primes are dealt to tasks; as
    many are taken as the coefficients can have bits, and one more that must agree."""
    d = len(matrix)
    reach = max(int(sum(abs(v) for v in row)) for row in matrix)  # no root is larger
    bits = d * (max(reach, 1).bit_length() + 1) + 2  # sum over k of C(d, k) reach^k is (1 + reach)^d
    some = primes(bits)
    last = next(p for p in range(some[-1] - 2, 2, -2) if _is_prime(p))

    def reduce(batches):  # noqa: ANN001, ANN202
        for b in batches:
            own = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([polynomial_mod(matrix, p) for p in own], pa.list_(pa.int64()))], ["p", "residues"])

    table = spark.createDataFrame([(p,) for p in [*some, last]], "p long").repartition(max(1, min(len(some) // 8, 64)))
    found = {r["p"]: r["residues"] for r in table.mapInArrow(reduce, "p long, residues array<bigint>").collect()}
    product, out = 1, [0] * (d + 1)
    for p in some:
        inverse = pow(product, -1, p)
        out = [v + product * ((r - v) * inverse % p) for v, r in zip(out, found[p])]
        product *= p
    out = [v - product if v > product // 2 else v for v in out]
    if any((v - r) % last for v, r in zip(out, found[last])):
        raise ArithmeticError("the residues do not make one polynomial")
    return out


def _above(poly: list[int], at: int) -> int:
    """How many roots, with multiplicity, are above a whole number: changes of sign of the coefficients around it, which is exact
    where all roots are real."""
    c = poly[::-1]
    for stop in range(len(c) - 1, 0, -1):
        for k in range(1, stop + 1):
            c[k] += at * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int = BITS) -> tuple[list[int], int]:
    """The largest `count` roots (with multiplicity, descending) of a polynomial whose roots are all real and none below 0, as whole
    numbers of 2^-scale, and scale. Roots that agree in so many bits come out equal."""
    size = len(poly) - 1
    poly = poly[next(i for i, v in enumerate(poly) if v) :]  # without the roots that are 0
    d = len(poly) - 1
    top = 1
    while _above(poly, top):
        top *= 2
    scale = max(0, bits - top.bit_length())
    fine = [v << scale * (d - i) for i, v in enumerate(poly)]
    out: list[int] = []

    def sign(x: int) -> int:
        total = 0
        for v in reversed(fine):
            total = total * x + v
        return (total > 0) - (total < 0)

    lo, hi, below, over = 0, top << scale, d, 0
    stack = [(lo, hi, below, over)]  # roots in (lo, hi]: below - over of them; below: those above lo
    while stack and len(out) < count:
        lo, hi, below, over = stack.pop()
        if below == over:
            continue
        if hi - lo == 1:
            out += [hi] * (below - over)
            continue
        if below - over == 1 and (at := sign(hi)):
            while hi - lo > 1:  # a root alone: its side is told by the sign
                mid = (lo + hi) // 2
                s = sign(mid)
                lo, hi = (lo, mid) if s == at or not s else (mid, hi)
            out.append(hi)
            continue
        mid = (lo + hi) // 2
        n = _above(fine, mid)
        stack += [(lo, mid, below, n), (mid, hi, n, over)]
    out += [0] * (min(count, size) - len(out))
    return out[:count], scale


def null_vectors(matrix: np.ndarray, root: int, scale: int, count: int, bits: int = BITS) -> list[np.ndarray]:
    """So many orthonormal vectors that matrix - root maps to nothing, by inverse iteration in fixed point."""
    d = len(matrix)
    work = 2 * bits
    one = 1 << work
    a = np.array([[int(v) << work for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= root << (work - scale)
    size = max(abs(int(v)) for v in a.ravel()) or 1
    tiny = max(size >> work, 1)
    order = np.arange(d)
    lower = np.zeros((d, d), object)
    for k in range(d):
        at = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        a[[k, at]], lower[[k, at]], order[[k, at]] = a[[at, k]], lower[[at, k]], order[[at, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < d:
            factor = np.array([(int(v) << work) // int(a[k, k]) for v in a[k + 1 :, k]], object)
            lower[k + 1 :, k] = factor
            a[k + 1 :, k:] = a[k + 1 :, k:] - np.array([[(int(f) * int(v)) >> work for v in a[k, k:]] for f in factor], object)

    def solve(b: list[int]) -> list[int]:
        y = [int(b[i]) for i in order]
        for i in range(d):
            y[i] -= sum(int(lower[i, k]) * y[k] for k in range(i)) >> work
        x = [0] * d
        for i in range(d - 1, -1, -1):
            x[i] = ((y[i] << work) - sum(int(a[i, k]) * x[k] for k in range(i + 1, d))) // int(a[i, i])
        return x

    def unit(v: list[int]) -> list[int]:
        cut = max(max(map(abs, v)).bit_length() - work, 0)
        v = [x >> cut for x in v]
        length = math.isqrt(sum(x * x for x in v)) or 1
        return [(x << work) // length for x in v]

    found: list[list[int]] = []
    for m in range(count):
        rng = np.random.default_rng(m)
        v = [int(x) << (work - 20) for x in rng.integers(1 << 19, 1 << 20, d) * rng.choice([-1, 1], d)]
        for _ in range(4):
            for w in found:
                dot = sum(x * y for x, y in zip(v, w)) >> work
                v = [x - (dot * y >> work) for x, y in zip(v, w)]
            v = unit(solve(unit(v)))
        for w in found:
            dot = sum(x * y for x, y in zip(v, w)) >> work
            v = [x - (dot * y >> work) for x, y in zip(v, w)]
        found.append(unit(v))
    return [np.array([x / one for x in v]) for v in found]


def components(spark, matrix: np.ndarray, n: int, count: int) -> list[tuple[float, np.ndarray]]:  # noqa: ANN001
    """Eigenvalue of the covariance and unit eigenvector of the largest `count` components, from the scatter."""
    if not len(matrix) or not n:
        return []
    roots, scale = largest_roots(characteristic_polynomial(spark, matrix), count)
    out = []
    for root in dict.fromkeys(roots):
        for v in null_vectors(matrix, root, scale, roots.count(root)):
            out.append((root / (n * n << scale), v))
    return out


def whiten(df: DataFrame, count: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every vector for each of the largest components.

    Vectors that are null or hold null or non-finite entries are left out. Shorter vectors count as ended by zeros; there are no
    more components than dimensions, and no rows where no vector is left or none has an entry. Rows that are equal, or whose ids
    are null or equal, are rows like others, but the fit has each vector once. Where a component has no variance whitened is null,
    as is explained where no dimension has any; identity_error is over the components with variance, 0 if there are none. A
    deviation beyond 64 bits is null; entries beyond the range of long become its ends. No other column is read, so their names can't clash.
    """
    spark = df.sparkSession
    schema = df.select(F.col(id_col)).schema.simpleString()[7:-1] + ",component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double"
    number = F.col(vector_col)
    real = number.isNotNull() & F.forall(number, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    own = df.where(real).select(F.col(id_col), F.transform(number, lambda c: F.floor(256 * c.cast("double")).cast("long")).alias("x"))
    dim = own.agg(F.max(F.size("x"))).head()[0] or 0
    if not dim:
        return spark.createDataFrame([], schema)
    padded = F.when(F.size("x") < dim, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))).otherwise(F.col("x"))
    fit = settle(own.select(padded.alias("x")).distinct(), "whitening-fit")
    n, sums, matrix = scatter(fit, dim)
    found = components(spark, matrix, n, count)
    trace = sum(int(matrix[i, i]) for i in range(dim)) / (n * n)
    values = np.array([e for e, _ in found])
    axes = np.column_stack([v for _, v in found])
    mean_free = lambda x: (n * x.astype(object) - np.array(sums, object))
    reach = max(abs(s) for s in sums)
    live = np.flatnonzero(values > 0)

    def centred(x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n x - S in doubles, rounded once, and the sum of their squares."""
        most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + reach
        if most * most * dim < 1 << 63:
            own = n * x - np.array(sums, np.int64)
            return own.astype(float), (own * own).sum(axis=1).tolist()
        own = mean_free(x)
        squares = [int(v) for v in (own * own).sum(axis=1)]
        return own.astype(float), [v if v < 1 << 63 else None for v in squares]

    def project(x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        own, squares = centred(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (own / n) @ axes / np.sqrt(values), squares

    def only(batches):  # noqa: ANN001, ANN202
        for b in batches:
            w, _ = project(_vectors(b.column(0), dim))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in live.tolist()], [f"w{k}" for k in live.tolist()])

    error = 0.0
    if len(live):
        pairs = [(int(i), int(j)) for i in live for j in live if i <= j]
        spread = fit.mapInArrow(only, ", ".join(f"w{k} double" for k in live)).agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).head()
        error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def rows(batches):  # noqa: ANN001, ANN202
        for b in batches:
            w, squares = project(_vectors(b.column(1), dim))
            k, m = len(found), len(b)
            whitened = pa.array(w.ravel(), mask=~np.tile(values > 0, m))
            share = [e / trace if trace else None for e in values.tolist()]
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(squares, pa.int64()).take(each), whitened, pa.array(share * m, pa.float64()), pa.array(np.full(m * k, error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.select(id_col, padded.alias("x")).mapInArrow(rows, schema)
