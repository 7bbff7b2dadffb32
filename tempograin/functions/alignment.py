"""Best rotation between two point sets as Column expressions.

The rotation that brings centred points closest to others is a unit quaternion: the
eigenvector of a symmetric 4×4 matrix for its largest eigenvalue. The matrix has no trace,
so its characteristic polynomial needs three numbers, and Newton's steps from above meet
the largest root in a fixed number of rounds. The product of the other factors of the
polynomial, taken at the matrix, is the projection onto the eigenvector.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempograin.functions.numeric import ratio

NEWTON_STEPS = 64  # from above each step closes at least a quarter of the distance
FLAT = 1e-10       # a projection of less trace than this is that of a repeated root


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _product(a, b, i: int, k: int) -> Column:
    terms = [a[i][j] * b[j][k] for j in range(len(b))]
    return sum(terms[1:], terms[0])


def _determinant(m) -> Column:
    """The determinant by its definition, for sizes of a few rows."""
    total = None
    for order in permutations(range(len(m))):
        sign = (-1) ** sum(order[i] > order[k] for i, k in combinations(range(len(m)), 2))
        term = F.lit(float(sign))
        for i, k in enumerate(order):
            term = term * m[i][k]
        total = term if total is None else total + term
    return total


def _square(cells: Column, n: int) -> list[list[Column]]:
    return [[cells[n * i + k] for k in range(n)] for i in range(n)]


def _key_matrix(s) -> Column:
    """The 16 cells of the quaternion matrix; ``s[i][k]`` sums moving i times fixed k."""
    x, y, z = 0, 1, 2
    rows = [
        [s[x][x] + s[y][y] + s[z][z], s[y][z] - s[z][y], s[z][x] - s[x][z], s[x][y] - s[y][x]],
        [s[y][z] - s[z][y], s[x][x] - s[y][y] - s[z][z], s[x][y] + s[y][x], s[z][x] + s[x][z]],
        [s[z][x] - s[x][z], s[x][y] + s[y][x], s[y][y] - s[x][x] - s[z][z], s[y][z] + s[z][y]],
        [s[x][y] - s[y][x], s[z][x] + s[x][z], s[y][z] + s[z][y], s[z][z] - s[x][x] - s[y][y]]]
    return F.array(*[c for row in rows for c in row])


def _largest_root(c2: Column, c1: Column, c0: Column) -> Column:
    """The largest root of x⁴ + c2·x² + c1·x + c0, all of whose roots are real and at most √3."""
    def step(x: Column, _: Column) -> Column:
        slope = 4 * x * x * x + 2 * c2 * x + c1
        value = ((x * x + c2) * x + c1) * x + c0
        return x - F.when(F.abs(slope) > 1e-14, value / slope).otherwise(0.0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(3.0 ** 0.5), step)


def _projections(cells: Column, root: Column, c2: Column, c1: Column) -> list[Column]:
    """Multiples of the projection onto the root's space, if it is single, double or triple."""
    n = _square(cells, 4)
    second = F.array(*[_product(n, n, i, k) for i in range(4) for k in range(4)])

    def built(squared: Column) -> Column:
        sq = _square(squared, 4)
        one, two, three = [], [], []
        for i in range(4):
            for k in range(4):
                unit = 1.0 if i == k else 0.0
                one.append(_product(sq, n, i, k) + root * sq[i][k] + (root * root + c2) * n[i][k]
                           + unit * (root * root * root + c2 * root + c1))
                two.append(sq[i][k] + 2 * root * n[i][k] + unit * (c2 + 3 * root * root))
                three.append(n[i][k] + unit * 3 * root)
        return F.array(F.array(*one), F.array(*two), F.array(*three))
    return _let(second, built)


def _trace(m: Column) -> Column:
    return m[0] + m[5] + m[10] + m[15]


def _rotation_of(m: Column) -> Column:
    """Row-major rotation of the quaternion that the longest column of a projection is."""
    top = F.greatest(m[0], m[5], m[10], m[15])
    column = F.array(*[F.when(m[0] == top, m[4 * i]).when(m[5] == top, m[4 * i + 1])
                       .when(m[10] == top, m[4 * i + 2]).otherwise(m[4 * i + 3]) for i in range(4)])

    def built(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        length = w * w + x * x + y * y + z * z
        cells = [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y),
                 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x),
                 2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]
        return F.array(*[c / length for c in cells])
    return _let(column, built)


def rotation_and_fit(cross: Column) -> Column:
    """(rotation, fit) of nine sums, row-major: moving coordinate i times fixed coordinate k.

    ``rotation`` is row-major and never a reflection; ``fit`` is the sum of products it
    reaches. Where several rotations are equally good, as for points on a line, it is one of
    them; where all are, it is the identity. NULL or undefined sums give NULL.
    """
    norm = F.sqrt(F.aggregate(cross, F.lit(0.0), lambda t, c: t + c * c))
    identity = F.array(*[F.lit(float(i == k)) for i in range(3) for k in range(3)])

    def solved(scaled: Column) -> Column:
        s = _square(scaled, 3)

        def polynomial(cells: Column) -> Column:
            # The matrix's squares sum to four times those of the scaled sums, which are 1.
            coefficients = F.struct(F.lit(-2.0).alias("c2"), (-8 * _determinant(s)).alias("c1"),
                                    _determinant(_square(cells, 4)).alias("c0"))

            def rooted(c: Column) -> Column:
                return _let(_largest_root(c["c2"], c["c1"], c["c0"]), lambda x: F.struct(
                    _let(_projections(cells, x, c["c2"], c["c1"]), lambda p: _rotation_of(
                        F.when(_trace(p[0]) > FLAT, p[0]).when(_trace(p[1]) > FLAT, p[1]).otherwise(p[2]))).alias("rotation"),
                    x.alias("fit")))
            return _let(coefficients, rooted)
        return _let(_key_matrix(s), polynomial)

    def scaled(size: Column) -> Column:
        found = _let(F.transform(cross, lambda c: ratio(c, size)), solved)
        return (F.when(size.isNull() | F.isnan(size), F.lit(None))
                .when(size == 0, F.struct(identity.alias("rotation"), F.lit(0.0).alias("fit")))
                .otherwise(_let(found, lambda f: F.struct(f["rotation"].alias("rotation"), (f["fit"] * size).alias("fit")))))
    return _let(norm, scaled)
