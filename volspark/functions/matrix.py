"""Small matrix expressions over ARRAY<ARRAY<DOUBLE>> columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def det3(matrix: str) -> Column:
    """Determinant of the upper left 3x3 block."""
    m = F.col(matrix)
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def rotation_angles(matrix: str) -> tuple[Column, Column, Column]:
    """Angles alpha, beta, gamma in degrees of Rz(-alpha) Ry(-beta) Rx(gamma)."""
    m = F.col(matrix)
    return (
        F.degrees(-F.atan2(m[1][0], m[0][0])),
        F.degrees(F.asin(m[2][0])),
        F.degrees(F.atan2(m[2][1], m[2][2])),
    )


def rotation_from_angles(alpha: Column, beta: Column, gamma: Column) -> Column:
    """Rotation matrix Rz(-alpha) Ry(-beta) Rx(gamma) of angles in degrees."""
    z, y, x = F.radians(-alpha), F.radians(-beta), F.radians(gamma)
    cz, sz, cy, sy, cx, sx = F.cos(z), F.sin(z), F.cos(y), F.sin(y), F.cos(x), F.sin(x)
    return F.array(
        F.array(cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx),
        F.array(sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx),
        F.array(-sy, cy * sx, cy * cx),
    )
