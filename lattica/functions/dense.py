"""Dense algebra of block size (b x b to 3b x 3b) in NumPy on the driver."""

from __future__ import annotations

import numpy as np


def symmetrize(g: np.ndarray) -> np.ndarray:
    return (g + g.T) / 2


def cholesky_upper(g: np.ndarray) -> np.ndarray | None:
    """Upper factor R with G = R'R; None if G isn't positive definite."""
    try:
        return np.linalg.cholesky(symmetrize(g)).T
    except np.linalg.LinAlgError:
        return None


def inverse_upper(r: np.ndarray) -> np.ndarray:
    return np.linalg.solve(r, np.eye(len(r)))


def generalized_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and B-orthonormal vectors of A v = w B v."""
    r = cholesky_upper(b)
    if r is None:
        raise np.linalg.LinAlgError("B isn't positive definite")
    ri = inverse_upper(r)
    w, v = np.linalg.eigh(symmetrize(ri.T @ a @ ri))
    return w, ri @ v


def tridiagonal_eigenvalues(alpha: list[float], beta: list[float]) -> np.ndarray:
    """Ascending eigenvalues of the symmetric tridiagonal matrix; the last beta isn't used."""
    off = np.array(beta[: len(alpha) - 1])
    return np.linalg.eigvalsh(np.diag(np.array(alpha, float)) + np.diag(off, 1) + np.diag(off, -1))


def assemble(blocks: list[list[np.ndarray]]) -> np.ndarray:
    """Symmetric block matrix from its upper blocks; blocks below the diagonal are None."""
    n = len(blocks)
    return np.block([[blocks[i][j] if j >= i else blocks[j][i].T for j in range(n)] for i in range(n)])
