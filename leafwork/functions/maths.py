"""Numeric functions, the stack calculator and rectangle geometry, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def exponential(x: Column, c0: float, c1: float, power: float, domain: tuple[float, float] = (0, 1)) -> Column:
    return F.lit(c0) + F.pow(clamp(x, *domain), F.lit(power)) * (c1 - c0)


def stitched(x: Column, bounds: list[float], parts: list[Callable[[Column], Column]], encode: list[tuple[float, float]], domain: tuple[float, float]) -> Column:
    """The part of the interval that x is in, applied to x re-encoded to the part's own range."""
    x = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for i in reversed(range(len(parts))):
        a, b = edges[i], edges[i + 1]
        e0, e1 = encode[i]
        inner = parts[i](F.lit(e0) + (x - a) * ((e1 - e0) / (b - a) if b > a else 0.0))
        out = inner if out is None else F.when(x < b, inner).otherwise(out)
    return out


def sampled(x: Column, samples: list[float], domain: tuple[float, float] = (0, 1)) -> Column:
    """Linear interpolation between evenly spaced samples."""
    at = (clamp(x, *domain) - domain[0]) * ((len(samples) - 1) / (domain[1] - domain[0]))
    low = F.least(F.floor(at).cast("int"), F.lit(len(samples) - 2))
    table = F.array(*map(F.lit, samples))
    a, b = F.element_at(table, low + 1), F.element_at(table, low + 2)
    return a + (at - low) * (b - a)


def sampled_grid(grid: np.ndarray):
    """Multilinear interpolation over a grid of samples, for points given as arrays in [0, 1] by axis."""

    @F.pandas_udf("double")
    def run(points: pd.Series) -> pd.Series:
        at = np.clip(np.stack(points.to_numpy()), 0, 1) * (np.array(grid.shape) - 1)
        low = np.minimum(at.astype(int), np.array(grid.shape) - 2)
        part, out = at - low, np.zeros(len(at))
        for corner in np.ndindex(*(2,) * grid.ndim):
            c = np.array(corner)
            out += np.where(c == 1, part, 1 - part).prod(axis=1) * grid[tuple((low + c).T)]
        return pd.Series(out)

    return run


#: What each calculator word does to the operands popped for it, given left to right.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a.cast("double") / b,
    "idiv": lambda a, b: F.when(a * b < 0, -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b))), "mod": lambda a, b: a % b,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "exp": F.pow, "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
}
LOGICAL: dict[str, tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]] = {
    "and": (lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)),
    "or": (lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)),
    "xor": (lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)),
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "neg": lambda a: -a, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": lambda a: F.round(a.cast("double")),
    "truncate": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double"), "sqrt": F.sqrt, "ln": F.ln, "log": F.log10,
    "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "cvi": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("int"), "cvr": lambda a: a.cast("double"),
}


def calculator(program: str, *inputs: Column) -> list[Column]:
    """The columns that a stack program leaves of its inputs, as expressions; braces delimit the branches of if and ifelse.

    The stack lives at plan time only: dup, exch, pop, copy, index and roll move column expressions, so a program
    becomes one Catalyst expression for each result. Truth values are tracked to tell logical from bitwise words.
    """
    words = program.replace("{", " { ").replace("}", " } ").split()

    def block(i: int) -> tuple[list, int]:
        out: list = []
        while i < len(words):
            if words[i] == "{":
                inner, i = block(i + 1)
                out.append(inner)
            elif words[i] == "}":
                return out, i + 1
            else:
                out.append(words[i])
                i += 1
        return out, i

    def number(x: tuple[Column, str | int | None]) -> int:
        if not isinstance(x[1], int):
            raise ValueError("copy, index and roll need literal counts")
        return x[1]

    def run(code: list, stack: list) -> list:
        for at, w in enumerate(code):
            if isinstance(w, list):
                continue
            if w in ("if", "ifelse"):
                test = stack.pop()[0]
                yes = run(code[at - (2 if w == "ifelse" else 1)], list(stack))
                no = run(code[at - 1], list(stack)) if w == "ifelse" else stack
                if len(yes) != len(no):
                    raise ValueError("branches leave different depths")
                stack = [(y if y is n else (F.when(test, y[0]).otherwise(n[0]), y[1] if y[1] == "bool" else None)) for y, n in zip(yes, no, strict=True)]
            elif w in BINARY:
                b, a = stack.pop()[0], stack.pop()[0]
                stack.append((BINARY[w](a, b), "bool" if w in ("eq", "ne", "gt", "ge", "lt", "le") else None))
            elif w in LOGICAL:
                b, a = stack.pop(), stack.pop()
                stack.append((LOGICAL[w][0 if a[1] == "bool" else 1](a[0], b[0]), a[1] if a[1] == "bool" else None))
            elif w in UNARY:
                stack.append((UNARY[w](stack.pop()[0]), None))
            elif w == "not":
                a = stack.pop()
                stack.append((~a[0] if a[1] == "bool" else F.bitwise_not(a[0]), a[1]))
            elif w == "bitshift":
                n, a = number(stack.pop()), stack.pop()[0]
                stack.append((F.shiftleft(a, n) if n >= 0 else F.shiftrightunsigned(a, -n), None))
            elif w in ("true", "false"):
                stack.append((F.lit(w == "true"), "bool"))
            elif w == "dup":
                stack.append(stack[-1])
            elif w == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif w == "pop":
                stack.pop()
            elif w == "copy":
                n = number(stack.pop())
                stack += stack[len(stack) - n :]
            elif w == "index":
                n = number(stack.pop())
                stack.append(stack[-1 - n])
            elif w == "roll":
                j, n = number(stack.pop()), number(stack.pop())
                top = stack[len(stack) - n :]
                stack[len(stack) - n :] = top[-j % n :] + top[: -j % n]
            else:
                value = float(w) if "." in w or "e" in w else int(w)
                stack.append((F.lit(value), value if isinstance(value, int) else None))
        return stack

    return [c for c, _ in run(block(0)[0], [(x, None) for x in inputs])]


def overlaps(a: Column, b: Column) -> Column:
    """Whether two rectangles (x1, y1, x2, y2) share a point."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x1"], r["x2"]) & y.between(r["y1"], r["y2"])


def rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle with its corners in order."""
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def clip(a: Column, to: Column) -> Column:
    inside = lambda v, low, high: F.least(F.greatest(v, to[low]), to[high])
    return F.struct(inside(a["x1"], "x1", "x2").alias("x1"), inside(a["y1"], "y1", "y2").alias("y1"), inside(a["x2"], "x1", "x2").alias("x2"), inside(a["y2"], "y1", "y2").alias("y2"))


def rotate(r: Column, quarter: Column, width: Column, height: Column) -> Column:
    """A rectangle on a page turned by quarters."""
    turned = [rect(r["x1"], r["y1"], r["x2"], r["y2"]), rect(r["y1"], width - r["x2"], r["y2"], width - r["x1"]), rect(width - r["x2"], height - r["y2"], width - r["x1"], height - r["y1"]), rect(height - r["y2"], r["x1"], height - r["y1"], r["x2"])]
    return F.when(quarter == 0, turned[0]).when(quarter == 1, turned[1]).when(quarter == 2, turned[2]).otherwise(turned[3])


def area(r: Column) -> Column:
    return (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])


def size_text(n: Column) -> Column:
    """A byte count as 12B, 3.4K, 5.6M or 7.8G."""
    steps = [(1 << 30, "G"), (1 << 20, "M"), (1 << 10, "K")]
    out = None
    for unit, name in steps:
        tenths = F.floor((n * 10 + unit // 2) / F.lit(unit))  # whole numbers, so that halves go up everywhere
        written = F.concat(F.format_string("%.1f", tenths / 10), F.lit(name))
        out = F.when(n >= unit, written) if out is None else out.when(n >= unit, written)
    return out.otherwise(F.concat(n.cast("string"), F.lit("B")))


def image_ratios(width: Column, height: Column, components: Column, bits: Column, size: Column, shown_x: Column, shown_y: Column) -> Column:
    """(raw, ratio, xppi, yppi): an image's uncompressed bytes, the share of them that is stored, in percent, and pixels an inch as shown (in points)."""
    raw = (F.floor((width * components * bits + 7) / 8) * height).cast("long")
    return F.struct(raw.alias("raw"), F.round(100 * size / raw, 1).alias("ratio"), F.round(width * 72 / shown_x, 0).cast("int").alias("xppi"), F.round(height * 72 / shown_y, 0).cast("int").alias("yppi"))


def moved(matrix: list[Column], x: Column, y: Column) -> Column:
    """A point under a matrix [a, b, c, d, e, f]."""
    a, b, c, d, e, f = matrix
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def unit_size(matrix: list[Column]) -> Column:
    """Width and height of the unit square under a matrix."""
    a, b, c, d = matrix[:4]
    return F.struct(F.sqrt(a * a + b * b).alias("width"), F.sqrt(c * c + d * d).alias("height"))


def same_matrix(p: list[Column], q: list[Column], most: float = 0.1) -> Column:
    """Whether two matrices turn alike, but for their shifts."""
    out = F.lit(True)
    for x, y in zip(p[:4], q[:4], strict=True):
        out = out & (F.abs(x - y) < most)
    return out


def corner_distance(a: Column, b: Column) -> Column:
    """The least squared distance between a corner of one box and a corner of another."""
    gaps = [(a[x] - b[u]) * (a[x] - b[u]) + (a[y] - b[v]) * (a[y] - b[v]) for x in ("x1", "x2") for y in ("y1", "y2") for u in ("x1", "x2") for v in ("y1", "y2")]
    return F.least(*gaps)
