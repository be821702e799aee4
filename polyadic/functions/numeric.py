"""Element-wise functions as Column expressions, with IEEE results where Spark has NULL or an error."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def safe_log(v: Column) -> Column:
    return F.when(v > 0, F.ln(v)).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))


def floor(v: Column) -> Column:
    return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)


def ceil(v: Column) -> Column:
    return -floor(-v)


def trunc(v: Column) -> Column:
    return F.when(v < 0, ceil(v)).otherwise(floor(v))


def modulo(a: Column, b: Column) -> Column:
    """Floored: the result has the divisor's sign."""
    return a - floor(safe_div(a, b)) * b


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def relu(v: Column) -> Column:
    return F.when(v > 0, v).otherwise(0.0)


def gelu(v: Column) -> Column:
    return 0.5 * v * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (v + 0.044715 * v * v * v)))


def elu(v: Column, alpha: float = 1.0) -> Column:
    return F.when(v > 0, v).otherwise(alpha * (F.exp(v) - 1.0))


def selu(v: Column) -> Column:
    # Fixed values of the SELU activation.
    return 1.0507009873554805 * elu(v, 1.6732632423543772)


def softplus(v: Column) -> Column:
    return F.when(v > 0, v).otherwise(0.0) + F.log1p(F.exp(-F.abs(v)))


UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda v: -v,
    "abs": F.abs,
    "exp": F.exp,
    "exp2": lambda v: F.pow(F.lit(2.0), v),
    "expm1": F.expm1,
    "log": safe_log,
    "log2": lambda v: safe_log(v) / math.log(2.0),
    "log10": lambda v: safe_log(v) / math.log(10.0),
    "log1p": lambda v: F.when(v > -1, F.log1p(v)).otherwise(safe_log(v + 1.0)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "sqr": lambda v: v * v,
    "recip": lambda v: safe_div(F.lit(1.0), v),
    "sign": F.signum,
    "floor": floor,
    "ceil": ceil,
    "round": lambda v: F.round(v, 0),
    "trunc": trunc,
    "fract": lambda v: v - trunc(v),
    "deg2rad": F.radians,
    "rad2deg": F.degrees,
    "sigmoid": sigmoid,
    "relu": relu,
    "leaky_relu": lambda v: F.when(v > 0, v).otherwise(0.01 * v),
    "gelu": gelu,
    "elu": elu,
    "selu": selu,
    "softplus": softplus,
    "softsign": lambda v: v / (1.0 + F.abs(v)),
    "swish": lambda v: v * sigmoid(v),
    "mish": lambda v: v * F.tanh(softplus(v)),
    "hard_sigmoid": lambda v: F.least(F.greatest(v / 6.0 + 0.5, F.lit(0.0)), F.lit(1.0)),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": safe_div,
    "pow": F.pow,
    "maximum": lambda a, b: F.when(a >= b, a).otherwise(b),
    "minimum": lambda a, b: F.when(a <= b, a).otherwise(b),
    "modulo": modulo,
    "atan2": F.atan2,
    "hypot": F.hypot,
}

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}
