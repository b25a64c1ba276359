"""The operators as functions, for expressions; a registry of them by name."""

from __future__ import annotations

from collections.abc import Callable

from panelkit.operators.factor import Factor, _is_number

#: Methods of a factor that are functions of the same name with the factor first.
_METHODS = (
    "ts_rank ts_sum ts_product ts_mean ts_median ts_std ts_min ts_max ts_argmin ts_argmax ts_scale ts_zscore ts_quantile "
    "ts_kurtosis ts_skewness ts_step ts_shift ts_delta ts_corr ts_cov ts_cv ts_jumpiness ts_autocorr ts_reversal_count ts_vr "
    "rank mean median abs sign inverse log ln sqrt signed_log1p signed_pow pow where max min reverse"
).split()
REGISTRY: dict[str, Callable] = {}


def register_operator(name: str, function: Callable) -> Callable:
    """Make ``function`` (factors and numbers to a factor) known to expressions."""
    if not name.isidentifier():
        raise ValueError(f"not a name: {name}")
    REGISTRY[name] = function
    return function


def _function(name: str) -> Callable:
    def call(factor: Factor, *args, **named):
        if not isinstance(factor, Factor):
            raise TypeError(f"{name}: the first argument must be a factor")
        return getattr(factor, name)(*args, **named)

    call.__name__ = name
    call.__doc__ = getattr(Factor, name).__doc__
    return register_operator(name, call)


for _name in _METHODS:
    globals()[_name] = _function(_name)


def _sides(op: str, left, right) -> None:
    if not all(isinstance(x, Factor) or _is_number(x) for x in (left, right)):
        raise TypeError(f"{op}: factors or numbers are needed")


def add(left, right):
    """Sum of factors or numbers; of two numbers, a number."""
    _sides("add", left, right)
    return left + right


def sub(left, right):
    _sides("sub", left, right)
    return left - right


def mul(left, right):
    _sides("mul", left, right)
    return left * right


def div(left, right):
    """Quotient; a number over a factor is missing only where that is 0, and of two numbers a division by 0 is nan."""
    _sides("div", left, right)
    if _is_number(left) and _is_number(right):
        return left / right if right != 0 else float("nan")
    return left / right


for _binary in (add, sub, mul, div):
    register_operator(_binary.__name__, _binary)
