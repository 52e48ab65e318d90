"""Sums of money held as doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMB = 1 << 20
_HUGE = 1 << 62


def money_sum(amount: str) -> Column:
    """Sum of a double column, rounded at the end to a double, the nearest if all have few digits.

    It does not depend on the order of rows or on tasks run again: every amount is split into
    whole numbers, and only these are added, as longs. Parts have 20 bits, the top one what is
    left, so the sums of 8e12 amounts fit. An amount is taken as the decimal that it stands for,
    where that has at most six digits after the point (two from 4e9 on, one from 3e13 on), and
    else as its binary value, kept to 2 ** -80. Amounts of 4e18 and more are added as doubles.
    Infinity and NaN fail the job.
    """
    x = amount
    size = f"abs({x})"
    whole = f"(CASE WHEN {size} < {_HUGE}D THEN CAST({x} AS BIGINT) END)"
    fraction = f"({x} - CAST({whole} AS DOUBLE))"

    def digits(scale: int, below: int) -> str:
        """Millionths, if the amount is the double next to a decimal of so many digits."""
        told = f"rint({fraction} * {scale}D)"
        same = f"({whole} * {scale}D + {told}) / {scale}D = {x}"
        return f"WHEN {size} < {below}D AND {same} THEN CAST({told} AS BIGINT) * {1_000_000 // scale}L"

    # Each size has as many digits as are sure to be told apart. Spark computes what the sums
    # have in common once a row where a CASE begins with it.
    micros = f"(CASE {digits(1_000_000, 1 << 32)} {digits(100, 1 << 45)} {digits(10, 1 << 49)}" \
             f" WHEN {fraction} = 0D THEN 0L END)"
    binary = f"CAST({fraction} * {1 << 60}D AS BIGINT)"
    finer = f"CAST(({fraction} * {1 << 60}D - {binary}) * {_LIMB}D AS BIGINT)"
    mask = _LIMB - 1

    def total(value: str) -> str:
        return f"coalesce(sum({value}), 0L)"

    def untold(value: str) -> str:
        return total(f"CASE WHEN {micros} IS NULL THEN {value} END")

    top, units, told = f"sum(shiftright({whole}, 20))", total(f"{whole} & {mask}L"), total(micros)
    limbs = (
        untold(f"shiftright({binary}, 40)"), untold(f"shiftright({binary}, 20) & {mask}L"),
        untold(f"{binary} & {mask}L"), untold(finer),
    )
    error = f"CAST(raise_error(concat('no amount of money: ', CAST({x} AS STRING))) AS DOUBLE)"
    huge = f"sum(CASE WHEN {size} >= {_HUGE}D THEN CASE WHEN {size} < DOUBLE('Infinity') THEN {x} ELSE {error} END END)"

    exact = f"CAST({top} AS DECIMAL(20, 0)) * {_LIMB} + {units} + CAST({told} AS DECIMAL(20, 0)) * 0.000001BD"
    rest = " + ".join(f"{limb} / {_LIMB**k}D" for k, limb in reversed([*enumerate(limbs, 1)]))
    # Whole numbers below 2 ** 53, and the smaller parts added to them at once.
    carried = f"({units} + {told} div 1000000)"
    whole_sum = f"(({top} + {carried} div {_LIMB}) * {_LIMB}D + {carried} % {_LIMB})"
    mixed = f"{whole_sum} + ({told} % 1000000 / 1e6D + ({rest}))"
    main = f"CASE WHEN ({rest}) = 0D THEN CAST({exact} AS DOUBLE) ELSE {mixed} END"
    return F.expr(f"coalesce({main} + coalesce({huge}, 0D), {huge})")
