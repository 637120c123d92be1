"""Helpers for folds over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an expression inside a lambda is worked out anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_place(array: Column, hit: Callable[[Column], Column]) -> Column:
    """The place (from 0) of the first element that ``hit`` accepts; null for none."""
    return F.array_min(F.filter(F.transform(array, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull()))


def replaced(array: Column, hit: Callable[[Column], Column], new: Callable[[Column], Column]) -> Column:
    """The array with ``new(element)`` in place of the first element that ``hit`` accepts; null where none is."""
    return once(first_place(array, hit), lambda at: F.when(at.isNotNull(), F.transform(array, lambda x, i: F.when(i == at, new(x)).otherwise(x))))


def changes(array: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements that aren't ``same`` as the one before them."""
    return once(array, lambda a: F.filter(a, lambda x, i: (i == 0) | ~same(F.get(a, F.greatest(i - 1, F.lit(0))), x)))
