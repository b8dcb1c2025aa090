"""DNA text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases and their complements.
BASES, PARTNERS = "ACGTacgt", "TGCAtgca"


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, PARTNERS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def piece(seq: Column, start: Column, end: Column) -> Column:
    """seq[start, end), ends swapped if reversed, clamped to the sequence; null when empty."""
    a, b = F.least(start, end), F.greatest(start, end)
    return F.when(a < b, F.substring(seq, (F.greatest(a, F.lit(0)) + 1).cast("int"), (b - F.greatest(a, F.lit(0))).cast("int")))


def oriented(seq: Column, sense: str) -> Column:
    """sense: fwd, fwd_complement, rev, rev_complement."""
    return {"fwd": seq, "fwd_complement": complement(seq), "rev": F.reverse(seq), "rev_complement": reverse_complement(seq)}[sense]


def stitched(seqs: Column, offset: Column, start: Column, end: Column) -> Column:
    """[start, end) of a sequence from its consecutive pieces, the first of which begins at ``offset``."""
    return piece(F.array_join(seqs, ""), start - offset, end - offset)
