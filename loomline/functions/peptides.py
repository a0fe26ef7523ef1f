"""Protein digestion and masses as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monoisotopic masses of residues, and of water.
RESIDUES = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891, "I": 113.08406, "K": 128.09496, "L": 113.08406,
    "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858, "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER = 18.01056


def digest(sequence: Column, missed: int = 2) -> Column:
    """Distinct sorted peptides cut after K or R, not before P, with up to ``missed`` cuts left out."""
    parts = F.filter(F.split(sequence, "(?<=[KR])(?!P)"), lambda p: p != "")

    def joined(n: int) -> Column:
        return F.transform(parts, lambda p, i: F.when(i + n < F.size(parts), F.array_join(F.slice(parts, i + 1, n + 1), "")))

    runs = F.concat(*(joined(n) for n in range(missed + 1)))
    return F.array_sort(F.array_distinct(F.filter(runs, lambda p: p.isNotNull())))


def mass(peptide: Column) -> Column:
    """Neutral mass; null if a letter is no residue."""
    table = F.create_map(*(F.lit(x) for pair in RESIDUES.items() for x in pair))
    return F.aggregate(F.split(peptide, ""), F.lit(WATER), lambda total, letter: total + F.try_element_at(table, letter))


def candidates(peptides: Column) -> Column:
    """Peptides of 9 to 29 residues and 500 to 5,000 Da."""
    return F.filter(peptides, lambda p: F.length(p).between(9, 29) & mass(p).between(500, 5000))
