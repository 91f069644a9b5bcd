"""Column expressions: residue names, weights, distances, label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide names, and the standard amino acids.
NUCLEOTIDES = ("A", "C", "G", "U", "I", "T", "DA", "DC", "DG", "DT", "DU")
AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
#: One-letter names of bases, modified ones included; other names stand for themselves.
MODIFIED = {
    "A": "A", "G": "G", "C": "C", "U": "U", "T": "T",
    "DA": "A", "DG": "G", "DC": "C", "DT": "T", "DI": "I",
    "1MA": "A", "2MA": "A", "6MA": "A", "M2A": "A", "I": "A", "A2M": "A", "M6A": "A", "MIA": "A", "RIA": "A", "MA6": "A",
    "5MC": "C", "OMC": "C", "CBR": "C", "CBV": "C", "CCC": "C", "M5C": "C", "RCY": "C", "MCT": "C", "4AC": "C",
    "M2G": "G", "7MG": "G", "OMG": "G", "2MG": "G", "G7M": "G", "Y": "G", "YG": "G", "GFM": "G",
    "5MU": "U", "H2U": "U", "PSU": "U", "OMU": "U", "M2U": "U", "D": "U", "S4U": "U", "4SU": "U", "MSE": "U",
    "T6A": "T", "5MT": "T",
    "X": "N", "N": "N",
    "ADE": "A", "GUA": "G", "CYT": "C", "THY": "T", "URA": "U",
    "B8N": "G", "6MZ": "A", "UY1": "U", "UR3": "U", "GTP": "G", "JMH": "A", "C4J": "C", "XSX": "U", "JMC": "C", "B8H": "G",
}


def is_nucleotide(name: Column) -> Column:
    """Whether a residue name is a nucleotide's; names that start with D count as one."""
    clean = F.upper(F.trim(name))
    return clean.isin(*NUCLEOTIDES) | clean.startswith("D")


def is_amino_acid(name: Column) -> Column:
    return F.upper(F.trim(name)).isin(*AMINO_ACIDS)


def contact_weight(distance: Column, d0: float = 8.0, sigma: float = 1.5) -> Column:
    """Logistic weight of a contact: 0.5 at ``d0``."""
    return 1 / (1 + F.exp((distance - d0) / sigma))


def distance(a: str, b: str) -> Column:
    """Euclidean distance of the points in columns ``{a}x`` ... and ``{b}x`` ..."""
    return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def base_number(label: Column) -> Column:
    """All digits of a residue label as one number; the sign is lost."""
    return F.regexp_replace(label, "[^0-9]", "").try_cast("int")


def range_gap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Residues between two inclusive ranges; 0 if they overlap."""
    return F.greatest(F.lit(0), start2 - end1, start1 - end2)


def boundary_distance(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Mean shift of the two ends."""
    return (F.abs(start1 - start2) + F.abs(end1 - end2)) / 2


def hamming(a: Column, b: Column) -> Column:
    """Share of places at which two arrays of the length of ``a`` differ."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return 1 - same / F.size(a)


def format_range(start: Column, end: Column) -> Column:
    """``a`` or ``a-b``."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def expand_ranges(ranges: Column) -> Column:
    """All positions of an array of half-open (s, e) structs, in order."""
    return F.flatten(F.transform(ranges, lambda r: F.when(r["e"] > r["s"], F.sequence(r["s"], r["e"] - 1)).otherwise(F.array().cast("array<int>"))))


def canonical_name(name: Column) -> Column:
    """One-letter name of a base; unknown names stay, upper-case."""
    clean = F.upper(F.trim(name))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in MODIFIED.items() for x in kv))[clean], clean)
