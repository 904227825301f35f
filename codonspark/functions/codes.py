"""Genetic codes as strings that Spark expressions index into.

A code is its 64 residues in the order of the bases T, C, A, G, and the codons that may start a protein. From it follow, by
rule, the stop codons, the residues of all IUPAC codons, and the degeneracy of each codon position.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

BASES = "TCAG"
#: IUPAC nucleotide letters and the bases they stand for.
IUPAC = {"T": "T", "C": "C", "A": "A", "G": "G", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Residue letters that stand for one of two residues.
EITHER = {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}

#: The public genetic codes by number, with names, residues and start codons. Codons that are a residue or a stop by what stands
#: around them (in 27, 28 and 31) count as residues.
CODES = {
    1: ("Standard", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "TTG CTG ATG"),
    2: ("Vertebrate Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG", "ATT ATC ATA ATG GTG"),
    3: ("Yeast Mitochondrial", "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATA ATG GTG"),
    4: ("Mold Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "TTA TTG CTG ATT ATC ATA ATG GTG"),
    5: ("Invertebrate Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG", "TTG ATT ATC ATA ATG GTG"),
    6: ("Ciliate Nuclear", "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    9: ("Echinoderm Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "ATG GTG"),
    10: ("Euplotid Nuclear", "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    11: ("Bacterial", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "TTG CTG ATT ATC ATA ATG GTG"),
    12: ("Alternative Yeast Nuclear", "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "CTG ATG"),
    13: ("Ascidian Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG", "TTG ATA ATG GTG"),
    14: ("Alternative Flatworm Mitochondrial", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "ATG"),
    16: ("Chlorophycean Mitochondrial", "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    21: ("Trematode Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG", "ATG GTG"),
    22: ("Scenedesmus obliquus Mitochondrial", "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    23: ("Thraustochytrium Mitochondrial", "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATT ATG GTG"),
    24: ("Pterobranchia Mitochondrial", "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "TTG CTG ATG GTG"),
    25: ("Candidate Division SR1", "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "TTG ATG GTG"),
    26: ("Pachysolen tannophilus Nuclear", "FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "CTG ATG"),
    27: ("Karyorelict Nuclear", "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    28: ("Condylostoma Nuclear", "FFLLSSSSYYQQCCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    29: ("Mesodinium Nuclear", "FFLLSSSSYYYYCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    30: ("Peritrich Nuclear", "FFLLSSSSYYEECC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    31: ("Blastocrithidia Nuclear", "FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "ATG"),
    32: ("Balanophoraceae Plastid", "FFLLSSSSYY*WCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", "TTG CTG ATT ATC ATA ATG GTG"),
    33: ("Cephalodiscidae Mitochondrial", "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG", "TTG CTG ATG GTG"),
}


def table_id(table: int | str) -> int:
    """The number of a code given by number or name (case doesn't matter); ValueError if there is none."""
    text = str(table).strip()
    if text.lstrip("-").isdigit():
        if int(text) in CODES:
            return int(text)
    else:
        for k, (name, _, _) in CODES.items():
            if name.lower() == text.lower():
                return k
    raise ValueError(f"unknown genetic code: {table}")


@lru_cache
def residues(table: int | str = 1) -> dict[str, str]:
    """Codon -> residue, * for a stop."""
    return {"".join(c): aa for c, aa in zip(product(BASES, repeat=3), CODES[table_id(table)][1], strict=True)}


@lru_cache
def stops(table: int | str = 1) -> tuple[str, ...]:
    return tuple(c for c, aa in residues(table).items() if aa == "*")


@lru_cache
def starts(table: int | str = 1) -> tuple[str, ...]:
    return tuple(CODES[table_id(table)][2].split())


@lru_cache
def ambiguous_residues(table: int | str = 1) -> str:
    """Residues of all IUPAC codons, in the order of IUPAC's letters: that of all codons meant, B, Z or J for two, else X."""
    own, out = residues(table), []
    for codon in product(IUPAC, repeat=3):
        found = {own["".join(c)] for c in product(*(IUPAC[x] for x in codon))}
        out.append(found.pop() if len(found) == 1 else EITHER.get(frozenset(found), "X"))
    return "".join(out)


@lru_cache
def folds(table: int | str = 1) -> str:
    """Degeneracy of the three positions of each codon, three digits a codon in the order of residues(); blanks for stops.

    A position has as many folds as bases that keep the residue; one that no other base keeps has fold 0.
    """
    own, out = residues(table), []
    for codon, aa in own.items():
        for k in range(3):
            same = sum(own[codon[:k] + b + codon[k + 1:]] == aa for b in BASES)
            out.append(" " if aa == "*" else "0" if same == 1 else str(same))
    return "".join(out)
