"""Position-specific log-odds of a cut between two residues.

Offset 0 is the residue before the cut, 1 the residue after it. `*` is the weight of a
residue that is not listed, `_` the weight beyond either end of the string (`*` when absent).
Matrices for further enzymes are passed in by the caller in the same shape.
"""

# Three digestive enzymes.
TRYPSIN = {
    "intercept": -6.5,
    "min_probability": 0.01,
    "positions": {
        -3: {"K": 0.3, "R": 0.2, "P": -0.4, "*": -0.1, "X": -0.2},
        -2: {"K": 0.4, "R": 0.3, "P": -0.6, "D": -0.4, "E": -0.4, "*": -0.1, "X": -0.3},
        -1: {"K": 1.0, "R": 0.9, "H": 0.6, "P": -1.2, "D": -0.6, "E": -0.6, "*": -0.2, "X": -0.5},
        0: {"K": 6.0, "R": 5.8, "H": 1.5, "P": -3.5, "D": -2.5, "E": -2.5, "*": -1.0, "X": -1.4},
        1: {"P": -5.5, "D": -1.0, "E": -1.0, "K": 0.6, "R": 0.6, "G": 0.3, "S": 0.3, "_": -1.2, "*": -0.3, "X": -0.8},
        2: {"P": -0.8, "G": 0.5, "S": 0.4, "T": 0.3, "K": 0.2, "R": 0.2, "*": 0.0, "X": -0.2},
        3: {"P": -0.6, "G": 0.2, "S": 0.2, "T": 0.2, "*": 0.0, "X": -0.1},
    },
}
CHYMOTRYPSIN = {
    "intercept": -5.5,
    "min_probability": 0.01,
    "positions": {
        -3: {"F": 0.3, "W": 0.3, "Y": 0.3, "L": 0.2, "I": 0.2, "M": 0.2, "*": 0.0, "X": -0.2},
        -2: {"F": 0.6, "W": 0.6, "Y": 0.6, "L": 0.5, "I": 0.4, "M": 0.4, "P": -0.6, "*": -0.1, "X": -0.4},
        -1: {
            "F": 1.4, "W": 1.3, "Y": 1.2, "L": 1.1, "I": 1.0, "M": 1.1, "V": 0.8, "A": 0.7,
            "P": -1.2, "D": -0.8, "E": -0.8, "*": -0.2, "X": -0.6,
        },
        0: {
            "F": 5.2, "W": 5.4, "Y": 5.0, "L": 3.0, "I": 2.7, "M": 2.8, "H": 1.7, "V": 1.5, "A": 1.2,
            "P": -3.0, "D": -2.2, "E": -2.2, "*": -1.2, "X": -1.6,
        },
        1: {"P": -4.2, "G": 0.7, "A": 0.7, "S": 0.7, "T": 0.6, "V": 0.5, "Y": -0.5, "_": -1.0, "*": -0.2, "X": -0.5},
        2: {"P": -1.4, "G": 0.3, "A": 0.3, "S": 0.3, "T": 0.2, "*": 0.0, "X": -0.2},
        3: {"P": -0.8, "G": 0.1, "A": 0.1, "S": 0.1, "*": 0.0},
    },
}
PEPSIN = {
    "intercept": -4.8,
    "min_probability": 0.01,
    "positions": {
        -2: {"F": 0.6, "W": 0.6, "Y": 0.6, "L": 0.5, "I": 0.5, "M": 0.5, "V": 0.4, "P": -0.7, "*": -0.2, "X": -0.4},
        -1: {
            "F": 1.0, "W": 1.0, "Y": 1.0, "L": 0.8, "I": 0.7, "M": 0.7, "V": 0.6, "A": 0.4, "P": -1.0, "*": -0.2, "X": -0.5,
        },
        0: {
            "F": 4.2, "W": 4.3, "Y": 4.0, "L": 3.5, "I": 3.3, "M": 3.2, "V": 3.0, "A": 2.0,
            "P": -2.5, "D": -2.0, "E": -2.0, "*": -1.2, "X": -1.6,
        },
        1: {
            "F": 3.0, "W": 3.2, "Y": 3.0, "L": 2.8, "I": 2.5, "M": 2.4, "V": 2.2, "A": 1.5,
            "P": -2.5, "D": -2.0, "E": -2.0, "_": -1.0, "*": -0.5, "X": -0.8,
        },
        2: {"F": 0.6, "W": 0.6, "Y": 0.6, "L": 0.5, "I": 0.5, "M": 0.5, "V": 0.4, "P": -0.8, "*": 0.0},
    },
}
CUT_MATRICES = {"trypsin": TRYPSIN, "chymotrypsin": CHYMOTRYPSIN, "pepsin": PEPSIN}
