"""Column-level functions: parsers (P1-P9, P12, P16, P17), normalisers
(P10, P11, P13-P15, J4) and classifiers (C1-C3, R9, P18)."""
