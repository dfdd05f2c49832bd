"""Fixed values of the published retention model (Krokhin et al., Mol Cell Proteomics 2004;3(9):908-19, version 3).

Residues in alphabetical order; a residue that a mapping does not name has its default.
"""

from __future__ import annotations

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Retention weights of a residue inside a peptide, and at its first, second, last and last but one place.
INNER = {"A": 1.10, "C": 0.45, "D": 0.15, "E": 0.95, "F": 10.90, "G": -0.35, "H": -1.45, "I": 8.00, "K": -2.05, "L": 9.30, "M": 6.20, "N": -0.85, "P": 2.10, "Q": -0.40, "R": -1.40, "S": -0.15, "T": 0.65, "V": 5.00, "W": 12.25, "Y": 4.85}
FIRST = {"A": 0.35, "C": 0.90, "D": 0.50, "E": 1.00, "F": 7.50, "G": 0.20, "H": -0.10, "I": 5.20, "K": -0.60, "L": 5.55, "M": 4.40, "N": 0.20, "P": 2.10, "Q": -0.70, "R": 0.50, "S": 0.80, "T": 0.80, "V": 2.90, "W": 11.10, "Y": 3.70}
SECOND = {"A": 0.50, "C": 0.20, "D": 0.40, "E": 0.00, "F": 9.50, "G": 0.15, "H": -0.20, "I": 6.60, "K": -1.50, "L": 7.40, "M": 5.70, "N": -0.20, "P": 2.10, "Q": -0.20, "R": -1.10, "S": -0.10, "T": 0.60, "V": 3.40, "W": 11.80, "Y": 4.50}
LAST = {"A": 0.80, "C": -0.80, "D": -0.50, "E": 0.00, "F": 10.50, "G": -0.90, "H": -1.30, "I": 8.40, "K": -1.90, "L": 9.60, "M": 5.80, "N": -1.20, "P": 0.20, "Q": -0.90, "R": -1.30, "S": -0.80, "T": 0.40, "V": 5.00, "W": 11.00, "Y": 4.00}
LAST_BUT_ONE = {"A": -0.10, "C": -0.50, "D": -0.50, "E": -0.10, "F": 10.30, "G": -0.70, "H": -1.70, "I": 7.70, "K": -1.45, "L": 9.30, "M": 6.00, "N": -1.10, "P": 2.10, "Q": -1.10, "R": -1.10, "S": -1.20, "T": 0.00, "V": 4.20, "W": 12.10, "Y": 4.40}

# The same in peptides under 10 residues.
SHORT_INNER = {"A": 0.80, "C": 0.50, "D": 0.30, "E": 0.50, "F": 11.10, "G": 0.00, "H": -1.00, "I": 7.70, "K": -0.20, "L": 9.20, "M": 6.20, "N": -0.85, "P": 3.00, "Q": -0.40, "R": -0.20, "S": -0.50, "T": 0.60, "V": 5.10, "W": 12.40, "Y": 5.10}
SHORT_FIRST = {"A": -0.30, "C": 0.40, "D": 0.30, "E": 0.10, "F": 8.10, "G": 0.00, "H": 0.10, "I": 5.00, "K": -1.40, "L": 6.00, "M": 5.00, "N": 0.20, "P": 1.00, "Q": -0.80, "R": 0.50, "S": 0.40, "T": 0.80, "V": 2.70, "W": 11.60, "Y": 4.20}
SHORT_SECOND = {"A": 0.10, "C": 0.00, "D": 0.70, "E": 0.00, "F": 9.50, "G": 0.10, "H": -0.20, "I": 6.80, "K": -1.30, "L": 7.90, "M": 5.70, "N": -0.20, "P": 1.50, "Q": -0.20, "R": -1.10, "S": 0.10, "T": 0.40, "V": 3.40, "W": 11.80, "Y": 4.50}
SHORT_LAST = {"A": 0.80, "C": -0.80, "D": -0.50, "E": 0.00, "F": 10.50, "G": -0.90, "H": -1.30, "I": 8.40, "K": -2.20, "L": 9.60, "M": 5.80, "N": -1.20, "P": 0.20, "Q": -0.90, "R": -1.20, "S": -0.80, "T": 0.40, "V": 5.00, "W": 11.00, "Y": 4.00}
SHORT_LAST_BUT_ONE = {"A": -0.50, "C": -0.50, "D": -0.50, "E": -0.10, "F": 10.30, "G": -0.70, "H": -1.70, "I": 7.70, "K": -1.45, "L": 8.70, "M": 6.00, "N": -1.10, "P": 2.10, "Q": -1.10, "R": -1.10, "S": -1.20, "T": 0.00, "V": 4.20, "W": 12.10, "Y": 4.40}

# What a neighbour of a cut site takes off; default 0.
NEAR_CUT = {"F": -0.10, "I": 0.15, "L": 0.30, "V": -0.30, "W": 0.15, "Y": -0.20}

# Masses of the isoelectric correction. That of F is not the residue's mass.
MASS = {"A": 71.0370, "C": 103.0090, "D": 115.0270, "E": 129.0430, "F": 147.0638, "G": 57.0210, "H": 137.0590, "I": 113.0840, "K": 128.0950, "L": 113.0840, "M": 131.0400, "N": 114.0430, "P": 97.0530, "Q": 128.0590, "R": 156.1010, "S": 87.0320, "T": 101.0480, "V": 99.0680, "W": 186.0790, "Y": 163.0630}

# pK of the first and last residue's ends, with their defaults, and of side chains.
PK_FIRST, PK_FIRST_ELSE = {"D": 4.55, "E": 4.75}, 3.55
PK_LAST, PK_LAST_ELSE = {"A": 7.59, "E": 7.70, "M": 7.00, "P": 8.36, "S": 6.93, "T": 6.82, "V": 7.44}, 7.50
PK_GAINS = {"H": 5.98, "K": 10.00, "R": 12.00}
PK_LOSSES = {"D": 4.05, "E": 4.45, "Y": 10.00}

# Weight of a residue in a long helix, and factor of its neighbours; default 1.
HELIX = {"A": 1.0, "F": 0.5, "I": 3.5, "L": 1.6, "M": 1.8, "V": 1.4, "W": 1.6, "Y": 0.2}
BESIDE_HELIX = {"A": 1.2, "D": 1.1, "E": 1.1, "G": 0.3, "H": 0.6, "I": 1.4, "L": 1.6, "N": 0.4, "P": 0.3, "V": 1.2}

# Score of a run of 2 to 6 hydrophobic residues (S strong, w weak).
CLUSTERS = {
    "ww": 0.3, "wS": 0.4, "Sw": 0.4, "SS": 1.3,
    "www": 0.5, "wwS": 0.7, "wSw": 0.7, "wSS": 2.1, "Sww": 0.7, "SwS": 2.1, "SSw": 2.1, "SSS": 2.8,
    "wwww": 0.7, "wwwS": 0.9, "wwSw": 0.9, "wwSS": 2.2, "wSww": 0.9, "wSwS": 2.2, "wSSw": 0.9, "wSSS": 3.0,
    "Swww": 0.9, "SwwS": 2.2, "SwSw": 2.2, "SwSS": 3.0, "SSww": 2.2, "SSwS": 3.0, "SSSw": 3.0, "SSSS": 3.5,
    "wwwww": 0.9, "wwwwS": 1.0, "wwwSw": 1.0, "wwwSS": 2.3, "wwSww": 1.0, "wwSwS": 2.3, "wwSSw": 2.3, "wwSSS": 3.1,
    "wSwww": 1.0, "wSwwS": 2.3, "wSwSw": 2.3, "wSwSS": 3.1, "wSSww": 2.3, "wSSwS": 3.1, "wSSSw": 3.1, "wSSSS": 3.6,
    "Swwww": 1.0, "SwwwS": 2.3, "SwwSw": 2.3, "SwwSS": 3.1, "SwSww": 3.6, "SwSwS": 2.3, "SwSSw": 3.1, "SwSSS": 3.6,
    "SSwww": 2.3, "SSwwS": 3.1, "SSwSw": 3.1, "SSwSS": 3.6, "SSSww": 3.1, "SSSwS": 3.6, "SSSSw": 3.6, "SSSSS": 4.0,
    "wwwwww": 1.1, "wwwwwS": 1.7, "wwwwSw": 1.7, "wwwwSS": 2.5, "wwwSww": 1.7, "wwwSwS": 2.5, "wwwSSw": 2.5, "wwwSSS": 3.3,
    "wwSwww": 1.7, "wwSwwS": 2.5, "wwSwSw": 2.5, "wwSwSS": 3.3, "wwSSww": 2.5, "wwSSwS": 3.3, "wwSSSw": 3.3, "wwSSSS": 3.7,
    "wSwwww": 1.7, "wSwwwS": 2.5, "wSwwSw": 2.5, "wSwwSS": 3.3, "wSwSww": 2.5, "wSwSwS": 3.3, "wSwSSw": 3.3, "wSwSSS": 3.7,
    "wSSwww": 2.5, "wSSwwS": 3.3, "wSSwSw": 3.3, "wSSwSS": 3.7, "wSSSww": 3.3, "wSSSwS": 3.7, "wSSSSw": 3.7, "wSSSSS": 4.1,
    "Swwwww": 1.7, "SwwwwS": 2.5, "SwwwSw": 2.5, "SwwwSS": 3.3, "SwwSww": 2.5, "SwwSwS": 3.3, "SwwSSw": 3.3, "SwwSSS": 3.7,
    "SwSwww": 2.5, "SwSwwS": 3.3, "SwSwSw": 3.3, "SwSwSS": 3.7, "SwSSww": 3.3, "SwSSwS": 3.7, "SwSSSw": 3.7, "SwSSSS": 4.1,
    "SSwwww": 2.5, "SSwwwS": 3.3, "SSwwSw": 3.3, "SSwwSS": 3.7, "SSwSww": 3.3, "SSwSwS": 3.7, "SSwSSw": 3.7, "SSwSSS": 4.1,
    "SSSwww": 3.3, "SSSwwS": 3.7, "SSSwSw": 3.7, "SSSwSS": 4.1, "SSSSww": 3.7, "SSSSwS": 4.1, "SSSSSw": 4.1, "SSSSSS": 4.5,
}

# Turns of four to six residues, hydrophobic ones (X strong, Z weak) around polar ones (O acid, U other).
TURNS = {
    "XOXX": 0.7, "XOXZ": 0.2, "XOZX": 0.5, "XOZZ": 0.7, "XUXX": 0.8, "XUXZ": 0.2, "XUZX": 0.5, "XUZZ": 0.2,
    "XXOX": 0.7, "XXOZ": 0.7, "XXUX": 0.8, "XXUZ": 0.2, "XZOX": 0.8, "XZOZ": 0.5, "XZUX": 0.7, "XZUZ": 0.2,
    "ZOXX": 0.7, "ZOXZ": 0.2, "ZOZX": 0.7, "ZOZZ": 0.2, "ZUXX": 0.7, "ZUXZ": 0.2, "ZUZX": 0.2, "ZUZZ": 0.2,
    "ZXOX": 0.7, "ZXOZ": 0.2, "ZXUX": 0.5, "ZXUZ": 0.2, "ZZOX": 0.2, "ZZOZ": 0.2, "ZZUX": 0.2, "ZZUZ": 0.2,
    "XOOXX": 1.25, "XOOXZ": 1.25, "XOOZX": 1.25, "XOOZZ": 1.25, "XOUXX": 1.25, "XOUXZ": 1.25, "XOUZX": 0.75, "XOUZZ": 0.75,
    "XUOXX": 1.25, "XUOXZ": 1.25, "XUOZX": 0.75, "XUOZZ": 0.75, "XUUXX": 1.25, "XUUXZ": 0.6, "XUUZX": 0.6, "XUUZZ": 0.6,
    "XXOOX": 1.25, "XXOOZ": 1.25, "XXOUX": 1.25, "XXOUZ": 0.75, "XXOXX": 3.75, "XXOXZ": 3.75, "XXOZX": 3.75, "XXOZZ": 2.7,
    "XXUOX": 1.25, "XXUOZ": 0.75, "XXUUX": 1.25, "XXUUZ": 0.6, "XXUXX": 3.75, "XXUXZ": 3.75, "XXUZX": 3.75, "XXUZZ": 1.1,
    "XZOOX": 1.25, "XZOOZ": 1.25, "XZOUX": 0.75, "XZOUZ": 0.75, "XZOXX": 3.75, "XZOXZ": 2.7, "XZOZX": 2.7, "XZOZZ": 1.3,
    "XZUOX": 0.75, "XZUOZ": 0.75, "XZUUX": 0.6, "XZUUZ": 0.6, "XZUXX": 3.75, "XZUXZ": 1.1, "XZUZX": 1.1, "XZUZZ": 1.3,
    "ZOOXX": 1.25, "ZOOXZ": 1.25, "ZOOZX": 1.25, "ZOOZZ": 1.25, "ZOUXX": 0.75, "ZOUXZ": 0.75, "ZOUZX": 0.75, "ZOUZZ": 0.75,
    "ZUOXX": 0.75, "ZUOXZ": 0.75, "ZUOZX": 0.75, "ZUOZZ": 0.75, "ZUUXX": 0.6, "ZUUXZ": 0.6, "ZUUZX": 0.6, "ZUUZZ": 0.6,
    "ZXOOX": 1.25, "ZXOOZ": 1.25, "ZXOUX": 1.25, "ZXOUZ": 0.75, "ZXOXX": 3.75, "ZXOXZ": 2.7, "ZXOZX": 2.7, "ZXOZZ": 1.3,
    "ZXUOX": 1.25, "ZXUOZ": 0.75, "ZXUUX": 0.6, "ZXUUZ": 0.6, "ZXUXX": 3.75, "ZXUXZ": 1.1, "ZXUZX": 1.1, "ZXUZZ": 1.3,
    "ZZOOX": 1.25, "ZZOOZ": 1.25, "ZZOUX": 0.75, "ZZOUZ": 0.75, "ZZOXX": 2.7, "ZZOXZ": 1.3, "ZZOZX": 1.3, "ZZOZZ": 1.3,
    "ZZUOX": 0.75, "ZZUOZ": 0.75, "ZZUUX": 0.6, "ZZUUZ": 0.6, "ZZUXX": 1.1, "ZZUXZ": 1.3, "ZZUZX": 1.3, "ZZUZZ": 1.3,
    "XXOOXX": 3.0, "XXOOXZ": 3.0, "XXOOZX": 1.6, "XXOOZZ": 1.6, "XXOUXX": 3.0, "XXOUXZ": 3.0, "XXOUZX": 1.5, "XXOUZZ": 1.5,
    "XXUOXX": 3.0, "XXUOXZ": 3.0, "XXUOZX": 1.5, "XXUOZZ": 1.5, "XXUUXX": 1.25, "XXUUXZ": 1.25, "XXUUZX": 1.25, "XXUUZZ": 1.25,
    "XZOOXX": 1.6, "XZOOXZ": 1.6, "XZOOZX": 1.6, "XZOOZZ": 1.6, "XZOUXX": 1.5, "XZOUXZ": 1.5, "XZOUZX": 1.25, "XZOUZZ": 1.25,
    "XZUOXX": 1.6, "XZUOXZ": 1.5, "XZUOZX": 1.25, "XZUOZZ": 1.25, "XZUUXX": 1.25, "XZUUXZ": 1.25, "XZUUZX": 0.75, "XZUUZZ": 0.75,
    "ZXOOXX": 3.0, "ZXOOXZ": 3.0, "ZXOOZX": 1.6, "ZXOOZZ": 1.6, "ZXOUXX": 3.0, "ZXOUXZ": 1.6, "ZXOUZX": 1.5, "ZXOUZZ": 1.5,
    "ZXUOXX": 3.0, "ZXUOXZ": 1.6, "ZXUOZX": 1.5, "ZXUOZZ": 1.5, "ZXUUXX": 1.25, "ZXUUXZ": 1.25, "ZXUUZX": 1.25, "ZXUUZZ": 1.25,
    "ZZOOXX": 1.6, "ZZOOXZ": 1.6, "ZZOOZX": 1.5, "ZZOOZZ": 1.5, "ZZOUXX": 1.5, "ZZOUXZ": 1.5, "ZZOUZX": 1.25, "ZZOUZZ": 1.25,
    "ZZUOXX": 1.5, "ZZUOXZ": 1.5, "ZZUOZX": 1.25, "ZZUOZZ": 1.25, "ZZUUXX": 1.25, "ZZUUXZ": 1.25, "ZZUUZX": 0.75, "ZZUUZZ": 0.75,
}
