import random

import pytest

from massgrid.functions import chemistry as chem
from massgrid.functions import codecs, hydrophobicity
from massgrid.functions import retention_tables as tables
from massgrid.functions.hydrophobicity import score
from massgrid.functions.proforma import delta_text, expand
from massgrid.plans.ptm import BOND_C, BOND_N, STATIC, TERMINUS_C, TERMINUS_N, VARIABLE, Condition, Plan, Ptm, PtmSet, conditions, mass_bounds, merged_windows

C = Ptm.of("c", "C", 57.021464, STATIC)
M = Ptm.of("m", "M", 15.99491, VARIABLE)
FIRST = Ptm.of("m1", "M", 16.99491, VARIABLE, TERMINUS_N)
LAST_K = Ptm.of("k", "K", 20.3, VARIABLE, TERMINUS_C)
LAST_R = Ptm.of("r", "R", 20.3, VARIABLE, TERMINUS_C)
NB, CB = Ptm.of("n", "X", 10.0, VARIABLE, BOND_N), Ptm.of("x", "X", 40.3, VARIABLE, BOND_C)
LONG = "MFCQLAKTCPVQLWVDMSTPPPGTRVR"


def test_masses():
    assert chem.mass_of("MFCQLAK") == 839403366202
    assert chem.mass_of("HMENEKTK") == 1015475679562
    assert chem.AVERAGE == 118805717108
    assert chem.to_int(859.49506802369) == 859495068023
    assert chem.ppm_bounds(1_234_567_890, 10, 5) == (1_234_567_890 - 12340, 1_234_567_890 + 6170)
    assert chem.code_letter(chem.code_number("w")) == "W"
    with pytest.raises(ValueError):
        chem.code_number("*")


def test_codecs():
    rng = random.Random(1)
    for prefix in (6, 16):
        for n in (1, 5, 50):
            s = "".join(rng.choice(chem.CANONICAL) for _ in range(n))
            data = codecs.encode_sequence(s, prefix)
            assert len(data) == codecs.compact_size(n, prefix) and codecs.decode_sequence(data, prefix) == s
    for ids in ([], [5], [3, 1, 3, 2], [-(2**31), -7, 0, 2**31 - 1]):
        assert codecs.decode_ids(codecs.encode_ids(ids)) == sorted(set(ids))
    assert [codecs.zigzag(x) for x in (0, -1, 1, -2)] == [0, 1, 2, 3]
    assert all(codecs.unzigzag(codecs.zigzag(x)) == x for x in range(-300, 300))
    with pytest.raises(ValueError):
        codecs.read_varint(b"\x80", 0)
    assert codecs.to_unsigned(codecs.to_signed(7)) == 7 and codecs.to_signed(0) < codecs.to_signed(1)



# Published test sequences and their scores.
SCORES = {
    "A": 0,
    "AA": 0,
    "AAA": 0,
    "AAAA": 0.8168572447196794,
    "ACDE": 0.4487883690977925,
    "WFIL": 34.42608528803379,
    "KRHK": 1.8329999999999997,
    "AAAAA": 1.3166397265478236,
    "AAAAAA": 1.9721127478392972,
    "AAAAAAA": 3.2637859860276164,
    "AAAAAAAA": 4.246475677881995,
    "AAAAAAAAA": 5.0017278816802255,
    "AAAAAAAAAA": 7.973553649754347,
    "ACDEFGHIKL": 24.170996006259134,
    "MNPQRSTVWY": 23.7086,
    "PEPTIDESEQ": 12.290167623790023,
    "SAMPLEPEPTIDE": 28.562999848538123,
    "GLYCINERICHGGG": 24.961824999999997,
    "PEPTIDESEQK": 11.303263091739549,
    "PEPTIDESEQR": 11.943060655671015,
    "PEPTIDESEQH": 11.938109641121251,
    "PEPKTIDESEQ": 10.249113163465555,
    "PEPRTIDESEQ": 10.942525704414477,
    "PEPHTIDESEQ": 10.884267764143639,
    "KPEPTIDESEQ": 12.77907299132314,
    "RPEPTIDESEQ": 13.9441305581841,
    "HPEPTIDESEQ": 13.30810408119215,
    "LLLLLLLLLLLL": 79.7113621670493,
    "LIWLIWLIWLIW": 84.16656463696798,
    "AMYVAMYVAMYV": 39.5556304198108,
    "PPAAAAAAAAAA": 13.18863872329183,
    "PPPAAAAAAAAA": 10.941671619754398,
    "PPPPAAAAAAAA": 10.438081290571837,
    "AAPPAAAAAAAA": 10.755683913057029,
    "AAAAAAAAAAAAAAAAAAAAAAAA": 24.125487660176162,
    "ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY": 46.28918181818182,
    "FFFFFFFFFFFFFFFFFFFF": 126.73135000000005,
    "WWWWWWWWWWWWWWWWWWWW": 146.156,
    "DDDDDDDDDDDDDDDDDDDD": 1.2793991989312616,
    "KKKKKKKKKKKKKKKKKKKK": -38.25,
    "FFFFFFFFFFDDDDDDDDDD": 68.61080862358062,
    "FFFFFWWWWWLLLLLIIIII": 123.87066000000002,
    "KRHKRHKRHKRH": -9.174999999999999,
    "DEDEDEDEDEDE": 5.335148203297889,
    "KRHDEYKRHDEY": 4.93125,
    "LEALKAEIRALEALKAEIRA": 43.71470125000001,
    "AKAEIRALEALKAEIRALEA": 44.26494875,
    "EEAAKKLLEEAAKKLLEEAA": 37.82605333578412,
    "AAAAAAADAAA": 11.143847248824894,
    "AAAAAAAEAAA": 11.791264553019078,
    "AAAAAAADPGA": 8.247745772922174,
    "AAAAAAADXXA": 4.497642833664811,
    "PEPTIDEAAADII": 33.65696490251762,
    "acdefghiklmnpqrstvwy": 0,
    "AC-DE*FG HI1KL": 24.170996006259134,
    "peptideSEQUENCE123": 1.173136635195106,
    "PEPTBIDEXSEQZ": 12.290167623790023,
    "SAMPLERPEPTIDEK": 26.422504864946223,
    "MASSSPECTROMETRY": 17.979999999999993,
    "HYDROPHOBICPEPTIDE": 23.623080625604818,
}


def test_scores():
    for s, want in SCORES.items():
        assert abs(score(s) - want) < 1e-6
    assert score(None) == score("acde") == 0.0


def test_runs_count_once():
    assert (len(tables.TURNS), len(tables.CLUSTERS)) == (192, 124)
    assert hydrophobicity._clusters("GAAGLLGALLAG") == 0.4 * (0.3 + 1.3 + 0.9)
    assert hydrophobicity._clusters("AAGAAG") == 0.4 * 0.3


def test_conditions():
    mass = 839403366202
    found = conditions(PtmSet([C, M, FIRST, LAST_K, Ptm.of("a", "X", 10.0, VARIABLE, TERMINUS_N), Ptm.of("b", "X", 40.3, VARIABLE, TERMINUS_C)]), mass, 6 * chem.MASS["G"], mass, 2, first_only=True)
    text = {f"{c.signature()} @ {chem.to_float(c.mass):.9f}" for c in found}
    assert len(found) == len(text) == 108
    assert "occurrences of 'C' == 0 @ 839.403366202" in text
    assert "occurrences of 'C' == 8, starts with 'M', ends with 'K', occurrences of 'K' >= 1, occurrences of 'M' >= 3 @ 313.946924202" in text
    assert conditions(PtmSet(), mass, 0, mass) == [Condition(mass)]
    low, high = mass_bounds(mass, PtmSet([Ptm.of("loss", "S", -18.0, VARIABLE)]))
    assert low == 6 * chem.MASS["G"] and high == mass + 18_000_000_000 * int(1.3 * (mass // chem.AVERAGE))
    with pytest.raises(ValueError):
        PtmSet([C, Ptm.of("again", "C", 1.0, STATIC)])
    with pytest.raises(ValueError):
        PtmSet([C, Ptm.of("free", "C", 1.0, VARIABLE)])
    two = Plan.of([mass], [Ptm.of("p", "S", 5.0, VARIABLE), Ptm.of("q", "T", 5.0, VARIABLE)], most_variable=3)
    assert len(two.conditions) == len({c.composition() for c in two.conditions})


def test_peptidoforms():
    plain = Condition(0, static=(C, C), variable=(M,))
    assert sorted(t for t, _ in expand(LONG, plain)) == ["<[+57.021464]@C>MFCQLAKTCPVQLWVDM[+15.99491]STPPPGTRVR", "<[+57.021464]@C>M[+15.99491]FCQLAKTCPVQLWVDMSTPPPGTRVR"]
    full = Condition(0, static=(C, C), variable=(M,), n_terminal=FIRST, c_terminal=LAST_R, n_bond=NB, c_bond=CB)
    (text, mass), = expand(LONG, full)
    assert text == "<[+57.021464]@C>[+10]-M[+16.99491]FCQLAKTCPVQLWVDM[+15.99491]STPPPGTRVR[+20.3]-[+40.3]"
    assert mass == chem.mass_of(LONG) + 2 * C.delta + M.delta + FIRST.delta + LAST_R.delta + NB.delta + CB.delta
    assert full.matches(LONG) and not Condition(0, excluded=frozenset("C")).matches(LONG)
    assert [delta_text(chem.to_int(x)) for x in (10.0, 20.3, -18.010565)] == ["+10", "+20.3", "-18.010565"]
    assert list(expand("AAA", Condition(0, variable=(M,)))) == []


def test_windows_merge():
    assert merged_windows([("a", 1, 5), ("a", 5, 9), ("b", 2, 3), ("a", 20, 21)]) == [("a", 1, 9, 2), ("a", 20, 21, 1), ("b", 2, 3, 1)]


def test_display_and_units():
    import base64
    import json

    from massgrid.functions.display import search_payload
    from massgrid.sources.files import mobility_request, mobility_response

    body = {"mass": 839.4, "ptms": [], "note": "??>>~~"}
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        assert search_payload(encode(json.dumps(body).encode()).decode().rstrip("=")) == body
    assert chem.mass_unit(" Da ") == "Dalton" and chem.mass_unit("m/z") == "Thompson"
    with pytest.raises(ValueError):
        chem.mass_unit("kg")
    assert chem.HEAVIEST == chem.mass_of("W" * 50)
    assert mobility_request(["AK"], [2])["inputs"][1]["data"] == [2] and mobility_response({"outputs": [{"data": [0.5]}]}) == [0.5]
    with pytest.raises(ValueError):
        mobility_request(["AK"], [])
