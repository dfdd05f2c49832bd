"""What the larger queries do once, or with fewer steps, against the plain way."""

import random

import pytest
from helpers import SMALL

from massgrid.functions import codecs, hydrophobicity
from massgrid.functions.chemistry import MASS, code_letter, code_number


def test_isoelectric_point_needs_few_places():
    """The least charge is found where its sign turns: the same place as a scan of all, with a fifth of the work."""
    r = random.Random(7)
    for letters in ("ACDEFGHIKLMNPQRSTVWY", "K", "R", "DE", "GAVL", "HKR", "Y"):
        for _ in range(25):
            s = "".join(r.choice(letters) for _ in range(r.randint(4, 50)))
            seen = []
            places = hydrophobicity._steps
            hydrophobicity._steps = lambda *a: seen.append(places(*a)) or seen[-1]
            try:
                found = hydrophobicity._isoelectric_point(s)
            finally:
                hydrophobicity._steps = places
            tables = hydrophobicity.tables
            gains = [(1, tables.PK_FIRST.get(s[0], tables.PK_FIRST_ELSE)), *((s.count(c), pk) for c, pk in tables.PK_GAINS.items() if c in s)]
            losses = [(1, tables.PK_LAST.get(s[-1], tables.PK_LAST_ELSE)), *((s.count(c), pk) for c, pk in tables.PK_LOSSES.items() if c in s)]
            charge = lambda ph: abs(sum(n / (1 + 10 ** (ph - pk)) for n, pk in gains) - sum(n / (1 + 10 ** (pk - ph)) for n, pk in losses))  # noqa: B023, E731
            assert len(seen) == 2 and found == min(seen[1], key=charge)
            assert seen[1] == places(min(seen[0], key=charge) - 0.3, min(seen[0], key=charge) + 0.3, 0.01)


def test_codec_by_digits():
    """The packed form is that of a loop over the residues, and other letters are refused by name."""
    r = random.Random(3)
    for _ in range(500):
        s = "".join(r.choice(sorted(MASS)) for _ in range(r.randint(1, 63)))
        bits = len(s)
        for c in s:
            bits = bits << 5 | code_number(c)
        size = codecs.compact_size(len(s))
        assert codecs.encode_sequence(s) == (bits << (8 * size - 6 - 5 * len(s))).to_bytes(size, "big")
        assert codecs.decode_sequence(codecs.encode_sequence(s.lower())) == s
    over = int.from_bytes(bytes([4]), "big") << 40 | 31 << 37
    assert codecs.decode_sequence(over.to_bytes(6, "big"))[0] == code_letter(31)
    for bad in ("AB", "A_", "A ", "-A", "Ä"):
        with pytest.raises(ValueError):
            codecs.encode_sequence(bad)
    assert hasattr(codecs, "DIGITS")


def exchanges(spark, name):
    from massgrid.catalog import QUERIES

    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("MapInArrow")


def test_tsv_in_one_shuffle(spark):
    assert exchanges(spark, "q_tsv") == (1, 1)


def test_unassigned_digests_once(spark):
    """Masses are counted once, into a table that ranges and the search for faults both read."""
    assert exchanges(spark, "q_unassigned_masses")[1] == 0
    assert "sequence" not in exchanges_plan(spark, "q_protein_id_codec")


def exchanges_plan(spark, name):
    from massgrid.catalog import QUERIES

    lines = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
    return "".join(x for x in lines if "Exchange hashpartitioning" in x or "Aggregate" in x)
