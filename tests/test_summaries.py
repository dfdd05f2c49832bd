"""Numbers of each protein's peptides without rows of peptides, against plain string work."""

import pytest
from test_places import KINDS, PROTEINS, plain

from massgrid import views
from massgrid.functions.chemistry import mass_of
from massgrid.operators import digest, places


@pytest.mark.parametrize("p", KINDS, ids=str)
def test_summaries(spark, p):
    proteins = spark.createDataFrame(list(enumerate(PROTEINS)), "id long, sequence string")
    got = {r.protein_id: r for r in digest.digest_summaries(proteins, p).collect()}
    for i, text in enumerate(PROTEINS):
        found = plain(text or "", p)
        if not found:
            assert i not in got
            continue
        masses, r = [mass_of(s) for s in found], got[i]
        assert (r.n, r.total, r.residues, r.lightest, r.heaviest) == (len(found), sum(masses), sum(map(len, found)), min(masses), max(masses))
        assert (r["first"], r["last"]) == (min(found), max(found))
        assert r.ends == sum(mass_of(s) % 1000003 * ord(s[0]) + ord(s[-1]) for s in found)
    assert digest.digest_summaries(proteins.limit(0), p).isEmpty()


def test_no_rows_of_peptides(spark):
    """q_semi_trypsin and q_unspecific shuffle a row for each protein and sort no peptides."""
    from helpers import SMALL

    from massgrid.catalog import QUERIES

    for name in ("q_semi_trypsin", "q_unspecific"):
        frame = QUERIES[name](spark, SMALL)
        made = [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line]
        assert made and all("lightest" in line for line in made)


def test_sums_are_exact():
    """Sums of a long protein leave 64 bits only in parts, never in the result."""
    import numpy as np

    known = np.zeros(256, bool)
    known[[ord("W"), ord("G")]] = True
    n = 60_000
    own = places.Places(np.frombuffer(("W" * n + "G" * 10).encode(), np.uint8), known, 50)
    assert places.summary(own, (50, 50, 50, True, False))["n"] == 11


def test_residues_of_odd_texts(spark):
    """Sequences are the ASCII letters of a text, whatever bytes it has."""
    texts = [None, "", "äöü Straße", "oUOu", "aBc-😀xyz", "\x00\x01Q", "K" * 70_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = [r.s for r in rows.select("i", views.residues(rows.t.cast("binary")).alias("s")).orderBy("i").collect()]
    assert got == ["".join(c for c in (t or "").replace("ß", "") if c.isascii() and c.isalpha()).upper().replace("O", "").replace("U", "") for t in texts]
