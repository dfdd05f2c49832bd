"""Every query of the peptide engine over the small tables against its SQL."""

import pytest
from helpers import SMALL, same_rows

import __spark_entry__
from massgrid import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, duck, name):
    # a query that nothing answers on either side would compare nothing
    assert same_rows(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL)
    assert rows.count() > 0
    if name == "q_protein_id_codec":
        assert rows.where("not same").isEmpty()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(isinstance(s, str) for s in __spark_entry__.oracle_sql().values())


def test_semi_trypsin_has_all_lengths(spark, duck):
    """Least and greatest peptides of some proteins are longer than 10 residues, the former limit."""
    rows = catalog.QUERIES["q_semi_trypsin"](spark, SMALL).collect()
    assert max(len(s) for r in rows for s in (r["first"], r["last"])) > 10
    assert sum(r.n for r in rows) == duck.execute(f"select sum(n) from ({catalog.ORACLES['q_semi_trypsin']})").fetchone()[0]
