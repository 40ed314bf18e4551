"""Molecule strings and spherical functions."""

import pytest
from pyspark.sql import functions as F

from arcloom.functions import smiles, spherical


def shape(atoms, bonds):
    label = {i: (*a, tuple(sorted((atoms[j if i == k else k][0], o) for k, j, o in bonds if i in (k, j)))) for i, a in enumerate(atoms)}
    return sorted(label.values()), len(bonds)


@pytest.mark.parametrize("text", ["CCO", "c1ccccc1", "CC(=O)O", "[NH4+].[Cl-]", "C1CC1C#N", "O=C(N)c1ccc(Br)cc1", "[13CH4]", "F/C=C/F", "C%12CCC%12"])
def test_round_trip(text):
    atoms, bonds = smiles.parse(text)
    assert shape(*smiles.parse(smiles.write(atoms, bonds))) == shape(atoms, bonds)


def test_graphs(spark):
    df = spark.createDataFrame([(1, "CC(=O)O"), (2, "c1cc1"), (3, "C(("), (4, None)], "k long, s string")
    n, e = smiles.molecule_graphs(df, "k", "s")
    assert sorted((r["gid"], r["z"], r["degree"]) for r in n.collect()) == [(1, 6, 1), (1, 6, 3), (1, 8, 1), (1, 8, 1), (2, 6, 2), (2, 6, 2), (2, 6, 2)]
    assert {(r["gid"], r["src"], r["dst"], r["order"]) for r in e.collect()} >= {(1, 0, 1, 1), (1, 1, 2, 2), (2, 2, 0, 5)} and e.count() == 12


def test_spherical(spark):
    z = spherical.zeros(3, 2)
    assert z[1] == pytest.approx([4.493409, 7.725252], abs=1e-5) and z[2] == pytest.approx([5.763459, 9.095011], abs=1e-5)
    r = spark.range(1).select(spherical.bessel_column(2, F.lit(2.0)).alias("j"), spherical.legendre_column(2, F.lit(0.5)).alias("p")).first()
    assert r["j"] == pytest.approx(spherical.bessel(2, 2.0)) and r["p"] == pytest.approx(-0.125)
