"""What the plans read and how they join."""

import re

from larkspur.operators import geometry, kernels, statistics
from larkspur.operators.kernels import Kernel
from larkspur.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_and_filters_pushed(spark, sf):
    df = catalogue.table(spark, sf, "lineitem").filter("l_quantity > 49").groupBy("l_returnflag").agg(statistics.mae(catalogue.F.col("l_tax")))
    text = plan(df)
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>", text) and "GreaterThan(l_quantity" in text


def test_neighbours_are_no_theta_join(spark, sf):
    text = plan(geometry.neighbours(catalogue.atoms(spark, sf), 5.0))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and text.count("Scan parquet") <= 4 and "Union" not in text


def test_tiles_meet_by_an_equi_join(spark, sf):
    v = catalogue.vectors(spark, sf)
    for df in (kernels.kernel_matrix(v, None, Kernel()), kernels.local_kernel_matrix(v, None, Kernel(), z="z"), kernels.rkhs_distances(v, Kernel()), catalogue.QUERIES["orbital_gaussian_kernel"](spark, sf)):
        text = plan(df)
        assert "SortMergeJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text and "Broadcast" not in text
    # sums over atoms are final where they are made: pairs of molecules are not shuffled
    assert "HashAggregate" not in plan(kernels.local_kernel_matrix(v, None, Kernel(), z="z"))


def test_coulomb_matrices_take_one_shuffle(spark, sf):
    a = catalogue.atoms(spark, sf)
    assert plan(geometry.coulomb_matrix(a)).count("Exchange") <= plan(a).count("Exchange") + 1


def test_losses_combine_before_the_shuffle(spark, sf):
    text = plan(catalogue.QUERIES["loss_huber"](spark, sf))
    assert text.count("HashAggregate") == 2 and "partial_avg" in text
