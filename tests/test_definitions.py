"""Definitions of multilevel pipelines: what compiles, what it gives, and what is refused."""

import numpy as np
import pytest

from larkspur.operators import definitions
from larkspur.operators.definitions import Nesting, ObjectType, compiled

from .test_plans import plan

#: Atoms in conformers, conformers weighted in an ensemble, ensembles in a list; and global vectors of conformers.
ATOMS = ObjectType(5, (Nesting("list", "conf"), Nesting("rhos", "ens", "w"), Nesting("list", "mol")), "z", (1, 6))
LOCAL = ["resize", "sorf", "element_id_switch", "component_sum", "mixed_extensive_sorf", "weighted_component_sum", "component_sum", "mixed_extensive_sorf"]
CONFORMERS = ObjectType(5, (Nesting("rhos", "ens", "w"), Nesting("list", "mol")))
GLOBAL = ["resize", "sorf", "weighted_component_sum", "normalization", "component_sum", "sorf"]
PARAMETERS = {1: {"stacks": 2, "transforms": 2, "sigma": 1.5}, 4: {"transforms": 2, "mixing": 0.5}, 5: {"sigma": 0.7}, 7: {"sigma": 0.8}}


def rows(spark):
    rng = np.random.default_rng(2)
    data, conf, ens = [], 0, 0
    for mol in range(3):
        for _ in range(2):
            ens += 1
            for _ in range(2):
                conf += 1
                w = float(rng.uniform(0.2, 1))
                data += [(mol, ens, conf, w, int(rng.choice([1, 6])), rng.normal(size=5).tolist()) for _ in range(4)]
    return data, spark.createDataFrame(data, "mol long, ens long, conf long, w double, z int, x array<double>")


def by_hand(pipe, data, local):
    """The same levels, object by object."""
    push = lambda level, v, e=0: level.push(np.array([v]), None, slice(0, 0), e)[0][0]
    sums = [i for i, s in enumerate(pipe.steps) if s[0] in ("sum", "weighted_sum")]
    inner, rest = pipe.steps[: sums[0]], [pipe.steps[a + 1 : b] for a, b in zip(sums, [*sums[1:], len(pipe.steps)], strict=True)]
    out = {}
    for mol, ens, conf, w, z, x in data:
        v = np.array(x)
        for s in inner:
            v = push(s[1], v, z if len(s) > 2 else 0)
        key = (mol, ens, conf, w) if local else (mol, ens)
        out[key] = out.get(key, 0) + (v if local else w * v)
    for k, steps in enumerate(rest):
        new = {}
        for key, v in out.items():
            for s in steps:
                v = push(s[1], v)
            if k == len(rest) - 1:
                new[key] = v
            elif local and k == 0:
                new[key[:2]] = new.get(key[:2], 0) + key[3] * v
            else:
                new[key[:1]] = new.get(key[:1], 0) + v
        out = new
    return out


@pytest.mark.parametrize("local", [True, False])
def test_definitions_give_what_their_levels_do(spark, local):
    data, df = rows(spark)
    of, definition = (ATOMS, LOCAL) if local else (CONFORMERS, GLOBAL)
    pipe = compiled(definition, of, PARAMETERS)
    x = definitions.features(definition, of, df, PARAMETERS)
    assert x.columns == ["mol", "x"] and len(pipe.logs()) == (5 if local else 2)
    text = plan(x)
    want = by_hand(pipe, data, local)
    got = {(r["mol"],): r["x"] for r in x.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    # one scan; a nesting shuffles for its partial sums and for the vector that they make
    assert text.count("Scan") == 1 and text.count("Exchange") <= 2 * len(of.nestings)


def test_types_are_those_of_objects():
    assert ATOMS.definition == ["array_1D", "element_id", "list", "rhos", "list"]


@pytest.mark.parametrize(
    ("definition", "words"),
    [
        (["component_sum"], "element_id_switch must come first"),
        (["sorf", "element_id_switch", "weighted_component_sum"], "needs a rhos, not list"),
        (["sorf", "element_id_switch", "component_sum", "component_sum"], "needs a list, not rhos"),
        (["sorf", "element_id_switch", "component_sum"], "ends inside"),
        (["sorf", "element_id_switch", "element_id_switch"], "needs vectors with elements"),
        (["element_id_switch"], "no map below"),
        (["sorf", "element_id_switch", "component_sum", "weighted_component_sum", "component_sum", "component_sum"], "not a single vector"),
        (["frobnicate"], "unknown level"),
        (["rescaling"], "do not cover"),
        (["compression"], "no whole number"),
    ],
)
def test_what_does_not_fit_is_refused(definition, words):
    with pytest.raises(ValueError, match=words):
        compiled(definition, ATOMS, {0: {"bounds": [0, 4], "weights": [1.0, 1.0]}})


def test_schemas_are_checked(spark):
    _, df = rows(spark)
    ATOMS.check(df.schema)
    for bad in (df.drop("x"), df.drop("w"), df.drop("ens"), df.withColumn("z", df["w"]), df.withColumn("x", df["w"])):
        with pytest.raises(ValueError):
            ATOMS.check(bad.schema)


def test_unscaled_maps_have_no_width_to_fit():
    pipe = compiled(["resize", "unscaled_sorf", "sorf"], ObjectType(5))
    assert len(pipe.logs()) == 1
    pipe.set_logs([0.5])
    assert [level.sigma for level in pipe.maps()] == pytest.approx([1.0, np.exp(0.5)])
