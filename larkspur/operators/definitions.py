"""Definitions of multilevel pipelines: a list of level names over a nested type, checked and compiled into steps over rows.

A type is built from the inside out: a vector, perhaps with an element, then lists and weighted lists (``rhos``) of what is inside.  In rows, each nesting is a key column (and a
weight column, which belongs to what is weighted).  A definition names levels from the inside out as well:

* vector to vector: resize, rescaling, normalization, compression, power_rescaling, full_rescaling, sorf, unscaled_sorf, sign_invariant_sorf, mixed_extensive_sorf;
* element_id_switch: the maps below it have parameters for each element;
* component_sum over a list, weighted_component_sum over a weighted one: one nesting less.

A level that does not fit the type it meets is an error before anything runs.  Neighbouring vector levels become one function over batches, so a definition costs one scan and a
shuffle or two for each nesting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import levels
from .features import Signs

MAPS = {"sorf": "plain", "unscaled_sorf": "plain", "sign_invariant_sorf": "even", "mixed_extensive_sorf": "extensive"}
VECTOR_LEVELS = ("resize", "rescaling", "normalization", "compression", "power_rescaling", "full_rescaling", *MAPS)
SUMS = {"component_sum": "list", "weighted_component_sum": "rhos"}


@dataclass(frozen=True)
class Nesting:
    """kind: list or rhos.  ``key``: what the rows have in common once this nesting is summed; ``weight``: the column of weights of a weighted list's components."""

    kind: str
    key: str
    weight: str | None = None


@dataclass(frozen=True)
class ObjectType:
    """Vectors of ``size`` numbers in column x, with an ``element`` column if they have elements, in nestings from the inside out."""

    size: int
    nestings: tuple[Nesting, ...] = ()
    element: str | None = None
    elements: tuple[int, ...] = ()

    @property
    def definition(self) -> list[str]:
        """As :func:`levels.datatype` takes it."""
        return ["array_1D", *(["element_id"] if self.element else []), *[n.kind for n in self.nestings]]

    def check(self, schema: T.StructType) -> None:
        """Whether rows of this schema are objects of this type."""
        kinds = {f.name: f.dataType for f in schema.fields}
        if not isinstance(kinds.get("x"), T.ArrayType) or not isinstance(kinds["x"].elementType, T.NumericType):
            raise ValueError("x must be an array of numbers")
        if self.element and not isinstance(kinds.get(self.element), T.IntegralType):
            raise ValueError(f"element column {self.element} must hold whole numbers")
        for n in self.nestings:
            if n.kind not in ("list", "rhos"):
                raise ValueError(f"unknown nesting {n.kind}")
            if n.key not in kinds:
                raise ValueError(f"no key column {n.key}")
            if n.kind == "rhos" and not isinstance(kinds.get(n.weight), T.NumericType):
                raise ValueError(f"a weighted list needs a numeric weight column, not {n.weight}")


def compiled(definition: list[str], of: ObjectType, parameters: dict[int, dict] | None = None, signs: Callable[[int, int, int, int, int], Signs] | None = None, seed: int = 0) -> levels.Pipeline:
    """The pipeline of a definition.  ``parameters``: for the level at a place, what it needs besides its hyperparameters' first guesses (size, bounds, weights, powers, sigmas; stacks, transforms, sigma, mixing).

    ``signs`` (place, element, stacks, transforms, size) gives a map's parameters, seeded ones if it is missing.
    """
    parameters = parameters or {}
    draw = signs or (lambda place, element, stacks, transforms, size: Signs.seeded(stacks, transforms, size, seed + 1009 * place + 7919 * element))
    steps: list[tuple] = []
    nestings, size, element = list(of.nestings), of.size, of.element
    for place, name in enumerate(definition):
        p = parameters.get(place, {})
        if name in SUMS:
            if element:
                raise ValueError(f"level {place} ({name}) meets vectors with elements; an element_id_switch must come first")
            if not nestings or nestings[0].kind != SUMS[name]:
                raise ValueError(f"level {place} ({name}) needs a {SUMS[name]}, not {nestings[0].kind if nestings else 'a single vector'}")
            done = nestings.pop(0)
            by = [done.key, *[c for n in nestings for c in (n.weight, n.key) if c]]
            steps.append(("weighted_sum", list(dict.fromkeys(by)), done.weight) if done.weight and name == "weighted_component_sum" else ("sum", list(dict.fromkeys(by))))
        elif name == "element_id_switch":
            if not element:
                raise ValueError(f"level {place} ({name}) needs vectors with elements")
            if not any(s[0] == "map" for s in steps):
                raise ValueError(f"level {place} ({name}) has no map below it to choose parameters for")
            element = None
        elif name in MAPS:
            stacks, transforms, width = p.get("stacks", 1), p.get("transforms", 1), 1 << max(0, (size - 1).bit_length())
            own = of.elements if element else (0,)
            level = levels.FeatureLevel({e: draw(place, e, stacks, transforms, width) for e in own}, p.get("sigma", 1.0), MAPS[name], p.get("mixing", 1.0), scaled=name != "unscaled_sorf")
            steps.append(("map", level, element) if element else ("map", level))
            size = stacks * width
        elif name in VECTOR_LEVELS:
            steps.append(("column", level := _vector_level(place, name, size, p)))
            size = level.size if name == "resize" else size // len(level.weights) if name == "compression" else size
        else:
            raise ValueError(f"unknown level {name}")
    if nestings or element:
        raise ValueError(f"the definition ends inside {[n.kind for n in nestings] or ['element_id']}")
    return levels.Pipeline(steps)


def _vector_level(place: int, name: str, size: int, p: dict) -> levels.ColumnLevel:
    if name == "resize":
        return levels.resize(p.get("size", 1 << max(0, (size - 1).bit_length())))
    if name == "normalization":
        return levels.normalise()
    if name == "compression":
        if size % len(p["weights"]):
            raise ValueError(f"level {place} ({name}): {size} components are no whole number of blocks of {len(p['weights'])}")
        return levels.compress(p["weights"])
    if name == "rescaling":
        bounds = p["bounds"]
        if bounds[0] != 0 or bounds[-1] != size or list(bounds) != sorted(bounds):
            raise ValueError(f"level {place} ({name}): bounds {bounds} do not cover {size} components")
        return levels.rescale(p.get("sigmas", [1.0] * (len(bounds) - 1)), bounds)
    return levels.full_rescale(p.get("sigma", 1.0)) if name == "full_rescaling" else levels.power_rescale(p.get("sigma", 1.0), p["powers"])


def features(definition: list[str], of: ObjectType, objects: DataFrame, parameters: dict[int, dict] | None = None, **how) -> DataFrame:
    """The definition's result for rows of objects: the outermost key and x."""
    of.check(objects.schema)
    return compiled(definition, of, parameters, **how).run(objects)
