"""A computation step by step: data, predicates, language, scores, search, report."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from prospect.functions.discretise import Discretiser, Frequency, Ranges
from prospect.functions.predicates import Attribute, Kind, Negate, Predicate, Prediciser, attributes
from prospect.operators import kernels, scores, search, summary
from prospect.operators.language import parse


@dataclass(frozen=True)
class Computation:
    """Each step returns a new computation; nothing runs before predicates are asked for."""

    df: DataFrame | None = None
    target: str | None = None
    of: tuple[Attribute, ...] = ()
    prediciser: Prediciser = field(default_factory=Prediciser)
    closed: bool = False
    measure: scores.Score | None = None
    bound: scores.Score | None = None
    removed: tuple[tuple[int, ...], ...] = ()
    result: search.Result | None = None
    kernel: dict = field(default_factory=kernels.linear)
    edges: DataFrame | None = None
    vid: str = "vid"

    def load_dataset(self, df: DataFrame, target: str | None = None, kinds: dict[str | None, Kind | str] | None = None, exclude: tuple[str, ...] = ()) -> Computation:
        """A frame, its target column (no attribute then), and kinds that override the columns' types."""
        skip = (*exclude, *([target] if target else []))
        return replace(self, df=df, target=target, of=tuple(attributes(df, kinds, skip)))

    def load_graph(self, edges: DataFrame, vid: str = "vid") -> Computation:
        """Edges (src, dst) between the rows, which ``vid`` names; measures of graphs need them, and ``vid`` is no attribute then."""
        return replace(self, edges=edges, vid=vid, of=tuple(a for a in self.of if a.name != vid))

    def load_prediciser(self, cuts: int = 5, ranges: str = "SLABS_POSITIVE", negate: str = "BOOLEAN|CATEGORICAL|RANGED", discretiser: type[Discretiser] = Frequency) -> Computation:
        return replace(self, prediciser=Prediciser(discretiser(cuts, Ranges.parse(ranges)), Negate.parse(negate)))

    def load_language(self, name: str = "conjunctions") -> Computation:
        """``conjunctions``, or ``closure-conjunctions`` (``-restricted`` too: the same sets) for closed sets only."""
        if name not in ("conjunctions", "closure-conjunctions", "closure-conjunctions-restricted"):
            raise KeyError(f"no language {name!r}")
        return replace(self, closed=name != "conjunctions")

    def load_measure(self, name: str, **how) -> Computation:
        return replace(self, measure=scores.MEASURES[name](how.pop("target", self.target), **how))

    def load_optimistic_estimator(self, name: str, **how) -> Computation:
        """By name; those whose bins or axes follow from the data read it once here."""
        kind, target = scores.BOUNDS[name], how.pop("target", self.target)
        made = kind.of(self.df, target, **how) if hasattr(kind, "of") else kind(target, **how)
        return replace(self, bound=made)

    def load_kernel(self, name: str = "linear", **how) -> Computation:
        """The kernel between targets: ``linear``, or an ``rbf`` kind (``gaussian``, ``exp``, ``inv-quadratic``) with ``sigma``."""
        return replace(self, kernel=kernels.linear() if name == "linear" else kernels.rbf(kind="gaussian" if name == "rbf" else name, **how))

    def compute_gramian(self, key: str, landmarks: int = 256) -> Computation:
        """Replace the vector target by features whose dot products are the kernel, which ``mmd`` and ``mmd-sd`` read."""
        if self.kernel["kind"] == "linear":
            return self
        df = kernels.features(self.df, key, self.target, self.kernel, landmarks).drop(self.target).withColumnRenamed("features", self.target)
        return replace(self, df=df)

    def predicates(self) -> list[Predicate]:
        return self.prediciser.predicates(self.df, list(self.of))

    def remove_subgroup(self, what: str) -> Computation:
        return replace(self, removed=(*self.removed, parse(what, self.predicates())))

    def optimise(self, k: int = 1, depth: int = 6, approximation_factor: float = 1.0, visit=None, resume: bool = False, **how) -> Computation:
        """Search; ``resume`` goes on from where this computation's last search stopped. ``how``: ``minimise``, ``seeds``, ``abort``, ``keep_tree``."""
        graph = {} if self.edges is None else {"edges": self.edges, "vid": self.vid}
        found = search.search(self.df, self.predicates(), self.measure, self.bound, k, depth, approximation_factor, self.closed, self.removed, visit, self.result if resume else None, **graph, **how)
        return replace(self, result=found)

    def summarise_to_json(self, indent: int = 4) -> str:
        return summary.to_json(self.result, indent)

    def subgroups(self) -> DataFrame:
        return search.as_frame(self.result, self.df)
