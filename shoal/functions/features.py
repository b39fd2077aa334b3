"""An algebra of feature columns, index functions, and one-hot models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.histogram import hist_by, hist_by_flat


class IndexFunction:
    """A partial function from 0 .. width - 1 to values; + puts one behind the other."""

    def __init__(self, width: int, values: Mapping[int, object] | None = None):
        values = dict(values or {})
        if width < 0 or any(not 0 <= k < width for k in values):
            raise ValueError("negative width or an index outside")
        self.width, self.values = width, values

    @classmethod
    def of(cls, *values) -> IndexFunction:
        return cls(len(values), dict(enumerate(values)))

    @classmethod
    def constant(cls, width: int, value) -> IndexFunction:
        return cls(width, {i: value for i in range(width)})

    @classmethod
    def undefined(cls, width: int) -> IndexFunction:
        return cls(width)

    def __call__(self, i: int):
        return self.values[i]

    def __contains__(self, i: int) -> bool:
        return i in self.values

    def get(self, i: int, default=None):
        return self.values.get(i, default)

    @property
    def domain(self) -> set[int]:
        return set(self.values)

    @property
    def range(self) -> set:
        return set(self.values.values())

    def __add__(self, other: IndexFunction) -> IndexFunction:
        return type(self)(self.width + other.width, self.values | {self.width + k: v for k, v in other.values.items()})

    def __eq__(self, other) -> bool:
        return isinstance(other, IndexFunction) and (self.width, self.values) == (other.width, other.values)

    __hash__ = None


class InvertibleIndexFunction(IndexFunction):
    """An index function without equal values."""

    def __init__(self, width: int, values: Mapping[int, object] | None = None):
        super().__init__(width, values)
        self.inverse = {v: k for k, v in self.values.items()}
        if len(self.inverse) < len(self.values):
            raise ValueError("values repeat")

    @classmethod
    def serial(cls, prefix: str, width: int) -> InvertibleIndexFunction:
        return cls.of(*[f"{prefix}{i}" for i in range(width)])


@dataclass(frozen=True)
class FeatureSpec:
    """Columns of doubles with names and numbers of categories; + concatenates."""

    columns: tuple[Column, ...] = ()
    names: IndexFunction = field(default_factory=lambda: InvertibleIndexFunction(0))
    categories: IndexFunction = field(default_factory=lambda: IndexFunction(0))

    def __post_init__(self):
        if not len(self.columns) == self.names.width == self.categories.width:
            raise ValueError("widths differ")

    @property
    def width(self) -> int:
        return len(self.columns)

    @classmethod
    def of(cls, *columns: Column) -> FeatureSpec:
        n = len(columns)
        return cls(tuple(c.cast("double") for c in columns), InvertibleIndexFunction(n), IndexFunction(n))

    @classmethod
    def empty(cls) -> FeatureSpec:
        return cls()

    @classmethod
    def constant(cls, *values: float) -> FeatureSpec:
        return cls.of(*[F.lit(float(v)) for v in values])

    @classmethod
    def numeric(cls, array: Column, *indices: int) -> FeatureSpec:
        return cls.of(*[F.element_at(array, i + 1) for i in indices])

    string = numeric  # text is cast to double; text that is no number is an error

    @classmethod
    def numeric_seq(cls, array: Column, width: int) -> FeatureSpec:
        """All of an array, whose length must be width."""
        checked = F.when(F.size(array) == width, array).otherwise(F.raise_error(F.lit(f"length isn't {width}")))
        return cls.of(*[F.element_at(checked, i + 1) for i in range(width)])

    def __add__(self, other: FeatureSpec) -> FeatureSpec:
        return FeatureSpec(self.columns + other.columns, self.names + other.names, self.categories + other.categories)

    def with_names(self, *names: str) -> FeatureSpec:
        return FeatureSpec(self.columns, InvertibleIndexFunction.of(*names), self.categories)

    def with_categories(self, **sizes: int) -> FeatureSpec:
        """Numbers of categories by name; names that aren't there are passed over."""
        known = {self.names.inverse[k]: n for k, n in sizes.items() if k in self.names.inverse}
        return FeatureSpec(self.columns, self.names, IndexFunction(self.width, self.categories.values | known))

    def then(self, f: Callable[[Column], FeatureSpec]) -> FeatureSpec:
        """f of this spec's array: function composition."""
        return f(self.array())

    def compose(self, df: DataFrame, name: str = "features", **inputs: Column) -> DataFrame:
        """df with this spec's array, the columns that it reads bound to expressions of df, whatever df's own are called."""
        return df.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in inputs.items()]).select("_row.*", self.array().alias(name))

    def fold(self, *steps: Callable[[Column], FeatureSpec]) -> FeatureSpec:
        """self + f(self) + g(all so far) ..."""
        out = self
        for step in steps:
            out = out + step(out.array())
        return out

    def quadratic(self, features: Sequence[int | str] | None = None, diagonal: bool = False) -> FeatureSpec:
        """self and the products of pairs, in order, by index or by name."""
        chosen = [self.names.inverse[f] if isinstance(f, str) else f for f in (range(self.width) if features is None else features)]
        if any(not 0 <= i < self.width for i in chosen):
            raise ValueError("an index outside")
        pairs = [(chosen[j], chosen[k]) for j in range(len(chosen)) for k in range(j if diagonal else j + 1, len(chosen))]
        names = {i: f"{self.names(a)}*{self.names(b)}" for i, (a, b) in enumerate(pairs) if a in self.names and b in self.names}
        more = FeatureSpec(tuple(self.columns[a] * self.columns[b] for a, b in pairs), InvertibleIndexFunction(len(pairs), names), IndexFunction(len(pairs)))
        return self + more

    def array(self) -> Column:
        return F.array(*self.columns) if self.columns else F.array().cast("array<double>")

    def vector(self) -> Column:
        return array_to_vector(self.array())

    def metadata(self) -> dict:
        """ML attributes for the column that vector() becomes."""
        numeric, nominal = [], []
        for i in range(self.width):
            one = {"idx": i, "name": self.names.get(i, f"f_{i}")}
            nominal.append(one | {"vals": [str(v) for v in range(self.categories(i))]}) if i in self.categories else numeric.append(one)
        attributes = {k: v for k, v in (("numeric", numeric), ("nominal", nominal)) if v}
        return {"ml_attr": {"attrs": attributes, "num_attrs": self.width}}


def density(array: Column) -> Column:
    """Share of the elements that aren't 0; 1 for an empty array."""
    return F.when(F.size(array) == 0, F.lit(1.0)).otherwise(F.size(F.filter(array, lambda x: x != 0)) / F.size(array))


def compressed(array: Column, sparse_at_half: bool = True) -> Column:
    """struct(dense, size, indices, values): dense above a density of one half, or from one half on; indices are null where dense."""
    dense = density(array) > 0.5 if sparse_at_half else density(array) >= 0.5
    values = F.when(dense, array).otherwise(active_values(array))
    return F.when(array.isNotNull(), F.struct(dense.alias("dense"), F.size(array).alias("size"), F.when(~dense, active_keys(array)).alias("indices"), values.alias("values")))


def ml_vector(array: Column, sparse_at_half: bool = True) -> Column:
    """The ML vector, dense or sparse, of what compressed() gives; an Arrow function, by column, since no cast makes vectors."""
    def made(c: pa.Array) -> pa.Array:
        dense = c.field("dense").fill_null(False).to_numpy(zero_copy_only=False)
        kind = pa.array(dense.astype("int8"))  # 0 sparse, 1 dense
        size = pa.array(c.field("size").fill_null(0).to_numpy(), pa.int32(), mask=dense)
        parts = {"type": kind, "size": size, "indices": c.field("indices"), "values": c.field("values")}
        return pa.StructArray.from_arrays(list(parts.values()), list(parts), mask=c.is_null())

    return F.arrow_udf(made, VectorUDT())(compressed(array, sparse_at_half))


def labeled_point(label: Column, array: Column, sparse_at_half: bool = True) -> Column:
    return F.struct(label.cast("double").alias("label"), ml_vector(array, sparse_at_half).alias("features"))


def vector_with_id(key: Column, array: Column) -> Column:
    """A vector that carries its id."""
    return F.struct(key.alias("id"), array.alias("vector"))


def active_keys(array: Column) -> Column:
    return F.filter(F.transform(array, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def active_values(array: Column) -> Column:
    return F.filter(array, lambda x: x != 0)


def _is(value) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(value)


class OneHotModel:
    """A vocabulary (value, freq), most frequent first, held by the driver: filters bound its size."""

    def __init__(self, vocabulary: Sequence[tuple[object, float]]):
        self.vocabulary = list(vocabulary)

    @classmethod
    def train(cls, df: DataFrame, value: Column, max_size: int | None = None, min_freq: float | None = None, max_freq: float | None = None, min_prob: float | None = None, max_prob: float | None = None) -> OneHotModel:
        """The vocabulary within inclusive bounds, which are applied before anything comes to the driver."""
        return cls._collected(hist_by(df, value), max_size, min_freq, max_freq, min_prob, max_prob)

    @classmethod
    def train_flat(cls, df: DataFrame, values: Column, max_size: int | None = None, min_freq: float | None = None, max_freq: float | None = None, min_prob: float | None = None, max_prob: float | None = None) -> OneHotModel:
        return cls._collected(hist_by_flat(df, values), max_size, min_freq, max_freq, min_prob, max_prob)

    @classmethod
    def _collected(cls, hist: DataFrame, max_size, min_freq, max_freq, min_prob, max_prob) -> OneHotModel:
        bounds = [(F.col("freq") >= min_freq) if min_freq is not None else None, (F.col("freq") <= max_freq) if max_freq is not None else None]
        for bound in bounds:
            hist = hist if bound is None else hist.where(bound)
        if min_prob is not None or max_prob is not None:
            total = hist.agg(F.sum("freq")).first()[0] or 0.0
            hist = hist.where(F.col("freq").between((min_prob or 0.0) * total, (1.0 if max_prob is None else max_prob) * total))
        top = hist.orderBy("place")
        return cls([(r["value"], r["freq"]) for r in (top.limit(max_size) if max_size is not None else top).collect()])

    def filtered(self, min_freq=None, max_freq=None, min_prob=None, max_prob=None, max_size=None) -> OneHotModel:
        """Inclusive bounds on what was trained: frequency, then probability (of the whole vocabulary), then size."""
        total = sum(f for _, f in self.vocabulary)
        inside = lambda x, lo, hi: (lo is None or x >= lo) and (hi is None or x <= hi)
        kept = [(v, f) for v, f in self.vocabulary if inside(f, min_freq, max_freq)]
        kept = [(v, f) for v, f in kept if inside(f / total, min_prob, max_prob)]
        return OneHotModel(kept[:max_size] if max_size is not None else kept)

    def _spec(self, columns: list[Column], prefix: str, undefined: str | None, other: Column, categories: bool) -> FeatureSpec:
        names = [f"{prefix}{v}" for v, _ in self.vocabulary] + ([undefined] if undefined else [])
        columns = columns + ([other] if undefined else [])
        n = len(columns)
        return FeatureSpec(tuple(c.cast("double") for c in columns), InvertibleIndexFunction.of(*names), IndexFunction.constant(n, 2) if categories else IndexFunction(n))

    def one_hot(self, value: Column, prefix: str = "v=", undefined: str | None = None) -> FeatureSpec:
        """1 at the value's place; a value outside is all 0, or in the last place if that has a name."""
        hits = [F.coalesce(value == F.lit(v), F.lit(False)) for v, _ in self.vocabulary]
        known = F.coalesce(value.isin(*[v for v, _ in self.vocabulary]), F.lit(False)) if self.vocabulary else F.lit(False)
        return self._spec(hits, prefix, undefined, ~known, True)

    def multi_hot(self, values: Column, prefix: str = "v=", undefined: str | None = None) -> FeatureSpec:
        """1 at the place of every value there is."""
        hits = [F.coalesce(F.array_contains(values, F.lit(v)), F.lit(False)) for v, _ in self.vocabulary]
        return self._spec(hits, prefix, undefined, F.exists(values, lambda x: ~self._known(x)), True)

    def hist(self, values: Column, prefix: str = "v=", undefined: str | None = None) -> FeatureSpec:
        """How often each value is there."""
        counts = [F.size(F.filter(values, _is(v))) for v, _ in self.vocabulary]
        return self._spec(counts, prefix, undefined, F.size(F.filter(values, lambda x: ~self._known(x))), False)

    def _known(self, x: Column) -> Column:
        return F.coalesce(x.isin(*[v for v, _ in self.vocabulary]), F.lit(False)) if self.vocabulary else F.lit(False)
