"""Record schema: which fields of a delimited connection record are numeric,
which are categorical and which one is the label.

The default layout follows the connection-record convention: fields 1, 2 and 3
(0-based) are categorical, the last field is the label (a string that ends with
one terminator character), every other field is numeric.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Positional roles of the connection-record layout.
DEFAULT_CATEGORICAL_POSITIONS = (1, 2, 3)
LABEL_TERMINATOR_LENGTH = 1


@dataclass(frozen=True)
class RecordSchema:
    """Names and roles of the fields of a delimited record.

    ``names`` is the full field list in file order; ``categorical`` the names
    of the string-valued features; ``label`` the name of the label field. All
    remaining fields are numeric (parsed as DOUBLE).
    """

    names: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    label: str = ""
    sep: str = ","
    extra_string: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if len(set(self.names)) != len(self.names):
            raise ValueError(f"duplicate field names in {self.names}")
        missing = [c for c in (*self.categorical, self.label, *self.extra_string)
                   if c and c not in self.names]
        if missing:
            raise ValueError(f"unknown fields {missing}")
        if not self.label:
            object.__setattr__(self, "label", self.names[-1])

    @classmethod
    def positional(cls, n_fields: int, sep: str = ",") -> "RecordSchema":
        """``_1 .. _n`` with the default roles (1-3 categorical, last label)."""
        if n_fields < 5:
            raise ValueError("a positional record needs at least 5 fields")
        names = tuple(f"_{i + 1}" for i in range(n_fields))
        cats = tuple(names[i] for i in DEFAULT_CATEGORICAL_POSITIONS)
        return cls(names=names, categorical=cats, label=names[-1], sep=sep)

    @classmethod
    def from_names(cls, names, categorical=None, label=None, sep=",") -> "RecordSchema":
        names = tuple(names)
        if categorical is None:
            categorical = tuple(names[i] for i in DEFAULT_CATEGORICAL_POSITIONS)
        return cls(names=names, categorical=tuple(categorical),
                   label=label or names[-1], sep=sep)

    @property
    def numeric(self) -> tuple[str, ...]:
        skip = {*self.categorical, self.label, *self.extra_string}
        return tuple(n for n in self.names if n not in skip)

    def is_string(self, name: str) -> bool:
        return name in self.categorical or name == self.label or name in self.extra_string

    def struct_type(self) -> T.StructType:
        return T.StructType([
            T.StructField(n, T.StringType() if self.is_string(n) else T.DoubleType(), True)
            for n in self.names
        ])

    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.struct_type())
