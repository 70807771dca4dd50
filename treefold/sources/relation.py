"""Relations and databases: JSON schemas, CSV and Parquet scans, in-memory and random relations, CSV sink."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attribute types of schema files and the Spark types they load as.
KINDS = {"int": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "category": T.LongType()}


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str = "double"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"attribute {self.name}: unknown type {self.kind!r}; known are {', '.join(KINDS)}")


@dataclass(frozen=True)
class RelationSchema:
    """Name, ordered attributes, primary key and data path of one relation."""

    name: str
    attributes: tuple[Attribute, ...]
    primary_key: tuple[str, ...] = ()
    path: str | None = None

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if len(set(names)) < len(names):
            raise ValueError(f"relation {self.name}: attribute names repeat")
        if missing := [k for k in self.primary_key if k not in names]:
            raise ValueError(f"relation {self.name}: key attributes {missing} do not exist")

    @property
    def categories(self) -> list[str]:
        return [a.name for a in self.attributes if a.kind == "category"]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, KINDS[a.kind], True, {"kind": a.kind}) for a in self.attributes])


@dataclass
class Database:
    """Relations by name; DataFrames are immutable, so every change just puts another DataFrame under a name."""

    spark: SparkSession
    relations: dict[str, DataFrame] = field(default_factory=dict)
    schemas: dict[str, RelationSchema] = field(default_factory=dict)

    @classmethod
    def from_config(cls, spark: SparkSession, config: str | dict, base: str | None = None) -> Database:
        """Schemas from a JSON file, its text or its dict; data load on load()."""
        spec = config if isinstance(config, dict) else json.loads(config) if config.lstrip().startswith("{") else json.loads(open(config, encoding="utf-8").read())
        db = cls(spark)
        for r in spec["database"]["relations"]:
            path = r.get("data_path")
            if path and base and not os.path.isabs(path) and "://" not in path:
                path = os.path.join(base, path)
            attributes = tuple(Attribute(a["name"], a.get("type", "double")) for a in r["attributes"])
            db.schemas[r["name"]] = RelationSchema(r["name"], attributes, tuple(r.get("primary_key", ())), path and os.path.expandvars(path))
        return db

    def load(self, name: str, path: str | None = None) -> DataFrame:
        """A headerless comma-separated file by its declared schema, or a Parquet file or folder."""
        schema = self.schemas[name]
        path = path or schema.path
        if path is None:
            raise ValueError(f"relation {name} has no data path")
        if path.rstrip("/").endswith(".parquet"):
            df = self.spark.read.parquet(path).select(*[F.col(a.name).cast(KINDS[a.kind]).alias(a.name, metadata={"kind": a.kind}) for a in schema.attributes])
        else:
            df = self.spark.read.csv(path, schema=schema.struct(), sep=",", header=False, mode="FAILFAST")
        self.relations[name] = df
        return df

    def load_all(self) -> Database:
        for name in self.schemas:
            self.load(name)
        return self

    def add(self, name: str, df: DataFrame, categories: Iterable[str] = (), primary_key: Sequence[str] = ()) -> DataFrame:
        """Put a DataFrame under a name; its numeric columns are its attributes."""
        kinds = {c: "category" if c in set(categories) else "double" if t in ("double", "float") or t.startswith("decimal") else "int" for c, t in df.dtypes}
        self.schemas[name] = RelationSchema(name, tuple(Attribute(c, kinds[c]) for c in df.columns), tuple(primary_key))
        self.relations[name] = df
        return df

    def add_rows(self, name: str, columns: Sequence[str], rows: Sequence[Sequence[float]]) -> DataFrame:
        """An in-memory relation."""
        types = [T.LongType() if all(isinstance(r[i], int) for r in rows) and rows else T.DoubleType() for i in range(len(columns))]
        schema = T.StructType([T.StructField(c, t) for c, t in zip(columns, types)])
        return self.add(name, self.spark.createDataFrame([tuple(float(v) if isinstance(t, T.DoubleType) else v for v, t in zip(r, types)) for r in rows], schema))

    def rename(self, old: str, new: str) -> None:
        self.relations[new] = self.relations.pop(old)
        if old in self.schemas:
            s = self.schemas.pop(old)
            self.schemas[new] = RelationSchema(new, s.attributes, s.primary_key, s.path)

    def copy(self, name: str, new: str | None = None) -> str:
        """Another name for the same rows."""
        new = new or f"COPY_{name}"
        self.relations[new] = self.relations[name]
        if name in self.schemas:
            s = self.schemas[name]
            self.schemas[new] = RelationSchema(new, s.attributes, s.primary_key, s.path)
        return new

    def drop(self, name: str) -> None:
        """Forget a relation and release what was kept of it."""
        if (df := self.relations.pop(name, None)) is not None:
            df.unpersist()
        self.schemas.pop(name, None)

    def persist(self, name: str) -> DataFrame:
        self.relations[name] = self.relations[name].persist()
        return self.relations[name]

    def drop_attributes(self, names: Sequence[str]) -> None:
        """Project attributes away wherever they occur; unknown names are ignored."""
        for r, df in self.relations.items():
            self.relations[r] = df.drop(*names)

    def save_tables(self, prefix: str = "") -> list[str]:
        """Every relation as a table of the session's catalog; returns the names."""
        names = []
        for n, df in self.relations.items():
            df.write.mode("overwrite").saveAsTable(f"{prefix}{n}")
            names.append(f"{prefix}{n}")
        return names

    def load_table(self, table: str, name: str | None = None) -> DataFrame:
        """A catalog table, under its own or another name."""
        return self.add(name or table, self.spark.table(table))

    def drop_tables(self, names: Iterable[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{n}`")

    def config(self, name: str = "database") -> dict:
        """The JSON schema of all relations, as from_config reads it."""
        relations = [
            {"name": s.name, "attributes": [{"name": a.name, "type": a.kind} for a in s.attributes], "primary_key": list(s.primary_key), "data_path": s.path}
            for s in self.schemas.values()
        ]
        return {"database": {"name": name, "relations": relations}}

    def memory_layout(self, layout: str) -> Database:
        """Row, column or sparse order is Spark's own business: accepted and without effect on results."""
        if layout not in ("row_major", "column_major", "sparse"):
            raise ValueError(f"unknown layout {layout!r}")
        return self

    def size(self, name: str) -> int:
        return self.relations[name].count()

    def report(self) -> DataFrame:
        """Rows, columns, values and bytes (as dense matrices of eight-byte numbers) of every relation; each is counted once."""
        sizes = [(n, df.count(), len(df.columns)) for n, df in sorted(self.relations.items())]
        return self.spark.createDataFrame([(n, r, c, r * c, 8 * r * c) for n, r, c in sizes], "relation string, n_rows long, n_columns int, n_values long, n_bytes long")


def write_csv(df: DataFrame, path: str, sep: str = ",", precision: int = 15, header: bool = False) -> None:
    """Numbers in scientific notation with ``precision`` digits after the point."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    cells = [F.format_string(f"%.{precision}e", F.col(c).cast("double")).alias(c) if c in numeric else F.col(c) for c in df.columns]
    df.select(*cells).write.mode("overwrite").csv(path, sep=sep, header=header)


def random_relation(spark: SparkSession, rows: int, columns: int, seed: int = 42, prefix: str = "A") -> DataFrame:
    """Standard normal values; the same for the same seed and partitioning."""
    return spark.range(rows).select(F.col("id").alias("row"), *[F.randn(seed + i).alias(f"{prefix}{i + 1}") for i in range(columns)])
