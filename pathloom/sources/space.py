"""Graph spaces: named sets of tag and edge tables, immutable in their data; mutations give a new space.

A tag table has ``_vid`` and the tag's properties; an edge table ``_src``, ``_dst``, ``_rank`` and the type's properties.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.values import SemanticError

OUT, IN, BOTH = "out", "in", "both"


@dataclass(frozen=True)
class Property:
    """A declared property."""

    name: str
    type: str
    nullable: bool = True
    default: object = None
    has_default: bool = False
    comment: str = ""


@dataclass(frozen=True)
class Schema:
    """A tag's or edge type's declaration; every change makes a new version."""

    name: str
    properties: tuple[Property, ...] = ()
    ttl_column: str | None = None
    ttl_seconds: int = 0
    version: int = 0
    comment: str = ""

    def names(self) -> list[str]:
        return [p.name for p in self.properties]


@dataclass(frozen=True)
class Space:
    """One graph: tag tables and edge tables with their declarations, and index declarations."""

    spark: SparkSession
    name: str
    vid_type: str = "string"
    tags: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    schemas: dict[tuple[str, str], Schema] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    options: dict[str, object] = field(default_factory=dict)

    # -- building -------------------------------------------------------------
    def with_tag(self, name: str, df: DataFrame, vid: str = "_vid", schema: Schema | None = None) -> Space:
        """A space with one more tag table; ``vid`` names its key column."""
        df = df.withColumnRenamed(vid, "_vid") if vid != "_vid" else df
        props = [c for c in df.columns if c != "_vid"]
        df = df.select("_vid", *props)
        schema = schema or Schema(name, tuple(Property(f.name, f.dataType.simpleString()) for f in df.schema if f.name != "_vid"))
        return replace(self, tags={**self.tags, name: df}, schemas={**self.schemas, ("tag", name): schema})

    def with_edge(self, name: str, df: DataFrame, src: str = "_src", dst: str = "_dst", rank: str | None = None, schema: Schema | None = None) -> Space:
        """A space with one more edge table; without ``rank`` every edge has rank 0."""
        df = df.withColumnRenamed(src, "_src").withColumnRenamed(dst, "_dst")
        df = df.withColumnRenamed(rank, "_rank") if rank else df if "_rank" in df.columns else df.withColumn("_rank", F.lit(0).cast("long"))
        props = [c for c in df.columns if c not in ("_src", "_dst", "_rank")]
        df = df.select("_src", "_dst", "_rank", *props)
        schema = schema or Schema(name, tuple(Property(f.name, f.dataType.simpleString()) for f in df.schema if f.name in props))
        return replace(self, edges={**self.edges, name: df}, schemas={**self.schemas, ("edge", name): schema})

    # -- reading --------------------------------------------------------------
    def tag(self, name: str) -> DataFrame:
        """Rows of a tag that have not expired."""
        if name not in self.tags:
            raise SemanticError(f"no tag named {name}")
        return self._live(self.tags[name], self.schemas.get(("tag", name)))

    def edge(self, name: str) -> DataFrame:
        """Rows of an edge type that have not expired."""
        if name not in self.edges:
            raise SemanticError(f"no edge type named {name}")
        return self._live(self.edges[name], self.schemas.get(("edge", name)))

    @staticmethod
    def _live(df: DataFrame, schema: Schema | None) -> DataFrame:
        if schema is None or not schema.ttl_column or not schema.ttl_seconds:
            return df
        t = F.col(schema.ttl_column)
        seconds = t if isinstance(df.schema[schema.ttl_column].dataType, T.IntegralType) else F.unix_timestamp(t.cast("timestamp"))
        # an edge or vertex without a time never expires
        return df.where(seconds.isNull() | (seconds + schema.ttl_seconds >= F.unix_timestamp()))

    def vertices(self) -> DataFrame:
        """All vertex ids, each once."""
        if not self.tags:
            return self.spark.createDataFrame([], f"_vid {self.vid_type}")
        out = None
        for name in self.tags:
            one = self.tag(name).select("_vid")
            out = one if out is None else out.union(one)
        return out.distinct()

    def vertex_rows(self) -> DataFrame:
        """Vertex ids, one row for each tag of a vertex."""
        out = None
        for name in self.tags:
            one = self.tag(name).select("_vid")
            out = one if out is None else out.union(one)
        return self.vertices() if out is None else out

    def closed(self) -> Space:
        """The space declared to have no dangling edges, as foreign keys grant; patterns then need not look for them.

        A statement that changes data or declarations ends it.
        """
        return replace(self, options={**self.options, "closed": True})

    def property_types(self) -> dict[str, T.DataType]:
        """Types of the vertex properties that have one type wherever they occur."""
        found: dict[str, T.DataType | None] = {}
        for t in self.tags.values():
            for f in t.schema.fields[1:]:
                found[f.name] = f.dataType if found.get(f.name, f.dataType) == f.dataType else None
        return {k: v for k, v in found.items() if isinstance(v, T.AtomicType) and not isinstance(v, T.BinaryType)}

    def edge_types(self, names: list[str] | None = None) -> list[str]:
        """The given edge types, or all; unknown names are an error."""
        for n in names or []:
            if n not in self.edges:
                raise SemanticError(f"no edge type named {n}")
        return list(dict.fromkeys(names)) if names else list(self.edges)

    def edge_view(self, names: list[str] | None = None, direction: str = OUT, props: list[str] | None = None) -> DataFrame:
        """Edges as traversals: ``_from, _to, _type, _src, _dst, _rank, _dir`` and properties.

        A reverse traversal has ``_dir`` -1. With both directions a self-loop is traversed once. Properties that a type
        lacks are null; ``props`` limits the properties read, so that scans read no more columns than are used.
        """
        types = self.edge_types(names)
        wanted = props if props is not None else list(dict.fromkeys(c for n in types for c in self.edges[n].columns[3:]))
        kinds: dict[str, T.DataType] = {}
        for n in self.edges:
            for f in self.edges[n].schema.fields[3:]:
                # a property that several types have with different kinds is read as text
                if f.name in wanted:
                    kinds[f.name] = f.dataType if kinds.get(f.name, f.dataType) == f.dataType else T.StringType()
        out = None
        for n in types:
            df = self.edge(n)
            cols = [(F.col(p).cast(kinds[p]) if p in df.columns else F.lit(None).cast(kinds.get(p, T.StringType()))).alias(p) for p in wanted]
            base = df.select(F.lit(n).alias("_type"), "_src", "_dst", "_rank", *cols)
            parts = []
            if direction in (OUT, BOTH):
                parts.append(base.select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"), "*", F.lit(1).alias("_dir")))
            if direction in (IN, BOTH):
                back = base if direction == IN else base.where("_src <> _dst")
                parts.append(back.select(F.col("_dst").alias("_from"), F.col("_src").alias("_to"), "*", F.lit(-1).alias("_dir")))
            for p in parts:
                out = p if out is None else out.unionByName(p)
        if out is None:
            raise SemanticError("the space has no edge types")
        return out

    def with_tag_columns(self, rows: DataFrame, vid: str, tag: str, columns: dict[str, str], how: str = "left") -> DataFrame:
        """Join properties of a tag to the vertex in column ``vid``: ``columns`` maps properties to new names."""
        t = self.tag(tag)
        missing = [c for c in columns if c not in t.columns]
        if missing:
            raise SemanticError(f"tag {tag} has no property {missing[0]}")
        t = t.select(F.col("_vid").alias("__vid"), *(F.col(c).alias(n) for c, n in columns.items()))
        return rows.join(t, rows[vid].eqNullSafe(t["__vid"]) if how == "null_safe" else rows[vid] == t["__vid"], "left" if how == "null_safe" else how).drop("__vid")

    def vertex_values(self, rows: DataFrame, vid: str, out: str) -> DataFrame:
        """Whole vertices as ``struct<_vid, _tags: map<tag, map<property, text>>>``, existing or not."""
        tags = None
        for name in self.tags:
            t = self.tag(name)
            props = [c for p in t.columns[1:] for c in (F.lit(p), F.col(p).cast("string"))]
            one = t.select("_vid", F.struct(F.lit(name).alias("key"), (F.create_map(*props) if props else F.create_map().cast("map<string,string>")).alias("value")).alias("t"))
            tags = one if tags is None else tags.union(one)
        tags = tags.join(rows.select(F.col(vid).alias("_vid")).distinct(), "_vid", "left_semi")
        # a vertex has one row for each tag: the list is bounded by the number of tags
        full = tags.groupBy("_vid").agg(F.map_from_entries(F.collect_list("t")).alias("__tags")).withColumnRenamed("_vid", "__v")
        empty = F.create_map().cast("map<string,map<string,string>>")
        joined = rows.join(full, rows[vid] == full["__v"], "left")
        return joined.withColumn(out, F.struct(F.col(vid).alias("_vid"), F.coalesce("__tags", empty).alias("_tags"))).drop("__v", "__tags")

    def path_values(self, paths: DataFrame, nodes: str = "_nodes") -> DataFrame:
        """Paths whose nodes are whole vertices instead of ids, in the same order. A path's rows meet by the path itself."""
        keys = [c for c in paths.columns if c != nodes]
        long = paths.select(F.struct(nodes, *keys).alias("__k"), F.posexplode(nodes).alias("__at", "__id"))
        full = self.vertex_values(long, "__id", "__w")
        by_place = F.array_sort(F.collect_list(F.struct("__at", "__w")), lambda a, b: a["__at"] - b["__at"])
        out = full.groupBy("__k").agg(F.transform(by_place, lambda x: x["__w"]).alias("__nodes"))
        return out.select(*(F.col(f"__k.`{c}`").alias(c) for c in keys), F.col("__nodes").alias(nodes))
