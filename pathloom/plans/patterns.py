"""Pattern queries: MATCH, OPTIONAL MATCH, UNWIND, WITH, RETURN.

A row holds a vertex variable as its id, an edge variable as one edge value (a list of them for variable length) and other
variables as values. Tags are joined only for properties that are used, vertices are read whole only where they are
returned, and conditions on one variable are applied where that variable is bound, before further hops.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom import values as V
from pathloom.operators import joins, paths, relational, traverse
from pathloom.operators.traverse import OPEN_END
from pathloom.operators.aggregate import aggregate
from pathloom.plans.ast import Column, Edge, Expr, Node, Pattern
from pathloom.plans.expressions import Scope, compile_expr, constant, is_aggregate
from pathloom.values import SemanticError, Typed

_FLIP = {"out": "in", "in": "out", "both": "both"}
_WHOLE = {"properties", "tags", "labels", "keys"}


@dataclass
class State:
    """Rows so far and what their columns mean."""

    session: object
    df: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)  # variable -> node, edge, edges, path, value
    info: dict[str, dict] = field(default_factory=dict)  # edge variable -> kinds of its properties
    hidden: int = 0
    everything: list = field(default_factory=list)  # all expressions of the query

    @property
    def space(self):
        return self.session.space

    def fresh(self, prefix: str) -> str:
        self.hidden += 1
        return f"__{prefix}{self.hidden}"


def run(session, clauses) -> DataFrame:
    """Run the clauses of a pattern query."""
    everything = [e for c in clauses for e in _expressions(c)]
    st = State(session, everything=everything)
    for c in clauses:
        if c.kind == "match":
            _match(st, c, everything)
        elif c.kind == "unwind":
            base = st.df if st.df is not None else session.spark.range(1).select(F.lit(1).alias("__one"))
            st.df = base
            prepare(st, [c["expr"]])
            x = compile_expr(c["expr"], scope(st))
            st.df = relational.unwind(st.df, x.col, c["alias"], x.kind == "list")
            st.kinds[c["alias"]] = "value"
        else:
            _project(st, c)
    return st.df


def _expressions(c):
    if c.kind == "match":
        yield from ([c["where"]] if c["where"] is not None else [])
        for p in c["patterns"]:
            for n in (*p.nodes, *p.edges):
                yield from n.props.values()
    elif c.kind == "unwind":
        yield c["expr"]
    else:
        yield from (x.expr for x in c["columns"])
        yield from (e for e, _ in c["order"] or [])
        yield from ([c["where"]] if c["where"] is not None else [])


# -- names --------------------------------------------------------------------------
def scope(st: State) -> Scope:
    """Names of the current rows."""
    df = st.df
    types = {f.name: f.dataType for f in df.schema}
    names: dict[str, Typed] = {}
    for v, kind in st.kinds.items():
        if v not in types:
            continue
        c = F.col(f"`{v}`")
        if kind == "node":
            whole = f"__w_{v}"
            names[v] = Typed(F.col(f"`{whole}`") if whole in types else F.when(c.isNotNull(), F.struct(c.alias("_vid"))), "vertex", info=st.space.property_types())
        elif kind == "edge":
            names[v] = Typed(c, "edge", info=st.info.get(v))
        elif kind == "edges":
            names[v] = Typed(c, "list", "edge", info=st.info.get(v))
        elif kind == "path":
            names[v] = Typed(c, "path")
        else:
            names[v] = Typed(c, *V.kind_of(types[v]), info=None)

    def special(e: Expr) -> Typed | None:
        if e.op == "attr" and e.args[0].op == "attr" and e.args[0].args[0].op == "name" and st.kinds.get(e.args[0].args[0].args[0]) == "node":
            v, tag, prop = e.args[0].args[0].args[0], e.args[0].args[1], e.args[1]
            name = f"__p_{v}_{tag}_{prop}"
            if name in types:
                return Typed(F.col(f"`{name}`"), *V.kind_of(types[name]))
        if e.op == "attr" and e.args[0].op == "name" and st.kinds.get(e.args[0].args[0]) == "node":
            raise SemanticError(f"a vertex property needs its tag: {e.args[0].args[0]}.<tag>.{e.args[1]}")
        if e.op == "call" and e.args[0].lower() == "id" and e.args[1] and e.args[1][0].op == "name" and st.kinds.get(e.args[1][0].args[0]) == "node":
            v = e.args[1][0].args[0]
            return Typed(F.col(f"`{v}`"), *V.kind_of(types[v]))
        if _is_size_of_pattern(e) and f"__count_{_pattern_key(e.args[1][0].args[0])}" in types:
            return Typed(F.col(f"`__count_{_pattern_key(e.args[1][0].args[0])}`"), "int")
        if e.op == "pattern":
            name = f"__roll_{_pattern_key(e.args[0])}"
            if name in types:
                return Typed(F.col(f"`{name}`"), "list", "path")
        return None

    return Scope(names, special, st.session.parameters)


def _is_size_of_pattern(e: Expr) -> bool:
    return e.op == "call" and e.args[0].lower() == "size" and len(e.args[1]) == 1 and e.args[1][0].op == "pattern"


def _pattern_key(p: Pattern) -> str:
    import hashlib

    return hashlib.sha1(repr(p).encode()).hexdigest()[:12]


def prepare(st: State, exprs: list[Expr]) -> None:
    """Join what expressions need: tag properties of vertices, whole vertices, lists of pattern matches."""
    wanted: dict[tuple[str, str], set[str]] = {}
    whole: set[str] = set()
    patterns: dict[str, Pattern] = {}
    uses: Counter = Counter()
    for root in exprs:
        if root.op == "name" and st.kinds.get(root.args[0]) == "node":
            whole.add(root.args[0])
        for e in root.walk():
            if e.op == "attr" and e.args[0].op == "attr" and e.args[0].args[0].op == "name" and st.kinds.get(e.args[0].args[0].args[0]) == "node":
                wanted.setdefault((e.args[0].args[0].args[0], e.args[0].args[1]), set()).add(e.args[1])
            if e.op == "call" and e.args[0].lower() in _WHOLE and e.args[1] and e.args[1][0].op == "name" and st.kinds.get(e.args[1][0].args[0]) == "node":
                whole.add(e.args[1][0].args[0])
            if e.op == "call" and e.args[0].lower() in ("collect", "collect_set") and e.args[1][0].op == "name" and st.kinds.get(e.args[1][0].args[0]) == "node":
                whole.add(e.args[1][0].args[0])
            if e.op == "pattern":
                patterns[_pattern_key(e.args[0])] = e.args[0]
                uses[_pattern_key(e.args[0])] += 1
            if _is_size_of_pattern(e):
                uses[_pattern_key(e.args[1][0].args[0])] -= 1
    for (v, tag), props in wanted.items():
        need = {p: f"__p_{v}_{tag}_{p}" for p in sorted(props) if f"__p_{v}_{tag}_{p}" not in st.df.columns}
        if need:
            st.df = st.space.with_tag_columns(st.df, v, tag, need)
    for v in sorted(whole):
        if f"__w_{v}" not in st.df.columns:
            st.df = st.space.vertex_values(st.df, v, f"__w_{v}").withColumn(f"__w_{v}", F.when(F.col(f"`{v}`").isNotNull(), F.col(f"`__w_{v}`")))
    for key, p in patterns.items():
        if not uses[key]:
            # only the number of matches is asked for: they are counted and never listed
            if f"__count_{key}" not in st.df.columns:
                matches, shared = _pattern_matches(st, p)
                st.df = joins.rollup_count(st.df, matches.select(*shared) if shared else matches.select(F.lit(1).alias("__one")), f"__count_{key}")
        elif f"__roll_{key}" not in st.df.columns:
            matches, shared = _pattern_matches(st, p, with_path=True)
            st.df = joins.rollup_apply(st.df, matches.select(*shared, "__path"), "__path", f"__roll_{key}")


# -- MATCH --------------------------------------------------------------------------
def _conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return _conjuncts(e.args[0]) + _conjuncts(e.args[1]) if e.op == "and" else [e]


def _names(e: Expr) -> set[str]:
    out: set[str] = set()
    for x in e.walk():
        if x.op == "name":
            out.add(x.args[0])
        if x.op == "pattern":
            out |= {n.alias for n in (*x.args[0].nodes, *x.args[0].edges) if n.alias}
    return out


def _match(st: State, c, everything: list[Expr]) -> None:
    conds = _conjuncts(c["where"])
    if c["optional"]:
        base = st.df
        shared = [n.alias for p in c["patterns"] for n in p.nodes if n.alias in st.kinds]
        shared = list(dict.fromkeys(shared))
        inner = State(st.session, base.select(*shared).distinct() if shared else None, {k: v for k, v in st.kinds.items() if k in shared}, dict(st.info), st.hidden + 1000, st.everything)
        _bind(inner, c["patterns"], conds, everything)
        new = {k: v for k, v in inner.kinds.items() if k not in st.kinds}
        read = [x for x in inner.df.columns if any(x.startswith(f"__p_{v}_") for v in new)]
        right = inner.df.select(*shared, *new, *read)
        st.df = joins.join(base, right, [(s, s) for s in shared], "left") if shared else base.join(right, F.lit(True), "left")
        st.kinds |= new
        st.info |= {k: v for k, v in inner.info.items() if k in new}
        st.hidden = inner.hidden
        return
    _bind(st, c["patterns"], conds, everything)


def _bind(st: State, patterns: list[Pattern], conds: list[Expr], everything: list[Expr]) -> None:
    left = list(conds)
    for p in patterns:
        _pattern(st, p, left, everything)
    _apply(st, left, final=True)


def _apply(st: State, conds: list[Expr], final: bool = False) -> None:
    """Apply the conditions whose variables are all bound, and take them off the list."""
    ready = [e for e in conds if final or (_names(e) <= set(st.kinds) and not any(x.op == "pattern" for x in e.walk()))]
    for e in ready:
        conds.remove(e)
        inner = e.args[0] if e.op == "not" else e
        if inner.op == "pattern":
            matches, shared = _pattern_matches(st, inner.args[0])
            st.df = joins.pattern_apply(st.df, matches.select(*shared) if shared else matches, e.op == "not")
            continue
        prepare(st, [e])
        st.df = relational.where(st.df, compile_expr(e, scope(st)).col)


def _pattern_matches(st: State, p: Pattern, with_path: bool = False) -> tuple[DataFrame, list[str]]:
    """Matches of a pattern from the current rows' vertices: shared variables (and the path)."""
    shared = list(dict.fromkeys(n.alias for n in p.nodes if n.alias in st.kinds))
    for n in p.nodes:
        if n.alias and n.alias not in st.kinds:
            raise SemanticError(f"a pattern in an expression may not bind new names: {n.alias}")
    inner = State(st.session, st.df.select(*shared).distinct() if shared else None, {k: st.kinds[k] for k in shared}, {}, st.hidden + 500)
    alias = "__path" if with_path else None
    _pattern(inner, Pattern(p.nodes, p.edges, alias, p.shortest), [], [])
    return inner.df, shared


def _rank(st: State, n: Node, conds: list[Expr]) -> int:
    """How selective a start is: bound, then known by id, by property, by tag."""
    if n.alias in st.kinds:
        return 0
    mine = [e for e in conds if n.alias and _names(e) == {n.alias}]
    if any(x.op == "call" and x.args[0].lower() == "id" for e in mine for x in e.walk()):
        return 1
    return 2 if n.props else 3 if mine else 4 if n.labels else 5


def _start(st: State, n: Node, alias: str, conds: list[Expr]) -> None:
    """Bind a node that begins a pattern."""
    space = st.space
    if n.labels:
        tag = n.labels[0]
        df = space.tag(tag).select(F.col("_vid").alias(alias), *_tag_columns(st, n, alias, tag))
        extra = n.labels[1:]
    else:
        df, extra = space.vertices().select(F.col("_vid").alias(alias)), []
    inner = State(st.session, df, {alias: "node"}, {}, st.hidden, st.everything)
    for label in extra:
        inner.df = inner.df.join(space.tag(label).select(F.col("_vid").alias("__l")), F.col(f"`{alias}`") == F.col("__l"), "left_semi")
    _node_props(inner, n, alias)
    _apply(inner, conds)
    st.df = inner.df if st.df is None else joins.cross(st.df, inner.df)
    st.kinds[alias] = "node"


def _node_props(st: State, n: Node, alias: str) -> None:
    for prop, value in n.props.items():
        tags = n.labels or [t for t in st.space.tags if prop in st.space.tags[t].columns]
        tag = next((t for t in tags if prop in st.space.tags[t].columns), None)
        if tag is None:
            raise SemanticError(f"no tag of the pattern has a property {prop}")
        e = Expr("==", (Expr("attr", (Expr("attr", (Expr("name", (alias,)), tag)), prop)), value))
        prepare(st, [e])
        st.df = relational.where(st.df, compile_expr(e, scope(st)).col)


def _bound_node(st: State, n: Node, alias: str, conds: list[Expr], again: bool) -> None:
    """Labels, properties and conditions of a node that a hop has reached."""
    if not again:
        st.kinds[alias] = "node"
    for label in n.labels:
        # one join checks the tag and brings the properties that any expression uses
        cols = [c for c, name in zip(_tag_columns(st, n, alias, label), _tag_names(st, n, alias, label), strict=True) if name not in st.df.columns]
        tag = st.space.tag(label).select(F.col("_vid").alias("__l"), *cols)
        st.df = st.df.join(tag, F.col(f"`{alias}`") == F.col("__l"), "inner" if cols else "left_semi").drop("__l")
    _node_props(st, n, alias)
    _apply(st, conds)


def _used(st: State, n: Node, alias: str, tag: str) -> list[str]:
    """Properties of a tag that the pattern's map or any expression reads from a vertex."""
    have = st.space.tags[tag].columns if tag in st.space.tags else []
    out = {p for p in n.props if p in have}
    for root in st.everything:
        for e in root.walk():
            if e.op == "attr" and e.args[0] == Expr("attr", (Expr("name", (alias,)), tag)) and e.args[1] in have:
                out.add(e.args[1])
    return sorted(out - {"_vid"})


def _tag_names(st: State, n: Node, alias: str, tag: str) -> list[str]:
    return [f"__p_{alias}_{tag}_{p}" for p in _used(st, n, alias, tag)]


def _tag_columns(st: State, n: Node, alias: str, tag: str) -> list:
    return [F.col(f"`{p}`").alias(name) for p, name in zip(_used(st, n, alias, tag), _tag_names(st, n, alias, tag), strict=True)]


def _pattern(st: State, p: Pattern, conds: list[Expr], everything: list[Expr]) -> None:
    aliases = [n.alias or st.fresh("n") for n in p.nodes]
    if p.shortest:
        _shortest(st, p, aliases, conds)
        return
    names = [e.alias or st.fresh("e") for e in p.edges]
    begin = min(range(len(p.nodes)), key=lambda k: (_rank(st, p.nodes[k], conds), k))
    first = p.nodes[begin]
    from_edges = _rank(st, first, conds) == 5 and bool(p.edges) and not p.edges[0].variable and len(set(aliases)) == len(aliases)
    if from_edges:
        # nothing narrows any vertex: the edge table itself is the start
        begin = 0
        st.kinds[aliases[0]] = "node"
    elif aliases[begin] in st.kinds:
        _bound_node(st, first, aliases[begin], conds, again=True)
    else:
        _start(st, first, aliases[begin], conds)
    whole = p.alias is not None
    used: list[tuple[str, bool]] = []
    between: dict[int, str] = {}
    props = sorted({c for e in p.edges for t in st.space.edge_types(e.types) for c in st.space.edges[t].columns[3:]}) if whole else None
    for k in list(range(begin, len(p.edges))) + list(range(begin - 1, -1, -1)):
        right = k >= begin
        here, there = (k, k + 1) if right else (k + 1, k)
        e = p.edges[k]
        nodes_col = st.fresh("m") if whole and e.variable else None
        if from_edges and k == 0:
            _edge_scan(st, e, names[0], aliases, props, everything)
        else:
            _hop(st, e, names[k], aliases[here], aliases[there], right, used, props, nodes_col, everything)
        if nodes_col:
            between[k] = nodes_col
            if not right:
                st.df = st.df.withColumn(names[k], F.reverse(names[k])).withColumn(nodes_col, F.reverse(nodes_col))
        elif not right and e.variable:
            st.df = st.df.withColumn(names[k], F.reverse(names[k]))
        used.append((names[k], e.variable))
        st.kinds[names[k]] = "edges" if e.variable else "edge"
        again = aliases[there] in st.kinds
        if not again and there in (0, len(p.nodes) - 1):
            _existing(st, p.nodes[there], aliases[there])
        if from_edges and k == 0:
            _existing(st, first, aliases[0])
        _bound_node(st, p.nodes[there], aliases[there], conds, again)
    if whole:
        def vertex(c):
            return F.struct(F.col(f"`{c}`").alias("_vid"))

        nodes, rels = F.array(vertex(aliases[0])), None
        for k, e in enumerate(p.edges):
            one = F.col(f"`{names[k]}`") if e.variable else F.array(F.col(f"`{names[k]}`"))
            rels = one if rels is None else F.concat(rels, one)
            if e.variable:
                # an edge list of length 0 ends where it began
                nodes = F.concat(nodes, F.transform(between[k], lambda v: F.struct(v.alias("_vid"))), F.when(F.size(names[k]) > 0, F.array(vertex(aliases[k + 1]))).otherwise(F.slice(nodes, 1, 0)))
            else:
                nodes = F.concat(nodes, F.array(vertex(aliases[k + 1])))
        if rels is None:
            rels = F.array().cast("array<struct<_type:string,_src:string,_dst:string,_rank:bigint,_dir:int>>")
        st.df = st.df.withColumn(p.alias, F.struct(nodes.alias("_nodes"), rels.alias("_rels")))
        st.kinds[p.alias] = "path"
        _apply(st, conds)


def _existing(st: State, n: Node, alias: str) -> None:
    """Drop rows in which a pattern ends at an id without a vertex; labels and properties tell that by themselves."""
    if not n.labels and not n.props and not st.space.options.get("closed"):
        st.df = traverse.append_vertices(st.space.vertex_rows(), st.df, alias)


def _edge_props(st: State, e: Edge, types: list[str], everything: list[Expr]) -> list[str]:
    """Properties of an edge variable that any expression reads; all if it is used as a whole or inside a list."""
    have = list(dict.fromkeys(c for t in types for c in st.space.edges[t].columns[3:]))
    if e.alias is None:
        return []
    if e.variable:
        used = {x.args[1] for r in everything for x in r.walk() if x.op == "attr"}
        if any(x == Expr("name", (e.alias,)) for r in everything for x in [r]):
            return have
        return [c for c in have if c in used]
    direct, total = set(), 0
    inside = 0
    for r in everything:
        for x in r.walk():
            if x == Expr("name", (e.alias,)):
                total += 1
            if x.op == "attr" and x.args[0] == Expr("name", (e.alias,)):
                direct.add(x.args[1])
                inside += 1
            if x.op == "call" and x.args[0].lower() in ("src", "dst", "rank", "type", "count", "id", "startnode", "endnode", "typeid") and x.args[1] and x.args[1][0] == Expr("name", (e.alias,)):
                inside += 1
    return have if total > inside else [c for c in have if c in direct]


def _view(st: State, e: Edge, direction: str, right: bool, props, everything) -> tuple[DataFrame, list[str], object]:
    """Edge view of a pattern edge, the properties its values hold, and the condition of its property map."""
    types = st.space.edge_types(e.types)
    wanted = props if props is not None else _edge_props(st, e, types, everything)
    view = st.space.edge_view(types, direction, list(dict.fromkeys([*wanted, *e.props])))
    if not right:
        # the value of an edge tells how it is walked from left to right
        view = view.withColumn("_dir", -F.col("_dir"))
    cond = None
    for prop, value in e.props.items():
        test = F.col(f"`{prop}`") == compile_expr(value, Scope(parameters=st.session.parameters)).col
        cond = test if cond is None else cond & test
    if e.alias is not None and any(x.op == "call" and x.args[0].lower() in ("properties", "keys") and x.args[1] and x.args[1][0] == Expr("name", (e.alias,)) for r in everything for x in r.walk()):
        pairs = [x for c in wanted for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        view = view.withColumn("_props", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>"))
        wanted = [*wanted, "_props"]
    return view, wanted, cond


def _edge_scan(st: State, e: Edge, name: str, aliases: list[str], props, everything) -> None:
    """Bind the first edge of a pattern and both its ends from the edge table alone."""
    view, wanted, cond = _view(st, e, e.direction, True, props, everything)
    view = view if cond is None else view.where(cond)
    df = view.select(F.col("_from").alias(aliases[0]), F.col("_to").alias(aliases[1]), traverse.edge_struct(wanted).alias(name))
    st.df = df if st.df is None else joins.cross(st.df, df)
    st.info[name] = {f.name: V.kind_of(f.dataType)[0] for f in view.schema if f.name in wanted}


def _hop(st: State, e: Edge, name: str, here: str, there: str, right: bool, used, props, nodes_col, everything) -> None:
    view, wanted, cond = _view(st, e, e.direction if right else _FLIP[e.direction], right, props, everything)
    least, most = (e.least, e.most if e.most is not None else OPEN_END) if e.variable else (1, 1)
    st.df = traverse.traverse(view, st.df, here, there, name, least, most, list(used), wanted, not e.variable, cond, into=there in st.kinds, nodes_col=nodes_col)
    st.info[name] = {f.name: V.kind_of(f.dataType)[0] for f in view.schema if f.name in wanted}


def _shortest(st: State, p: Pattern, aliases: list[str], conds: list[Expr]) -> None:
    if len(p.edges) != 1:
        raise SemanticError("a shortest path pattern has one edge")
    e = p.edges[0]
    sides, before = [], st.df
    apart = aliases[0] != aliases[1] and not any(a in st.kinds for a in aliases)
    for n, alias in zip(p.nodes, aliases, strict=True):
        if apart:
            # both ends are new: each is found by itself, and only pairs with a path between them ever meet
            st.df = None
        if alias in st.kinds:
            _bound_node(st, n, alias, conds, again=True)
        else:
            _start(st, n, alias, conds)
        sides.append(st.df)
        if apart:
            del st.kinds[alias]
    for alias in aliases:
        st.kinds[alias] = "node"
    types = st.space.edge_types(e.types)
    view = st.space.edge_view(types, e.direction, [])
    least, most = (e.least, e.most if e.most is not None else OPEN_END) if e.variable else (1, 1)
    found = paths.shortest_paths(view, sides[0] if apart else st.df, sides[1] if apart else st.df, most, aliases[0], aliases[1], single=p.shortest == "single", least=max(least, 1))
    out = p.alias or st.fresh("p")
    found = found.select(F.col("_start").alias("__a"), F.col("_end").alias("__b"), F.struct(F.transform("_nodes", lambda v: F.struct(v.alias("_vid"))).alias("_nodes"), F.col("_rels")).alias(out))
    if apart:
        pairs = sides[0].join(found, F.col(f"`{aliases[0]}`") == F.col("__a")).join(sides[1], F.col(f"`{aliases[1]}`") == F.col("__b")).drop("__a", "__b")
        st.df = pairs if before is None else joins.cross(before, pairs)
    else:
        st.df = st.df.join(found, (F.col(f"`{aliases[0]}`") == F.col("__a")) & (F.col(f"`{aliases[1]}`") == F.col("__b"))).drop("__a", "__b")
    st.kinds[out] = "path"
    if e.alias:
        st.df = st.df.withColumn(e.alias, F.col(f"`{out}`")["_rels"])
        st.kinds[e.alias] = "edges"
    _apply(st, conds)


# -- WITH and RETURN --------------------------------------------------------------------
def _project(st: State, c) -> None:
    session = st.session
    if st.df is None:
        st.df = session.spark.range(1).select(F.lit(1).alias("__one"))
    columns: list[Column] = []
    for x in c["columns"]:
        columns += [Column(Expr("name", (v,)), v) for v in st.kinds if not v.startswith("__")] if x.expr.op == "star" else [x]
    names = [x.alias for x in columns]
    if len(set(names)) < len(names):
        raise SemanticError(f"duplicate column names: {names}")
    last = c.kind == "return"
    aliases = dict(zip(names, (x.expr for x in columns), strict=True))
    factors, extra = [], {}
    for n, (e, d) in enumerate(c["order"] or []):
        if e.op == "name" and e.args[0] in aliases:
            factors.append((e.args[0], d))
        elif e in aliases.values():
            factors.append((next(a for a, x in aliases.items() if x == e), d))
        else:
            extra[f"__o{n}"] = e
            factors.append((f"__o{n}", d))

    def carried(x: Column) -> bool:
        return not last and x.expr.op == "name" and x.expr.args[0] in st.kinds

    prepare(st, [x.expr for x in columns if not carried(x)] + list(extra.values()))
    s = scope(st)

    def value(x: Column):
        return F.col(f"`{x.expr.args[0]}`") if carried(x) else compile_expr(x.expr, s).col

    compiled = {x.alias: value(x) for x in columns}
    compiled_extra = {n: compile_expr(e, s).col for n, e in extra.items()}
    grouped = any(is_aggregate(x.expr) for x in columns)
    if grouped:
        keys = {x.alias: compiled[x.alias] for x in columns if not is_aggregate(x.expr)}
        items = {x.alias: compiled[x.alias] for x in columns if is_aggregate(x.expr)}
        df = aggregate(st.df, keys, items | {n: v for n, v in compiled_extra.items() if is_aggregate(extra[n])})
        lost = [n for n in extra if not is_aggregate(extra[n])]
        if lost:
            raise SemanticError("ORDER BY after grouping needs a returned column")
        df = df.select(*(F.col(f"`{n}`") for n in (*names, *extra)))
    else:
        df = relational.project(st.df, compiled | compiled_extra)
    if c["distinct"]:
        if extra:
            raise SemanticError("ORDER BY after DISTINCT needs a returned column")
        df = df.distinct()
    if factors:
        df = relational.sort(df, factors)
    skip = constant(c["skip"], session.parameters) if c["skip"] is not None else 0
    if c["limit"] is not None:
        df = relational.limit(df, constant(c["limit"], session.parameters), skip)
    elif skip:
        df = df.offset(skip)
    df = df.drop(*extra) if extra else df
    kinds = {x.alias: (st.kinds[x.expr.args[0]] if carried(x) else "value") for x in columns}
    info = {x.alias: st.info[x.expr.args[0]] for x in columns if carried(x) and x.expr.args[0] in st.info}
    st.df, st.kinds, st.info = df, kinds, info
    if not last and c["where"] is not None:
        _apply(st, _conjuncts(c["where"]), final=True)
