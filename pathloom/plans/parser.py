"""Recursive-descent parser of the statement language (a pipe-able traversal dialect and a pattern dialect)."""

from __future__ import annotations

from pathloom.plans.ast import Column, Edge, Expr, Node, Pattern, Statement
from pathloom.plans.lexer import SyntaxProblem, Token, tokenize

_CLAUSE = {
    "WHERE", "YIELD", "OVER", "FROM", "TO", "RETURN", "WITH", "ORDER", "LIMIT", "SKIP", "OFFSET", "UNION", "INTERSECT", "MINUS", "MATCH", "OPTIONAL", "UNWIND", "AS", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "XOR", "NOT",
    "IN", "CONTAINS", "STARTS", "ENDS", "IS", "ASC", "DESC", "ASCENDING", "DESCENDING", "UPTO", "BY", "REVERSELY", "BIDIRECT", "SAMPLE", "GROUP", "SET", "BOTH", "OUT", "STEPS",
}


def parse(text: str) -> list[Statement]:
    """All statements of a text."""
    p = Parser(tokenize(text))
    out = []
    while not p.ended():
        if p.accept(";"):
            continue
        out.append(p.sentence())
        if not p.ended():
            p.expect(";")
    return out


def parse_expression(text: str) -> Expr:
    """One expression."""
    p = Parser(tokenize(text))
    e = p.expression()
    if not p.ended():
        p.fail()
    return e


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # -- token access -----------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def ended(self) -> bool:
        return self.now.kind == "end"

    def fail(self, wanted: str = ""):
        raise SyntaxProblem(f"unexpected {self.now.text or 'end'!r} at {self.now.at}" + (f", expected {wanted}" if wanted else ""))

    def accept(self, *texts: str) -> bool:
        """Take the given operators or keywords if all of them come next."""
        for k, t in enumerate(texts):
            x = self.peek(k)
            if not ((x.kind == "op" and x.text == t) or (x.kind == "word" and x.upper == t)):
                return False
        self.at += len(texts)
        return True

    def expect(self, *texts: str) -> None:
        if not self.accept(*texts):
            self.fail(" ".join(texts))

    def sees(self, *texts: str) -> bool:
        at = self.at
        ok = self.accept(*texts)
        self.at = at
        return ok

    def name(self) -> str:
        t = self.now
        if t.kind not in ("word", "name"):
            self.fail("a name")
        self.at += 1
        return str(t.value)

    def integer(self) -> int:
        t = self.now
        if t.kind != "number" or not isinstance(t.value, int):
            self.fail("an integer")
        self.at += 1
        return t.value

    # -- sentences ----------------------------------------------------------------
    def sentence(self) -> Statement:
        """An optional assignment of a set operation over pipes."""
        for word in ("EXPLAIN", "PROFILE"):
            if self.accept(word):
                style = "row"
                if self.accept("FORMAT", "="):
                    style = str(self.now.value)
                    self.at += 1
                if self.accept("{"):
                    inner = self.sentence()
                    self.accept(";")
                    self.expect("}")
                else:
                    inner = self.sentence()
                return Statement("explain", {"of": inner, "format": style, "profile": word == "PROFILE"})
        if self.now.text == "$" and self.peek(1).kind == "word" and self.peek(2).text == "=":
            self.at += 1
            name = self.name()
            self.expect("=")
            return Statement("assign", {"name": name, "of": self.set_operation()})
        return self.set_operation()

    def set_operation(self) -> Statement:
        left = self.piped()
        while True:
            if self.accept("UNION", "ALL"):
                kind = "union_all"
            elif self.accept("UNION"):
                self.accept("DISTINCT")
                kind = "union"
            elif self.accept("INTERSECT"):
                kind = "intersect"
            elif self.accept("MINUS"):
                kind = "minus"
            else:
                return left
            left = Statement("set", {"op": kind, "left": left, "right": self.piped()})

    def piped(self) -> Statement:
        left = self.basic()
        while self.accept("|"):
            left = Statement("pipe", {"left": left, "right": self.basic()})
        return left

    def basic(self) -> Statement:
        if self.accept("("):
            inner = self.set_operation()
            self.expect(")")
            return inner
        word = self.now.upper
        method = getattr(self, f"s_{word.lower()}", None) if word else None
        if method is None:
            self.fail("a statement")
        return method()

    # -- shared clauses -------------------------------------------------------------
    def yields(self) -> dict:
        distinct = self.accept("DISTINCT")
        return {"distinct": distinct, "columns": self.columns()}

    def columns(self) -> list[Column]:
        out = [self.column()]
        while self.accept(","):
            out.append(self.column())
        return out

    def column(self) -> Column:
        start = self.at
        if self.accept("*"):
            return Column(Expr("star"), "*")
        if self.now.text == "$-" and self.peek(1).text == "." and self.peek(2).text == "*":
            self.at += 3
            return Column(Expr("star"), "*")
        e = self.expression()
        text = "".join(self._spaced(start, self.at))
        alias = self.name() if self.accept("AS") else text
        return Column(e, alias)

    def _spaced(self, a: int, b: int):
        for k in range(a, b):
            t = self.tokens[k]
            if k > a and t.at > self.tokens[k - 1].at + len(self.tokens[k - 1].text):
                yield " "
            yield str(t.value) if t.kind == "name" else t.text

    def optional_where(self) -> Expr | None:
        return self.expression() if self.accept("WHERE") else None

    def optional_yield(self) -> dict | None:
        return self.yields() if self.accept("YIELD") else None

    def names(self) -> list[str]:
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        return out

    def vids(self) -> list[Expr]:
        out = [self.expression()]
        while self.accept(","):
            out.append(self.expression())
        return out

    def over(self) -> dict:
        types = None if self.accept("*") else self.names()
        direction = "in" if self.accept("REVERSELY") else "both" if self.accept("BIDIRECT") else "out"
        return {"types": types, "direction": direction}

    def order_by(self) -> list[tuple[Expr, bool]]:
        out = []
        while True:
            e = self.expression()
            descending = self.accept("DESC") or self.accept("DESCENDING")
            if not descending:
                self.accept("ASC") or self.accept("ASCENDING")
            out.append((e, descending))
            if not self.accept(","):
                return out

    def numbers(self) -> list[int]:
        self.expect("[")
        out = [self.integer()]
        while self.accept(","):
            out.append(self.integer())
        self.expect("]")
        return out

    # -- traversal dialect -------------------------------------------------------------
    def s_go(self) -> Statement:
        self.expect("GO")
        first = last = 1
        if self.now.kind == "number":
            first = last = self.integer()
            if self.accept("TO"):
                last = self.integer()
            self.accept("STEPS") or self.expect("STEP")
        self.expect("FROM")
        p = {"first": first, "last": last, "from": self.vids()}
        self.expect("OVER")
        p |= {"over": self.over(), "where": self.optional_where(), "yield": self.optional_yield()}
        if self.sees("LIMIT", "["):
            self.at += 1
            p["limits"] = self.numbers()
        elif self.sees("SAMPLE", "["):
            self.at += 1
            p["samples"] = self.numbers()
        return Statement("go", p)

    def s_lookup(self) -> Statement:
        self.expect("LOOKUP", "ON")
        return Statement("lookup", {"on": self.name(), "where": self.optional_where(), "yield": self.optional_yield()})

    def s_fetch(self) -> Statement:
        self.expect("FETCH", "PROP", "ON")
        names = ["*"] if self.accept("*") else self.names()
        first = self.expression(no_arrow=True)
        if self.accept("->"):
            keys = [self._edge_key(first)]
            while self.accept(","):
                src = self.expression(no_arrow=True)
                self.expect("->")
                keys.append(self._edge_key(src))
            return Statement("fetch_edges", {"on": names, "keys": keys, "yield": self.optional_yield()})
        vids = [first]
        while self.accept(","):
            vids.append(self.expression())
        return Statement("fetch_vertices", {"on": names, "from": vids, "yield": self.optional_yield()})

    def _edge_key(self, src: Expr) -> tuple:
        dst = self.expression(no_arrow=True)
        return src, dst, self.expression(no_arrow=True) if self.accept("@") else Expr("lit", (0,))

    def s_find(self) -> Statement:
        self.expect("FIND")
        single = self.accept("SINGLE")
        kind = "shortest" if self.accept("SHORTEST") else "all" if self.accept("ALL") else "noloop" if self.accept("NOLOOP") else self.fail("a kind of path")
        self.expect("PATH")
        props = self.accept("WITH", "PROP")
        self.expect("FROM")
        src = self.vids()
        self.expect("TO")
        dst = self.vids()
        self.expect("OVER")
        p = {"kind": kind, "single": single, "props": props, "from": src, "to": dst, "over": self.over(), "where": self.optional_where(), "steps": 5}
        if self.accept("UPTO"):
            p["steps"] = self.integer()
            self.accept("STEPS") or self.expect("STEP")
        p["yield"] = self.optional_yield()
        return Statement("find_path", p)

    def s_get(self) -> Statement:
        self.expect("GET", "SUBGRAPH")
        p: dict = {"props": self.accept("WITH", "PROP"), "steps": 1, "in": None, "out": None, "both": None}
        if self.now.kind == "number":
            p["steps"] = self.integer()
            self.accept("STEPS") or self.expect("STEP")
        self.expect("FROM")
        p["from"] = self.vids()
        for word in ("IN", "OUT", "BOTH"):
            if self.accept(word):
                p[word.lower()] = self.names()
        p |= {"where": self.optional_where(), "yield": self.optional_yield()}
        return Statement("subgraph", p)

    def s_yield(self) -> Statement:
        self.expect("YIELD")
        p = self.yields()
        if self.accept("FROM"):
            # YIELD … FROM $a INNER JOIN $b ON $a.x == $b.y
            self.expect("$")
            left = self.name()
            how = "inner"
            for word, kind in (("INNER", "inner"), ("LEFT", "left"), ("SEMI", "left_semi"), ("ANTI", "left_anti")):
                if self.accept(word):
                    how = kind
            self.expect("JOIN")
            self.expect("$")
            right = self.name()
            self.expect("ON")
            return Statement("yield_join", p | {"left": left, "right": right, "how": how, "on": self.expression()})
        return Statement("yield", p | {"where": self.optional_where()})

    def s_group(self) -> Statement:
        self.expect("GROUP", "BY")
        keys = [self.expression()]
        while self.accept(","):
            keys.append(self.expression())
        self.expect("YIELD")
        return Statement("group", {"keys": keys, "yield": self.yields()})

    def s_order(self) -> Statement:
        self.expect("ORDER", "BY")
        return Statement("order", {"factors": self.order_by()})

    def s_limit(self) -> Statement:
        self.expect("LIMIT")
        a = self.integer()
        if self.accept(","):
            return Statement("limit", {"offset": a, "count": self.integer()})
        return Statement("limit", {"offset": self.integer() if self.accept("OFFSET") else 0, "count": a})

    def s_offset(self) -> Statement:
        self.expect("OFFSET")
        return Statement("limit", {"offset": self.integer(), "count": None})

    def s_sample(self) -> Statement:
        self.expect("SAMPLE")
        return Statement("sample", {"count": self.integer()})

    # -- pattern dialect ---------------------------------------------------------------
    def s_match(self) -> Statement:
        return self.cypher()

    s_optional = s_with = s_return = s_match

    def s_unwind(self) -> Statement:
        at = self.at
        self.expect("UNWIND")
        e = self.expression()
        self.expect("AS")
        alias = self.name()
        if self.now.upper in ("MATCH", "OPTIONAL", "WITH", "RETURN", "UNWIND"):
            self.at = at
            return self.cypher()
        return Statement("unwind", {"expr": e, "alias": alias})

    def cypher(self) -> Statement:
        clauses = []
        while True:
            if self.sees("MATCH") or self.sees("OPTIONAL", "MATCH"):
                optional = self.accept("OPTIONAL")
                self.expect("MATCH")
                patterns = [self.pattern()]
                while self.accept(","):
                    patterns.append(self.pattern())
                clauses.append(Statement("match", {"optional": optional, "patterns": patterns, "where": self.optional_where()}))
            elif self.accept("UNWIND"):
                e = self.expression()
                self.expect("AS")
                clauses.append(Statement("unwind", {"expr": e, "alias": self.name()}))
            elif self.sees("WITH") or self.sees("RETURN"):
                kind = self.now.upper.lower()
                self.at += 1
                p = self.yields()
                if self.accept("ORDER", "BY"):
                    p["order"] = self.order_by()
                if self.accept("SKIP") or self.accept("OFFSET"):
                    p["skip"] = self.expression()
                if self.accept("LIMIT"):
                    p["limit"] = self.expression()
                if kind == "with":
                    p["where"] = self.optional_where()
                clauses.append(Statement(kind, p))
                if kind == "return":
                    return Statement("cypher", {"clauses": clauses})
            else:
                self.fail("a clause of a pattern query")

    def pattern(self) -> Pattern:
        alias = None
        if self.now.kind in ("word", "name") and self.peek(1).text == "=":
            alias = self.name()
            self.expect("=")
        for word, kind in (("SHORTESTPATH", "single"), ("ALLSHORTESTPATHS", "all")):
            if self.now.upper == word and self.peek(1).text == "(":
                self.at += 2
                p = self.chain()
                self.expect(")")
                return Pattern(p.nodes, p.edges, alias, kind)
        p = self.chain()
        p.alias = alias
        return p

    def chain(self) -> Pattern:
        nodes, edges = [self.node()], []
        while self.now.text in ("-", "<-", "->", "<") and self.now.kind == "op":
            edges.append(self.edge())
            nodes.append(self.node())
        return Pattern(nodes, edges)

    def node(self) -> Node:
        self.expect("(")
        alias = self.name() if self.now.kind in ("word", "name") else None
        labels = []
        while self.accept(":"):
            labels.append(self.name())
        props = self.property_map() if self.sees("{") else {}
        self.expect(")")
        return Node(alias, labels, props)

    def property_map(self) -> dict[str, Expr]:
        self.expect("{")
        out: dict[str, Expr] = {}
        while not self.accept("}"):
            if out:
                self.expect(",")
            key = self.name()
            self.expect(":")
            out[key] = self.expression()
        return out

    def edge(self) -> Edge:
        back = self.accept("<-")
        if not back:
            self.expect("-")
        alias, types, least, most, props = None, [], None, None, {}
        if self.accept("["):
            if self.now.kind in ("word", "name"):
                alias = self.name()
            if self.accept(":"):
                types.append(self.name())
                while self.accept("|"):
                    self.accept(":")
                    types.append(self.name())
            if self.accept("*"):
                least, most = 1, None
                if self.now.kind == "number":
                    least = most = self.integer()
                    if self.accept(".."):
                        most = self.integer() if self.now.kind == "number" else None
                elif self.accept(".."):
                    most = self.integer()
            if self.sees("{"):
                props = self.property_map()
            self.expect("]")
        forward = self.accept("->")
        if not forward:
            self.expect("-")
            forward = self.accept(">")
        direction = "both" if back == forward else "in" if back else "out"
        return Edge(alias, types, direction, least, most, props)

    # -- mutation ------------------------------------------------------------------------
    def s_insert(self) -> Statement:
        self.expect("INSERT")
        vertex = self.accept("VERTEX")
        if not vertex:
            self.expect("EDGE")
        keep = self.accept("IF", "NOT", "EXISTS")
        heads = [self._head()]
        while vertex and self.accept(","):
            heads.append(self._head())
        self.accept("VALUES") or self.expect("VALUE")
        rows = [self._row(vertex)]
        while self.accept(","):
            rows.append(self._row(vertex))
        return Statement("insert_vertex" if vertex else "insert_edge", {"heads": heads, "rows": rows, "keep": keep})

    def _head(self) -> tuple[str, list[str] | None]:
        name, props = self.name(), None
        if self.accept("("):
            props = [] if self.sees(")") else self.names()
            self.expect(")")
        return name, props

    def _row(self, vertex: bool):
        key: tuple = (self.expression(no_arrow=True),)
        if not vertex:
            self.expect("->")
            dst = self.expression(no_arrow=True)
            key = (*key, dst, self.expression(no_arrow=True) if self.accept("@") else Expr("lit", (0,)))
        self.expect(":")
        self.expect("(")
        values = [] if self.sees(")") else self.vids()
        self.expect(")")
        return key, values

    def s_update(self) -> Statement:
        upsert = self.accept("UPSERT")
        if not upsert:
            self.expect("UPDATE")
        vertex = self.accept("VERTEX")
        if not vertex:
            self.expect("EDGE")
        self.expect("ON")
        name = self.name()
        key: tuple = (self.expression(no_arrow=True),)
        if not vertex:
            self.expect("->")
            dst = self.expression(no_arrow=True)
            key = (*key, dst, self.expression(no_arrow=True) if self.accept("@") else Expr("lit", (0,)))
        self.expect("SET")
        sets = {}
        while True:
            prop = self.name()
            self.expect("=")
            sets[prop] = self.expression()
            if not self.accept(","):
                break
        when = self.expression() if self.accept("WHEN") else None
        return Statement("update", {"upsert": upsert, "vertex": vertex, "on": name, "key": key, "set": sets, "when": when, "yield": self.optional_yield()})

    s_upsert = s_update

    def s_delete(self) -> Statement:
        self.expect("DELETE")
        if self.accept("VERTEX"):
            vids = self.vids()
            return Statement("delete_vertex", {"from": vids, "with_edge": self.accept("WITH", "EDGE")})
        if self.accept("TAG"):
            names = ["*"] if self.accept("*") else self.names()
            self.expect("FROM")
            return Statement("delete_tag", {"on": names, "from": self.vids()})
        self.expect("EDGE")
        name, keys = self.name(), []
        while True:
            src = self.expression(no_arrow=True)
            self.expect("->")
            keys.append(self._edge_key(src))
            if not self.accept(","):
                return Statement("delete_edge", {"on": name, "keys": keys})

    # -- catalog ---------------------------------------------------------------------------
    def s_use(self) -> Statement:
        self.expect("USE")
        return Statement("use", {"name": self.name()})

    def s_create(self) -> Statement:
        self.expect("CREATE")
        if self.accept("SPACE"):
            keep = self.accept("IF", "NOT", "EXISTS")
            p: dict = {"name": self.name(), "keep": keep, "options": {}}
            if self.accept("AS"):
                return Statement("create_space", p | {"as": self.name()})
            if self.accept("("):
                while not self.accept(")"):
                    key = self.name().lower()
                    self.expect("=")
                    p["options"][key] = self._type() if key == "vid_type" else self.now.value
                    if key != "vid_type":
                        self.at += 1
                    self.accept(",")
            return Statement("create_space", p)
        fulltext = self.accept("FULLTEXT")
        kind = "tag" if self.accept("TAG") else "edge"
        if kind == "edge":
            self.expect("EDGE")
        if self.accept("INDEX"):
            keep = self.accept("IF", "NOT", "EXISTS")
            name = self.name()
            self.expect("ON")
            on = self.name()
            self.expect("(")
            fields = []
            while not self.accept(")"):
                fields.append(self.name())
                if self.accept("("):
                    fields[-1] += f"({self.integer()})"
                    self.expect(")")
                self.accept(",")
            return Statement("create_index", {"kind": kind, "name": name, "on": on, "fields": fields, "keep": keep, "fulltext": fulltext})
        keep = self.accept("IF", "NOT", "EXISTS")
        name, props = self.name(), []
        self.expect("(")
        while not self.accept(")"):
            props.append(self._property())
            self.accept(",")
        return Statement("create_schema", {"kind": kind, "name": name, "props": props, "keep": keep, "ttl": self._ttl()})

    def _ttl(self) -> dict:
        out = {}
        while self.sees("TTL_COL") or self.sees("TTL_DURATION") or self.sees("COMMENT") or self.sees(","):
            if self.accept(","):
                continue
            key = self.name().lower()
            self.expect("=")
            out[key] = self.now.value
            self.at += 1
        return out

    def _type(self) -> str:
        out = self.name().lower()
        if self.accept("("):
            out += f"({self.now.value})"
            self.at += 1
            self.expect(")")
        elif self.accept("<"):
            out += f"<{self.name().lower()}>"
            self.expect(">")
        return out

    def _property(self) -> dict:
        p: dict = {"name": self.name(), "type": self._type(), "nullable": True}
        while True:
            if self.accept("NOT", "NULL"):
                p["nullable"] = False
            elif self.accept("NULL"):
                p["nullable"] = True
            elif self.accept("DEFAULT"):
                p["default"] = self.expression()
            elif self.accept("COMMENT"):
                p["comment"] = self.now.value
                self.at += 1
            else:
                return p

    def s_alter(self) -> Statement:
        self.expect("ALTER")
        if self.accept("SPACE"):
            name, options = self.name(), {}
            while self.now.kind == "word":
                key = self.name().lower()
                self.accept("=")
                options[key] = self.now.value
                self.at += 1
            return Statement("alter_space", {"name": name, "options": options})
        kind = "tag" if self.accept("TAG") else "edge"
        if kind == "edge":
            self.expect("EDGE")
        p: dict = {"kind": kind, "name": self.name(), "changes": []}
        while self.sees("ADD") or self.sees("CHANGE") or self.sees("DROP"):
            what = self.name().lower()
            self.expect("(")
            items = []
            while not self.accept(")"):
                items.append(self.name() if what == "drop" else self._property())
                self.accept(",")
            p["changes"].append((what, items))
            self.accept(",")
        return Statement("alter_schema", p | {"ttl": self._ttl()})

    def s_drop(self) -> Statement:
        self.expect("DROP")
        fulltext = self.accept("FULLTEXT")
        if self.accept("SPACE"):
            kind = "space"
        else:
            kind = "tag" if self.accept("TAG") else "edge" if self.accept("EDGE") else ""
            if self.accept("INDEX"):
                kind = "index"
            elif not kind:
                self.fail()
        keep = self.accept("IF", "EXISTS")
        return Statement("drop", {"kind": kind, "name": self.name(), "keep": keep, "fulltext": fulltext})

    def s_clear(self) -> Statement:
        self.expect("CLEAR", "SPACE")
        keep = self.accept("IF", "EXISTS")
        return Statement("clear_space", {"name": self.name(), "keep": keep})

    def s_describe(self) -> Statement:
        self.at += 1
        kind = "space" if self.accept("SPACE") else "tag" if self.accept("TAG") else "edge"
        if kind == "edge":
            self.expect("EDGE")
        if self.accept("INDEX"):
            kind = "index"
        return Statement("describe", {"kind": kind, "name": self.name()})

    s_desc = s_describe

    def s_show(self) -> Statement:
        self.expect("SHOW")
        if self.accept("CREATE"):
            kind = "space" if self.accept("SPACE") else "tag" if self.accept("TAG") else "edge"
            if kind == "edge":
                self.expect("EDGE")
            if self.accept("INDEX"):
                kind = "index"
            return Statement("show_create", {"kind": kind, "name": self.name()})
        words = []
        while self.now.kind == "word":
            words.append(self.name().lower())
        return Statement("show", {"what": " ".join(words)})

    def s_submit(self) -> Statement:
        self.expect("SUBMIT", "JOB")
        return Statement("submit_job", {"what": self.name().lower()})

    # -- expressions ---------------------------------------------------------------------------
    def expression(self, no_arrow: bool = False) -> Expr:
        if no_arrow:
            return self.unary()
        return self.ternary()

    def ternary(self) -> Expr:
        c = self.either()
        if self.accept("?"):
            a = self.ternary()
            self.expect(":")
            return Expr("case", (None, ((c, a),), self.ternary()))
        return c

    def either(self) -> Expr:
        e = self.exclusive()
        while self.accept("OR") or self.accept("||"):
            e = Expr("or", (e, self.exclusive()))
        return e

    def exclusive(self) -> Expr:
        e = self.both()
        while self.accept("XOR"):
            e = Expr("xor", (e, self.both()))
        return e

    def both(self) -> Expr:
        e = self.negated()
        while self.accept("AND") or self.accept("&", "&"):
            e = Expr("and", (e, self.negated()))
        return e

    def negated(self) -> Expr:
        if self.accept("NOT") or self.accept("!"):
            return Expr("not", (self.negated(),))
        return self.comparison()

    def comparison(self) -> Expr:
        e = self.sum()
        while True:
            if self.now.kind == "op" and self.now.text in ("==", "!=", "<>", "<", "<=", ">", ">=", "=~", "="):
                op = {"<>": "!=", "=": "=="}.get(self.now.text, self.now.text)
                self.at += 1
                e = Expr(op, (e, self.sum()))
            elif self.accept("IN"):
                e = Expr("in", (e, self.sum()))
            elif self.accept("NOT", "IN"):
                e = Expr("not", (Expr("in", (e, self.sum())),))
            elif self.accept("IS", "NOT", "NULL") or self.accept("IS", "NOT", "EMPTY"):
                e = Expr("not", (Expr("is_null", (e,)),))
            elif self.accept("IS", "NULL") or self.accept("IS", "EMPTY"):
                e = Expr("is_null", (e,))
            else:
                negate = self.now.upper == "NOT"
                k = self.at + negate
                word = self.tokens[k].upper
                if word not in ("CONTAINS", "STARTS", "ENDS"):
                    return e
                self.at = k + 1
                if word != "CONTAINS":
                    self.expect("WITH")
                e = Expr(word.lower(), (e, self.sum()))
                e = Expr("not", (e,)) if negate else e

    def sum(self) -> Expr:
        e = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-"):
            op = self.now.text
            self.at += 1
            e = Expr(op, (e, self.product()))
        return e

    def product(self) -> Expr:
        e = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.now.text
            self.at += 1
            e = Expr(op, (e, self.unary()))
        return e

    def unary(self) -> Expr:
        if self.accept("-"):
            e = self.unary()
            if e.op == "lit" and isinstance(e.args[0], (int, float)) and not isinstance(e.args[0], bool):
                return Expr("lit", (-e.args[0],))
            return Expr("neg", (e,))
        if self.accept("+"):
            return self.unary()
        if self.now.text == "(" and self.peek(1).upper in ("INT", "FLOAT", "DOUBLE", "STRING", "BOOL") and self.peek(2).text == ")":
            kind = self.peek(1).upper.lower()
            self.at += 3
            return Expr("cast", (kind, self.unary()))
        return self.postfix(self.primary())

    def postfix(self, e: Expr) -> Expr:
        while True:
            if self.now.text == "." and self.peek(1).kind in ("word", "name"):
                self.at += 1
                e = Expr("attr", (e, self.name()))
            elif self.accept("["):
                low = None if self.sees("..") else self.expression()
                if self.accept(".."):
                    high = None if self.sees("]") else self.expression()
                    e = Expr("slice", (e, low, high))
                else:
                    e = Expr("item", (e, low))
                self.expect("]")
            else:
                return e

    def primary(self) -> Expr:
        t = self.now
        if t.kind in ("number", "string"):
            self.at += 1
            return Expr("lit", (t.value,))
        if t.text == "$-":
            self.at += 1
            self.expect(".")
            return Expr("input", (self.name(),))
        if t.text in ("$^", "$$"):
            self.at += 1
            if self.now.text == "." and self.peek(2).text == ".":
                self.at += 1
                tag = self.name()
                self.expect(".")
                return Expr("source" if t.text == "$^" else "target", (tag, self.name()))
            return Expr("source_vertex" if t.text == "$^" else "target_vertex")
        if t.text == "$":
            self.at += 1
            name = self.name()
            if self.now.text == "." and self.peek(1).kind in ("word", "name"):
                self.at += 1
                return Expr("variable", (name, self.name()))
            return Expr("parameter", (name,))
        if t.text == "(":
            at = self.at
            try:
                p = self.chain()
                if p.edges:
                    return Expr("pattern", (p,))
            except SyntaxProblem:
                pass
            self.at = at + 1
            e = self.expression()
            self.expect(")")
            return e
        if t.text == "[":
            return self.bracket()
        if t.text == "{":
            return self.brace()
        if t.kind == "name":
            return Expr("name", (self.name(),))
        if t.kind == "word":
            return self.word()
        self.fail("an expression")

    def bracket(self) -> Expr:
        self.expect("[")
        if self.now.kind == "word" and self.peek(1).upper == "IN":
            at = self.at
            var = self.name()
            self.expect("IN")
            try:
                source = self.expression()
                if self.sees("WHERE") or self.sees("|"):
                    cond = self.expression() if self.accept("WHERE") else None
                    out = self.expression() if self.accept("|") else None
                    self.expect("]")
                    return Expr("comprehension", (var, source, cond, out))
            except SyntaxProblem:
                pass
            self.at = at
        items = []
        while not self.accept("]"):
            if items:
                self.expect(",")
            items.append(self.expression())
        return Expr("list", tuple(items))

    def brace(self) -> Expr:
        if self.peek(1).text == "}" or (self.peek(1).kind in ("word", "name", "string") and self.peek(2).text == ":"):
            self.expect("{")
            pairs = []
            while not self.accept("}"):
                if pairs:
                    self.expect(",")
                key = str(self.now.value)
                self.at += 1
                self.expect(":")
                pairs.append((key, self.expression()))
            return Expr("map", tuple(pairs))
        self.expect("{")
        items = []
        while not self.accept("}"):
            if items:
                self.expect(",")
            items.append(self.expression())
        return Expr("setof", tuple(items))

    def word(self) -> Expr:
        w = self.now.upper
        if w in ("TRUE", "FALSE"):
            self.at += 1
            return Expr("lit", (w == "TRUE",))
        if w in ("NULL", "__NULL__"):
            self.at += 1
            return Expr("lit", (None,))
        if w == "CASE":
            return self.case()
        if self.peek(1).text == "(":
            if w in ("ALL", "ANY", "SINGLE", "NONE") and self.peek(2).kind == "word" and self.peek(3).upper == "IN":
                self.at += 2
                var = self.name()
                self.expect("IN")
                source = self.expression()
                self.expect("WHERE")
                cond = self.expression()
                self.expect(")")
                return Expr("predicate", (w.lower(), var, source, cond))
            if w == "EXISTS":
                self.at += 2
                e = self.expression()
                self.expect(")")
                return e if e.op == "pattern" else Expr("not", (Expr("is_null", (e,)),))
            if w == "REDUCE":
                self.at += 2
                acc = self.name()
                self.expect("=")
                start = self.expression()
                self.expect(",")
                var = self.name()
                self.expect("IN")
                source = self.expression()
                self.expect("|")
                step = self.expression()
                self.expect(")")
                return Expr("reduce", (acc, start, var, source, step))
            name = self.name()
            self.expect("(")
            distinct = self.accept("DISTINCT")
            args = []
            while not self.accept(")"):
                if args:
                    self.expect(",")
                args.append(Expr("star") if self.accept("*") else self.expression())
            return Expr("call", (name, tuple(args), distinct))
        if w in _CLAUSE and w not in ("SET", "OUT", "BOTH", "STEPS", "TO", "FROM", "GROUP", "SAMPLE", "END"):
            self.fail("an expression")
        return Expr("name", (self.name(),))

    def case(self) -> Expr:
        self.expect("CASE")
        base = None if self.sees("WHEN") else self.expression()
        arms = []
        while self.accept("WHEN"):
            c = self.expression()
            self.expect("THEN")
            arms.append((c, self.expression()))
        other = self.expression() if self.accept("ELSE") else None
        self.expect("END")
        return Expr("case", (base, tuple(arms), other))
