"""The shape of sources: one pass emits node facts per source, SQL derives families and performance smells from them.

A source becomes one row: its loops, the names it binds to lists and texts, what it does inside loops, and counts of what
it is made of. Everything after that is expressions over this row, so nothing is shuffled.
"""

from __future__ import annotations

import ast
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.code import parse, per_source

# ---- fixed values: vocabularies, names, reasons and messages that results depend on ----
GRAPH_WORDS = ["bfs", "dfs", "adjacency", "graph", "visited", "neighbors", "neighbours", "queue"]
TABLE_WORDS = ["memo", "cache", "dp", "lru_cache", "table"]
STRING_WORDS = ["split", "join", "strip", "replace", "startswith", "endswith", "lower", "upper", "format", "encode", "decode"]
MATH_WORDS = ["gcd", "lcm", "prime", "factorial", "modulo", "pow", "sqrt", "isqrt", "comb"]
STREAM_WORDS = ["input", "readline", "stdin", "stdout", "print", "open", "loads", "dumps"]
#: check -> severity, detail, suggestion; %1$s is the name concerned, %2$s the loop's variables.
SMELLS = {
    "nested_loop_same_collection": ("high", "loop over '%1$s' nested inside another loop over the same collection: this is quadratic in len(%1$s)", "index it once (a dict or set keyed by what you are matching on) instead of re-scanning the inner collection"),
    "membership_test_on_list": ("medium", "`in %1$s` inside a loop, and %1$s is a list: each test scans it", "build `%1$s_set = set(%1$s)` once outside the loop"),
    "string_concat_in_loop": ("medium", "`%1$s +=` inside a loop builds a new string each time", 'append to a list and "".join(parts) after the loop'),
    "loop_invariant_call": ("low", "`%1$s(...)` inside a loop uses none of the loop variables (%2$s), so it recomputes the same value every iteration", "hoist it above the loop"),
}
# ---- end of fixed values ----

_SHAPE = (
    "parses boolean, loops array<struct<n:int,line:int,over:string,bound:array<string>,above:array<int>,scopes:array<int>>>, binds array<struct<name:string,what:string,scopes:array<int>>>, "
    "uses array<struct<what:string,line:int,name:string,names:array<string>,loops:array<int>,scopes:array<int>>>, called map<string,int>, methods map<string,int>, modules array<string>, defs array<string>, subscripts int, dicts int, sets int"
)
_LISTS, _LIST_CALLS = (ast.List, ast.Tuple, ast.ListComp), {"list", "tuple", "sorted"}


def _ids(node) -> list[str]:
    return sorted({x.id for x in ast.walk(node) if isinstance(x, ast.Name)})


def _call_name(node) -> str | None:
    return node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None


def _collection(it) -> str | None:
    """The name that a loop runs over: itself, the object of a method call, or the first argument of a call."""
    if isinstance(it, ast.Call):
        it = getattr(it.func, "value", None) if isinstance(it.func, ast.Attribute) else next(iter(it.args), None) if _call_name(it) else None
    return getattr(it, "id", None) if isinstance(it, ast.Name) else None


def shape_of(text: str) -> tuple:
    """The row of _SHAPE of one source, by one walk with the scopes and loops above each node."""
    tree = parse(text.lstrip("\n"))
    if tree is None:
        return (False, [], [], [], {}, {}, [], [], 0, 0, 0)
    loops, binds, uses, defs, modules = [], [], [], [], set()
    called, methods, sizes, scopes_of = Counter(), Counter(), Counter(), {}
    todo, serial = [(tree, (), ())], 0
    while todo:
        node, scopes, above = todo.pop()
        kind = type(node)
        innermost = scopes_of[above[-1]] if above else None
        if kind in (ast.FunctionDef, ast.AsyncFunctionDef):
            serial += 1
            scopes = (*scopes, serial)
            defs.append(node.name)
        elif kind in (ast.For, ast.While):
            is_for = kind is ast.For
            loops.append((len(loops), node.lineno, _collection(node.iter) if is_for else None, _ids(node.target) if is_for else [], above, scopes))
            scopes_of[len(loops) - 1] = scopes
            above = (*above, len(loops) - 1)
        elif kind is ast.Assign:
            what = "list" if isinstance(node.value, _LISTS) or _call_name(node.value) in _LIST_CALLS else "text" if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) else None
            binds += [(t.id, what, scopes) for t in node.targets if what and isinstance(t, ast.Name)]
        elif kind is ast.Compare and above and isinstance(node.ops[0], ast.In) and isinstance(node.comparators[0], ast.Name):
            uses.append(("in", node.lineno, node.comparators[0].id, [], above, innermost))
        elif kind is ast.AugAssign and above and isinstance(node.op, ast.Add) and isinstance(node.target, ast.Name):
            uses.append(("grow", node.lineno, node.target.id, [], above, innermost))
        elif kind is ast.Call:
            name = _call_name(node)
            if name:
                called[name] += 1
                if above and node.args:
                    uses.append(("call", node.lineno, name, _ids(node), above, innermost))
            elif isinstance(node.func, ast.Attribute):
                methods[node.func.attr] += 1
        elif kind in (ast.Import, ast.ImportFrom):
            modules |= {a.name.partition(".")[0] for a in node.names} | {(getattr(node, "module", None) or "").partition(".")[0]} - {""}
        elif kind is ast.Subscript:
            sizes["subscripts"] += 1
        elif kind in (ast.Dict, ast.DictComp):
            sizes["dicts"] += 1
        elif kind in (ast.Set, ast.SetComp):
            sizes["sets"] += 1
        todo += [(child, scopes, above) for child in ast.iter_child_nodes(node)]
    if not defs:  # without functions the module is the scope of everything
        loops, binds, uses = ([(*x[:-1], (0,)) for x in part] for part in (loops, binds, uses))
    return (True, loops, binds, uses, dict(called), dict(methods), sorted(modules), defs, sizes["subscripts"], sizes["dicts"], sizes["sets"])


def shapes(rows: DataFrame, id: str = "row", text: str = "text") -> DataFrame:
    """(id, text, parses, loops, binds, uses, called, methods, modules, defs, subscripts, dicts, sets) of every row with a text."""
    kind = rows.schema[id].dataType.simpleString()
    return per_source(rows, [id, text], lambda i, t: [(i, t, *shape_of(t))], f"{id} {kind}, {text} string, {_SHAPE}", distinct=False)


def _family(text: Column) -> tuple[Column, Column]:
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower))
    some = lambda vocabulary: F.array_sort(F.array_intersect(words, F.array(*map(F.lit, vocabulary))))
    many = lambda vocabulary, n=1: F.size(some(vocabulary)) >= n
    shown = lambda vocabulary: F.array_join(F.slice(some(vocabulary), 1, 3), ", ")
    calls = lambda *names: F.arrays_overlap(F.map_keys("called"), F.array(*map(F.lit, names)))
    loops, recursive = F.size("loops"), F.arrays_overlap("defs", F.map_keys("called"))
    depth = F.aggregate("loops", F.lit(0), lambda n, x: n + F.size(x["above"]))
    string_methods = F.aggregate(F.map_values(F.map_filter("methods", lambda k, _: k.isin(*STRING_WORDS))), F.lit(0), lambda a, b: a + b)
    cascade = [
        ("dynamic_programming", recursive & (many(TABLE_WORDS) | (F.col("dicts") > 0)), F.lit("recursive with a memo table")),
        ("dynamic_programming", many(TABLE_WORDS) & (loops > 0), F.lit("loop over a dp/memo table")),
        ("heap_priority", F.array_contains("modules", "heapq") | calls("heappush", "heappop"), F.lit("uses a heap")),
        ("graph_search", many(GRAPH_WORDS), F.concat(F.lit("graph vocabulary ("), shown(GRAPH_WORDS), F.lit(")"))),
        ("recursion", recursive, F.lit("calls itself")),
        ("sorting", calls("sorted") | F.array_contains(F.map_keys("methods"), "sort"), F.lit("sorts its input")),
        ("math_number_theory", many(MATH_WORDS), F.concat(F.lit("number-theory vocabulary ("), shown(MATH_WORDS), F.lit(")"))),
        ("matrix_grid", (depth > 0) & (F.col("subscripts") >= 2), F.lit("nested loops over indexed data")),
        ("hashing_lookup", (F.col("dicts") > 0) | (F.col("sets") > 0), F.lit("builds a dict or set for lookup")),
        ("string_processing", many(STRING_WORDS, 2) | (string_methods >= 2), F.lit("string methods")),
        ("io_parsing", many(STREAM_WORDS, 2), F.lit("reads or writes streams")),
        ("iteration", loops > 0, F.lit("a plain loop")),
    ]
    name, reason = F.when(~F.col("parses"), "other"), F.when(~F.col("parses"), "does not parse as Python")
    for family, test, why in cascade:
        name, reason = name.when(test, family), reason.when(test, why)
    return name.otherwise("other"), reason.otherwise("no distinctive structure")


def families(rows: DataFrame, id: str = "row", text: str = "text") -> DataFrame:
    """(id, ast_family, ast_reason) of every row with a text: the first rule of an ordered cascade that holds."""
    name, reason = _family(F.col(text))
    return shapes(rows, id, text).select(id, name.alias("ast_family"), reason.alias("ast_reason"))


def smells(rows: DataFrame, id: str = "row", text: str = "text", start: Column | None = None) -> DataFrame:
    """(id, check, line, severity, detail, suggestion) of performance smells in every row that parses; each check once a line.

    `start`, if given, is the file line of a text's first line, by which lines are moved (it may use the other columns).
    Of several details of one check and line the first of the alphabet counts.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id,)}
    placed = rows.select(F.col(id), (F.lit(1) if start is None else start).cast("int").alias("first"), F.col(text).alias("text"))
    shaped = per_source(placed, [id, "first", "text"], lambda i, f, t: [(i, f, *shape_of(t))], f"{id} {kinds[id]}, first int, {_SHAPE}", distinct=False)
    bound = "exists(binds, b -> b.name = u.name and b.what = '{}' and arrays_overlap(b.scopes, u.scopes))"
    finding = "named_struct('check', '{}', 'line', u.line, 'name', u.name, 'bound', {})"
    none = "cast(array() as array<string>)"
    found = F.concat(
        F.expr("transform(filter(loops, l -> l.over is not null and exists(loops, o -> array_contains(l.above, o.n) and o.over = l.over and size(o.scopes) > 0)), l -> named_struct('check', 'nested_loop_same_collection', 'line', l.line, 'name', l.over, 'bound', " + none + "))"),
        F.expr(f"transform(filter(uses, u -> u.what = 'in' and {bound.format('list')}), u -> {finding.format('membership_test_on_list', none)})"),
        F.expr(f"transform(filter(uses, u -> u.what = 'grow' and {bound.format('text')}), u -> {finding.format('string_concat_in_loop', none)})"),
        F.expr(
            "flatten(transform(filter(uses, u -> u.what = 'call' and u.name not in ('print', 'append')), u -> transform(filter(loops, l -> array_contains(u.loops, l.n) and size(l.scopes) > 0 and size(l.bound) > 0 and not arrays_overlap(l.bound, u.names)), l -> "
            + finding.format("loop_invariant_call", "l.bound")
            + ")))"
        ),
    )
    each = shaped.select(id, "first", F.explode(found).alias("x")).select(id, "x.check", (F.col("x.line") + F.col("first") - 1).alias("line"), F.col("x.name").alias("name"), F.array_join("x.bound", ", ").alias("bound"))

    def message(part: int) -> Column:
        out = None
        for check, parts in SMELLS.items():
            value = F.format_string(parts[part], "name", "bound") if part else F.lit(parts[0])
            out = F.when(F.col("check") == check, value) if out is None else out.when(F.col("check") == check, value)
        return out

    told = each.select(id, "check", "line", message(0).alias("severity"), message(1).alias("detail"), message(2).alias("suggestion"))
    return told.groupBy(id, "check", "line").agg(F.min(F.struct("severity", "detail", "suggestion")).alias("x")).select(id, "check", "line", "x.*")
