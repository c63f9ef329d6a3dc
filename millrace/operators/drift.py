"""Schemas that drift between files: nested schema trees, minimum-cost edit scripts, projections.

A file's schema is a tree of fields. The edit distance between two trees adds, deletes, renames and
moves fields at least cost; fields are matched by an exact assignment, and a field that stays under
another parent is a move. Scripts are compiled into one projection per file, so that all files read into one consistent table.
Trees and scripts are file metadata (a few kilobytes a file) and live on the driver; everything
taken from rows is aggregated by Spark first.
"""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from millrace.session import bounded_broadcast

ADD, DELETE, MOVE, RETYPE = 1.0, 1.0, 0.8, 0.3
#: A rename costs at most this; a dearer one is an add and a delete.
RENAME_LIMIT = 0.9
#: Matchings of structs that are tried one by one; schemas with more structs are searched step by step.
MATCHINGS = 2000
#: Shares of the value profile and the spelling in the likeness of two fields.
PROFILE_WEIGHT, NAME_WEIGHT = 0.75, 0.25


@dataclass
class Node:
    """A field: its name, its type class, its children if it is a struct, and a profile {value cell: share} if known."""

    name: str
    kind: str = "struct"
    children: list["Node"] = field(default_factory=list)
    profile: dict[str, float] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def walk(self, path: tuple[str, ...] = ()):
        for c in self.children:
            yield (*path, c.name), c
            yield from c.walk((*path, c.name))


@dataclass(frozen=True)
class Edit:
    op: str  # add, delete, rename, move or retype
    path: tuple[str, ...]
    to: tuple[str, ...] = ()
    kind: str = ""


def plain(name: str) -> str:
    """A name without case and separators."""
    return re.sub(r"[^0-9a-z]", "", name.lower())


def likeness(a: Node, b: Node) -> float:
    """0 to 1; 1 for names that differ in case or separators only. Without profiles the spelling decides."""
    if plain(a.name) == plain(b.name):
        return 1.0
    spelled = SequenceMatcher(None, plain(a.name), plain(b.name)).ratio()
    if a.profile and b.profile:
        shared = sum(min(p, b.profile.get(k, 0.0)) for k, p in a.profile.items())
        return PROFILE_WEIGHT * shared + NAME_WEIGHT * spelled
    return spelled


def assign(cost: list[list[float]]) -> list[int]:
    """For each row of a square matrix its column in an assignment of least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, p = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, used, way = [math.inf] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[p[j] - 1] = j - 1
    return out


def _cost(a: Node, b: Node) -> float:
    """Cost of keeping a as b under matched parents; infinite where that is no rename."""
    if (a.kind == "struct") != (b.kind == "struct"):
        return math.inf
    like = likeness(a, b)
    named = 0.0 if a.name == b.name else 0.1 if like == 1.0 else 2 * (1 - like)
    return math.inf if named > RENAME_LIMIT else named + (RETYPE if a.kind != b.kind else 0.0)


class _Forest:
    """The nodes of a tree under its root, with the numbers of their parents (0 is the root)."""

    def __init__(self, root: Node):
        self.nodes, self.parent, self.path = [root], [-1], [()]
        at = 0
        while at < len(self.nodes):
            for c in self.nodes[at].children:
                self.nodes.append(c)
                self.parent.append(at)
                self.path.append((*self.path[at], c.name))
            at += 1
        self.structs = [i for i, n in enumerate(self.nodes) if i and n.kind == "struct"]
        self.leaves = [i for i, n in enumerate(self.nodes) if i and n.kind != "struct"]


def _best(old: _Forest, new: _Forest, structs: dict[int, int]) -> tuple[float, dict[int, int]]:
    """Least cost, and the nodes kept, if these structs are matched (0 to 0): leaves are matched by an exact assignment in
    which a leaf whose parents are not matched to each other costs a move more."""
    cost = DELETE * (len(old.structs) - len(structs) + 1) + ADD * (len(new.structs) - len(structs) + 1)
    moved = lambda i, j: 0.0 if structs.get(old.parent[i]) == new.parent[j] else MOVE
    for i, j in structs.items():
        if i:
            cost += _cost(old.nodes[i], new.nodes[j]) + moved(i, j)
    keep = dict(structs)
    left = {(new.parent[j], new.nodes[j].name, new.nodes[j].kind): j for j in new.leaves}
    for i in old.leaves:  # what stays as it is costs nothing
        j = left.get((structs.get(old.parent[i], -1), old.nodes[i].name, old.nodes[i].kind))
        if j is not None:
            keep[i] = j
    done = set(keep.values())
    rows, cols = [i for i in old.leaves if i not in keep], [j for j in new.leaves if j not in done]
    n, m = len(rows), len(cols)
    if n + m:
        each = [[_cost(old.nodes[i], new.nodes[j]) + moved(i, j) for j in cols] for i in rows]
        big = 1e6
        matrix = [[min(c, big) for c in r] + [DELETE] * n for r in each] + [[ADD] * m + [0.0] * n for _ in range(m)]
        for k, at in enumerate(assign(matrix)):
            cost += matrix[k][at]
            if k < n and at < m:
                keep[rows[k]] = cols[at]
    return cost, keep


def _matchings(old: list[int], new: list[int]):
    """Every way to match some of old with some of new."""
    if not old:
        yield {}
        return
    for rest in _matchings(old[1:], new):
        yield rest
        for j in new:
            if j not in rest.values():
                yield rest | {old[0]: j}


def least_edits(old: Node, new: Node) -> tuple[float, _Forest, _Forest, dict[int, int]]:
    """Least cost of turning old into new by adding, deleting, renaming, retyping and moving nodes, and the nodes kept.

    Every matching of structs is tried where there are at most MATCHINGS of them, which is exact; beyond that
    structs of one path are matched first and one struct after another is matched anew while that is cheaper.
    """
    a, b = _Forest(old), _Forest(new)
    ways = sum(math.comb(len(a.structs), k) * math.comb(len(b.structs), k) * math.factorial(k) for k in range(min(len(a.structs), len(b.structs)) + 1))
    if ways <= MATCHINGS:
        every = [{0: 0} | m for m in _matchings(a.structs, b.structs) if all(_cost(a.nodes[i], b.nodes[j]) < math.inf for i, j in m.items())]
        found = [(*_best(a, b, m), -len(m)) for m in every]
        cost, keep, _ = min(found, key=lambda x: (round(x[0], 9), x[2]))
        return cost, a, b, keep
    at = {b.path[j]: j for j in b.structs}
    structs = {0: 0} | {i: at[a.path[i]] for i in a.structs if a.path[i] in at}
    cost, keep = _best(a, b, structs)
    better = True
    while better:
        better = False
        for i in a.structs:
            for j in [None, *b.structs]:
                other = {x: y for x, y in structs.items() if x != i and y != j} | ({} if j is None else {i: j})
                if j is not None and _cost(a.nodes[i], b.nodes[j]) == math.inf:
                    continue
                c, k = _best(a, b, other)
                if c < cost - 1e-9:
                    cost, keep, structs, better = c, k, other, True
    return cost, a, b, keep


def edit_script(old: Node, new: Node) -> list[Edit]:
    """The edits of least cost from old to new, in path order. Equal trees give none. A node that stays under another
    parent is a move, whatever its name there."""
    _, a, b, keep = least_edits(old, new)
    out: list[Edit] = []
    for i, j in keep.items():
        x, y = a.nodes[i], b.nodes[j]
        if not i:
            continue
        if keep.get(a.parent[i]) != b.parent[j]:
            out.append(Edit("move", a.path[i], b.path[j], y.kind))
        elif x.name != y.name:
            out.append(Edit("rename", a.path[i], b.path[j], y.kind))
        if x.kind != y.kind:
            out.append(Edit("retype", a.path[i], b.path[j], y.kind))
    kept = set(keep.values())
    out += [Edit("delete", a.path[i], (), a.nodes[i].kind) for i in range(1, len(a.nodes)) if i not in keep]
    out += [Edit("add", (), b.path[j], b.nodes[j].kind) for j in range(1, len(b.nodes)) if j not in kept]
    return sorted(out, key=lambda e: (e.path or e.to, e.op))


def tree_of(schema, name: str = "") -> Node:
    """The tree of a Spark schema (StructType); arrays and maps count as leaves of their own type."""
    out = Node(name, "struct")
    for f in schema.fields:
        out.children.append(tree_of(f.dataType, f.name) if f.dataType.typeName() == "struct" else Node(f.name, f.dataType.simpleString()))
    return out


def compile_projection(script: list[Edit], target) -> list[Column]:
    """Columns that read a file of the old schema as the target schema (StructType): renamed and moved
    fields are followed, added ones null, deleted ones dropped, retyped ones cast where a value can be."""
    source = {e.to: e.path for e in script if e.op in ("rename", "move")}
    added = {e.to for e in script if e.op == "add"}

    def build(f, path: tuple[str, ...], src: tuple[str, ...] | None) -> Column:
        here = (*path, f.name)
        if here in added or src is None:
            return F.lit(None).cast(f.dataType)
        old = source.get(here, (*src, f.name))
        if f.dataType.typeName() == "struct":
            return F.struct(*[build(c, here, old).alias(c.name) for c in f.dataType.fields])
        return F.col(".".join(f"`{p}`" for p in old)).try_cast(f.dataType)

    return [build(f, (), ()).alias(f.name) for f in target.fields]


def union_schema(schemas: list[StructType]) -> StructType:
    """One schema for files in order: the first one's fields, then those that later files add. A renamed or moved field
    is the field it was; a type that changes is widened between numbers and text otherwise."""
    out = schemas[0]
    for s in schemas[1:]:
        script = edit_script(tree_of(out), tree_of(s))
        known = {e.to: e.path for e in script if e.op in ("rename", "move")}

        def add(have: StructType, more: StructType, path: tuple[str, ...], known=known) -> StructType:
            fields = {f.name: f for f in have.fields}
            for f in more.fields:
                here = (*path, f.name)
                name = known[here][-1] if here in known and known[here][:-1] == path else f.name
                if here in known and known[here][:-1] != path:
                    continue  # moved: it stays where it was
                old = fields.get(name)
                if old is None:
                    fields[name] = StructField(name, f.dataType, True)
                elif isinstance(old.dataType, StructType) and isinstance(f.dataType, StructType):
                    fields[name] = StructField(name, add(old.dataType, f.dataType, here), True)
                else:
                    fields[name] = StructField(name, wider(old.dataType, f.dataType), True)
            return StructType(list(fields.values()))

        out = add(out, s, ())
    return out


#: Footers that are read at a time.
FOOTERS = 16
#: Numbers by width (fixed order of the engine's own types).
_NUMBERS = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)


def wider(a: DataType, b: DataType) -> DataType:
    if a == b:
        return a
    rank = {k: i for i, k in enumerate(_NUMBERS)}
    if type(a) in rank and type(b) in rank:
        pair = {type(a), type(b)}
        if pair == {LongType, FloatType} or pair == {IntegerType, FloatType}:
            return DoubleType()
        return a if rank[type(a)] > rank[type(b)] else b
    return StringType()


def schemas_of(spark: SparkSession, paths: list[str]) -> list[StructType]:
    """The schemas of Parquet files, several footers at a time."""
    with ThreadPoolExecutor(FOOTERS) as pool:
        return list(pool.map(lambda p: spark.read.parquet(p).schema, paths))


def read_unified(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[tuple[str, list[Edit]]]]:
    """Parquet files of drifting, nested schemas as one table, and each file's script against the file before it.

    Paths are taken in their order. Files of one schema are one scan, each with the projection that its
    script compiles to, so Spark reads only what the projection needs.
    """
    schemas = list(zip(paths, schemas_of(spark, paths)))
    target = union_schema([s for _, s in schemas])
    scripts = [(p, edit_script(tree_of(before), tree_of(s))) for (_, before), (p, s) in zip(schemas, schemas[1:])]
    groups: dict[str, tuple[StructType, list[str]]] = {}
    for p, s in schemas:
        groups.setdefault(s.json(), (s, []))[1].append(p)
    out = None
    for s, files in groups.values():
        to_target = edit_script(tree_of(s), tree_of(target))
        part = spark.read.schema(s).parquet(*files).select(*compile_projection(to_target, target), F.col("_metadata.file_name").alias("_source_file"))
        out = part if out is None else out.unionByName(part)
    return out, scripts


# ---- tables landed under a tracked schema, with the rest of each row in a rescued JSON column ----

#: Spark types by the class that a change is reported in.
CLASSES = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "decimal", "double": "decimal",
           "string": "text", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "date": "timestamp"}


def _class_of_json(kind: Column) -> Column:
    return (F.when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "decimal")
            .when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").otherwise(F.lower(kind)))


def _value_cell(v: Column) -> Column:
    """A coarse cell of a value, the same for a number and its text: numbers by 5 % of size, text by its hash, times by the hour of the day."""
    x = v.try_cast("double")
    number = F.when(x == 0, F.lit("0")).otherwise(F.concat(F.when(x < 0, F.lit("n")).otherwise(F.lit("p")), F.round(F.log(F.abs(x)) / math.log(1.05)).cast("string")))
    when = F.when(v.rlike(r"\d\d:\d\d:\d\d"), F.concat(F.lit("h"), F.regexp_extract(v, r"(\d\d):\d\d:\d\d", 1)))
    return F.coalesce(when, F.when(x.isNotNull(), number), F.concat(F.lit("t"), F.pmod(F.xxhash64(F.lower(F.trim(v))), F.lit(256)).cast("string")))


@dataclass
class LandedTable:
    """A landed table: tracked columns, a rescued JSON column, the file and the arrival of each row.

    Defined results: rows without a file are left out; rescued text that is no JSON object counts as
    none; a JSON null is no value; a file without any value has an empty schema; fields named
    `ignore` are no fields. Files that arrive at the same time are ordered by name.
    """

    df: DataFrame
    file: str
    arrived: str
    rescued: str
    ignore: tuple[str, ...] = ("_file_path",)

    def __post_init__(self):
        own = {self.file, self.arrived, self.rescued}
        self.columns = {c: CLASSES.get(t, t) for c, t in self.df.dtypes if c not in own}

    def _extra(self, df: DataFrame) -> DataFrame:
        """(file, name, value) of every rescued value that is not null."""
        each = F.explode(F.from_json(self.rescued, "map<string,variant>")).alias("name", "value")
        rows = df.filter(F.col(self.file).isNotNull() & F.col(self.rescued).isNotNull()).select(F.col(self.file).alias("file"), each)
        return rows.filter(~F.col("name").isin(*self.ignore)).filter(F.col("value").cast("string").isNotNull())

    def profile(self, columns: list[str], extra: list[str]) -> DataFrame:
        """(file, name, cell, n): how the values of some columns and rescued names are spread; map-side combined, and of at
        most a few hundred cells a field."""
        parts = []
        if columns:
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
            parts.append(self.df.filter(F.col(self.file).isNotNull()).select(F.col(self.file).alias("file"), each.alias("x")).select("file", "x.*").filter("v IS NOT NULL"))
        if extra:
            parts.append(self._extra(self.df).filter(F.col("name").isin(*extra)).select("file", "name", F.col("value").cast("string").alias("v")))
        rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        return rows.groupBy("file", "name", _value_cell(F.col("v")).alias("cell")).agg(F.count("*").alias("n"))

    def kinds(self) -> DataFrame:
        """(file, name, kind, n): how many values each file has of each kind under each name, in columns and rescued; a field of
        mixed kinds has several rows, where schemas go by the most frequent one. One pass, combined before it is shuffled."""
        counts = [F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.columns)]
        held = self.df.filter(F.col(self.file).isNotNull()).groupBy(F.col(self.file).alias("file")).agg(*counts)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("n")) for i, (c, k) in enumerate(self.columns.items())]))
        held = held.select("file", each.alias("x")).select("file", "x.*").filter("n > 0")
        rest = self._extra(self.df).groupBy("file", "name", F.schema_of_variant("value").alias("raw")).agg(F.count("*").alias("n"))
        return held.unionByName(rest.select("file", "name", _class_of_json(F.col("raw")).alias("kind"), "n")).groupBy("file", "name", "kind").agg(F.sum("n").alias("n"))

    def schemas(self) -> list[tuple[str, Node]]:
        """(file, schema tree) in order of arrival.

        The first pass counts values per file and column, and names and kinds of rescued values. Only if
        a file has names that no column spells, and columns without values, are profiles taken, of these
        names and columns alone.
        """
        order = self.df.filter(F.col(self.file).isNotNull()).groupBy(F.col(self.file).alias("file")).agg(F.min(self.arrived).alias("a")).orderBy("a", "file").collect()
        kinds: dict[str, dict[str, dict[str, int]]] = {r.file: {} for r in order}
        for r in self.kinds().collect():  # a row per file, field and kind
            kinds[r.file].setdefault(r.name, {})[r.kind] = r.n
        known = {plain(c) for c in self.columns}
        unknown, empty = set(), set()
        for own in kinds.values():
            strange = {n for n in own if plain(n) not in known}
            if strange:
                unknown |= strange
                there = {plain(n) for n in own}
                empty |= {c for c in self.columns if plain(c) not in there}
        profiles: dict[tuple[str, str], dict[str, float]] = {}
        if unknown and empty:
            spelled = sorted(unknown | {n for own in kinds.values() for n in own if n not in self.columns and plain(n) in {plain(c) for c in empty}})
            cells = self.profile(sorted(empty), spelled).groupBy("file", "name").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("cells"))
            for r in cells.collect():
                total = sum(r.cells.values())
                profiles[r.file, r.name] = {k: n / total for k, n in r.cells.items()}
        out = []
        for r in order:
            root = Node(r.file)
            for name, own in sorted(kinds[r.file].items()):
                root.children.append(Node(name, max(sorted(own), key=lambda k: own[k]), [], profiles.get((r.file, name), {})))
            out.append((r.file, root))
        return out

    def resolve(self, schemas: list[tuple[str, Node]]) -> list[tuple[str, dict[str, Node]]]:
        """(file, {field: node}): what each file calls the tracked fields. The script from the tracked schema to
        the file's tree names them; a field that no column stands for keeps its own name."""
        pooled = {}
        for c in self.columns:
            cells: dict[str, float] = {}
            parts = [n.profile for _, t in schemas for n in t.children if plain(n.name) == plain(c) and n.profile]
            for p in parts:
                for k, x in p.items():
                    cells[k] = cells.get(k, 0.0) + x / len(parts)
            pooled[c] = cells
        tracked = Node("", "struct", [Node(c, k, [], pooled[c]) for c, k in self.columns.items()])
        out, extras = [], {}
        for file, tree in schemas:
            script = edit_script(tracked, Node("", "struct", tree.children))
            named = {e.to[0]: e.path[0] for e in script if e.op == "rename"}
            fields: dict[str, Node] = {}
            for n in tree.children:
                name = named.get(n.name, n.name)
                if name not in self.columns:
                    name = extras.setdefault(plain(name), name)
                fields[name] = n
            out.append((file, fields))
        return out

    def changes(self) -> list[tuple[str, str, str, str, str]]:
        """(file, field, change, before, after) of each file against the file before, from the edit script between the two.
        A field goes by the name of its tracked column, or by its own if it has none."""
        schemas = self.schemas()
        out, before, called = [], None, {}
        for (file, tree), (_, fields) in zip(schemas, self.resolve(schemas)):
            now = {n.name: f if f in self.columns else n.name for f, n in fields.items()}
            if before is not None:
                kinds = {n.name: n.kind for n in before.children}
                for e in edit_script(Node("", "struct", before.children), Node("", "struct", tree.children)):
                    old, new = (p[0] if p else None for p in (e.path, e.to))
                    if e.op == "delete":
                        out.append((file, called[old], "removed", old, None))
                    elif e.op == "add":
                        out.append((file, now[new], "added", None, new))
                    elif e.op == "rename":
                        out.append((file, now[new], "renamed", old, new))
                    else:
                        out.append((file, now[new], "retyped", kinds[old], e.kind))
            before, called = tree, now
        return out

    def unified(self) -> DataFrame:
        """One consistent table: every tracked column under its name and type, from the column or, where it is
        null, from the rescued value under the file's spelling; then one text column per further field. Values
        that cannot be read as the tracked type are null.

        The scripts compile to a table with one row per file, what it calls each field, which is joined to the
        rows; so the plan has the same size for any number of files, and the table is scanned once.
        """
        resolved = self.resolve(self.schemas())
        every = list(dict.fromkeys(f for _, fields in resolved for f in fields))
        spelled = [(file, {f: n.name for f, n in fields.items()}) for file, fields in resolved]
        names = bounded_broadcast(self.df.sparkSession.createDataFrame(spelled, "_file string, _names map<string,string>"))
        types = dict(self.df.dtypes)
        read = lambda f: F.col("_rest")[F.col("_names")[f]].cast("string")

        def typed(c: str) -> Column:
            t, v = types[c], read(c)
            if t.startswith("timestamp"):
                since = f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, try_cast(`_r_{c}` AS BIGINT) / 1000)"
                v = F.coalesce(F.expr(f"try_to_timestamp(`_r_{c}`, 'dd.MM.yyyy HH:mm:ss')").cast(t), F.expr(since).cast(t), v.try_cast(t))
            elif t in ("int", "bigint"):
                v = v.try_cast("double").try_cast(t)
            else:
                v = v.try_cast(t)
            return F.coalesce(F.col(f"`{c}`"), v).alias(c)

        base = self.df.withColumn("_rest", F.from_json(self.rescued, "map<string,variant>")).join(names, F.col(self.file) == F.col("_file"), "left")
        base = base.withColumns({f"_r_{c}": read(c) for c in self.columns if types[c].startswith("timestamp")})
        more = [f for f in every if f not in self.columns]
        return base.select(*[typed(c) for c in self.columns], *[read(f).alias(f) for f in sorted(more)], self.file, self.arrived)
