"""Registry of queries and the table fixtures they run on.

A fixture is one SQL text that both engines understand; the few constructs that
differ are filled in by a ``Dialect``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovekit.session import ship_package

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Dialect:
    """Constructs that Spark SQL and the reference engine spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark

    def ordered_list(self, value: str, order: str) -> str:
        if self.spark:
            return f"transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v)"
        return f"list({value} ORDER BY {order})"

    def div(self, a: str, b) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def array(self, *items: str) -> str:
        body = ", ".join(items)
        return f"array({body})" if self.spark else f"[{body}]"

    def md5(self, x: str, seed="2023") -> str:
        return f"md5(concat('{seed}:', cast({x} AS {'string' if self.spark else 'varchar'})))"

    def hash32(self, x: str, seed="2023") -> str:
        h = f"substr({self.md5(x, seed)}, 1, 8)"
        return f"cast(conv({h}, 16, 10) AS bigint)" if self.spark else f"cast('0x' || {h} AS bigint)"

    def unnest(self, *items: str) -> str:
        return f"explode(array({', '.join(items)}))" if self.spark else f"unnest([{', '.join(items)}])"

    def no_list(self) -> str:
        return "cast(array() AS array<string>)" if self.spark else "cast([] AS varchar[])"

    def one_based(self, array: str, index: str) -> str:
        return f"try_element_at({array}, cast({index} AS int))" if self.spark else f"({array})[{index}]"

    def repeat(self, x: str, n: str) -> str:
        return f"repeat({x}, cast({n} AS int))" if self.spark else f"repeat({x}, {n})"


SPARK, DUCK = Dialect(True), Dialect(False)

FIXTURES: dict[str, tuple[tuple[str, ...], Callable[[Dialect], str]]] = {}
#: fixture -> {table: key}: small tables whose rows become large ones, dealt over all tasks by the key
SPREAD: dict[str, dict[str, str]] = {}
QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture(*needs: str, spread: dict[str, str] | None = None):
    def add(fn):
        FIXTURES[fn.__name__] = (needs, fn)
        SPREAD[fn.__name__] = spread or {}
        return fn

    return add


def ctes(dialect: Dialect, *names: str) -> str:
    """``WITH`` clause holding the fixtures and everything they need."""
    done: list[str] = []

    def visit(name):
        needs, _ = FIXTURES[name]
        for n in needs:
            visit(n)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{FIXTURES[n][1](dialect).strip()}\n)" for n in done)


def query(sql: str | None = None, needs: str = ""):
    """Register a query under its function name, with its SQL if it has one.

    ``needs`` names fixtures to put in front of the SQL; SQL that starts with a
    comma continues their ``WITH`` clause.
    """

    def add(fn):
        name = fn.__name__
        QUERIES[name] = fn
        if sql is not None:
            head = ctes(DUCK, *needs.split()) + "\n" if needs else ""
            ORACLES[name] = head + sql.strip()
        return fn

    return add


class Tables:
    """Driver tables and fixtures as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in FIXTURES:
            return self.fx(name)
        raise AttributeError(name)

    def fx(self, name: str) -> DataFrame:
        text = ctes(SPARK, name)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for t in TABLES:
            if t in text:
                rows = self.spark.read.parquet(f"{self.folder}/{t}.parquet")
                if t in SPREAD[name]:
                    rows = rows.repartition(parts, SPREAD[name][t])
                rows.createOrReplaceTempView(t)
        return self.spark.sql(f"{text}\nSELECT * FROM {name}")


# -- pieces of reference SQL ---------------------------------------------------


def clean(x: str) -> str:
    """Reference SQL of the text cleaning."""
    s = (
        f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), chr(13), ''), '^\\s+|\\s+$', '', 'g'), "
        "'^\"+|\"+$', '', 'g')"
    )
    u = f"(upper({s}[1]) || {s}[2:])"
    return f"CASE WHEN {s} = '' THEN '' WHEN right({s}, 1) IN ('.', '?', '!') THEN {u} ELSE {u} || '.' END"


def words(x: str) -> str:
    return f"[w FOR w IN regexp_split_to_array(coalesce({x}, ''), '\\s+') IF w <> '']"


def chunks(x: str, size: int = 100) -> str:
    w = words(x)
    return f"[array_to_string(({w})[i:i+{size - 1}], ' ') FOR i IN range(1, len({w}) + 1, {size})]"


def doc_key_sql(txt="txt", img="img_path", modality="modality") -> str:
    return f"concat_ws('-', nullif({txt}, ''), nullif({img}, ''), nullif({modality}, ''))"


def unit(v: str) -> str:
    d = f"{v}::DOUBLE[]"
    return f"CASE WHEN list_dot_product({d}, {d}) = 0 THEN {d} ELSE [x / sqrt(list_dot_product({d}, {d})) FOR x IN {d}] END"


def task_id_sql(q: str, c: str) -> str:
    return (
        f"CASE {q} || ' -> ' || {c} WHEN 'text -> image' THEN 0 WHEN 'text -> text' THEN 1 "
        "WHEN 'text -> image,text' THEN 2 WHEN 'image -> text' THEN 3 WHEN 'image -> image' THEN 4 "
        "WHEN 'image -> text,image' THEN 5 WHEN 'image,text -> text' THEN 6 WHEN 'image,text -> image' THEN 7 "
        "WHEN 'image,text -> image,text' THEN 8 END"
    )


def task_name_sql(t: str) -> str:
    return (
        f"CASE {t} WHEN 0 THEN 'text -> image' WHEN 1 THEN 'text -> text' WHEN 2 THEN 'text -> image,text' "
        "WHEN 3 THEN 'image -> text' WHEN 4 THEN 'image -> image' WHEN 5 THEN 'image -> text,image' "
        "WHEN 6 THEN 'image,text -> text' WHEN 7 THEN 'image,text -> image' WHEN 8 THEN 'image,text -> image,text' END"
    )


def dataset_sql(d: str) -> str:
    names = "VisualNews Fashion200K WebQA EDIS NIGHTS OVEN INFOSEEK FashionIQ CIRR MSCOCO FLICKR30K".split()
    return f"CASE {d} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def domain_sql(d: str) -> str:
    return f"CASE WHEN {d} IN (0, 3) THEN 'news' WHEN {d} IN (1, 7) THEN 'fashion' WHEN {d} IN (2, 5, 6) THEN 'wiki' WHEN {d} IN (4, 8, 9, 10) THEN 'common' END"


def rate_sql(h: str, n: str) -> str:
    """Exact half-even rate to four digits."""
    return (
        f"CASE WHEN {n} > 0 THEN (((10000 * {h}) // {n}) + CASE WHEN 2 * ((10000 * {h}) % {n}) > {n} "
        f"OR (2 * ((10000 * {h}) % {n}) = {n} AND ((10000 * {h}) // {n}) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE END"
    )
