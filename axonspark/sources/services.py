"""Live services as data sources: a graph service that answers Cypher, and a table service of materialised releases.

``spark.read.format("graph_service")`` and ``("table_service")`` plan like
files: equality, membership, comparisons and substrings on plain columns go into
the request, lists of ids are dealt into chunks, each a partition of its own,
and partitions page through their answer. A request that the service can't take
now is tried again, later each time.

Protocol values are those of the public interfaces: POST /api/custom/custom with
{"cypher", "dataset"} gives {"columns", "data"}; POST
/materialize/api/v3/datastack/<stack>/version/<n>/query gives an Arrow stream.
"""

from __future__ import annotations

import io
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual, StringContains
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from axonspark.session import setting

# The public services.
GRAPH_SERVER, GRAPH_DATASET = "neuprint.janelia.org", "hemibrain:v1.2.1"
TABLE_SERVER, TABLE_STACK = "https://global.daf-apis.com", "flywire_fafb_public"
GRAPH_TOKENS, TABLE_TOKENS = ("NEUPRINT_APPLICATION_CREDENTIALS", "NEUPRINT_AUTH_TOKEN", "NEUPRINT_TOKEN"), ("CAVE_AUTH_TOKEN", "CAVE_TOKEN")
#: Ids in a request, rows in an answer, and how often a request is made at most.
CHUNK, PAGE, TRIES = 2000, 50_000, 6
BUSY = (408, 429, 500, 502, 503, 504)

NEURON = "bodyId long, type string, instance string, status string, cropped boolean, size long"
CONNECTION = "upstream_bodyId long, upstream_type string, upstream_instance string, downstream_bodyId long, downstream_type string, downstream_instance string, weight long"
#: Of each kind: the pattern, the expression of each column, the keys that pages go by, and the schema.
KINDS = {
    "neurons": ("(n:Neuron)", {c: f"n.{c}" for c in ("bodyId", "type", "instance", "status", "cropped", "size")}, ("bodyId",), NEURON),
    "connections": (
        "(up:Neuron)-[w:ConnectsTo]->(down:Neuron)",
        {f"{side}stream_{c}": f"{side}.{c}" for side in ("up", "down") for c in ("bodyId", "type", "instance")} | {"weight": "w.weight"},
        ("upstream_bodyId", "downstream_bodyId"),
        CONNECTION,
    ),
}


class ServiceError(RuntimeError):
    pass


def call(url: str, body: dict | None, token: str, wait: float = 0.5, timeout: float = 120) -> bytes:
    """The answer to a request; services that are busy or away are asked again, after twice the wait each time."""
    data = None if body is None else json.dumps(body).encode()
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {token}"}
    for k in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as r:  # noqa: S310
                return r.read()
        except urllib.error.HTTPError as e:
            text = e.read()[:300].decode("utf-8", "replace")
            if e.code not in BUSY or k == TRIES - 1:
                raise ServiceError(f"{url.split('?')[0]}: {e.code} {text}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if k == TRIES - 1:
                raise ServiceError(f"{url.split('?')[0]}: {e}") from None
        time.sleep(wait * 2**k)
    raise AssertionError


def quoted(value: object) -> str:
    """A literal of a Cypher statement."""
    return json.dumps(value, ensure_ascii=False)


def _base(server: str) -> str:
    return (server if "://" in server else f"https://{server}").rstrip("/")


class Chunk(InputPartition):
    """Part of an answer: ``within`` has the ids of this part by column; ``turn`` of ``turns`` parts are told apart by the first key."""

    def __init__(self, within: dict[str, list], turn: int = 0, turns: int = 1):
        self.within, self.turn, self.turns = within, turn, turns


class ServiceReader(DataSourceReader):
    """What both services share: pushed filters, chunks of ids, options."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options = {k.lower(): v for k, v in dict(options).items()}
        self.wanted = schema
        self.equal: dict[str, object] = {}
        self.within: dict[str, list] = {}
        self.other: list[tuple[str, str, object]] = []
        self.known = set(schema.fieldNames())

    def option(self, name: str, default: str = "") -> str:
        return self.options.get(name.lower()) or default

    def takes(self, f: Filter) -> bool:
        """Notes a filter for the request; False leaves it to Spark."""
        column = ".".join(getattr(f, "attribute", ()))
        if column not in self.known:
            return False
        if isinstance(f, EqualTo) and f.value is not None and column not in self.equal:
            self.equal[column] = f.value
        elif isinstance(f, In) and None not in f.value and column not in self.within:
            self.within[column] = list(dict.fromkeys(f.value))
        else:
            return self.more(f, column)
        return True

    def more(self, f: Filter, column: str) -> bool:
        return False

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.takes(f):
                yield f

    def partitions(self) -> list[Chunk]:
        size = int(self.option("chunk", str(CHUNK)))
        if not self.within:
            turns = int(self.option("partitions", "1"))
            return [Chunk({}, k, turns) for k in range(turns)]
        longest = max(self.within, key=lambda c: len(self.within[c]))
        ids = self.within[longest]
        return [Chunk({**self.within, longest: ids[k : k + size]}) for k in range(0, len(ids), size)]


class GraphReader(ServiceReader):
    def more(self, f: Filter, column: str) -> bool:
        for kind, sign in ((GreaterThanOrEqual, ">="), (LessThanOrEqual, "<="), (StringContains, "CONTAINS")):
            if isinstance(f, kind):
                self.other.append((column, sign, f.value))
                return True
        if isinstance(f, IsNotNull):
            self.other.append((column, "IS NOT NULL", None))
            return True
        return False

    def statement(self, part: Chunk, after: tuple | None) -> str:
        pattern, columns, keys, _ = KINDS[self.option("kind", "neurons")]
        where = [f"{columns[c]} = {quoted(v)}" for c, v in self.equal.items()]
        where += [f"{columns[c]} IN {quoted(v)}" for c, v in part.within.items()]
        where += [f"{columns[c]} {sign}" + ("" if v is None else f" {quoted(v)}") for c, sign, v in self.other]
        for c in ("type", "instance"):
            if c in columns and self.option(f"{c}_contains"):
                where.append(f"toLower({columns[c]}) CONTAINS {quoted(self.option(f'{c}_contains').lower())}")
        if part.turns > 1:
            where.append(f"{columns[keys[0]]} % {part.turns} = {part.turn}")
        if after is not None:
            # the keys after the last page's, in order
            steps = [" AND ".join([*(f"{columns[k]} = {quoted(x)}" for k, x in zip(keys[:n], after, strict=False)), f"{columns[keys[n]]} > {quoted(after[n])}"]) for n in range(len(keys))]
            where.append("(" + " OR ".join(f"({s})" for s in steps) + ")" if len(steps) > 1 else steps[0])
        clause = f" WHERE {' AND '.join(where)}" if where else ""
        order = ", ".join(columns[k] for k in keys)
        return f"MATCH {pattern}{clause} RETURN {', '.join(f'{x} AS {c}' for c, x in columns.items())} ORDER BY {order} LIMIT {self.option('page', str(PAGE))}"

    def ask(self, text: str) -> tuple[list[str], list[list]]:
        body = json.loads(call(_base(self.option("server", GRAPH_SERVER)) + "/api/custom/custom", {"cypher": text, "dataset": self.option("dataset", GRAPH_DATASET)}, self.option("token"), float(self.option("wait", "0.5"))))
        return body["columns"], body["data"]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.wanted)
        if self.option("query"):
            names, rows = self.ask(self.option("query"))
            yield _batch(names, rows, shape)
            return
        keys, after = KINDS[self.option("kind", "neurons")][2], None
        while True:
            names, rows = self.ask(self.statement(partition, after))
            if rows:
                yield _batch(names, rows, shape)
            if len(rows) < int(self.option("page", str(PAGE))):
                return
            after = tuple(rows[-1][names.index(k)] for k in keys)


def _batch(names: list[str], rows: list[list], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=shape)


class GraphService(DataSource):
    """Options: kind (neurons or connections) or query, server, dataset, token, page, chunk, partitions, type_contains, instance_contains."""

    @classmethod
    def name(cls) -> str:
        return "graph_service"

    def schema(self) -> str | T.StructType:
        if not self.options.get("query"):
            return KINDS[self.options.get("kind", "neurons")][3]
        names, rows = GraphReader(self.options, T.StructType()).ask(self.options["query"])
        return from_arrow_schema(pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[:1000]], schema=None if rows else pa.schema([(n, pa.string()) for n in names])).schema)

    def reader(self, schema: T.StructType) -> GraphReader:
        return GraphReader(self.options, schema)


class TableReader(ServiceReader):
    def url(self) -> str:
        stack, version = self.option("datastack", TABLE_STACK), self.option("version")
        return f"{_base(self.option('server', TABLE_SERVER))}/materialize/api/v3/datastack/{stack}/version/{version}/query?return_pyarrow=true&arrow_format=true"

    def ask(self, within: dict[str, list], offset: int, limit: int) -> pa.Table:
        table = self.option("table")
        body = {"table": table, "filter_equal_dict": {table: self.equal} if self.equal else None, "filter_in_dict": {table: within} if within else None, "select_columns": self.option("columns").split(",") if self.option("columns") else None, "offset": offset, "limit": limit}
        got = call(self.url(), {k: v for k, v in body.items() if v is not None}, self.option("token"), float(self.option("wait", "0.5")))
        with pa.ipc.open_stream(io.BytesIO(got)) as stream:
            return stream.read_all()

    def partitions(self) -> list[Chunk]:
        found = super().partitions()
        return found[:1] if not self.within else found  # without ids there is nothing that tells parts apart

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        shape, page, offset = to_arrow_schema(self.wanted), int(self.option("page", str(PAGE))), 0
        most = int(self.option("limit", "0"))
        while True:
            size = min(page, most - offset) if most else page
            t = self.ask(partition.within, offset, size)
            yield from t.select(shape.names).cast(shape).to_batches()
            offset += t.num_rows
            if t.num_rows < size or offset == most:
                return


class TableService(DataSource):
    """Options: table, server, datastack, version, token, columns, page, chunk, limit (of each part)."""

    @classmethod
    def name(cls) -> str:
        return "table_service"

    def schema(self) -> T.StructType:
        return from_arrow_schema(TableReader(self.options, T.StructType()).ask({}, 0, 1).schema)

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets filters reach them."""
    spark.dataSource.register(GraphService)
    spark.dataSource.register(TableService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def graph(spark: SparkSession, kind: str = "neurons", **options: str) -> DataFrame:
    """Neurons or connections of the graph service that the environment names, or the rows of ``query``."""
    register(spark)
    token = options.pop("token", None) or setting(*GRAPH_TOKENS, required=True)
    given = {"server": setting("NEUPRINT_SERVER") or GRAPH_SERVER, "dataset": setting("NEUPRINT_DATASET") or GRAPH_DATASET, "kind": kind, "token": token, **options}
    return spark.read.format("graph_service").options(**given).load()


def _table_settings(options: dict) -> dict:
    token = options.pop("token", None) or setting(*TABLE_TOKENS, required=True)
    return {"server": setting("CAVE_SERVER") or TABLE_SERVER, "datastack": setting("FLYWIRE_DATASTACK") or TABLE_STACK, "token": token, **options}


def _version(given: dict) -> str:
    """The release asked for, the one of the environment, or the newest."""
    if given.get("version"):
        return str(given["version"])
    if setting("CAVE_MATERIALIZATION_VERSION"):
        return setting("CAVE_MATERIALIZATION_VERSION")
    return str(max(json.loads(call(f"{_base(given['server'])}/materialize/api/v2/datastack/{given['datastack']}/versions", None, given["token"]))))


def table(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """A table of the table service that the environment names."""
    register(spark)
    given = _table_settings(options)
    return spark.read.format("table_service").options(**{**given, "version": _version(given), "table": name}).load()


def table_names(**options: str) -> list[str]:
    given = _table_settings(options)
    return sorted(json.loads(call(f"{_base(given['server'])}/materialize/api/v2/datastack/{given['datastack']}/version/{_version(given)}/tables", None, given["token"])))


def by_ids(ids: DataFrame, source: DataFrame, column: str, table: str, chunk: int = CHUNK, **options: str) -> DataFrame:
    """The rows of a service's table for each id of the one column of ``ids``, with the schema of ``source``.

    The ids stay where they are: every task asks for its own, ``chunk`` at a
    time, so that no list of them is on the driver.
    """
    given = _table_settings(options)
    given = {**given, "version": _version(given), "table": table}
    shape = source.schema

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TableReader(given, shape)
        for b in batches:
            values = b.column(0).drop_null().to_pylist()
            for k in range(0, len(values), chunk):
                yield from reader.read(Chunk({column: values[k : k + chunk]}))

    return ids.distinct().mapInArrow(fetch, shape)


def limited(text: str, limit: int | None) -> str:
    """A statement with the limit, unless it has one."""
    return text if limit is None or re.search(r"\slimit\s", text, re.I) else f"{text.rstrip()} LIMIT {limit}"
