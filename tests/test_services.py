"""Both live services against a server of this machine that answers by their protocols."""

import io
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonspark import cli
from axonspark.operators import live
from axonspark.sources import services

NEURONS = [(k, None if k % 11 == 0 else f"{'ORN' if k % 3 else 'DM'}_{k % 7}", f'i"{k}', "Traced", k % 2 == 0, k * 10) for k in range(1, 401)]
EDGES = [(a, b, (a * b) % 50) for a in range(1, 41) for b in range(1, 41) if (a + b) % 4 == 0]
SYNAPSES = pa.table({"id": list(range(3000)), "pre_pt_root_id": [k % 500 for k in range(3000)], "post_pt_root_id": [k % 7 for k in range(3000)], "score": [k / 2 for k in range(3000)]})


class Stub(BaseHTTPRequestHandler):
    asked: list = []
    refuse: list = []

    def log_message(self, *_):
        pass

    def _send(self, body: bytes, code: int = 200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self._send(json.dumps([3, 783] if self.path.endswith("/versions") else ["synapses_nt_v1", "nuclei"]).encode())

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.headers["Authorization"] != "Bearer sesame":
            return self._send(b"who?", 401)
        if Stub.refuse:
            return self._send(b"later", Stub.refuse.pop())
        Stub.asked.append((self.path, body))
        if self.path == "/api/custom/custom":
            return self._send(json.dumps(self.graph(body["cypher"])).encode())
        t = body["table"]
        rows = SYNAPSES.to_pylist()
        for c, v in body.get("filter_equal_dict", {}).get(t, {}).items():
            rows = [r for r in rows if r[c] == v]
        for c, v in body.get("filter_in_dict", {}).get(t, {}).items():
            rows = [r for r in rows if r[c] in set(v)]
        rows = rows[body["offset"] : body["offset"] + body["limit"]]
        out = pa.Table.from_pylist(rows, SYNAPSES.schema).select(body.get("select_columns") or SYNAPSES.column_names)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, out.schema) as w:
            w.write_table(out)
        self._send(sink.getvalue())

    def graph(self, text):
        if "RETURN 1" in text:
            return {"columns": ["one", "name"], "data": [[1, "x"], [2, None]]}
        hops = "ConnectsTo" in text
        if hops:
            names = [c.strip() for c in services.CONNECTION.replace(" long", "").replace(" string", "").split(",")]
            rows = [(a, NEURONS[a - 1][1], NEURONS[a - 1][2], b, NEURONS[b - 1][1], NEURONS[b - 1][2], w) for a, b, w in EDGES]
        else:
            names, rows = ["bodyId", "type", "instance", "status", "cropped", "size"], NEURONS
        of = {"n." + c: c for c in names} if not hops else {f"{s}.{c}": f"{s}stream_{c}" for s in ("up", "down") for c in ("bodyId", "type", "instance")} | {"w.weight": "weight"}
        got = [dict(zip(names, r, strict=True)) for r in rows]
        where = re.search(r"WHERE (.*) RETURN", text)
        where = where[1] if where else ""
        after = re.search(r"\(\((\S+) > (\d+)\) OR \(\1 = \2 AND (\S+) > (\d+)\)\)", where)
        if after:
            got = [r for r in got if (r[of[after[1]]], r[of[after[3]]]) > (int(after[2]), int(after[4]))]
            where = where.replace(after[0], "TRUE")
        for part in where.split(" AND ") if where else ():
            if m := re.fullmatch(r"(\S+) IN (\[.*\])", part):
                got = [r for r in got if r[of[m[1]]] in json.loads(m[2])]
            elif m := re.fullmatch(r"toLower\((\S+)\) CONTAINS (.*)", part):
                got = [r for r in got if json.loads(m[2]) in (r[of[m[1]]] or "").lower()]
            elif m := re.fullmatch(r"(\S+) % (\d+) = (\d+)", part):
                got = [r for r in got if r[of[m[1]]] % int(m[2]) == int(m[3])]
            elif m := re.fullmatch(r"(\S+) IS NOT NULL", part):
                got = [r for r in got if r[of[m[1]]] is not None]
            elif m := re.fullmatch(r"(\S+) (=|>=|<=|>|CONTAINS) (.*)", part):
                test = {"=": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "CONTAINS": lambda a, b: b in (a or "")}[m[2]]
                got = [r for r in got if r[of[m[1]]] is not None and test(r[of[m[1]]], json.loads(m[3]))]
            else:
                assert part == "TRUE", part
        got.sort(key=lambda r: (r[names[0]], r["downstream_bodyId"] if hops else 0))
        limit = re.search(r"LIMIT (\d+)", text)
        return {"columns": names, "data": [list(r.values()) for r in got[: int(limit[1])]]}


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.fixture
def asked():
    Stub.asked.clear()
    return Stub.asked


def test_filters_and_chunks_reach_the_request(spark, server, asked):
    ids = list(range(2, 380, 3))
    df = services.graph(spark, server=server, token="sesame", chunk="40", type_contains="dm").where(F.col("bodyId").isin(ids) & (F.col("size") >= 100) & (F.col("status") == "Traced"))
    got = {tuple(r) for r in live.neurons(df, limit=None).collect()}
    assert got == {n for n in NEURONS if n[0] in ids and n[5] >= 100 and "dm" in (n[1] or "").lower()}
    sent = [json.loads(re.search(r"IN (\[[^]]*\])", b["cypher"])[1]) for _, b in asked]
    assert len(sent) == 4 and max(map(len, sent)) == 40 and sorted(sum(sent, [])) == ids
    assert all('n.status = "Traced"' in b["cypher"] and "n.size >= 100" in b["cypher"] and 'CONTAINS "dm"' in b["cypher"] for _, b in asked)


def test_pages_and_parts(spark, server, asked):
    df = services.graph(spark, server=server, token="sesame", page="30", partitions="3")
    assert df.rdd.getNumPartitions() == 3
    asked.clear()
    assert {tuple(r) for r in df.collect()} == set(NEURONS) and len(asked) >= 15
    hops = services.graph(spark, "connections", server=server, token="sesame", page="17")
    got = live.hops(hops, upstream=list(range(1, 30)), min_weight=5, limit=None)
    assert {(r.upstream_bodyId, r.downstream_bodyId, r.weight) for r in got.collect()} == {(a, b, w) for a, b, w in EDGES if a < 30 and w >= 5}
    top = live.hops(hops, min_weight=1, limit=5).collect()
    assert [r.weight for r in top] == sorted((w for *_, w in EDGES), reverse=True)[:5]
    assert [tuple(r) for r in services.graph(spark, query="MATCH (n) RETURN 1", server=server, token="sesame").collect()] == [(1, "x"), (2, None)]


def test_tables(spark, server, asked):
    df = services.table(spark, "synapses_nt_v1", server=server, token="sesame", page="70", chunk="50")
    want = [r for r in SYNAPSES.to_pylist() if r["pre_pt_root_id"] < 120 and r["post_pt_root_id"] == 3]
    got = df.where(F.col("pre_pt_root_id").isin(list(range(120))) & (F.col("post_pt_root_id") == 3)).collect()
    assert sorted(r.id for r in got) == [r["id"] for r in want]
    sent = [b for p, b in asked if "/version/783/" in p and "filter_in_dict" in b]
    assert {len(b["filter_in_dict"]["synapses_nt_v1"]["pre_pt_root_id"]) for b in sent} == {50, 20} and all(b["filter_equal_dict"] == {"synapses_nt_v1": {"post_pt_root_id": 3}} for b in sent)
    assert services.table_names(server=server, token="sesame") == ["nuclei", "synapses_nt_v1"]
    ids = spark.range(0, 500, 2, 3).toDF("pre_pt_root_id")
    fetched = services.by_ids(ids, df, "pre_pt_root_id", "synapses_nt_v1", chunk=60, server=server, token="sesame", page="100")
    assert sorted(r.id for r in fetched.collect()) == [r["id"] for r in SYNAPSES.to_pylist() if r["pre_pt_root_id"] % 2 == 0]


def test_busy_services_are_asked_again(server):
    Stub.refuse[:] = [503, 429]
    reader = services.GraphReader({"server": server, "token": "sesame", "wait": "0.01"}, T.StructType())
    assert reader.ask("MATCH (n) RETURN 1")[1] == [[1, "x"], [2, None]] and not Stub.refuse
    Stub.refuse[:] = [503] * services.TRIES
    with pytest.raises(services.ServiceError, match="503"):
        services.call(f"{server}/api/custom/custom", {"cypher": "", "dataset": ""}, "sesame", 0.001)
    with pytest.raises(services.ServiceError, match="401 who"):
        services.call(f"{server}/api/custom/custom", {}, "wrong", 0.001)


def test_command_line(spark, server, asked, monkeypatch, capsys):
    monkeypatch.setenv("NEUPRINT_TOKEN", "sesame")
    monkeypatch.setenv("NEUPRINT_SERVER", server)
    monkeypatch.setenv("CAVE_TOKEN", "sesame")
    monkeypatch.setenv("CAVE_SERVER", server)
    run = lambda *words: cli.main(["--env-file", "", *words, "--format", "jsonl"])
    assert run("live", "hemibrain", "neurons", "--body-id", "4", "--body-id", "6") == 0
    assert [json.loads(x)["bodyId"] for x in capsys.readouterr().out.splitlines()] == ["6", "4"]
    assert run("live", "flywire", "synapses", "--pre-root-id", "5", "--limit", "2") == 0
    assert len(capsys.readouterr().out.splitlines()) == 2 and asked[-1][1]["limit"] == 2
    assert run("live", "flywire", "tables") == 0 and "nuclei" in capsys.readouterr().out
    assert run("live", "hemibrain", "cypher", "--query", "MATCH (n) RETURN 1", "--limit", "2") == 0 and "LIMIT 2" in asked[-1][1]["cypher"]
