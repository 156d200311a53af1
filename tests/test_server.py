import io
import json
import threading
import urllib.request

import pytest

from lodestone.api import Tools
from lodestone.config import Config, Index
from lodestone.server import NAMES, Server


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    return Server(Tools(spark, Config(index=Index(index_path=str(tmp_path_factory.mktemp("idx"))))))


def asked(method, id_=1, **params):
    return {"jsonrpc": "2.0", "id": id_, "method": method, "params": params}


def test_protocol(server):
    assert server.answer(asked("initialize"))["result"]["serverInfo"]["name"] == "lodestone"
    tools = server.answer(asked("tools/list"))["result"]["tools"]
    assert [t["name"] for t in tools] == list(NAMES) and len(NAMES) == 17
    form = next(t for t in tools if t["name"] == "search_code")["inputSchema"]
    assert form["required"] == ["query"] and form["properties"]["top_k"] == {"type": "integer", "default": 10}
    assert server.answer({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    assert server.answer(asked("nothing"))["error"]["code"] == -32601 and server.answer({"id": 1})["error"]["code"] == -32600 and json.loads(server.answered("{"))["error"]["code"] == -32700
    assert server.answer(asked("tools/call", name="none"))["error"]["code"] == -32602
    assert server.answer(asked("tools/call", name="search_code", arguments={"words": 1}))["error"]["code"] == -32602


def test_calls(server, tmp_path):
    (tmp_path / "pyproject.toml").write_text("[project]\n")
    (tmp_path / "a.py").write_text("def one():\n    return 1\n")
    call = lambda name, **arguments: server.answer(asked("tools/call", name=name, arguments=arguments))["result"]
    done = call("index_project", directory=str(tmp_path), format="json")
    ws = json.loads(done["content"][0]["text"])["workspace_id"]
    assert not done["isError"] and "one" in call("get_function_details", symbol_name="one", workspace_id=ws)["content"][0]["text"]
    assert call("get_function_details", symbol_name="two", workspace_id=ws)["isError"] and call("index_project", directory="/no/such")["isError"]


def test_transports(server):
    out = io.StringIO()
    server.over_lines(io.StringIO("\n".join(map(json.dumps, [asked("ping", 7), {"jsonrpc": "2.0", "method": "x"}, [asked("ping", 8)]])) + "\n\n"), out)
    assert [json.loads(x) for x in out.getvalue().splitlines()] == [{"jsonrpc": "2.0", "id": 7, "result": {}}, [{"jsonrpc": "2.0", "id": 8, "result": {}}]]
    http = server.over_http("127.0.0.1", 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        post = lambda x: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}/", json.dumps(x).encode()), timeout=20)
        assert json.loads(post(asked("ping", 9)).read()) == {"jsonrpc": "2.0", "id": 9, "result": {}} and post({"jsonrpc": "2.0", "method": "x"}).status == 202
    finally:
        http.shutdown()
