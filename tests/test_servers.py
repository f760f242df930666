"""The model-context server and the coroutines."""

import asyncio
import json

import pytest

from quire import aio, mcp
from tests.test_pdfedit import book


def test_tools(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>Top</h1><p>some words</p><table><tr><td>k</td><td>v</td></tr></table>")
    (tmp_path / "b.html").write_text("<h1>Top</h1><p>other words</p>")
    (tmp_path / "c.pdf").write_bytes(book("c"))
    server = mcp.Server(spark, str(tmp_path))

    def call(name, **a):
        r = server.answer({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
        return r["content"][0]["text"] if r["isError"] else json.loads(r["content"][0]["text"])

    names = {t["name"] for t in server.answer({"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert len(names) == 26 and server.answer({"method": "notifications/initialized"}) is None
    assert server.answer({"id": 2, "method": "initialize"})["result"]["serverInfo"]["name"] == "quire"
    assert server.answer({"id": 3, "method": "no"})["error"]["code"] == -32601
    one, two = call("open", path="a.html")["session"], call("open", path="b.html")["session"]
    assert "| k   | v   |" in call("markdown", session=one)["rows"][0]["markdown"]
    assert [r["type"] for r in call("structure", session=one)["rows"]] == ["heading", "paragraph", "table"]
    assert call("search", session=one, query="some")["rows"] and not call("search", session=one, query="none")["rows"]
    assert {r["kind"] for r in call("diff", session=one, other=two)["rows"]} == {"changed", "removed"} or call("diff", session=one, other=two)["rows"]
    assert call("convert", session=one, format="docx", output="x/a.docx")["output"].endswith("a.docx") and (tmp_path / "x" / "a.docx").stat().st_size
    assert call("merge", paths=["c.pdf", "c.pdf"], output="d.pdf") and call("open", path="d.pdf")["files"]["rows"][0]["page_count"] == 6
    assert call("redact", path="c.pdf", output="e.pdf", pattern="secret")["also"] == 3
    assert any(r["rule"] == "ua.tab_order" for r in call("validate", path="c.pdf", standard="pdf_ua")["rows"])
    assert "outside" in call("open", path="../x") and "needs" in call("open") and "no tool" in call("zzz") and "no session" in call("text", session="q")
    assert call("close", session=one)["closed"] and "no session" in call("text", session=one)


def test_sessions_expire():
    now = [0.0]
    s = mcp.Sessions(most=2, ttl=10, clock=lambda: now[0])
    a, b = s.add(None, "a"), s.add(None, "b")
    s.get(a)
    c = s.add(None, "c")
    with pytest.raises(mcp.ToolError):
        s.get(b)
    now[0] = 9
    s.get(a)
    now[0] = 15
    assert s.get(a).path == "a"
    with pytest.raises(mcp.ToolError):
        s.get(c)


def test_coroutines(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>Top</h1>")

    async def run():
        texts, marks = await asyncio.gather(aio.texts(spark, str(tmp_path)), aio.markdown(spark, str(tmp_path)))
        docs = await aio.open_files(spark, str(tmp_path))
        await aio.save(docs.texts, str(tmp_path / "out"))
        with pytest.raises(Exception):
            await aio.texts(spark, str(tmp_path / "none"))
        slow = asyncio.ensure_future(aio.collect(spark.range(1 << 40).selectExpr("sum(id % 7)")))
        await asyncio.sleep(1)
        slow.cancel()
        with pytest.raises(asyncio.CancelledError):
            await slow
        return texts[0].text, marks[0].markdown

    assert asyncio.run(run()) == ("Top", "# Top\n")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
