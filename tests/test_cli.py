import json

from quire import cli

PAGE = b"<html><head><title>T</title></head><body><h1>Top</h1><p>some words</p><h3>Deep</h3></body></html>"


def test_commands(spark, tmp_path, capsys):
    a, b = tmp_path / "a.html", tmp_path / "b.html"
    a.write_bytes(PAGE)
    b.write_bytes(PAGE.replace(b"words", b"wordy"))
    run = lambda *x: (cli.main(list(x), spark), capsys.readouterr().out)
    assert run("text", str(a))[1].startswith("T")
    code, out = run("--json", "structure", str(a))
    assert code == 0 and [json.loads(x)["type"] for x in out.splitlines()] == ["heading", "paragraph", "heading"]
    assert "# Top" in run("markdown", str(a))[1]
    assert run("search", str(a), "words")[0] == 0 and run("search", str(a), "nothing")[0] == 1
    assert "changed" in run("diff", str(a), str(b))[1]
    assert "heading.skip" in run("validate", str(a))[1]
    assert run("convert", str(a), str(tmp_path / "c.docx"))[0] == 0 and (tmp_path / "c.docx").stat().st_size
    assert run("text", str(tmp_path / "none.html"))[0] == 1 and run("nonsense")[0] == 1
    (tmp_path / "bad.pdf").write_bytes(b"x")
    assert run("text", str(tmp_path / "bad.pdf"))[0] == 2
    (tmp_path / "p.json").write_text(json.dumps({"input": str(a), "steps": [{"type": "to_markdown"}, {"type": "save", "path": str(tmp_path / "{stem}.md")}]}))
    assert run("run", str(tmp_path / "p.json"))[0] == 0 and "some words" in (tmp_path / "a.md").read_text()


def test_pdf_commands(spark, tmp_path, capsys):
    from quire.sources import pdf
    from tests.test_pdfedit import book, texts

    a, b = tmp_path / "a.pdf", tmp_path / "b.pdf"
    a.write_bytes(book("a", catalog=b"/AcroForm << /Fields [11 0 R] >>", more=[b"<< /T (x) /FT /Tx >>"]))
    b.write_bytes(book("b", 2))
    run = lambda *x: cli.main([str(v) for v in x], spark)
    to = tmp_path / "out" / "{stem}.pdf"
    got = lambda n: texts((tmp_path / "out" / n).read_bytes())
    assert run("merge", tmp_path / "*.pdf", tmp_path / "out" / "all.pdf") == 0 and len(got("all.pdf")) == 5
    assert run("split", a, tmp_path / "out" / "s{part}.pdf", "1,2-3") == 0 and [len(got("s1.pdf")), len(got("s2.pdf"))] == [1, 2]
    assert run("reorder", a, to, "3,1") == 0 and [t[:8] for t in got("a.pdf")] == ["a page 3", "a page 1"]
    assert run("delete", a, to, "1-2") == 0 and [t[:8] for t in got("a.pdf")] == ["a page 3"]
    assert run("rotate", a, to, 90, "--pages", "2") == 0 and [p["rotation"] for p in pdf.read((tmp_path / "out" / "a.pdf").read_bytes())["pages"]] == [0, 90, 0]
    assert run("watermark", a, to, "DRAFT") == 0 and all("DRAFT" in t for t in got("a.pdf"))
    assert run("stamp", a, to, b, "--pages", "1") == 0
    assert run("redact", a, to, "secret") == 0 and not any("secret" in t for t in got("a.pdf"))
    assert run("sanitize", a, to) == 0 and run("optimize", a, to, "--strip-metadata") == 0 and run("archive", a, to) == 0
    assert run("fill", a, to, "x=new") == 0 and pdf.read((tmp_path / "out" / "a.pdf").read_bytes())["fields"][0]["value"] == "new"
    assert run("encrypt", a, to, "pw", "--algorithm", "aes256") == 0 and len(texts((tmp_path / "out" / "a.pdf").read_bytes(), password="pw")) == 3
    from quire.sources import sign

    key, cert = sign.identity("me")
    (tmp_path / "k").write_bytes(key)
    (tmp_path / "c").write_bytes(cert)
    assert run("verify", a) == 1 and run("sign", a, to, tmp_path / "k", tmp_path / "c") == 0
    capsys.readouterr()
    assert run("--json", "verify", tmp_path / "out" / "a.pdf") == 0 and '"integrity_ok": true' in capsys.readouterr().out
    assert run("reorder", a, to, "9") == 2 and run("delete", a, to, "x") == 1
    capsys.readouterr()
    assert run("validate", a, "--standard", "pdf_ua") == 0 and "ua.tab_order" in capsys.readouterr().out
    assert run("form", a) == 0 and "x" in capsys.readouterr().out
    assert run("toc", a) == 0
    assert run("render", a, tmp_path / "out" / "{stem}-{page}.png", "--dpi", "20", "--pages", "1,3") == 0 and sorted(p.name for p in (tmp_path / "out").glob("*.png")) == ["a-1.png", "a-3.png"]
