import io
import json

from quillmeter import cli


def run(capsys, *argv):
    code = cli.main([*argv, "--json"])
    return code, json.loads(capsys.readouterr().out)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    f = tmp_path / "m.py"
    f.write_text('def refresh(token):\n    """Renew."""\n    return token\n\n\nclass A:\n    def go(self):\n        return 1\n')
    assert run(capsys, "count", str(f))[1][0]["lines"] == 8
    assert run(capsys, "trim", str(f), "--budget", "10")[1][0]["truncated"]
    assert run(capsys, "headroom", "--spend", "a=100000", "--lane", "x:1:10:20")[1][0]["pressure"] == "warm"
    assert "def refresh" in run(capsys, "skeleton", str(f))[1][0]["skeleton"]
    assert run(capsys, "symbol", str(f), "A.go")[1][0]["start"] == 7
    assert len(run(capsys, "outline", str(f))[1]) == 3
    assert run(capsys, "chunk", str(f))[1][0]["symbol"] == "refresh"
    assert run(capsys, "search", "refresh token", "--root", str(tmp_path))[1][0]["symbol"] == "refresh"
    assert run(capsys, "pack", "refresh", "--root", str(tmp_path), "--no-cache")[1][0]["used"] <= 6000
    assert run(capsys, "pack", "--files", str(f))[1][0]["files"] == 1
    monkeypatch.setattr("sys.stdin", io.StringIO('{"tool": "Read", "input": {"file_path": "a.py"}}'))
    assert run(capsys, "hook", "--root", "/w")[1][0] == {"payload": '{"tool": "Read", "input": {"file_path": "a.py"}}', "tool": "Read", "route": "read", "path": "/w/a.py", "query": None, "used": None}
    assert run(capsys, "stats", "--root", str(tmp_path)) == (1, [])
    assert cli.main(["forget", "--root", str(tmp_path)]) == 0
