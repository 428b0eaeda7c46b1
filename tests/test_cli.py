"""The command line: summaries, exit codes and files, with the values that the examples state."""

import json

import pytest

from segmill import cli


def jsonl(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), "utf-8")
    return str(path)


def run(spark, capsys, *argv):
    code = cli.main([*map(str, argv)], spark)
    said = capsys.readouterr()
    return code, said.out.strip(), said.err.strip()


def test_gate(spark, tmp_path, capsys):
    rows = [{"segment_id": "a", "source": "こんにちは {name}", "target": "你好 {name}"}, {"segment_id": "b", "source": "はい", "target": "是 [wait]"}, {"segment_id": "c", "source": "次", "target": ""}]
    path = jsonl(tmp_path / "c.jsonl", rows)
    report, md = tmp_path / "r.json", tmp_path / "r.md"
    code, out, _ = run(spark, capsys, "gate", path, "--encoding", "gbk", "--require-complete", "--report", report, "--markdown", md)
    assert (code, out) == (1, "gate=FAIL records=3 completed=2 pending=1 failures=2 warnings=0")
    told = json.loads(report.read_text("utf-8"))
    assert told["counts"] == {"control-token-added": 1, "empty-translation": 1} and [f["segment_id"] for f in told["findings"]] == ["b", "c"]
    assert "## Blockers" in md.read_text("utf-8") and "## Warnings" not in md.read_text("utf-8")
    assert run(spark, capsys, "gate", jsonl(tmp_path / "d.jsonl", rows[:1]))[0] == 0
    assert run(spark, capsys, "gate", tmp_path / "none.jsonl")[0] == 2
    (tmp_path / "bad.jsonl").write_text("[1]\n", "utf-8")
    code, _, err = run(spark, capsys, "gate", tmp_path / "bad.jsonl")
    assert code == 2 and err.startswith("ERROR: ") and run(spark, capsys, "gate", path, "--max-chars", "0")[0] == 2
    assert run(spark, capsys, "none")[0] == 2


def test_memory_and_review(spark, tmp_path, capsys):
    now = jsonl(tmp_path / "now.jsonl", [{"segment_id": f"s{k}", "source": s, "target": "", "kept": k} for k, s in enumerate(["扉を開けた。", "春の花が咲いた。", "夏の雨が降る。", "遠くの町まで歩いて行ったらしい。"])])
    past = jsonl(tmp_path / "p1.jsonl", [{"segment_id": "s0", "source": "扉を開けた。", "target": "打开了门。"}, {"segment_id": "x", "source": "春の花が咲いた。", "target": "春天的花开了。"}, {"segment_id": "y", "source": "遠くの町まで歩いて行ったようだ。", "target": "好像走到了远处的镇上。"}])
    fix = jsonl(tmp_path / "p2.jsonl", [{"segment_id": "z", "source": "夏の雨が降る。", "target": "下着夏天的雨。"}])
    out, report, queue, md = (tmp_path / n for n in ("o.jsonl", "r.json", "q.csv", "m.md"))
    argv = ("memory", "--current", now, "--previous", past, "--previous", fix, "--output", out, "--report", report, "--review-csv", queue, "--markdown", md, "--threshold", "0.8")
    code, said, _ = run(spark, capsys, *argv)
    assert code == 0 and json.loads(said) == {"status": "PASS", "reused_by_id": 1, "reused_by_source": 2, "suggestions": 1, "conflicts": 0, "pending": 1}
    merged = [json.loads(x) for x in out.read_text("utf-8").splitlines()]
    assert [r["target"] for r in merged] == ["打开了门。", "春天的花开了。", "下着夏天的雨。", ""] and [r["kept"] for r in merged] == [0, 1, 2, 3]
    assert len(json.loads(report.read_text("utf-8"))["details"]) == 4 and "review-suggestion" in md.read_text("utf-8")
    assert run(spark, capsys, *argv)[0] == 2  # nothing is overwritten unasked
    text = queue.read_text("utf-8-sig")
    reviewed = tmp_path / "done.csv"
    header, row = text.splitlines()
    cells = row.split(",")
    cells[10] = "好像走到了远方的镇上。"
    reviewed.write_text("﻿" + header + "\n" + ",".join(cells) + "\n", "utf-8")
    code, said, _ = run(spark, capsys, "review", "--current", now, "--review-csv", reviewed, "--dry-run")
    facts = json.loads(said)
    assert code == 0 and (facts["ready"], facts["applied"], facts["pending"], facts["catalog_records"]) == (1, 0, 0, 4)
    done = tmp_path / "done.jsonl"
    assert run(spark, capsys, "review", "--current", now, "--review-csv", reviewed, "--output", done, "--encoding", "gbk")[0] == 0
    assert [json.loads(x)["target"] for x in done.read_text("utf-8").splitlines()] == ["", "", "", cells[10]]
    assert run(spark, capsys, "review", "--current", past, "--review-csv", reviewed, "--dry-run")[0] == 2  # of another catalog
    assert run(spark, capsys, "review", "--current", now, "--review-csv", reviewed)[0] == 2


def test_audit(spark, tmp_path, capsys):
    root = tmp_path / "game"
    for name in ("startup.tjs", "scenario/scene01.ks", "data.xp3"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x\n")
    code, out, _ = run(spark, capsys, "audit", root, "--json", tmp_path / "a.json", "--markdown", tmp_path / "a.md")
    assert code == 0 and out.splitlines()[0] == "mode=read-only files=3 engine=KiriKiri candidate confidence=0.94 input_files_changed=0" and out.splitlines()[1].startswith("next=")
    told = json.loads((tmp_path / "a.json").read_text("utf-8"))
    assert told["plan"]["adapter"] == "kirikiri" and [(e["path"], e["sampled_bytes"]) for e in told["encodings"]] == [("startup.tjs", 2), ("scenario/scene01.ks", 2)] and "startup.tjs" in (tmp_path / "a.md").read_text("utf-8")
    assert run(spark, capsys, "audit", root, "--json", root / "inside.json")[0] == 2 and run(spark, capsys, "audit", tmp_path / "none")[0] == 2


@pytest.mark.parametrize("source, target, code", [("%s {a}", "{a} %s", 1), ("%s", "%s", 0), ("x", "[w]", 1)])
def test_tokens(spark, capsys, source, target, code):
    assert run(spark, capsys, "compare", "--source", source, "--target", target)[0] == code
    assert run(spark, capsys, "tokens", "--text", "hi %s %03d {name}")[1].split("\n") == ["%s", "%03d", "{name}"]
