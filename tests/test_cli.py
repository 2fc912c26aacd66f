from __future__ import annotations

import json

from millrace import cli


def write(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_gates_and_reports(spark, tmp_path, capsys):
    pairs = write(tmp_path / "p.jsonl", [{"ko": f"안녕하세요 여러분 {i}번", "ja": f"みなさんこんにちは{i}番です"} for i in range(12)])
    assert cli.main(["audit-data", pairs]) == 0
    assert '"pass_rate": 1.0' in capsys.readouterr().out
    out = str(tmp_path / "out")
    assert cli.main(["prepare-data", pairs, "--out", out, "--validation", "0.2", "--test", "0.2"]) == 0
    assert spark.read.parquet(out).count() > 0
    assert cli.main(["audit-templates", pairs]) == 1  # one frame only
    good = write(tmp_path / "g.jsonl", [{"source": "5 kg", "translation": "5 kg"}])
    bad = write(tmp_path / "b.jsonl", [{"source": "5 kg", "translation": "6 kg"}])
    none = write(tmp_path / "n.jsonl", [{}])
    assert [cli.main(["check-preservation", f]) for f in (good, bad, none)] == [0, 1, 2]
    case = {"id": "1", "source_language": "ko", "target_language": "ja", "source": "안녕하세요 여러분 3번", "reference": "全然違う文です", "category": "x"}
    cases = write(tmp_path / "c.jsonl", [case])
    assert cli.main(["audit-holdout", pairs, "--cases", cases]) == 1
    assert cli.main(["audit-holdout", pairs, "--cases", cases, "--allow-leaks"]) == 0
    ok = write(tmp_path / "s.jsonl", [{"id": "1", "translation": "全然違う文です"}])
    assert cli.main(["compare", "--cases", cases, ok]) == 0
    assert "| ko-ja | 1 | 100.0 |" in capsys.readouterr().out
    assert cli.main(["compare", "--cases", cases, write(tmp_path / "x.jsonl", [{"id": "2", "translation": "a"}])]) == 2
