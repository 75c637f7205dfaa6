"""Readers over files of several kinds, encodings and sizes."""

from __future__ import annotations

import json

from corpusloom.sources import files as S


def test_lines_keep_their_numbers(spark, tmp_path):
    """Files larger than a split: each line's number in its file, bad and blank lines counted."""
    wanted = {}
    for name, n in (("a", 3000), ("b", 2), ("c", 0)):
        lines = ["" if i % 10 == 3 else "{bad" if i % 10 == 5 else json.dumps({"x": i, "t": "y" * (i % 50)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
        wanted |= {(name, i + 1): (None if x == "{bad" else i, x if x == "{bad" else None) for i, x in enumerate(lines) if x}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = S.read_jsonl_reported(spark, str(tmp_path), "x long, t string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.file[-7], r.line): (r.row.x if r.row else None, r.raw) for r in rows} == wanted and len(rows) == len(wanted)


def test_arrays_and_lines_are_told_apart(spark, tmp_path):
    (tmp_path / "array.json").write_text("\n  [\n" + ",\n".join(json.dumps({"x": i, "t": "[é"}) for i in range(500)) + "\n]\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "lines.json").write_text("\n\n" + "\n".join(json.dumps({"x": 1000 + i, "t": "l"}) for i in range(500)) + "\nbad\n")
    rows = S.read_json_rows(spark, str(tmp_path), "x long, t string").collect()
    assert sorted((r.x is None, r.x or 0) for r in rows) == [(False, i) for i in [*range(500), *range(1000, 1500)]] + [(True, 0)]
    assert {r.t for r in rows if r.x is not None and r.x < 500} == {"[é"}


def test_encodings_are_told_by_all_lines(spark, tmp_path):
    long = "é" * 300
    (tmp_path / "u.json").write_bytes("\n".join([f"{i} {long}" for i in range(200)]).encode())
    (tmp_path / "l.json").write_bytes("\n".join(["plain"] * 200 + [f"{long} à"]).encode("latin-1"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_bytes(b"\n \nx\r\n")
    (tmp_path / "no.txt").write_text("not read")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = [(r.file.rsplit("/", 1)[1], r.line) for r in S.read_decoded(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == sorted([*(("u.json", f"{i} {long}") for i in range(200)), *[("l.json", "plain")] * 200, ("l.json", f"{long} à"), ("b.json", "x\r")])
