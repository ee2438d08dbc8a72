"""JSON arrays cut into elements, against a whole-file parser."""

import json
import random

from sortie.sources import elements


def pieces_of(spark, files, per_block):
    """Pieces as the reader gives them, `per_block` to a block."""
    rows = []
    for name, text in files.items():
        parts = text.split(",")
        rows += [(name, k // per_block, k, p) for k, p in enumerate(parts)]
    return spark.createDataFrame(rows, "path string, block long, pos long, piece string")


def random_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 4)
    if kind == 0:
        return rng.choice(['a,b', '"quoted", [x', "\\", "\\\",]", "{", "]}", "", "é,\n\t", 'x"y"z'])
    if kind == 1:
        return rng.choice([0, -1.5, 1e20, True, None])
    if kind in (2, 3):
        return "word"
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k,", "a", '"', "[b"]) + str(i): random_value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_elements_equal_a_parser_wherever_blocks_end(spark):
    rng = random.Random(12)
    files, want = {}, {}
    for k in range(60):
        value = [random_value(rng) for _ in range(rng.randrange(9))]
        files[f"ok{k}"] = rng.choice(["", " \n"]) + json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + rng.choice(["", "\n"])
        want[f"ok{k}"] = value
    bad = {
        "open": '[1, 2', "two": "[1],[2]", "object": '{"a": [1, 2]}', "text": "call, me", "quote": '["a, 1]', "early": "[1] 2, 3]",
        "hole": "[1,,2]", "tail": "[1, 2] x", "nested": "[[1, 2], 3", "word": "[1, oops]", "close": "[1, 2]]",
    }
    for per_block in (1, 3):
        found, files_ = elements.array_elements(pieces_of(spark, files | bad, per_block))
        got = {}
        for r in found.collect():
            got.setdefault(r.path, {})[r.part] = r.text
        status = {r.path: r for r in files_.collect()}
        assert {p for p, r in status.items() if not r.well_formed} == set(bad)
        for name, value in want.items():
            parts = got.get(name, {})
            assert [json.loads(parts[i]) for i in range(len(parts))] == value and status[name].elements == len(value)
            assert status[name].bytes == len(files[name].encode())


def test_files_are_read_in_small_splits(spark, tmp_path):
    value = [{"call": f"f{i}", "args": ["a,b", [i, {"x": '"'}]]} for i in range(500)]
    (tmp_path / "i-0").mkdir()
    (tmp_path / "i-0" / "big.json").write_text(json.dumps(value))
    (tmp_path / "i-0" / "none.json").write_text("[ ]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        pieces = elements.read_pieces(spark, str(tmp_path))
        assert pieces.select("block").distinct().count() > 20
        found, files = elements.array_elements(pieces)
        texts = {r.part: json.loads(r.text) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [texts[i] for i in range(len(texts))] == value
    assert {(r.path, r.elements, r.well_formed) for r in files.collect()} == {("i-0/big.json", 500, True), ("i-0/none.json", 0, True)}
